"""Embedding of file contents through a pluggable provider, with a cache, and the two-tier match of a diff against test files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runweave.functions.expr import band, cosine, hamming, sign_bits
from runweave.operators import retrieval
from runweave.session import materialize

BATCH = 64
Embedder = Callable[[list[str]], list[list[float]] | None]


def hashing_embedder(dim: int) -> Embedder:
    """An offline stand-in: counts of words in ``dim`` signed buckets, the same for the same text everywhere."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * dim
            for word in text.split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                vector[h % dim] += 1.0 if h >> 63 else -1.0
            out.append(vector)
        return out

    return embed


def embed_contents(contents: DataFrame, embed: Embedder, dim: int) -> DataFrame:
    """key, vector, dim of contents(content), each distinct content once, in batches in order of content. A batch the provider fails on has no rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.sort_values("content")
            for a in range(0, len(part), BATCH):
                some = part.iloc[a : a + BATCH]
                found = embed(list(some["content"]))
                if found is not None and len(found) == len(some):
                    yield pd.DataFrame({"key": list(some["key"]), "vector": found, "dim": dim})

    distinct = contents.where(F.col("content").isNotNull()).select("content").distinct().withColumn("key", retrieval.content_key("content", dim))
    return distinct.mapInPandas(run, "key string, vector array<double>, dim int")


def embedded(contents: DataFrame, cache: DataFrame | None, embed: Embedder, dim: int) -> tuple[DataFrame, DataFrame]:
    """(contents with their vector, cache entries to add): only what the cache lacks goes to the provider. Contents without vector are left out."""
    keyed = contents.withColumn("key", retrieval.content_key("content", dim))
    if cache is None:
        new = materialize(embed_contents(contents, embed, dim), "vectors")
        return keyed.join(new.select("key", "vector"), "key"), new
    hits, misses = retrieval.cache_lookup(contents, cache, dim)
    new = materialize(embed_contents(misses, embed, dim), "vectors")
    found = hits.unionByName(misses.join(new.select("key", "vector"), "key"))
    return found, new


def match_files(files: DataFrame, diff: DataFrame, embed: Embedder, dim: int, cache: DataFrame | None = None, *, above: int = retrieval.TIER_ABOVE, n: int = retrieval.SHORTLIST) -> DataFrame:
    """path, score, band of files(path, content) against diff(content) of one row: screened by sign bits above ``above`` files. No vector of the diff, no rows."""
    own, _ = embedded(files, cache, embed, dim)
    query, _ = embedded(diff, cache, embed, dim)
    asked = query.select(F.lit("").alias("path"), "vector")
    return retrieval.tiered(own.select("path", "vector"), asked, above=above, n=n, key="path", vector="vector").select(F.col("key").alias("path"), "score", "band")


def match_repos(files: DataFrame, diffs: DataFrame, embed: Embedder, dim: int, cache: DataFrame | None = None, *, above: int = retrieval.TIER_ABOVE, n: int = retrieval.SHORTLIST) -> DataFrame:
    """repo_id, test_path, score, band of files(repo_id, path, content) against the diffs(repo_id, content) of their repositories, a diff each.

    Repositories of more than ``above`` files are screened by sign bits to the n nearest, which are then scored exactly. A diff or file without a vector has no rows.
    """
    own, _ = embedded(files, cache, embed, dim)
    asked, _ = embedded(diffs, cache, embed, dim)
    pairs = own.select("repo_id", F.col("path").alias("test_path"), "vector").join(asked.select("repo_id", F.col("vector").alias("query")), "repo_id")
    sizes = own.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_files"))
    pairs = pairs.join(sizes, "repo_id")
    near = F.row_number().over(W.partitionBy("repo_id").orderBy(hamming(sign_bits("vector"), sign_bits("query")), "test_path"))
    screened = pairs.where(F.col("_files") > above).withColumn("_near", near).where(F.col("_near") <= n).drop("_near")
    kept = pairs.where(F.col("_files") <= above).unionByName(screened)
    return kept.select("repo_id", "test_path", cosine("vector", "query").alias("score")).withColumn("band", band("score"))
