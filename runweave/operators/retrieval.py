"""Vector retrieval: exact cosine bands, a bit screen, and both in two tiers; a cache of embedded contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runweave.functions.expr import band, cosine, hamming, sign_bits

#: fixed values: corpora above this many files are screened, and this many stay
TIER_ABOVE, SHORTLIST = 200, 50


def against_queries(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, query, key, vector: every vector beside each query. No side is held to a size: Catalyst broadcasts a small one, else pairs blocks of both."""
    asked = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("query"))
    return vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).crossJoin(asked)


def _scored(pairs: DataFrame) -> DataFrame:
    return pairs.select("query_id", "key", cosine("vector", "query").alias("score")).withColumn("band", band("score"))


def cosine_bands(vectors: DataFrame, queries: DataFrame, **names: str) -> DataFrame:
    """query_id, key, score, band for every query and vector."""
    return _scored(against_queries(vectors, queries, **names))


def hamming_nearest(vectors: DataFrame, queries: DataFrame, n: int = SHORTLIST, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, distance of the n vectors whose sign bits are nearest each query's; ties by key. A task sends at most n rows a query."""
    bits = lambda df: df.select(key, sign_bits(vector).alias(vector))
    rows = against_queries(bits(vectors), bits(queries), key=key, vector=vector).select("query_id", "key", hamming("vector", "query").alias("distance"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "key"))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def cosine_nearest(vectors: DataFrame, queries: DataFrame, n: int = SHORTLIST, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, score of the n vectors of the highest cosine for each query; ties by key. The exact way beside the bit screen; a task sends at most n rows a query."""
    rows = against_queries(vectors, queries, key=key, vector=vector).select("query_id", "key", cosine("vector", "query").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "key"))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def tiered(vectors: DataFrame, queries: DataFrame, *, above: int = TIER_ABOVE, n: int = SHORTLIST, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, score, band: all vectors if there are few, else for each query the exact cosine of those its bit screen keeps."""
    if vectors.limit(above + 1).count() <= above:
        return cosine_bands(vectors, queries, key=key, vector=vector)
    short = hamming_nearest(vectors, queries, n, key=key, vector=vector).select("query_id", "key")
    asked = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("query"))
    return _scored(short.join(vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "key").join(asked, "query_id"))


def content_key(content: str, dim: int) -> F.Column:
    """Cache key of a content: its SHA-256 and the vector's length."""
    return F.concat(F.lit("sha256:"), F.sha2(F.col(content), 256), F.lit(f":dim{dim}"))


def cache_lookup(contents: DataFrame, cache: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(contents with their cached vector, contents without one); cache(key, vector, dim, model), entries of another length don't count."""
    good = cache.where((F.col("dim") == dim) & (F.size("vector") == dim)).select("key", "vector").dropDuplicates(["key"])
    keyed = contents.withColumn("key", content_key("content", dim))
    return keyed.join(good, "key"), keyed.join(good, "key", "left_anti")
