"""Merging the layers into blocking, recommended and skipped tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.functions.expr import exact_avg
from runweave.operators import ranks
from runweave.session import materialize

#: fixed values: largest share of tests a mode may skip
SKIP_SHARE = {"shadow": 0.0, "conservative": 0.15, "standard": 0.5, "aggressive": 0.8}


def merge_layers(tests: DataFrame, graph_hits: DataFrame, bands: DataFrame, decisions: DataFrame, *, mode: str = "standard", quarantine: float = 0.3,
                 full_suite: DataFrame | None = None) -> DataFrame:
    """repo_id, test_path, bucket.

    tests(repo_id, test_path, flake_score), graph_hits(repo_id, test_path), bands(repo_id, test_path, band), decisions(repo_id, test_path,
    classification), full_suite(repo_id). Blocking are graph hits, high bands and blocking decisions, and all tests of a full-suite
    repository; recommended are recommended decisions that aren't blocking. Of the other tests the first share in path order may be
    skipped, and of these the ones above the quarantine score run after all; nothing moves up for them. A test listed twice counts twice in the share's base.
    Places in path order are taken in stretches, so that no repository is one task.
    """
    keys = ["repo_id", "test_path"]
    blocking = graph_hits.select(*keys).unionByName(bands.where("band = 'high'").select(*keys)).unionByName(decisions.where("classification = 'blocking'").select(*keys))
    if full_suite is not None:
        blocking = blocking.unionByName(tests.join(full_suite.select("repo_id").distinct(), "repo_id", "left_semi").select(*keys))
    votes = blocking.withColumn("rank", F.lit(2)).unionByName(decisions.where("classification = 'recommended'").select(*keys).withColumn("rank", F.lit(1)))
    taken = materialize(votes.groupBy(*keys).agg(F.max("rank").alias("rank")), "taken")  # the layers are read once, not once a use
    chosen = taken.select(*keys, F.when(F.col("rank") == 2, "blocking").otherwise("recommended").alias("bucket"))
    totals = tests.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"))
    if not SKIP_SHARE[mode]:
        return chosen
    free = ranks.placed(tests.select(*keys, "flake_score").join(taken, keys, "left_anti"), ["repo_id"], [F.col("test_path"), F.col("flake_score")])
    skipped = free.join(totals, "repo_id").where(F.col("place") <= F.floor(F.col("total") * F.lit(SKIP_SHARE[mode])))
    skipped = skipped.where(F.coalesce("flake_score", F.lit(0.0)) <= quarantine).select(*keys, F.lit("skip").alias("bucket"))
    return chosen.unionByName(skipped)


def selection_metrics(buckets: DataFrame, bands: DataFrame) -> DataFrame:
    """repo_id, blocking, recommended, skipped, confidence (mean score of the bands, 0 if none), minutes_saved."""
    of = lambda b: F.count_if(F.col("bucket") == b)
    counts = buckets.groupBy("repo_id").agg(of("blocking").alias("blocking"), of("recommended").alias("recommended"), of("skip").alias("skipped"))
    mean = bands.groupBy("repo_id").agg(exact_avg("score").alias("confidence"))
    return counts.join(mean, "repo_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("minutes_saved", F.col("skipped") * 0.5)


def consensus(decisions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """repo_id, test_path, classification, pass and the columns to keep: over several passes the most cautious decision, the earliest pass among equals."""
    rank = F.when(F.col("classification") == "blocking", 2).when(F.col("classification") == "recommended", 1).otherwise(0)
    best = F.max_by(F.struct("classification", "pass", *keep), F.struct(rank, -F.col("pass"), -F.col("position"))).alias("b")
    return decisions.groupBy("repo_id", "test_path").agg(best).select("repo_id", "test_path", "b.classification", "b.pass", *(f"b.{k}" for k in keep))


def pass_orders(paths: str) -> dict[str, F.Column]:
    """Three orders of an array for repeated passes: sorted, reversed, even places then odd ones."""
    asc = F.array_sort(F.col(paths))
    return {"sorted": asc, "reversed": F.reverse(asc), "interleaved": F.concat(F.filter(asc, lambda x, i: i % 2 == 0), F.filter(asc, lambda x, i: i % 2 == 1))}


def logged_tests(buckets: DataFrame) -> DataFrame:
    """repo_id, all_tests: what a new run record lists, blocking then recommended then skipped, each in path order."""
    part = lambda b: F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.col("test_path"))))
    return buckets.groupBy("repo_id").agg(F.concat(part("blocking"), part("recommended"), part("skip")).alias("all_tests"))
