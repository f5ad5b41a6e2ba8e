"""Feature vectors of tests, for serving and for training; the two differ on purpose and keep their own names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runweave.functions.expr import items
from runweave.session import materialize

NAMES = ("embedding_similarity", "graph_distance", "failure_rate", "days_since_failure", "flakiness", "exec_time", "file_churn", "author_defect_rate")
DAY_US = 86_400_000_000


def capped(c: F.Column, most: float = 1.0) -> F.Column:
    return F.least(c, F.lit(most))


def serving_features(candidates: DataFrame, runs: DataFrame, tests: DataFrame, as_of: F.Column) -> DataFrame:
    """repo_id, test_path and the eight features of each candidate (repo_id, test_path, similarity, distance).

    Rates are over all runs of the repository; a test that never failed is a year away; ``as_of`` stands for now.
    """
    recent = (F.col("created_at") > as_of - F.expr("interval 30 days")) & (F.col("created_at") <= as_of)
    repo = runs.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(recent, F.col("pr_number"))).alias("prs"))
    failed = runs.select("repo_id", "created_at", F.explode(F.array_distinct(items("actual_failures"))).alias("test_path"))
    failed = failed.groupBy("repo_id", "test_path").agg(F.count(F.lit(1)).alias("fails"), F.max("created_at").alias("last"))
    # a test listed twice counts by its least known row
    known = tests.groupBy("repo_id", F.col("path").alias("test_path")).agg(F.min("flake_score").alias("flake"), F.min("avg_duration_ms").alias("ms"))
    days = (F.unix_micros(as_of) - F.unix_micros("last")) / F.lit(DAY_US)
    rows = candidates.join(repo, "repo_id", "left").join(failed, ["repo_id", "test_path"], "left").join(known, ["repo_id", "test_path"], "left")
    return rows.select(
        "repo_id", "test_path",
        F.coalesce("similarity", F.lit(0.0)).alias(NAMES[0]),
        F.coalesce("distance", F.lit(0.0)).alias(NAMES[1]),
        F.when(F.col("n") > 0, F.coalesce("fails", F.lit(0)) / F.when(F.col("n") > 0, F.col("n"))).otherwise(0.0).alias(NAMES[2]),
        F.coalesce(capped(days, 365.0) / 365, F.lit(1.0)).alias(NAMES[3]),
        F.coalesce("flake", F.lit(0.0)).alias(NAMES[4]),
        F.coalesce(capped(F.col("ms") / 60000), F.lit(0.0)).alias(NAMES[5]),
        capped(F.coalesce("prs", F.lit(0)) / 30).alias(NAMES[6]),
        F.lit(0.0).alias(NAMES[7]),
    )


def proxy_distance(test: str) -> F.Column:
    """A reproducible stand-in for the graph distance: a digest of the name in six steps from 0 to 1."""
    return F.conv(F.substring(F.md5(F.col(test)), 1, 4), 16, 10).cast("int") % 6 / 5


def training_features(runs: DataFrame) -> DataFrame:
    """repo_id, ingest_seq, test_path, label and the eight features of every (run, listed test).

    Failures count if the run lists the test. Days since failure look at failures up to the run's own time, its own included.
    Churn counts the requests of the test's runs from 30 days before the run on, with no upper bound, which are the requests whose last
    run isn't older than that. Windows run within (test, day) and carry over from day tables, so that a test listed by every
    run of a large repository is many tasks.
    """
    test, at = ["repo_id", "test_path"], F.unix_micros("created_at")
    day_of = lambda t: F.floor(t / F.lit(DAY_US)).cast("int")
    failing = items("actual_failures")
    each = F.transform(F.array_distinct(items("all_tests")), lambda t: F.struct(t.alias("test_path"), F.array_contains(failing, t).cast("int").alias("label")))
    listed = runs.where(F.col("created_at").isNotNull()).select("repo_id", "ingest_seq", "pr_number", at.alias("at"), F.inline(each))
    rows = listed.where(F.col("test_path").isNotNull()).withColumn("label", F.coalesce("label", F.lit(0))).withColumn("day", day_of(F.col("at")))
    rows = listed_rows = materialize(rows, "listed")
    failed_at = F.when(F.col("label") == 1, F.col("at"))
    # totals and earlier failures come from a table of a row a test and day
    days = rows.groupBy(*test, "day").agg(F.sum("label").alias("f"), F.count(F.lit(1)).alias("c"), F.max(failed_at).alias("l"))
    whole = W.partitionBy(*test)
    before = F.max("l").over(whole.orderBy("day").rowsBetween(W.unboundedPreceding, -1))
    days = days.select(*test, "day", F.sum("f").over(whole).alias("fails"), F.sum("c").over(whole).alias("n"), before.alias("before"))
    so_far = F.max(failed_at).over(W.partitionBy(*test, "day").orderBy("at"))
    rows = rows.withColumn("own", so_far).join(days, [*test, "day"]).withColumn("last", F.greatest("own", "before"))
    # the last run of each request is an event; a run's churn is the events from 30 days before it on
    events = listed_rows.where(F.col("pr_number").isNotNull()).groupBy(*test, "pr_number").agg(F.max("at").alias("at")).select(*test, "at", F.lit(1).alias("event"))
    back = F.lit(30 * DAY_US)
    shifted = rows.withColumns({"at": F.col("at") - back, "day": day_of(F.col("at") - back), "event": F.lit(0)})
    marks = shifted.unionByName(events.withColumn("day", day_of(F.col("at"))), allowMissingColumns=True)
    stops = listed_rows.select(*test, day_of(F.col("at") - back).alias("day"), F.lit(0).alias("event")).unionByName(events.select(*test, day_of(F.col("at")).alias("day"), "event"))
    ahead = stops.groupBy(*test, "day").agg(F.sum("event").alias("e"))
    ahead = ahead.select(*test, "day", F.coalesce(F.sum("e").over(whole.orderBy("day").rowsBetween(1, W.unboundedFollowing)), F.lit(0)).alias("ahead"))
    rest = F.sum("event").over(W.partitionBy(*test, "day").orderBy("at").rangeBetween(W.currentRow, W.unboundedFollowing))
    rows = marks.withColumn("rest", rest).where(F.col("event") == 0).join(ahead, [*test, "day"])
    rows = rows.withColumns({"prs": F.col("rest") + F.col("ahead"), "at": F.col("at") + back})
    rate = F.col("fails") / F.col("n")
    return rows.select(
        "repo_id", "ingest_seq", "test_path", "label",
        rate.alias(NAMES[0]), proxy_distance("test_path").alias(NAMES[1]), rate.alias(NAMES[2]),
        F.coalesce(capped((F.col("at") - F.col("last")) / F.lit(DAY_US), 365.0) / 365, F.lit(1.0)).alias(NAMES[3]),
        F.when((F.col("fails") > 0) & (F.col("fails") < F.col("n")), 1.0).otherwise(0.0).alias(NAMES[4]),
        F.lit(0.1).alias(NAMES[5]), capped(F.col("prs") / 30).alias(NAMES[6]), F.lit(0.0).alias(NAMES[7]),
    )
