"""Run records made up from a seed, for tests and demonstrations, with the dirt real logs have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def made_up_runs(spark: SparkSession, n: int, *, seed: int = 1, repos: int = 3, tests: int = 12, days: int = 90) -> DataFrame:
    """n run records with an order of arrival; every value is a function of the row number and the seed.

    Among them are missed failures, repeated elements, empty test lists, tied times, and every twentieth record a repeat of the one before it.
    """
    number = F.when(F.col("_n") % 20 == 19, F.col("_n") - 1).otherwise(F.col("_n"))
    draw = lambda what, m: F.pmod(F.xxhash64(F.lit(what), number, F.lit(seed)), F.lit(m)).cast("int")
    path = lambda k: F.concat(F.lit("test/"), F.format_string("%03d", k), F.lit(".test.ts"))
    rows = spark.range(n).withColumnRenamed("id", "_n")
    every = F.transform(F.sequence(F.lit(0), F.lit(tests - 1)), lambda k: F.struct(k.alias("k"), F.pmod(F.xxhash64(k, number, F.lit(seed)), F.lit(100)).alias("d")))
    pick = lambda most: F.transform(F.filter(every, lambda x: x["d"] < most), lambda x: path(x["k"]))
    empty = F.array().cast("array<string>")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return rows.select(
        F.col("_n").alias("ingest_seq"), F.concat(F.lit("run-"), number).alias("id"), F.concat(F.lit("repo-"), draw("repo", repos)).alias("repo_id"), draw("pr", max(n // 5, 1)).cast("bigint").alias("pr_number"), F.sha1(number.cast("string")).alias("sha"),
        pick(50).alias("predicted_skip"), F.concat(pick(6), F.when(draw("twice", 7) == 0, pick(2)).otherwise(empty)).alias("actual_failures"), F.when(draw("none", 15) == 0, empty).otherwise(pick(85)).alias("all_tests"),
        F.element_at(F.array(*map(F.lit, ("shadow", "conservative", "standard", "aggressive"))), draw("mode", 4) + 1).alias("mode"), (F.size(pick(50)) * 0.5).cast("float").alias("time_saved_minutes"),
        F.timestamp_seconds(F.unix_seconds(start) + draw("hour", days * 24) * 3600).alias("created_at"),
    )


def runs_ddl(name: str, location: str | None = None) -> str:
    """CREATE TABLE statement of the runs table, by repository and month."""
    columns = "id STRING, pr_number BIGINT, sha STRING, predicted_skip ARRAY<STRING>, actual_failures ARRAY<STRING>, all_tests ARRAY<STRING>, mode STRING, time_saved_minutes FLOAT, created_at TIMESTAMP, repo_id STRING, yyyymm STRING"
    return f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (repo_id, yyyymm)" + (f" LOCATION '{location}'" if location else "")
