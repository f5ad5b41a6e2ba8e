"""Batch ingest: validation with reasons, refusal of known rows, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MODES = ("shadow", "conservative", "standard", "aggressive")


def blank(c: str) -> F.Column:
    return F.col(c).isNull() | (F.trim(F.regexp_replace(c, r"\s+", " ")) == "")


def validated(rows: DataFrame) -> DataFrame:
    """rows with ``problems`` (array of field names in a fixed order, empty if the row is valid)."""
    checks = [(c, blank(c)) for c in ("id", "repo_id", "sha")]
    checks += [("pr_number", F.col("pr_number").isNull())]
    checks += [(c, F.col(c).isNull() | F.exists(c, lambda x: x.isNull())) for c in ("predicted_skip", "actual_failures", "all_tests")]
    checks += [("mode", ~F.coalesce(F.col("mode").isin(*MODES), F.lit(False))), ("created_at", F.col("created_at").isNull())]
    found = F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks))
    return rows.withColumn("problems", F.filter(found, lambda x: x.isNotNull()))


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, others with their problems)."""
    v = validated(rows)
    return v.where(F.size("problems") == 0).drop("problems"), v.where(F.size("problems") > 0)


def unknown_only(incoming: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose keys the table doesn't hold (insert, do nothing on conflict)."""
    return incoming.join(known.select(*keys).distinct(), keys, "left_anti")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table after the changes: for each key the row of the highest order, changes before table rows of the same order."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.col("_new").desc()))
    return both.withColumn("_p", place).where(F.col("_p") == 1).drop("_p", "_new")


def derive(rows: DataFrame) -> DataFrame:
    """What ingest adds: minutes saved from the skips (half a minute each) where absent, created_at in milliseconds."""
    half = F.size(F.coalesce("predicted_skip", F.array().cast("array<string>"))) * F.lit(0.5)
    return rows.withColumns({"time_saved_minutes": F.coalesce(F.col("time_saved_minutes").cast("double"), half), "created_at": F.date_trunc("MILLISECOND", "created_at")})
