"""Rolling totals over trailing periods, days without activity included.

Rows are first reduced to one total per entity and day (partial aggregate, so an entity with a third of all rows shuffles
a row a day). The calendar has one row per entity and day between the entity's first and last day. Both sides carry a
coarse bucket of days as wide as the longest period: a calendar date can only meet daily totals of its own bucket and of the one
before, so the range join is an equi-join on (entity, bucket) with the bounds as a residual filter, and no task gets more
than two periods of a single entity.

Defined results: rows without entity or timestamp belong to no day; null and NaN values count as a row that adds nothing, an
infinite value makes the totals it falls into infinite. Averages divide by the rows in the period that have a value, null if
there are none. Empty input gives no rows. Other input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_totals(df: DataFrame, entity: str, at: str, value: str) -> DataFrame:
    """(entity, day, total, valued, n): day is a day number since 1970 in UTC."""
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    days = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(86_400_000_000)).cast("int")
    rows = df.where(F.col(entity).isNotNull() & F.col(at).isNotNull()).select(F.col(entity).alias("entity"), days.alias("day"), v.alias("v"))
    return rows.groupBy("entity", "day").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"), F.count("v").alias("valued"), F.count(F.lit(1)).alias("n"))


def trailing_totals(df: DataFrame, *, entity: str = "repo_id", at: str = "created_at", value: str = "time_saved_minutes", periods: Sequence[int] = (7, 30)) -> DataFrame:
    """entity, run_day (YYYY-MM-DD), first_day and last_day (day numbers), day, and total_N, avg_N, rows_N for every period of N days.

    One row for each entity and calendar day from its first to its last day with a row.
    """
    width = max(periods)
    daily = daily_totals(df, entity, at, value)
    spans = daily.groupBy("entity").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    dates = spans.withColumn("on", F.explode(F.sequence("first_day", "last_day")))
    bucket = F.floor(F.col("on") / width).cast("int")
    dates = dates.withColumn("bucket", F.explode(F.array(bucket, bucket - 1)))
    totals = daily.withColumn("bucket", F.floor(F.col("day") / width).cast("int"))
    # left: a date in a gap longer than the width meets no daily total and keeps zeros
    near = (F.col("d.entity") == F.col("t.entity")) & (F.col("d.bucket") == F.col("t.bucket")) & (F.col("t.day") <= F.col("d.on")) & (F.col("t.day") > F.col("d.on") - width)
    met = dates.alias("d").join(totals.alias("t"), near, "left").select("d.entity", "d.on", "d.first_day", "d.last_day", "t.day", "t.total", "t.valued", "t.n")
    sums = []
    for n in periods:
        within = F.col("day") > F.col("on") - n
        sums += [F.sum(F.when(within, F.col(c))).alias(f"_{c}_{n}") for c in ("total", "valued", "n")]
    found = met.groupBy("entity", "on", "first_day", "last_day").agg(*sums)
    out = [F.col("entity").alias(entity), F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("on")), "yyyy-MM-dd").alias("run_day"), F.col("on").alias("day"), "first_day", "last_day"]
    for n in periods:
        total, valued = F.coalesce(F.col(f"_total_{n}"), F.lit(0.0)), F.coalesce(F.col(f"_valued_{n}"), F.lit(0))
        out += [total.alias(f"total_{n}"), F.when(valued > 0, total / valued).alias(f"avg_{n}"), F.coalesce(F.col(f"_n_{n}"), F.lit(0)).alias(f"rows_{n}")]
    return found.select(*out)


def concentrated_days(df: DataFrame, *, least: float = 20.0, share_tenths: int = 7) -> DataFrame:
    """Days from the 30th on whose trailing 30-day total reaches ``least`` and lies to ``share_tenths`` tenths in the last 7 days."""
    t = trailing_totals(df)
    full = F.col("day") >= F.col("first_day") + 29
    return t.where(full & (F.col("total_30") >= least) & (F.col("total_7") * 10 >= F.col("total_30") * share_tenths)).select("repo_id", "run_day")
