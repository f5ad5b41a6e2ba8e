"""Top N items within every group, by descending score bands.

Repeated items are first reduced to their best score (partial aggregate on (group, item), so that a hot group spreads over all
tasks) and written to the shared folder in bands of score. Bands are read from the top; each drops, by an anti-join, the
groups the bands above have filled, and only the rest is ranked. The ranking inside a band is exact: score descending, then
item in byte order. The rank filter is a constant, so Spark keeps at most N rows a group in each task before it shuffles
(WindowGroupLimit); a group with millions of equal scores sends N rows a task.

Defined results: rows with a null group, null item, null or NaN score don't count; an item counts once with its highest score;
infinite scores take part; 0.0 and -0.0 are equal. A group with fewer than N items comes out whole. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runweave.session import state_path

#: Shares of the rows above which a band begins, from the top.
BAND_SHARES = (0.99, 0.95, 0.85, 0.6, 0.3)


def band_edges(rows: DataFrame, shares: Sequence[float]) -> list[float]:
    """Lower bounds of the bands, descending. Approximate quantiles: they only decide how the work is cut."""
    found = rows.agg(F.percentile_approx("score", list(shares), 1000)).first()[0]
    return sorted(set(found or []), reverse=True)


def top_items(df: DataFrame, *, group: str, item: str, score: str, n: int, shares: Sequence[float] = BAND_SHARES) -> DataFrame:
    """group, item, score, rank (1 to n) in the input's column names and ``rank``."""
    spark = df.sparkSession
    value = F.col(score).cast("double")
    rows = df.select(F.col(group).alias("grp"), F.col(item).alias("item"), (value + F.lit(0.0)).alias("score"))
    rows = rows.where(F.col("grp").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    edges = band_edges(rows, shares)
    band = F.lit(len(edges))
    for i, edge in reversed(list(enumerate(edges))):
        band = F.when(F.col("score") >= edge, F.lit(i)).otherwise(band)
    banded = state_path(spark, "bands")
    best = rows.groupBy("grp", "item").agg(F.max("score").alias("score"))
    best.withColumn("band", band).write.partitionBy("band").parquet(banded)
    picked: list[DataFrame] = []
    for i in range(len(edges) + 1):
        inside = _band(spark, banded, best, i)
        if inside is None:
            continue
        have = reduce(DataFrame.unionByName, picked).groupBy("grp").agg(F.count(F.lit(1)).alias("have")) if picked else None
        if have is not None:
            inside = inside.join(have.where(F.col("have") >= n), "grp", "left_anti")
        place = F.row_number().over(W.partitionBy("grp").orderBy(F.col("score").desc(), F.col("item")))
        ranked = inside.withColumn("place", place).where(F.col("place") <= n)
        if have is None:
            ranked = ranked.withColumn("have", F.lit(0).cast("bigint"))
        else:
            ranked = ranked.join(have, "grp", "left").withColumn("have", F.coalesce("have", F.lit(0)))
        ranked = ranked.where(F.col("place") + F.col("have") <= n).select("grp", "item", "score", (F.col("place") + F.col("have")).cast("int").alias("rank"))
        out = state_path(spark, "picked")
        ranked.write.parquet(out)
        picked.append(spark.read.schema(ranked.schema).parquet(out))
    result = reduce(DataFrame.unionByName, picked) if picked else best.where(F.lit(False)).withColumn("rank", F.lit(0))
    return result.select(F.col("grp").alias(group), F.col("item").alias(item), F.col("score").alias(score), "rank")


def _band(spark, path: str, best: DataFrame, i: int) -> DataFrame | None:
    """One band's folder, None if no row fell into it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/band={i}")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(best.schema).parquet(f"{path}/band={i}")
