"""Places of rows in an order, for groups of any size.

Rows are range-partitioned by group and order, so a group of a third of all rows lies in many tasks; each task numbers its own stretch
and stretches get the count of the group's rows before them from a table of a row a group and stretch. Cutting an order samples the rows first, which
computes them once more; callers write rows that are costly to make.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runweave.session import materialize

STRETCH, INSIDE, BEFORE = "_stretch", "_inside", "_before"


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[F.Column], name: str = "place") -> DataFrame:
    """rows with their place from 1 within the group, in the given order; rows equal in it take places in any order.

    rows must not hold columns called _stretch, _inside or _before. The rows are written once, so that a repeated task can't cut them otherwise.
    """
    return stretched(rows, group, order, name).drop(STRETCH)


def stretched(rows: DataFrame, group: Sequence[str], order: Sequence[F.Column], name: str = "place") -> DataFrame:
    """``placed`` with the number of the stretch each row lies in; within a group stretches follow the order."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    cut = rows.repartitionByRange(tasks, *(F.col(g) for g in group), *order).withColumn(STRETCH, F.spark_partition_id())
    cut = materialize(cut, "stretches")
    counts = cut.groupBy(*group, STRETCH).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy(STRETCH).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = counts.select(*group, STRETCH, before.alias(BEFORE)).alias("s")
    numbered = cut.withColumn(INSIDE, F.row_number().over(W.partitionBy(*group, STRETCH).orderBy(*order))).alias("r")
    met = numbered.join(ahead, [F.col(f"r.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in (*group, STRETCH)])
    return met.select(*(F.col(f"r.`{c}`") for c in rows.columns), F.col(f"r.{STRETCH}"), (F.col(f"r.{INSIDE}") + F.col(f"s.{BEFORE}")).alias(name))
