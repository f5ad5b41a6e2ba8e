"""Diff text: its kind, its effective lines, and truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.functions.expr import effective_lines, is_effective

#: fixed value: a line that adds a definition
DEFINITION = r"^\+(?:(?:export\s+)?(?:function|class)\s|(?:export\s+)?const\s+\w+\s*=\s*\()"


def diff_kind(diff: str) -> F.Column:
    """feature if more definitions are added than lines removed, else bugfix; unknown for blank diffs or if neither occurs."""
    lines = F.split(F.col(diff), "\n")
    added = F.size(F.filter(lines, lambda x: x.rlike(DEFINITION)))
    removed = F.size(F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---")))
    blank = F.col(diff).isNull() | (F.trim(F.regexp_replace(diff, r"\s+", " ")) == "")
    return F.when(blank | ((added == 0) & (removed == 0)), "unknown").when(added > removed, "feature").otherwise("bugfix")


def truncated(diff: str, most: int = 2000) -> F.Column:
    """The diff with its first ``most`` effective lines; other lines all stay. Linear in the lines: the place of the last line kept is looked up once."""
    lines = F.split(F.col(diff), "\n")
    places = F.filter(F.transform(lines, lambda x, i: F.when(is_effective(x), i)), lambda i: i.isNotNull())
    last = F.element_at(places, most) if most > 0 else F.lit(-1)
    kept = F.filter(lines, lambda x, i: ~is_effective(x) | (i <= last))
    return F.when(F.size(places) > most, F.array_join(kept, "\n")).otherwise(F.col(diff))


def classified(documents: DataFrame, *, key: str, diff: str) -> DataFrame:
    """key, kind, effective."""
    return documents.select(key, diff_kind(diff).alias("kind"), F.coalesce(effective_lines(diff), F.lit(0)).alias("effective"))
