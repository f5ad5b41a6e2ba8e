"""Column expressions: run arrays, weeks, vectors, paths and diff lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: what makes a file a test
TEST_SUFFIXES = (".test.ts", ".test.tsx", ".test.js", ".spec.ts", ".spec.tsx", ".spec.js", "_test.go", "_spec.rb")
TEST_FOLDERS = ("/__tests__/", "\\__tests__\\")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def items(c: str | Column) -> Column:
    """An array, empty for null."""
    return F.coalesce(col(c), F.array().cast("array<string>"))


def size0(c: str | Column) -> Column:
    return F.size(items(c)).cast("bigint")


def missed(failures: str | Column = "actual_failures", skipped: str | Column = "predicted_skip") -> Column:
    """Failures that were predicted skips; a failure listed twice counts twice."""
    skip = items(skipped)
    return F.size(F.filter(items(failures), lambda f: F.array_contains(skip, f))).cast("bigint")


def with_counts(runs):
    """runs with what trends and recalls need of the arrays: n_skipped, n_failed, n_listed, n_missed. Taken before a shuffle they keep the arrays out of it."""
    if "n_failed" in runs.columns:
        return runs
    return runs.withColumns({"n_skipped": size0("predicted_skip"), "n_failed": size0("actual_failures"), "n_listed": size0("all_tests"), "n_missed": missed()})


def skipped_share() -> Column:
    """Share of tests predicted to be skipped, from the counts, over one test at least."""
    return F.col("n_skipped") / F.greatest(F.col("n_listed"), F.lit(1))


def exact_avg(c: str | Column) -> Column:
    """Mean in whole billionths: the sum is exact, so it doesn't depend on the order of rows."""
    x = col(c)
    return F.sum(F.floor(x * 1e9 + 0.5).cast("decimal(20,0)")).cast("double") / F.count(x) / 1e9


def sunday_week(at: str | Column) -> Column:
    """Date of the Sunday that begins the week."""
    day = F.to_date(col(at))
    return F.date_sub(day, F.dayofweek(day) - 1)


def share_or_one(part: Column, whole: Column) -> Column:
    """1 - part/whole, and 1 where the whole is nothing."""
    return F.when(whole > 0, (whole - part) / F.when(whole > 0, whole)).otherwise(F.lit(1.0))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two vectors in double precision, within [-1, 1]; 0 for null, empty, unequal or zero vectors."""
    x, y = F.transform(col(a), lambda v: v.cast("double")), F.transform(col(b), lambda v: v.cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norms = F.sqrt(total(F.transform(x, lambda p: p * p))) * F.sqrt(total(F.transform(y, lambda p: p * p)))
    fit = (F.size(x) == F.size(y)) & (F.size(x) > 0)
    return F.coalesce(F.when(fit & (norms > 0), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot / F.when(norms > 0, norms)))), F.lit(0.0))


def sign_bits(vector: str | Column) -> Column:
    """A vector's signs packed eight to a byte value, first element in the highest bit."""
    v = col(vector)
    byte = lambda i: F.aggregate(F.slice(v, i * 8 + 1, 8), F.lit(0), lambda s, e: s * 2 + F.when(e > 0, 1).otherwise(0))
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 8).cast("int") - 1), byte)


def hamming(a: str | Column, b: str | Column) -> Column:
    """Differing bits of two packed vectors; eight times the first's length if the lengths differ."""
    x, y = col(a), col(b)
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, e: s + e)
    return F.when(F.size(x) == F.size(y), apart).otherwise(F.size(x) * 8)


def band(score: str | Column) -> Column:
    """high above 0.85, medium from 0.3 to 0.7, low elsewhere (between 0.7 and 0.85 too)."""
    s = col(score)
    return F.when(s > 0.85, "high").when((s >= 0.3) & (s <= 0.7), "medium").otherwise("low")


def is_test_file(path: str | Column) -> Column:
    """Whether a path names a test: by folder, by suffix, or a Python file called test_*.py or *_test.py."""
    p = col(path)
    name = F.element_at(F.split(p, "/"), -1)
    named = F.lit(False)
    for part in TEST_FOLDERS:
        named = named | p.contains(part)
    for end in TEST_SUFFIXES:
        named = named | p.endswith(end)
    return named | (name.startswith("test_") & name.endswith(".py")) | name.endswith("_test.py")


def glob_regex(glob: str) -> str:
    """Regular expression of a glob: ** over folders, * and ? within one, [...] and {a,b}; without slash it tests the last segment.

    A segment that begins with a dot is met only by a pattern that says the dot.
    """
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        first = i == 0 or glob[i - 1] in "/{,"
        shown = r"(?!\.)" if first else ""
        if glob.startswith("**/", i) and first:
            out.append(r"(?:(?!\.)[^/]+/)*")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(shown + r"(?:[^/]|/(?!\.))*")
            i += 2
            continue
        if c == "*":
            out.append(shown + "[^/]*")
        elif c == "?":
            out.append(shown + "[^/]")
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end]
            out.append(shown + "[" + ("^" + body[1:] if body[:1] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{" and "}" in glob[i + 1 :]:
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    body = "".join(out)
    return f"^(?:.*/)?{body}$" if "/" not in glob else f"^{body}$"


def matches_any(path: str | Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | col(path).rlike(glob_regex(g))
    return hit


def is_effective(line: Column) -> Column:
    """An added or removed line of a diff, file headers left out."""
    return line.rlike("^[+-]") & ~line.startswith("+++") & ~line.startswith("---")


def effective_lines(diff: str | Column) -> Column:
    return F.size(F.filter(F.split(col(diff), "\n"), is_effective)).cast("bigint")
