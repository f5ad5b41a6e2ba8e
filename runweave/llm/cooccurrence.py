"""Items that appear together: exact pair counts against a fitted bipartite configuration null.

A record offers a set of items (``offered``) and marks some of them (``marked``). For each pair marked together at least
``least`` times the operator counts the records that offer both, those of them that mark the first, the second, and both.

Only items marked ``least`` times can be part of such a pair, and only pairs counted ``least`` times are followed into the
offered sets. Pairs of marks come from a generator over a record's frequent marks. The offered sets meet a group's pairs in cells of
(group, salt): there each item is a row of bits over the cell's records, sorted by basket size, and a pair's counts are the ones
in the conjunction of two rows, class by class. So a record is shuffled once, with its items as 64-bit hashes, and no pair is ever
built for a record. A group has as many salts as its offered items and bits need to stay within a task's memory; groups of one salt, which
are nearly all, need no table of salts, and those of several number at most SALTED by construction, so that table is broadcast. Two
frequent items of one group with one hash are detected and refused.

The null: in a group, a record of basket size d marks an offered item a with probability x_d y_a / (1 + x_d y_a), the maximum-entropy
bipartite configuration model, fitted so that expected item frequencies and expected marks of each basket size equal the
observed ones over the cells that are offered. A group of up to FIT_CELLS cells is fitted within a task, larger ones by
rounds of two aggregates; both stop when no parameter moves by more than 1e-7 of itself and say by how much the sums are missed (``fit_gap``).
Under the null the number of joint marks of a pair is Poisson-binomial. Its upper tail comes from the exact distribution after exponential
tilting to the observed count, by a discrete Fourier transform over 12 deviations and 100 places to both sides: what lies outside is below
e**-70 of the tail, rounding is below 1e-8 of it, and the work grows with the deviation and not with the count. Tails are
kept as logarithms, so none underflows. Benjamini-Hochberg over each group's pairs gives q-values.

Defined results: rows with a null group are left out; null arrays are empty, null elements are no items, repeated elements
count once, marked items that aren't offered don't count. Empty inputs give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runweave.operators.ranks import STRETCH, stretched
from runweave.session import discard, materialize

#: A task's share of a group: offered items, and bits of items times records.
CELL_ITEMS, CELL_BITS = 4_000_000, 2**31
#: Most groups of several salts: a group gets a second one only above this part of all items.
SALTED = 1_000_000
FIT_CELLS, FIT_ROUNDS, FIT_MOVED = 2_000_000, 300, 1e-7
BLOCK_BYTES = 2**23


def hashed(column: str | F.Column) -> F.Column:
    """Distinct hashes of an array's elements."""
    c = F.col(column) if isinstance(column, str) else column
    return F.array_distinct(F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.xxhash64(x)))


def encode(records: DataFrame, *, group: str, offered: str, marked: str, record: str) -> DataFrame:
    """(grp, rec, at, af): the group as a string, hashes of the offered items and of the marked ones among them; one narrow row a record."""
    at = hashed(offered)
    return records.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("grp"), F.col(record).alias("rec"), at.alias("at"), F.array_intersect(at, hashed(marked)).alias("af"))


def names_of(records: DataFrame, *, group: str, marked: str) -> DataFrame:
    """(grp, item, name) of every item that is marked anywhere."""
    rows = records.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("grp"), F.explode(marked).alias("name"))
    return rows.where(F.col("name").isNotNull()).distinct().withColumn("item", F.xxhash64("name"))


def fit_sums(d: np.ndarray, item: np.ndarray, cells: np.ndarray, item_marks: np.ndarray, class_marks: np.ndarray, rounds: int = FIT_ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(x, y, gap) of the configuration model over cells (d, item) that ``cells`` records offer; item_marks and class_marks are the sums to be met.

    gap is the largest miss of a sum, as a part of it.
    """
    by_d = lambda v: np.bincount(d, v, len(class_marks))
    by_item = lambda v: np.bincount(item, v, len(item_marks))
    x = np.sqrt(class_marks / np.maximum(by_d(cells), 1))
    y = np.sqrt(item_marks / np.maximum(by_item(cells), 1))
    for _ in range(rounds):
        y_new = np.clip(item_marks / np.maximum(by_item(cells * x[d] / (1 + x[d] * y[item])), 1e-300), 0, 1e9)
        x_new = np.clip(class_marks / np.maximum(by_d(cells * y_new[item] / (1 + x[d] * y_new[item])), 1e-300), 0, 1e9)
        moved = max(np.max(np.abs(x_new - x) / np.maximum(x, 1e-12), initial=0), np.max(np.abs(y_new - y) / np.maximum(y, 1e-12), initial=0))
        x, y = x_new, y_new
        if moved < FIT_MOVED:
            break
    expected = cells * (x[d] * y[item] / (1 + x[d] * y[item]))
    misses = [np.abs(got - want) / np.maximum(want, 1e-12) for got, want in ((by_d(expected), class_marks), (by_item(expected), item_marks))]
    return x, y, float(max(np.max(m, initial=0) for m in misses))


def fit_null(cells: np.ndarray, item_marks: np.ndarray, class_marks: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Probabilities [class, item] of the configuration model of a full grid of cells."""
    d, item = np.divmod(np.arange(cells.size), cells.shape[1])
    x, y, _ = fit_sums(d, item, cells.ravel(), item_marks, class_marks, rounds)
    product = np.outer(x, y)
    return product / (1 + product)


def log_upper_tail(counts, probabilities, at_least: int) -> float:
    """log P(X >= at_least) for a sum of binomials, with a relative error of P below 1e-8."""
    n, p = np.asarray(counts, float), np.asarray(probabilities, float)
    there = (n > 0) & (p > 0)
    n, p = n[there], np.minimum(p[there], 1 - 1e-12)
    total = n.sum()
    if at_least <= 0:
        return 0.0
    if at_least > total:
        return -np.inf
    rest = np.log1p(-p)
    odds = np.log(p) - rest
    if at_least == total:
        return float((n * np.log(p)).sum())
    share = lambda t: 1 / (1 + np.exp(-(odds + t)))
    tilt = 0.0
    if (n * p).sum() < at_least:
        low, high = 0.0, 1.0
        while (n * share(high)).sum() < at_least:
            low, high = high, high * 2
        for _ in range(200):
            q = share(tilt) if low < tilt < high else share(tilt := (low + high) / 2)
            miss = (n * q).sum() - at_least
            low, high = (tilt, high) if miss < 0 else (low, tilt)
            if abs(miss) < 1e-9 * at_least or high - low < 1e-13 * high:
                break
            tilt -= miss / (n * q * (1 - q)).sum()
    q = share(tilt)
    middle, deviation = (n * q).sum(), np.sqrt((n * q * (1 - q)).sum())
    reach = 12 * deviation + 100
    first, last = max(0, int(middle - reach)), int(min(total, middle + reach + 1))
    size = last - first + 1
    turn = np.exp(2j * np.pi * np.arange(size) / size)
    logs = np.zeros(size, complex)
    for k, x in zip(n, q):
        with np.errstate(divide="ignore"):  # a factor may be nothing at half a turn
            logs += k * np.log(1 - x + x * turn)
    mass = np.fft.fft(np.exp(logs)).real / size
    places = np.arange(max(first, at_least), last + 1)
    tail = (np.maximum(mass[places % size], 0) * np.exp(-tilt * (places - at_least))).sum()
    if tail <= 0:
        return -np.inf
    grown = (n * (rest + np.logaddexp(0, odds + tilt))).sum() - tilt * at_least
    return float(min(0.0, grown + np.log(tail)))


def upper_tail(counts, probabilities, at_least: int) -> float:
    return float(np.exp(log_upper_tail(counts, probabilities, at_least)))


def pair_surprise(records: DataFrame, names: DataFrame, *, least: int) -> DataFrame:
    """grp, item_a, item_b (names, a < b in byte order), n, n_a, n_b, n_ab, lift, expected, log_p, p_value, q_value, fit_gap.

    records as ``encode`` gives them, names as ``names_of`` does.
    """
    records = materialize(records.withColumn("row", F.monotonically_increasing_id()), "records")
    marks = records.where(F.size("af") > 0).select("grp", "row", F.explode("af").alias("item"))
    frequent = materialize(marks.groupBy("grp", "item").agg(F.count(F.lit(1)).alias("marks")).where(F.col("marks") >= least), "frequent")
    named = materialize(frequent.join(names, ["grp", "item"]), "named")
    clash = named.groupBy("grp", "item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).limit(1).collect()
    if clash:
        raise ValueError(f"two frequent items of {clash[0][0]} share a hash")

    # pairs marked together often enough
    own = marks.join(frequent.select("grp", "item"), ["grp", "item"], "left_semi").groupBy("grp", "row").agg(F.collect_list("item").alias("af"))
    first = own.where(F.size("af") > 1).select("grp", "af", F.explode("af").alias("a"))
    together = first.select("grp", "a", F.explode(F.filter("af", lambda b: b > F.col("a"))).alias("b"))
    pairs = materialize(together.groupBy("grp", "a", "b").agg(F.count(F.lit(1)).alias("n_ab")).where(F.col("n_ab") >= least), "pairs")

    classes = materialize(_class_counts(records, frequent, pairs), "classes")
    discard(records)
    fitted = materialize(_fitted(classes.where("b is null and d > 0").select("grp", "d", F.col("a").alias("item"), F.col("n").alias("cells"), F.col("n_a").alias("marks"))), "fitted")

    p_a, p_b = fitted.select("grp", "d", F.col("item").alias("a"), F.col("p").alias("p_a"), "gap"), fitted.select("grp", "d", F.col("item").alias("b"), F.col("p").alias("p_b"))
    null = classes.where("b is not null").join(p_a, ["grp", "d", "a"], "left").join(p_b, ["grp", "d", "b"], "left")
    null = null.select("grp", "a", "b", "n", "n_a", "n_b", "gap", (F.coalesce("p_a", F.lit(0.0)) * F.coalesce("p_b", F.lit(0.0))).alias("p"))
    sums = [F.sum(c).alias(c) for c in ("n", "n_a", "n_b")]
    whole = null.groupBy("grp", "a", "b").agg(*sums, F.max("gap").alias("fit_gap"), F.sum(F.col("n") * F.col("p")).alias("expected"), F.collect_list(F.struct(F.col("n").alias("n"), "p")).alias("bins"))
    whole = whole.join(pairs, ["grp", "a", "b"])
    tails = whole.mapInPandas(_tails, "grp string, a bigint, b bigint, n bigint, n_a bigint, n_b bigint, n_ab bigint, expected double, fit_gap double, log_p double")

    # Benjamini-Hochberg within the group: all pairs of its frequent items are hypotheses, the uncounted ones with p = 1
    tests = frequent.groupBy("grp").agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("tests"))
    tails = materialize(tails, "tails")  # an order is sampled before it is cut: without this every tail would be computed twice
    ranked = q_values(tails.withColumn("p_value", F.exp("log_p")).join(tests, "grp"))
    left, right = named.select("grp", F.col("item").alias("a"), F.col("name").alias("name_1")), named.select("grp", F.col("item").alias("b"), F.col("name").alias("name_2"))
    out = ranked.join(left, ["grp", "a"]).join(right, ["grp", "b"])
    swap = F.col("name_1") > F.col("name_2")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    lift = F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), F.col("n") * F.col("n_ab") / (F.col("n_a") * F.col("n_b")))
    return out.select("grp", pick("name_1", "name_2").alias("item_a"), pick("name_2", "name_1").alias("item_b"), "n", pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"),
                      "n_ab", lift.alias("lift"), "expected", "log_p", "p_value", "q_value", "fit_gap")


def _class_counts(records: DataFrame, frequent: DataFrame, pairs: DataFrame) -> DataFrame:
    """(grp, a, b, d, n, n_a, n_b) for each pair and basket size: records that offer both, and of these those that mark a, and b.

    Rows with a null b are single items: n records offer a, n_a mark it. Groups without a pair have no rows, they have nothing to compare.
    """
    active = pairs.select("grp").distinct()
    sizes = records.groupBy("grp").agg(F.sum(F.size("at")).alias("items"), F.count(F.lit(1)).alias("rows"))
    sizes = materialize(sizes.join(active, "grp", "left_semi").join(frequent.groupBy("grp").agg(F.count(F.lit(1)).alias("kinds")), "grp"), "sizes")
    load = F.greatest(F.col("items") / F.lit(CELL_ITEMS), F.col("kinds") * F.col("rows") / F.lit(CELL_BITS))
    total = sizes.agg(F.sum(load)).first()[0] or 0.0
    # loads add up to the total, so at most SALTED groups lie above this bound
    bound = max(1.0, total / SALTED)
    salted = F.broadcast(sizes.where(load > bound).select("grp", F.ceil(load).cast("int").alias("salts")))
    spread = F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    left = records.where(F.size("at") > 0).join(active, "grp", "left_semi").join(salted, "grp", "left").select("grp", spread, F.size("af").alias("d"), "at", "af")
    right = pairs.select("grp", "a", "b").unionByName(frequent.join(active, "grp", "left_semi").select("grp", F.col("item").alias("a"), F.lit(None).cast("bigint").alias("b")))
    right = right.join(salted, "grp", "left").select("grp", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), "a", "b")
    cells = left.groupBy("grp", "salt").cogroup(right.groupBy("grp", "salt")).applyInArrow(_count_cell, "grp string, a bigint, b bigint, d int, n bigint, n_a bigint, n_b bigint")
    return cells.groupBy("grp", "a", "b", "d").agg(*(F.sum(c).alias(c) for c in ("n", "n_a", "n_b")))


_COUNTS = pa.schema([("grp", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("d", pa.int32()), ("n", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64())])


def _bit_rows(lists: pa.ChunkedArray, place: np.ndarray, items: np.ndarray, width: int) -> np.ndarray:
    """[item, byte]: the bit of each record, by its place, set in the rows of the items its list holds."""
    bits = np.zeros((len(items), width), np.uint8)
    flat = bits.reshape(-1)
    at = 0
    for chunk in lists.chunks:
        offsets = chunk.offsets.to_numpy()
        values = chunk.values.to_numpy()[offsets[0] : offsets[-1]]
        owner = np.repeat(place[at : at + len(chunk)], np.diff(offsets))
        at += len(chunk)
        row = np.minimum(np.searchsorted(items, values), len(items) - 1)
        hit = items[row] == values
        row, owner = row[hit], owner[hit]
        np.add.at(flat, row * width + (owner >> 3), (1 << (owner & 7)).astype(np.uint8))  # an item is in a list once
    return bits


def _count_cell(left: pa.Table, right: pa.Table) -> pa.Table:
    """Counts of one (group, salt): left(grp, salt, d, at, af), right(grp, salt, a, b)."""
    if not left.num_rows or not right.num_rows:
        return _COUNTS.empty_table()
    a, b = right["a"].to_numpy(), right["b"]
    single = b.is_null().to_numpy()
    items = np.unique(a[single])
    one, two = np.searchsorted(items, a[~single]), np.searchsorted(items, b.drop_null().to_numpy())
    # records in order of basket size, each size from a byte of its own
    d = left["d"].to_numpy()
    sizes, kind, many = np.unique(d, return_inverse=True, return_counts=True)
    begins = np.concatenate([[0], np.cumsum((many + 7) // 8)])
    order = np.argsort(kind, kind="stable")
    inside = np.arange(len(d)) - np.repeat(np.cumsum(many) - many, many)
    place = np.empty(len(d), np.int64)
    place[order] = begins[kind[order]] * 8 + inside
    width = int(begins[-1])
    offered, marked = (_bit_rows(left[c], place, items, width) for c in ("at", "af"))
    starts = begins[:-1]

    def ones(rows: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(rows), starts, axis=1, dtype=np.int64)

    parts = []

    def put(x: np.ndarray, y: np.ndarray | None, n: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        row, size = np.nonzero(n)
        parts.append((x[row], np.zeros(len(row), np.int64) if y is None else y[row], np.full(len(row), y is None), sizes[size], n[row, size], n_a[row, size], n_b[row, size]))

    step = max(BLOCK_BYTES // max(width, 1), 1)
    for i in range(0, len(items), step):
        rows = slice(i, i + step)
        n_a = ones(marked[rows])
        put(items[rows], None, ones(offered[rows]), n_a, np.zeros_like(n_a))
    for i in range(0, len(one), step):
        x, y = one[i : i + step], two[i : i + step]
        put(items[x], items[y], ones(offered[x] & offered[y]), ones(marked[x] & offered[y]), ones(offered[x] & marked[y]))
    x, y, bare, size, n, n_a, n_b = (np.concatenate(c) for c in zip(*parts))
    name = pa.array([left["grp"][0].as_py()] * len(x), pa.string())
    return pa.Table.from_arrays([name, pa.array(x), pa.array(y, mask=bare), pa.array(size.astype(np.int32)), pa.array(n), pa.array(n_a), pa.array(n_b)], schema=_COUNTS)


def _fitted(cells: DataFrame, most: int | None = None) -> DataFrame:
    """(grp, d, item, p, gap) of the null model of each group, from cells(grp, d, item, cells, marks)."""
    most = FIT_CELLS if most is None else most
    counts = cells.groupBy("grp").agg(F.count(F.lit(1)).alias("k"))
    small = cells.join(counts.where(F.col("k") <= most), "grp", "left_semi")
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = small.repartition(tasks, "grp").groupBy("grp").applyInPandas(_fit_group, "grp string, d int, item bigint, p double, gap double")
    large = cells.join(counts.where(F.col("k") > most), "grp", "left_semi").select(*cells.columns)
    return found if large.isEmpty() else found.unionByName(_fit_rounds(large))


def _fit_group(part: pd.DataFrame) -> pd.DataFrame:
    """The fitted probabilities of one group."""
    _, d = np.unique(part["d"].to_numpy(), return_inverse=True)
    _, item = np.unique(part["item"].to_numpy(), return_inverse=True)
    marks, cells = part["marks"].to_numpy(float), part["cells"].to_numpy(float)
    x, y, gap = fit_sums(d, item, cells, np.bincount(item, marks), np.bincount(d, marks))
    product = x[d] * y[item]
    return part[["grp", "d", "item"]].assign(p=product / (1 + product), gap=gap)


def _fit_rounds(cells: DataFrame) -> DataFrame:
    """The same by rounds over all large groups at once: an aggregate by item and one by basket size a round, cells never gathered."""
    cells = materialize(cells, "cells")
    items = materialize(cells.groupBy("grp", "item").agg(F.sum("marks").alias("want"), F.sum("cells").alias("there")), "items")
    sizes = materialize(cells.groupBy("grp", "d").agg(F.sum("marks").alias("want"), F.sum("cells").alias("there")), "sizes")
    start = F.sqrt(F.col("want") / F.greatest("there", F.lit(1)))
    x, y = materialize(sizes.select("grp", "d", "want", start.alias("x")), "x"), materialize(items.select("grp", "item", "want", start.alias("y")), "y")

    def next_of(mine: DataFrame, key: str, own: str, other: str) -> DataFrame:
        met = cells.join(x.select("grp", "d", "x"), ["grp", "d"]).join(y.select("grp", "item", "y"), ["grp", "item"])
        sums = met.groupBy("grp", key).agg(F.sum(F.col("cells") * F.col(other) / (1 + F.col("x") * F.col("y"))).alias("s"))
        value = F.least(F.col("want") / F.greatest("s", F.lit(1e-300)), F.lit(1e9))
        return materialize(mine.join(sums, ["grp", key]).select("grp", key, "want", value.alias(own), (F.abs(value - F.col(own)) / F.greatest(own, F.lit(1e-12))).alias("moved")), own)

    for _ in range(FIT_ROUNDS):
        y_new = next_of(y, "item", "y", "x")
        discard(y)
        y = y_new
        x_new = next_of(x, "d", "x", "y")
        discard(x)
        x = x_new
        if max(v.agg(F.max("moved")).first()[0] or 0.0 for v in (x, y)) < FIT_MOVED:
            break
    product = F.col("x") * F.col("y")
    met = cells.join(x.select("grp", "d", "x"), ["grp", "d"]).join(y.select("grp", "item", "y"), ["grp", "item"]).select("grp", "d", "item", "cells", "marks", (product / (1 + product)).alias("p"))
    miss = None
    for key in ("item", "d"):
        sums = met.groupBy("grp", key).agg(F.sum(F.col("cells") * F.col("p")).alias("got"), F.sum("marks").alias("want"))
        own = sums.groupBy("grp").agg(F.max(F.abs(F.col("got") - F.col("want")) / F.greatest("want", F.lit(1e-12))).alias("gap"))
        miss = own if miss is None else miss.unionByName(own)
    return met.join(miss.groupBy("grp").agg(F.max("gap").alias("gap")), "grp").select("grp", "d", "item", "p", "gap")


def q_values(rows: DataFrame) -> DataFrame:
    """rows(grp, a, b, p_value or log_p, tests, ...) with the q_value p * tests / rank made monotone, per group.

    Ranks and running minima are taken within stretches of the order and carried between them by a table of a row a group and stretch, so a group's
    pairs are never in one task, however many of them have one p.
    """
    if "log_p" not in rows.columns:
        rows = rows.withColumn("log_p", F.log(F.greatest("p_value", F.lit(5e-324))))
    rows = stretched(rows, ["grp"], [F.col("log_p"), F.col("a"), F.col("b")], "_place")
    raw = F.col("log_p") + F.log("tests") - F.log("_place")
    rows = rows.withColumn("_raw", raw)
    least = rows.groupBy("grp", STRETCH).agg(F.min("_raw").alias("_l"))
    after = F.min("_l").over(W.partitionBy("grp").orderBy(STRETCH).rowsBetween(1, W.unboundedFollowing))
    here = F.min("_raw").over(W.partitionBy("grp", STRETCH).orderBy("_place").rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("_here", here).join(least.select("grp", STRETCH, after.alias("_after")), ["grp", STRETCH])
    return rows.withColumn("q_value", F.exp(F.least(F.lit(0.0), "_here", "_after"))).drop(STRETCH, "_place", "_raw", "_here", "_after")


def _tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        part["log_p"] = [log_upper_tail([b["n"] for b in bins], [b["p"] for b in bins], n_ab) for bins, n_ab in zip(part["bins"], part["n_ab"])]
        yield part[["grp", "a", "b", "n", "n_a", "n_b", "n_ab", "expected", "fit_gap", "log_p"]]
