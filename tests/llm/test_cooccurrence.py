import itertools
import math
import random

import numpy as np
import pytest

from runweave.llm import cooccurrence as C

SCHEMA = "repo string, rec bigint, offered array<string>, marked array<string>, grp int, n int"


def brute(data, least):
    out = {}
    groups = {}
    for g, _, t, f in data:
        if g is not None:
            t = {x for x in t or [] if x is not None}
            groups.setdefault(g, []).append((t, t & set(f or [])))
    for g, own in groups.items():
        items = sorted({x for _, f in own for x in f}, key=str.encode)
        for a, b in itertools.combinations(items, 2):
            both = [f for t, f in own if a in t and b in t]
            n_ab = sum(a in f and b in f for f in both)
            if n_ab >= least:
                out[(g, a, b)] = (len(both), sum(a in f for f in both), sum(b in f for f in both), n_ab)
    return out


def run(spark, data, least):
    df = spark.createDataFrame([(*r, 1, 1) for r in data], SCHEMA)
    records = C.encode(df, group="repo", offered="offered", marked="marked", record="rec")
    return C.pair_surprise(records, C.names_of(df, group="repo", marked="marked"), least=least).collect()


def test_counts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "CELL_ITEMS", 150)  # the hot group is cut in several
    rnd = random.Random(5)
    names = [f"t{i}" for i in range(8)] + ["é", "Z"]
    data = []
    for i in range(300):
        offered = rnd.sample(names, rnd.randint(0, 8)) * rnd.choice([1, 1, 2])
        marked = [x for x in offered if rnd.random() < 0.4] + rnd.choice([[], ["unlisted"]])
        data.append((rnd.choice(["hot"] * 4 + ["b", None]), i, rnd.choice([offered, offered + [None]]) if i % 20 else None, marked if i % 15 else None))
    found = {(r["grp"], r["item_a"], r["item_b"]): (r["n"], r["n_a"], r["n_b"], r["n_ab"]) for r in run(spark, data, 3)}
    assert found == brute(data, 3)


def test_planted_pair_is_surprising_and_chance_is_not(spark):
    rnd = random.Random(6)
    names = [f"t{i}" for i in range(40)]
    data = []
    for i in range(400):
        marked = [x for x in names if rnd.random() < 0.05]
        if i % 12 == 0:
            marked += ["t0", "t1"]
        data.append(("g", i, names, marked))
    rows = run(spark, data, 2)
    by = {(r["item_a"], r["item_b"]): r for r in rows}
    assert min(by, key=lambda k: by[k]["p_value"]) == ("t0", "t1") and by[("t0", "t1")]["q_value"] < 0.01
    assert sum(r["q_value"] < 0.05 for r in rows) <= 3
    assert all(r["q_value"] >= r["p_value"] for r in rows)


def test_fit_meets_the_sums():
    rnd = np.random.default_rng(1)
    cells = rnd.integers(1, 50, (5, 9)).astype(float)
    truth = rnd.random((5, 1)) * rnd.random((1, 9)) * 0.5
    expected = cells * truth
    p = C.fit_null(cells, expected.sum(0), expected.sum(1), 5000)
    assert np.allclose((cells * p).sum(0), expected.sum(0), rtol=1e-4) and np.allclose((cells * p).sum(1), expected.sum(1), rtol=1e-4)
    assert ((p >= 0) & (p <= 1)).all()


def test_tail_is_exact():
    assert C.upper_tail([10], [0.3], 0) == 1.0 and C.upper_tail([3], [0.5], 4) == 0.0
    want = sum(math.comb(20, k) * 0.1**k * 0.9 ** (20 - k) for k in range(7, 21))
    assert C.upper_tail([20], [0.1], 7) == pytest.approx(want, rel=1e-9)
    ps = [0.2] * 3 + [0.5] * 2
    total = sum(math.prod(p if x else 1 - p for p, x in zip(ps, xs)) for xs in itertools.product([0, 1], repeat=5) if sum(xs) >= 3)
    assert C.upper_tail([3, 2], [0.2, 0.5], 3) == pytest.approx(total, rel=1e-12)
    assert 0 < C.upper_tail([5000], [0.001], 60) < 1e-40


def test_q_values_against_brute_force(spark):
    rnd = random.Random(4)
    data = [("g" if i % 3 else "h", i, i + 1, rnd.choice([1e-320, 1e-9, 0.01, 0.2, 1.0, rnd.random() ** 6]), 500.0) for i in range(200)]
    df = spark.createDataFrame(data, "grp string, a bigint, b bigint, p_value double, tests double")
    got = {r["a"]: r["q_value"] for r in C.q_values(df).collect()}
    for g in "gh":
        own = sorted((r for r in data if r[0] == g), key=lambda r: (r[3], r[1]))
        least = 1.0
        for rank in range(len(own), 0, -1):
            least = min(least, own[rank - 1][3] * 500 / rank)
            assert got[own[rank - 1][1]] == pytest.approx(least, rel=1e-9, abs=1e-300)


def test_empty(spark):
    assert run(spark, [], 2) == []
    assert run(spark, [("g", 1, None, ["a"]), ("g", 2, ["a"], None), (None, 3, ["a", "b"], ["a", "b"])], 1) == []


def test_tail_of_large_counts():
    n, p, at_least = 400_000, 0.25, 100_274  # a deviation above the mean; 400 further terms hold 0.96 of it
    k = range(at_least, at_least + 4000)
    want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in k)
    assert C.upper_tail([n], [p], at_least) == pytest.approx(want, rel=1e-6)


def test_tail_in_logarithms():
    assert C.log_upper_tail([5000], [1e-6], 400) < -2000
    n, p, k = 3000, 0.001, 900
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    assert C.log_upper_tail([n], [p], k) == pytest.approx(first + math.log1p((n - k) / (k + 1) * p / (1 - p)), rel=1e-6)
    assert C.log_upper_tail([4, 3], [0.5, 0.25], 7) == pytest.approx(4 * math.log(0.5) + 3 * math.log(0.25))


def test_tail_against_convolution():
    rnd = np.random.default_rng(2)
    for _ in range(200):
        n, p = rnd.integers(1, 60, 4), rnd.random(4) ** rnd.integers(1, 6)
        mass = np.ones(1)
        for k, q in zip(n, p):
            for _ in range(k):
                mass = np.convolve(mass, [1 - q, q])
        at_least = int(rnd.integers(1, n.sum() + 1))
        want = math.fsum(mass[at_least:])
        if want > 1e-290:
            assert C.log_upper_tail(n, p, at_least) == pytest.approx(math.log(want), rel=1e-8, abs=1e-8)


def test_tail_costs_no_more_for_large_counts():
    import time

    began = time.process_time()
    assert C.upper_tail([10**9] * 5, [0.1] * 5, 500_030_000) == pytest.approx(0.0786, abs=2e-4)  # a normal tail at 1.4142 deviations
    assert time.process_time() - began < 5


def test_rounds_fit_as_a_task_does(spark):
    rnd = np.random.default_rng(3)
    data = [(g, d, i, int(rnd.integers(5, 80)), 0) for g in ("g", "h") for d in (1, 2, 3) for i in range(6)]
    data = [(g, d, i, n, int(rnd.binomial(n, min(0.9, 0.05 * d * (1 + i))))) for g, d, i, n, _ in data]
    df = spark.createDataFrame(data, "grp string, d int, item bigint, cells bigint, marks bigint")
    inside = {(r["grp"], r["d"], r["item"]): (r["p"], r["gap"]) for r in C._fitted(df).collect()}
    assert all(gap < 1e-4 for _, gap in inside.values())
    rounds = {(r["grp"], r["d"], r["item"]): (r["p"], r["gap"]) for r in C._fitted(df, most=20).collect()}
    assert rounds.keys() == inside.keys() and all(rounds[k][0] == pytest.approx(inside[k][0], rel=1e-4) for k in inside)


def test_surprise_against_a_brute_force_null(spark):
    """Counts over 10**5: the expected number and the tail of a pair under the fitted null, cell by cell."""
    rnd = random.Random(11)
    data = []
    for i in range(3000):
        marked = [x for x in ("a", "b", "c", "d") if rnd.random() < 0.6]
        data.append(("g", i, ["a", "b", "c", "d"], marked))
    rows = {(r["item_a"], r["item_b"]): r for r in run(spark, data, 5)}
    sizes = [len(m) for *_, m in data]
    marks = {x: sum(x in m for *_, m in data) for x in "abcd"}
    cells = np.array([[sizes.count(d)] * 4 for d in (1, 2, 3, 4)], float)
    p = C.fit_null(cells, np.array([marks[x] for x in "abcd"], float), np.array([d * sizes.count(d) for d in (1, 2, 3, 4)], float), 20_000)
    for (x, y), r in rows.items():
        i, j = "abcd".index(x), "abcd".index(y)
        probabilities = p[:, i] * p[:, j]
        assert r["expected"] == pytest.approx(float((cells[:, 0] * probabilities).sum()), rel=1e-2)
        assert r["n"] == 3000 and r["q_value"] >= r["p_value"]
