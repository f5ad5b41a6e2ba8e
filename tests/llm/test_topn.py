import random

from runweave.llm.topn import top_items

SCHEMA = "repo_id string, test_path string, flake_score double, total_runs bigint, item string, score int, have int"


def brute(data, n):
    best = {}
    for g, i, s, *_ in data:
        if g is not None and i is not None and s is not None and s == s:
            best[(g, i)] = max(best.get((g, i), s), s)
    out = []
    for g in {k[0] for k in best}:
        own = sorted(((-s, i.encode()) for (h, i), s in best.items() if h == g))[:n]
        out += [(g, i.decode(), -s, r + 1) for r, (s, i) in enumerate(own)]
    return sorted(out)


def run(spark, data, n, **more):
    df = spark.createDataFrame([(*r, 1, "x", 1, 1) for r in data], SCHEMA)
    return sorted(tuple(r) for r in top_items(df, group="repo_id", item="test_path", score="flake_score", n=n, **more).collect())


def test_against_brute_force(spark):
    rnd = random.Random(3)
    names = ["a", "B", "é", "z", "Z", "ab", "日", "a/b"] + [f"p{i}" for i in range(30)]
    data = [(rnd.choice(["g1"] * 6 + ["g2", "g3", None]), rnd.choice(names + [None]), rnd.choice([None, float("nan"), 0.0, -0.0, 0.5, 0.5, 1.0, float("inf"), -3.0, rnd.random()])) for _ in range(600)]
    for n in (1, 3, 10):
        assert run(spark, data, n) == brute(data, n)
    assert run(spark, data, 5, shares=(0.5,)) == brute(data, 5)


def test_one_group_of_equal_scores(spark):
    data = [("hot", f"t{i:04d}", 0.0) for i in range(2000)] + [("few", "a", 1.0)]
    assert run(spark, data, 4) == brute(data, 4)


def test_empty_and_worthless(spark):
    assert run(spark, [], 3) == []
    assert run(spark, [("g", "t", None), (None, "t", 1.0), ("g", None, 1.0), ("g", "t", float("nan"))], 3) == []
    assert run(spark, [("g", "", 1.0)] * 3, 3) == [("g", "", 1.0, 1)]
