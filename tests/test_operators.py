import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from runweave.functions import expr
from runweave.operators import decisions, diffs, features, graph, ingest, merge, model, retrieval


def test_test_file_names(spark):
    yes = ["a/__tests__/x.ts", "a.test.ts", "b.spec.js", "x.test.tsx", "p/q_test.go", "z_spec.rb", "test_a.py", "p/test_a.py", "b_test.py", "C\\__tests__\\x.ts"]
    no = ["__tests__/x.txt", "a.test.jsx", "a.test.mjs", "testa.py", "contest.go", "p/test_dir/a.rb", "a.ts"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(p,) for p in yes + no], "p string").select("p", expr.is_test_file("p")).collect()}
    assert [p for p in yes + no if got[p]] == yes


def test_globs(spark):
    cases = [("package.json", "a/b/package.json", True), ("*.config.ts", "x/jest.config.ts", True), ("*.config.ts", "x/a.ts", False), (".github/workflows/**", ".github/workflows/a/b.yml", True),
             ("src/**/a.ts", "src/a.ts", True), ("src/*/a.ts", "src/x/y/a.ts", False), ("*.{ts,js}", "d/a.js", True), ("a?.ts", "ab.ts", True), ("a?.ts", "a/.ts", False), ("[!a].py", "b.py", True), ("a+b.ts", "a+b.ts", True), ("*.ts", "d/.a.ts", False), ("**/a.ts", ".x/a.ts", False), ("a/**", "a/b/.c", False), (".env*", ".env.local", True), ("{.a,b}*", ".ab", True), ("src/**", "src/a/b.ts", True)]
    for glob, path, want in cases:
        got = spark.createDataFrame([(path,)], "p string").select(expr.matches_any("p", [glob])).first()[0]
        assert got is want, (glob, path)


def test_cosine_hamming_and_bands(spark):
    def cos(a, b):
        return spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(expr.cosine("a", "b")).first()[0]

    assert cos([1.0, 0.0], [1.0, 0.0]) == 1.0 and cos([1.0], [-2.0]) == -1.0 and cos([1.0, 1.0], [1.0, 0.0]) == pytest.approx(2**-0.5)
    assert cos([], []) == cos(None, [1.0]) == cos([1.0], [1.0, 2.0]) == cos([0.0], [1.0]) == 0.0
    ham = lambda a, b: spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(expr.hamming("a", "b")).first()[0]
    assert ham([255, 0], [0, 0]) == 8 and ham([1], [1, 2]) == 8 and ham([], []) == 0
    scores = [0.86, 0.85, 0.71, 0.7, 0.3, 0.29]
    got = {r[0]: r[1] for r in spark.createDataFrame([(s,) for s in scores], "s double").select("s", expr.band("s")).collect()}
    assert got == {0.86: "high", 0.85: "low", 0.71: "low", 0.7: "medium", 0.3: "medium", 0.29: "low"}


def test_tiers(spark):
    data = [(i, [float((i * k) % 7 - 3) for k in range(1, 17)]) for i in range(30)]
    v = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    q = v.where("vec_id = 1")
    assert retrieval.tiered(v, q, above=30).count() == 30
    near = retrieval.tiered(v, q, above=29, n=5)
    assert near.count() == 5 and near.where("key = 1").first()["score"] == pytest.approx(1.0)
    assert retrieval.tiered(v, q.where("false"), above=29, n=5).count() == 0


def test_cache_needs_the_same_length(spark):
    contents = spark.createDataFrame([("x",), ("y",), ("z",)], "content string")
    key = lambda c: contents.where(F.col("content") == c).select(retrieval.content_key("content", 2)).first()[0]
    cache = spark.createDataFrame([(key("x"), [1.0, 2.0], 2), (key("y"), [1.0], 2)], "key string, vector array<double>, dim int")
    hits, misses = retrieval.cache_lookup(contents, cache, 2)
    assert [r["content"] for r in hits.collect()] == ["x"] and sorted(r["content"] for r in misses.collect()) == ["y", "z"]


def test_validation_reasons(spark):
    schema = "id string, repo_id string, sha string, pr_number bigint, predicted_skip array<string>, actual_failures array<string>, all_tests array<string>, mode string, created_at timestamp"
    now = dt.datetime(2025, 1, 1)
    data = [("a", "r", "s", 1, [], [], [], "shadow", now), (" \n", None, "", None, None, ["x", None], [], "SHADOW", None)]
    got = [r["problems"] for r in ingest.validated(spark.createDataFrame(data, schema)).orderBy(F.col("id").desc()).collect()]
    assert got == [[], ["id", "repo_id", "sha", "pr_number", "predicted_skip", "actual_failures", "mode", "created_at"]]
    good, bad = ingest.quarantine(spark.createDataFrame(data, schema))
    assert good.count() == 1 and bad.count() == 1


def test_upsert_and_unknown(spark, rows):
    table = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old")], "k string, v int, s string")
    changes = spark.createDataFrame([("a", 2, "new"), ("b", 4, "late"), ("c", 1, "new")], "k string, v int, s string")
    assert rows(ingest.upsert(table, changes, ["k"], "v")) == [("a", 2, "new"), ("b", 5, "old"), ("c", 1, "new")]
    assert rows(ingest.unknown_only(changes, table, ["k"])) == [("c", 1, "new")]


def test_dependents_with_cycles(spark, rows):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "x"), (None, "a"), ("e", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), (None,)], "node string")
    assert rows(graph.dependents(edges, seeds)) == [("a", 0), ("b", 1), ("c", 2), ("e", 3)]
    assert rows(graph.dependents(edges.where("false"), seeds)) == [("a", 0)]


def test_key_distance_and_blocking(spark, rows):
    g = spark.createDataFrame([(1, {"t/a.test.ts": ["./b.ts"], "b.ts": ["c.ts"]}, ["c.ts"]), (2, None, ["x"]), (3, {"x_test.go": None}, ["x_test.go"])], "result_id bigint, dependency_graph map<string,array<string>>, changed array<string>")
    assert rows(graph.blocking_tests(g)) == [(1, "t/a.test.ts"), (3, "x_test.go")]
    assert rows(graph.key_distance(graph.links(g))) == [(1, "b.ts", 0.0), (1, "c.ts", 0.2), (1, "t/a.test.ts", 0.0)]


def made_tests(spark, n, flake=None):
    return spark.createDataFrame([("r", f"t{i:02d}", (flake or {}).get(i)) for i in range(n)], "repo_id string, test_path string, flake_score double")


@pytest.mark.parametrize("mode,n,want", [("shadow", 10, 0), ("conservative", 20, 3), ("conservative", 10, 1), ("standard", 7, 3), ("aggressive", 10, 8)])
def test_skip_caps(spark, mode, n, want):
    none = spark.createDataFrame([], "repo_id string, test_path string, band string, classification string")
    got = merge.merge_layers(made_tests(spark, n), none, none, none, mode=mode)
    assert sorted(r["test_path"] for r in got.collect()) == [f"t{i:02d}" for i in range(want)]


def test_merge_buckets_are_disjoint_and_quarantine_does_not_refill(spark, rows):
    tests = made_tests(spark, 6, {1: 0.41, 2: 0.4})
    hits = spark.createDataFrame([("r", "t00"), ("r", "new")], "repo_id string, test_path string")
    bands = spark.createDataFrame([("r", "t00", "high"), ("r", "t05", "medium")], "repo_id string, test_path string, band string")
    decided = spark.createDataFrame([("r", "t05", "recommended"), ("r", "t00", "recommended"), ("r", "t03", "skip")], "repo_id string, test_path string, classification string")
    got = merge.merge_layers(tests, hits, bands, decided, mode="standard", quarantine=0.4)
    assert rows(got) == [("r", "new", "blocking"), ("r", "t00", "blocking"), ("r", "t02", "skip"), ("r", "t03", "skip"), ("r", "t05", "recommended")]
    full = merge.merge_layers(tests, hits, bands, decided, full_suite=spark.createDataFrame([("r",)], "repo_id string"))
    assert full.where("bucket <> 'blocking'").count() == 0 and full.count() == 7


def test_consensus_and_orders(spark, rows):
    data = [("r", "a", 0, 0, "skip"), ("r", "a", 1, 0, "recommended"), ("r", "a", 2, 0, "recommended"), ("r", "b", 2, 0, "blocking")]
    df = spark.createDataFrame(data, "repo_id string, test_path string, pass bigint, position bigint, classification string")
    assert rows(merge.consensus(df)) == [("r", "a", "recommended", 1), ("r", "b", "blocking", 2)]
    o = spark.createDataFrame([(["d", "a", "c", "b", "e"],)], "p array<string>").select(*(c.alias(n) for n, c in merge.pass_orders("p").items())).first()
    assert o["sorted"] == list("abcde") and o["reversed"] == list("edcba") and o["interleaved"] == list("acebd")


def test_diff_kinds_and_truncation(spark):
    feature = "--- a/x\n+++ b/x\n+export function f() {\n+const y = (a) => 1\n-old"
    bugfix = "-old\n+new"
    got = [r[0] for r in spark.createDataFrame([(0, feature), (1, bugfix), (2, "  "), (3, None), (4, "+plain"), (5, "+def a\n-x"), (6, "+const y = 1\n+ function g() {}\n+async function h() {}"), (7, "+class A {\n+type B = 1")], "i int, d string").orderBy("i").select(diffs.diff_kind("d")).collect()]
    assert got == ["feature", "bugfix", "unknown", "unknown", "unknown", "bugfix", "unknown", "feature"]
    text = "head\n+a\n+b\nmid\n-c\n+++ file\n-d\ntail"
    cut = lambda n: spark.createDataFrame([(text,)], "d string").select(diffs.truncated("d", n)).first()[0]
    assert cut(4) == text and cut(2) == "head\n+a\n+b\nmid\n+++ file\ntail" and cut(0) == "head\nmid\n+++ file\ntail"


def test_strict_decisions():
    ok = {"test_path": "a", "classification": "skip", "confidence": 2, "reasoning": ""}
    parse = decisions.parse_decisions
    assert parse(json.dumps({"decisions": [ok]})) == [("a", "skip", 2.0, "")] and parse('{"decisions": []}') == []
    for bad in ("", None, "[]", "{", '{"decisions": {}}', json.dumps({"decisions": [ok, {}]}), json.dumps({"decisions": [ok | {"classification": "maybe"}]}), json.dumps({"decisions": [ok | {"confidence": True}]}), json.dumps({"decisions": [ok | {"reasoning": None}]})):
        assert parse(bad) is None


def test_classifier_asks_twice(spark, rows):
    df = spark.createDataFrame([("r", f"e2e/{i}") for i in range(3)] + [("r", "unit/x")], "repo_id string, test_path string").coalesce(1)
    found = rows(decisions.classify(df, decisions.rule_answer).select("test_path", "classification"))
    assert found == [("e2e/0", "blocking"), ("e2e/1", "blocking"), ("e2e/2", "blocking"), ("unit/x", "skip")]
    assert decisions.classify(df, lambda paths: "no").count() == 0


def test_features_and_model(spark):
    at = lambda d: dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=d)
    runs = spark.createDataFrame([(i, "r", i % 7, at(i), ["a"] if i % 3 == 0 else [], ["a", "b"]) for i in range(60)], "ingest_seq bigint, repo_id string, pr_number bigint, created_at timestamp, actual_failures array<string>, all_tests array<string>")
    tests = spark.createDataFrame([("r", "a", 0.2, 30000.0), ("r", "a", 0.4, None)], "repo_id string, path string, flake_score double, avg_duration_ms double")
    cand = spark.createDataFrame([("r", "a", 0.5, 0.2), ("r", "zz", None, None), ("other", "a", None, None)], "repo_id string, test_path string, similarity double, distance double")
    got = {(r["repo_id"], r["test_path"]): r for r in features.serving_features(cand, runs, tests, F.lit(at(60))).collect()}
    a = got[("r", "a")]
    assert a["failure_rate"] == pytest.approx(20 / 60) and a["days_since_failure"] == pytest.approx(3 / 365) and a["flakiness"] == 0.2 and a["exec_time"] == 0.5 and a["file_churn"] == pytest.approx(7 / 30)
    assert got[("r", "zz")]["days_since_failure"] == 1.0 and got[("other", "a")]["failure_rate"] == 0.0
    train = features.training_features(runs)
    assert train.count() == 120 and train.where("label = 1").select(F.max("days_since_failure")).first()[0] == 0.0
    fitted = model.fit(train, trees=2)
    scores = model.scored(fitted, train).select("repo_id", "test_path", "score")
    assert scores.where("score < 0 or score > 1").count() == 0
    few = model.ranked(scores.distinct(), spark.createDataFrame([("r", 99)], "repo_id string, run_count bigint"))
    assert few.where("score <> 0.5").count() == 0
    many = model.ranked(scores.groupBy("repo_id", "test_path").agg(F.max("score").alias("score")), spark.createDataFrame([("r", 100)], "repo_id string, run_count bigint"))
    assert many.where("place = 1").first()["test_path"] == "a"
