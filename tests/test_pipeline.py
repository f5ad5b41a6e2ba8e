import datetime as dt
import json

from pyspark.sql import functions as F

from runweave.operators import analytics, decisions, embed, merge, model, prompts
from runweave.operators.redelivery import once
from runweave.plans.orchestrator import orchestrate
from runweave.plans.pipeline import select_tests, selection_report
from runweave.sources.config import SelectionConfig
from runweave.sources.generate import made_up_runs, runs_ddl


def test_selection_end_to_end(spark, rows):
    tests = spark.createDataFrame([("r", f"unit/{i}", 0.0) for i in range(6)] + [("r", "e2e/a", 0.0), ("r", "x/b", 0.0)], "repo_id string, test_path string, flake_score double")
    hits = spark.createDataFrame([("r", "unit/0")], "repo_id string, test_path string")
    bands = spark.createDataFrame([("r", "e2e/a", 0.5, "medium"), ("r", "x/b", 0.4, "medium"), ("r", "unit/1", 0.9, "high"), ("r", "unit/2", 0.1, "low")], "repo_id string, test_path string, score double, band string")
    diff = spark.createDataFrame([("r", "+function f() {")], "repo_id string, diff string")
    got = select_tests(hits, bands, tests, diff, SelectionConfig(mode="standard"))
    assert rows(got) == [("r", "e2e/a", "blocking"), ("r", "unit/0", "blocking"), ("r", "unit/1", "blocking"), ("r", "unit/2", "skip"), ("r", "unit/3", "skip"), ("r", "unit/4", "skip"), ("r", "unit/5", "skip"), ("r", "x/b", "recommended")]
    metrics = merge.selection_metrics(got, bands)
    assert metrics.first()["minutes_saved"] == 2.0 and abs(metrics.first()["confidence"] - 0.475) < 1e-9
    text = selection_report(got, metrics).first()["report"]
    assert "3 blocking, 1 recommended, 4 skipped" in text and text.index("| `e2e/a`") < text.index("| `unit/0`")
    shadow = select_tests(hits, bands, tests, diff, SelectionConfig())
    assert shadow.where("bucket = 'skip'").count() == 0
    assert rows(merge.logged_tests(got)) == [("r", ["e2e/a", "unit/0", "unit/1", "x/b", "unit/2", "unit/3", "unit/4", "unit/5"])]


def test_embedding_uses_the_cache(spark, rows):
    files = spark.createDataFrame([("a", "one two"), ("b", "three"), ("c", "one two"), ("d", None)], "path string, content string")
    stub = embed.hashing_embedder(16)
    found, new = embed.embedded(files, None, stub, 16)
    assert rows(found.select("path")) == [("a",), ("b",), ("c",)] and new.count() == 2
    again, more = embed.embedded(files, new, lambda texts: None, 16)
    assert again.count() == 3 and more.count() == 0
    diff = spark.createDataFrame([("two one",)], "content string")
    got = {r["path"]: (r["score"], r["band"]) for r in embed.match_files(files, diff, stub, 16).collect()}
    assert got["a"] == got["c"] and got["a"][1] == "high" and got["b"][1] != "high"
    assert embed.match_files(files, diff, lambda texts: None, 16).count() == 0
    assert embed.match_files(files, diff, stub, 16, above=2, n=1).count() == 1


def test_prompts(spark):
    df = spark.createDataFrame([(["b", "a"], "+x\n" * 101, " ", "bad" * 300), (["a"], None, "note", None)], "p array<string>, d string, n string, r string")
    got = df.select(prompts.prompt("p", "d", "n").alias("q"), prompts.retry_prompt("p", "d", "r").alias("again"), prompts.in_steps("d").alias("steps")).collect()
    assert got[0]["q"].startswith("Tests:\na\nb\n\nChange:\n+x") and "Notes" not in got[0]["q"] and got[1]["q"].endswith("Notes:\nnote")
    assert got[0]["again"].endswith("bad" * 166 + "ba") and got[0]["steps"] and not got[1]["steps"]


def test_made_up_runs_are_stable_and_dirty(spark, rows):
    runs = made_up_runs(spark, 200)
    assert rows(runs) == rows(made_up_runs(spark.newSession(), 200).repartition(3))
    assert once(runs).count() == 190 and runs.where(F.size("all_tests") == 0).count() > 0
    assert runs.where(F.size("actual_failures") > F.size(F.array_distinct("actual_failures"))).count() > 0
    gates = analytics.activity_gates(once(runs), least=10)
    assert gates.count() == 3
    spark.sql(runs_ddl("made_up_runs_table"))
    assert "yyyymm" in spark.table("made_up_runs_table").columns
    spark.sql("DROP TABLE made_up_runs_table")


def test_retrain_and_modes(spark, rows):
    now = dt.datetime(2025, 1, 8)
    gates = spark.createDataFrame([("a", 100), ("b", 99), ("c", 100), ("d", 500)], "repo_id string, run_count bigint")
    trained = spark.createDataFrame([("c", now - dt.timedelta(days=7)), ("d", now - dt.timedelta(days=6))], "repo_id string, trained_at timestamp")
    assert rows(analytics.retrain_due(gates, trained, F.lit(now))) == [("a", True), ("b", False), ("c", True), ("d", False)]
    floors = spark.createDataFrame([("a", True), ("b", False)], "repo_id string, below_floor boolean")
    assert rows(analytics.effective_modes(floors, "standard")) == [("a", "shadow"), ("b", "standard")]


def silent():
    def ask(system, question):
        raise OSError("no line")

    return ask


def test_providers_in_turn():
    ask_nothing = silent()
    assert decisions.first_of(ask_nothing, lambda s, q: None, lambda s, q: ("yes", 3))("", "") == ("yes", 3)
    assert decisions.first_of(ask_nothing)("", "") is None


def test_steps_and_passes_and_counts(spark, rows):
    log = []

    def provider(system, question):
        log.append(question)
        if "Tests:" not in question:
            return ("a.ts, b.ts" if "Which files" in question else " " if "functions" in question else "it rounds up"), 5
        paths = question.partition("Tests:\n")[2].partition("\n\n")[0].split("\n")
        if paths[0] == "bad" and "not valid JSON" not in question:
            return "no json", 2
        kind = "blocking" if paths[0] == "t9" else "recommended"  # asked in reverse it is more careful
        return json.dumps({"decisions": [{"test_path": p, "classification": kind, "confidence": 0.5, "reasoning": f"first {paths[0]}"} for p in paths]}), 10

    large = "\n".join("+line {x}" for _ in range(101))
    context, calls, tokens = prompts.step_context(large, lambda q: provider("", q))
    assert context == "Files: a.ts, b.ts\nFunctions: unknown\nBehaviour: it rounds up" and (calls, tokens) == (3, 15)
    assert "Files:\na.ts, b.ts" in log[1] and "Functions:\nunknown" in log[2] and "+line {x}" in log[2]
    candidates = spark.createDataFrame([("r", f"t{i}") for i in range(10)] + [("s", "bad"), ("s", "good")], "repo_id string, test_path string")
    changes = spark.createDataFrame([("r", large, "mind the gap"), ("s", "+x", None)], "repo_id string, diff string, notes string")
    careful = spark.createDataFrame([("r",)], "repo_id string")
    found, usage = decisions.classify_changes(candidates, changes, provider, careful, size=64)
    got = {(r["repo_id"], r["test_path"]): (r["classification"], r["pass"], r["reasoning"]) for r in found.collect()}
    assert got[("r", "t3")] == ("blocking", 1, "first t9") and got[("s", "good")] == ("recommended", 0, "first bad") and len(got) == 12
    assert {r["repo_id"]: (r["calls"], r["tokens"], r["fallback_used"]) for r in usage.collect()} == {"r": (6, 45, False), "s": (2, 12, False)}
    found, usage = decisions.classify_changes(candidates, changes, silent())
    assert found.count() == 0 and {(r["calls"], r["fallback_used"]) for r in usage.collect()} == {(0, True)}
    batches = decisions.in_batches(candidates, 4).collect()
    assert sorted((b["repo_id"], b["batch"], len(b["paths"])) for b in batches) == [("r", 0, 4), ("r", 1, 4), ("r", 2, 2), ("s", 0, 2)]


def test_orchestration_goes_on_without_a_layer(spark, rows):
    at = dt.datetime(2025, 1, 1)
    changes = spark.createDataFrame([("r", "+alpha beta", ["src/a.ts"]), ("q", "+x", ["package.json"])], "repo_id string, diff string, changed array<string>")
    graphs = spark.createDataFrame([("r", {"test/one.test.ts": ["src/a.ts"], "src/a.ts": []})], "repo_id string, dependency_graph map<string,array<string>>")
    files = spark.createDataFrame([("r", "e2e/mix.test.ts", "+alpha beta gamma delta epsilon zeta eta theta iota"), ("r", "same.test.ts", "+alpha beta"), ("r", "far.test.ts", "omega")], "repo_id string, path string, content string")
    runs = spark.createDataFrame([(i, "r", i, at, ["far.test.ts"] if i % 4 == 0 else [], ["far.test.ts", "low.test.ts"]) for i in range(8)], "ingest_seq bigint, repo_id string, pr_number bigint, created_at timestamp, actual_failures array<string>, all_tests array<string>")
    names = ["test/one.test.ts", "e2e/mix.test.ts", "same.test.ts", "far.test.ts", "low.test.ts", "more.test.ts"]
    tests = spark.createDataFrame([("r", n, 0.0, 10.0) for n in names] + [("q", "x.test.ts", 0.0, 1.0)], "repo_id string, path string, flake_score double, avg_duration_ms double")
    stub = embed.hashing_embedder(256)
    config = SelectionConfig(mode="aggressive", flaky_test_quarantine=0.2, flaky_test_threshold=0.15)
    out = orchestrate(changes, graphs, files, runs, tests, config, embedder=stub, dim=256, as_of=F.lit(at))
    assert out.failed == []
    buckets = {(r["repo_id"], r["test_path"]): r["bucket"] for r in out.buckets.collect()}
    assert buckets[("r", "test/one.test.ts")] == buckets[("r", "same.test.ts")] == buckets[("q", "x.test.ts")] == "blocking"
    assert buckets[("r", "low.test.ts")] == "skip" and ("r", "far.test.ts") not in buckets  # too flaky to be left out
    assert {r["score"] for r in out.ranked.collect()} == {0.5}
    text = {r["repo_id"]: r["report"] for r in out.report.collect()}["r"]
    assert "**Flaky**: `far.test.ts`" in text and "| `test/one.test.ts` | imports or similarity |" in text

    def broken(texts):
        raise OSError("no embeddings")

    again = orchestrate(changes, graphs, files, runs, tests, config, embedder=broken, dim=256, as_of=F.lit(at))
    assert again.failed == ["embeddings"] and again.bands.count() == 0
    assert {(r["repo_id"], r["test_path"]) for r in again.buckets.collect() if r["bucket"] == "blocking"} == {("r", "test/one.test.ts"), ("q", "x.test.ts")}


def test_model_is_saved_and_loaded(spark, rows, tmp_path):
    data = [("r", f"t{i}", float(i % 2), *[float((i * k) % 5) for k in range(8)]) for i in range(60)]
    training = spark.createDataFrame([(*r[:2], int(r[2]), *r[3:]) for r in data], "repo_id string, test_path string, label int, " + ", ".join(f"{n} double" for n in model.NAMES))
    fitted = model.fit(training, trees=3)
    model.save(fitted, f"file://{tmp_path}/gbt")
    again = model.load(f"file://{tmp_path}/gbt")
    assert rows(model.scored(fitted, training).select("test_path", "score")) == rows(model.scored(again, training).select("test_path", "score"))
    assert model.load(f"file://{tmp_path}/none") is None
    assert {r["score"] for r in model.scored_or_zero(None, training).collect()} == {0.0}
