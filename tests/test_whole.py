"""Queries over small tables of their own: every row that belongs to the job comes out."""

import datetime as dt

import pytest

from runweave.operators import model
from runweave.plans import core_queries, layer1_queries, reference_queries, source_queries
from runweave.session import ship

QUERIES = core_queries.QUERIES | reference_queries.QUERIES | layer1_queries.QUERIES | source_queries.QUERIES


@pytest.fixture
def run(spark, tmp_path, rows):
    """The rows of a query over the given tables."""

    def of(name, **tables):
        ship(spark)
        for table, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        return rows(QUERIES[name](spark, str(tmp_path)))

    return of


def test_files_without_links(spark, run):
    data = [(1, {"a.ts": ["b.ts"], "b.ts": [], "lone.test.ts": [], "null.ts": None, "blank.ts": ["./"]}), (2, {"x.types.ts": []}), (3, {}), (4, None)]
    g = spark.createDataFrame(data, "result_id bigint, dependency_graph map<string,array<string>>")
    sizes = [(1, "a.ts", 2, False), (1, "b.ts", 1, False), (1, "blank.ts", 1, False), (1, "lone.test.ts", 1, False), (1, "null.ts", 1, False), (2, "x.types.ts", 1, False)]
    assert run("p2_links", layer1_results=g) == run("p2_sizes", layer1_results=g) == sizes
    assert run("graph_distance", layer1_results=g) == [(k, p, 0.0) for k, p, _, _ in sizes]
    assert run("is_test_file", layer1_results=g) == sorted((p, p == "lone.test.ts") for _, p, _, _ in sizes)
    assert run("run_full_suite", layer1_results=g) == [(1, False), (2, True), (3, False), (4, False)]
    assert run("import_links", layer1_results=g) == [(1, "a.ts", "b.ts")]


def test_every_query_vector(spark, run):
    data = [(i, [float((i * k) % 11 - 5) for k in range(1, 17)]) for i in range(301)]
    v = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    queries = [0, 100, 200, 300]
    bits = {i: [x > 0 for x in e] for i, e in data}
    near = {q: sorted((sum(a != b for a, b in zip(bits[q], bits[i])), i) for i in bits)[:50] for q in queries}
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) ** 0.5 * sum(b * b for b in y) ** 0.5)
    want = {(q, i): cos(data[q][1], data[i][1]) for q in queries for i in bits}
    found = {(q, i): s for q, i, s, _ in run("cosine_bands", embeddings=v)}
    assert found == pytest.approx(want, abs=1e-6) and len(found) == 4 * 301
    assert sorted(run("hamming_topk", embeddings=v)) == sorted((q, i, n) for q in queries for n, i in near[q])
    found = {(q, i): s for q, i, s, _ in run("tiered_retrieval", embeddings=v)}
    assert found == pytest.approx({(q, i): want[q, i] for q in queries for _, i in near[q]}, abs=1e-6)


def test_reach_takes_all_orders(spark, run):
    customers = spark.createDataFrame([(i,) for i in range(1, 201)], "c_custkey bigint")
    orders = [(1, (7 - 1 * 7) % 200, "5-LOW"), (2, (1 - 2 * 7) % 200, "1-URGENT"), (3, (2 - 3 * 7) % 200, "3-MEDIUM"), (9, (8 - 9 * 7) % 200, "1-URGENT")]
    o = spark.createDataFrame(orders, "o_custkey bigint, o_orderkey bigint, o_orderpriority string")
    assert sorted(r[0] for r in run("customer_reach", customer=customers, orders=o)) == [1, 2, 3, 7, 77, 100]


def test_copies_are_looked_up(spark, run):
    texts = [f"text {i}" for i in range(30)]
    docs = spark.createDataFrame([(i * 30 + j, t) for i in range(3) for j, t in enumerate(texts)] + [(90, None)], "doc_id bigint, text string")
    found = run("embedding_cache", documents=docs)
    assert sorted(r[0] for r in found) == list(range(90))
    states = {key: hit for _, hit, key in found}
    assert len(states) == 30 and {hit for hit in states.values()} == {True, False} and all(states[key] is hit for _, hit, key in found)


def test_scores_by_a_whole_booster_and_graph_distance(spark, run, monkeypatch):
    at = lambda d: dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=d)
    data = [(i, f"id-{i}", "r", i % 7, at(i % 50), ["a"] if i % 3 == 0 else [], ["a", "b"]) for i in range(20)]
    runs = spark.createDataFrame(data, "ingest_seq bigint, id string, repo_id string, pr_number bigint, created_at timestamp, actual_failures array<string>, all_tests array<string>")
    tests = spark.createDataFrame([("r", "a", 0.2, 30000.0)], "repo_id string, path string, flake_score double, avg_duration_ms double")
    flaky = spark.createDataFrame([("r", t, 0.5) for t in "abcde"] + [("s", "b", 0.5)], "repo_id string, test_path string, flake_score double")
    data = [(1, "r", {"a": ["b"], "c": [], "d": ["c", "e"]}), (2, "r", {"e": []}), (3, "s", {"b": ["a"]})]
    graphs = spark.createDataFrame(data, "result_id bigint, repo_id string, dependency_graph map<string,array<string>>")
    given = {"runs": runs, "tests": tests, "flaky_rows": flaky, "layer1_results": graphs}
    # repo_id, test_path, similarity, distance, ...
    assert [(r[0], r[1], r[3]) for r in run("serving_features", **given)] == [("r", "a", 0.0), ("r", "b", 0.2), ("r", "c", 0.0), ("r", "d", 0.0), ("r", "e", 0.0), ("s", "b", 0.0)]
    fitted, real = [], model.scored
    distances = []

    def seen(m, features):
        fitted.append(m)
        distances.extend(sorted(r[0] for r in features.select("graph_distance").collect()))
        return real(m, features)

    monkeypatch.setattr(model, "scored", seen)
    assert len(run("ml_scores", **given)) == 6
    assert fitted[0].stages[-1].getNumTrees == 100 and distances == [0.0] * 5 + [0.2]
