"""Queries of the run-history, selection and ingest operators, each with its SQL where SQL can say it."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.functions.expr import is_test_file, matches_any
from runweave.operators import analytics, decisions, diffs, features, graph, ingest, merge, model, retrieval
from runweave.operators.embed import hashing_embedder
from runweave.plans.core_queries import ONCE, counted_runs, measured_runs
from runweave.operators.redelivery import in_epochs
from runweave.plans.orchestrator import orchestrate
from runweave.session import state_path
from runweave.sources.config import SelectionConfig
from runweave.sources.tables import table
from runweave.streaming.ingest import ingest_batch, messages

ARRAYS = ("actual_failures", "all_tests")
AS_OF = "2026-03-01 00:00:00"
FULL_SUITE_GLOBS = ["**/*.types.ts", "*Core.*"]

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _cte(columns: str = "*") -> str:
    return f"""r AS (SELECT *, coalesce(predicted_skip, []) AS ps, coalesce(actual_failures, []) AS af, coalesce(all_tests, []) AS tt FROM ({ONCE})),
m AS (SELECT *, len(list_filter(af, lambda f: list_contains(ps, f))) AS missed, len(af) AS failures FROM r)"""


R = _cte()
RECALL = "CASE WHEN {f} > 0 THEN ({f} - {m}) / CAST({f} AS DOUBLE) ELSE 1.0 END"
WEEK = "CAST(created_at AT TIME ZONE 'UTC' AS DATE) - CAST(dayofweek(CAST(created_at AT TIME ZONE 'UTC' AS DATE)) AS INTEGER)"
#: mean in whole billionths, so that the order of rows doesn't matter
MEAN = "CAST(sum(CAST(floor(({x}) * 1e9 + 0.5) AS BIGINT)) AS DOUBLE) / count({x}) / 1e9"
NEWEST = "row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC NULLS LAST, ingest_seq DESC)"


# -- run history ---------------------------------------------------------------------------------------------------


@query("shadow_progress", f"""WITH {R} SELECT repo_id, count(*) AS run_count, {MEAN.format(x='len(ps) / CAST(greatest(len(tt), 1) AS DOUBLE)')} AS avg_skip_pct,
  least(count(*) / 50.0 * 100, 100.0) AS progress_pct FROM r GROUP BY 1""")  # fmt: skip
def shadow_progress(spark, d):
    return analytics.shadow_progress(measured_runs(spark, d))


_SEEN = """e AS (SELECT repo_id, unnest(tt) AS test_path, 0 AS f FROM r UNION ALL SELECT repo_id, unnest(af), 1 FROM r),
s AS (SELECT repo_id, test_path, sum(1 - f) AS seen, sum(f) AS failed FROM e GROUP BY 1, 2)"""


@query("flaky_leaderboard", f"""WITH {R}, {_SEEN} SELECT repo_id, test_path, failed / CAST(seen + failed AS DOUBLE) AS flake_score, CAST(seen + failed AS BIGINT) AS total_runs
  FROM s WHERE seen + failed > 5 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY failed / CAST(seen + failed AS DOUBLE) DESC, test_path) <= 50""")  # fmt: skip
def flaky_leaderboard(spark, d):
    return analytics.flaky_leaderboard(counted_runs(spark, d, *ARRAYS))


@query("flake_scores", f"WITH {R}, {_SEEN} SELECT repo_id, test_path, failed / CAST(seen AS DOUBLE) AS flake_score FROM s WHERE seen > 0")
def flake_scores(spark, d):
    return analytics.flake_scores(counted_runs(spark, d, *ARRAYS))


@query("accuracy_trend", f"""WITH {R} SELECT repo_id, {WEEK} AS week, CAST(count_if(failures > 0) AS BIGINT) AS runs_with_failures, CAST(sum(missed) AS BIGINT) AS missed_failures,
  CAST(sum(failures) AS BIGINT) AS total_failures, {RECALL.format(f='sum(failures)', m='sum(missed)')} * 100 AS accuracy_pct
  FROM m WHERE created_at IS NOT NULL GROUP BY 1, 2""")  # fmt: skip
def accuracy_trend(spark, d):
    return analytics.accuracy_trend(measured_runs(spark, d, "created_at"))


@query("savings_trend", f"""WITH {R} SELECT repo_id, {WEEK} AS week, coalesce(sum(CASE WHEN NOT isnan(time_saved_minutes) THEN CAST(time_saved_minutes AS DOUBLE) END), 0.0) AS minutes_saved
  FROM r WHERE created_at IS NOT NULL GROUP BY 1, 2""")  # fmt: skip
def savings_trend(spark, d):
    return analytics.savings_trend(counted_runs(spark, d, "time_saved_minutes", "created_at"))


@query("recent_recall", f"""WITH {R}, n AS (SELECT * FROM m QUALIFY {NEWEST} <= 20)
SELECT repo_id, {RECALL.format(f='sum(failures)', m='sum(missed)')} AS recall, CAST(sum(failures) AS BIGINT) AS total_failures FROM n GROUP BY 1""")  # fmt: skip
def recent_recall(spark, d):
    return analytics.recent_recall(measured_runs(spark, d, "created_at"))


@query("recent_runs", f"""WITH {R} SELECT repo_id, CAST({NEWEST} AS INTEGER) AS place, pr_number, sha, mode, epoch_us(created_at) AS created_us,
  len(ps) / CAST(greatest(len(tt), 1) AS DOUBLE) AS skip_pct, CAST(len(af) AS BIGINT) AS failure_count FROM r QUALIFY {NEWEST} <= 10""")  # fmt: skip
def recent_runs(spark, d):
    return analytics.recent_runs(measured_runs(spark, d, "created_at", "pr_number", "sha", "mode"))


@query("latest_n_per_repo", f"WITH {R} SELECT repo_id, ingest_seq, CAST({NEWEST} AS INTEGER) AS place FROM r QUALIFY {NEWEST} <= 5")
def latest_n_per_repo(spark, d):
    return analytics.latest_per_repo(counted_runs(spark, d, "created_at"), 5).select("repo_id", "ingest_seq", "place")


_ROLL = f"""roll AS (SELECT repo_id, ingest_seq, created_at, {RECALL.format(f='sum(failures) OVER w', m='sum(missed) OVER w')} AS recall FROM m WHERE created_at IS NOT NULL
  WINDOW w AS (PARTITION BY repo_id ORDER BY created_at, ingest_seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


@query("rolling_recall", f"WITH {R}, {_ROLL} SELECT repo_id, ingest_seq, recall FROM roll")
def rolling_recall(spark, d):
    return analytics.rolling_recall(measured_runs(spark, d, "created_at")).select("repo_id", "ingest_seq", "recall")


@query("alert_transitions", f"""WITH {R}, {_ROLL},
g AS (SELECT *, CASE WHEN recall < 0.95 THEN 'low' WHEN recall >= 0.98 THEN 'high' END AS signal FROM roll),
p AS (SELECT *, last_value(signal IGNORE NULLS) OVER (PARTITION BY repo_id ORDER BY created_at, ingest_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM g)
SELECT repo_id, ingest_seq, recall, CASE WHEN signal = 'low' AND prior IS DISTINCT FROM 'low' THEN 'fire' WHEN signal = 'high' AND prior = 'low' THEN 'recover' ELSE 'hold' END AS event FROM p""")  # fmt: skip
def alert_transitions(spark, d):
    return analytics.alert_transitions(measured_runs(spark, d, "created_at"))


@query("accuracy_report", f"""WITH {R} SELECT repo_id, coalesce({MEAN.format(x='CASE WHEN len(tt) > 0 THEN len(ps) / CAST(len(tt) AS DOUBLE) END')}, 0.0) AS skip_rate,
  {RECALL.format(f='sum(failures)', m='sum(missed)')} AS recall FROM m GROUP BY 1""")  # fmt: skip
def accuracy_report(spark, d):
    return analytics.accuracy_report(measured_runs(spark, d)).select("repo_id", "skip_rate", "recall")


@query("accuracy_floor", f"""WITH {R}, n AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY ingest_seq DESC) <= 20),
s AS (SELECT repo_id, count(*) AS runs_seen, {RECALL.format(f='sum(failures)', m='sum(missed)')} AS recall FROM n GROUP BY 1)
SELECT repo_id, runs_seen, recall, runs_seen >= 20 AND recall < 0.99 AS below_floor FROM s""")  # fmt: skip
def accuracy_floor(spark, d):
    return analytics.accuracy_floor(measured_runs(spark, d))


@query("dominant_repo", f"WITH {R} SELECT repo_id, count(*) AS runs FROM r GROUP BY 1 ORDER BY runs DESC, min(ingest_seq) LIMIT 1")
def dominant_repo(spark, d):
    return analytics.dominant_repo(counted_runs(spark, d))


@query("activity_gates", f"WITH {R} SELECT repo_id, count(*) AS run_count, count(*) < 100 AS dormant, count(*) % 7 = 0 AS backstop FROM r GROUP BY 1")
def activity_gates(spark, d):
    return analytics.activity_gates(counted_runs(spark, d))


@query("dedup_final", "SELECT ingest_seq, repo_id, id FROM runs QUALIFY row_number() OVER (PARTITION BY repo_id, created_at, id ORDER BY ingest_seq DESC) = 1")
def dedup_final(spark, d):
    return analytics.final_rows(table(spark, d, "runs").select("ingest_seq", "repo_id", "created_at", "id")).select("ingest_seq", "repo_id", "id")


# -- ingest --------------------------------------------------------------------------------------------------------

_BLANK = "({c} IS NULL OR trim(regexp_replace({c}, '\\s+', ' ', 'g')) = '')"


@query("ingest_validation", f"""SELECT ingest_seq, list_filter([
  CASE WHEN {_BLANK.format(c='id')} THEN 'id' END, CASE WHEN {_BLANK.format(c='repo_id')} THEN 'repo_id' END, CASE WHEN {_BLANK.format(c='sha')} THEN 'sha' END,
  CASE WHEN pr_number IS NULL THEN 'pr_number' END,
  CASE WHEN predicted_skip IS NULL OR len(list_filter(predicted_skip, lambda x: x IS NULL)) > 0 THEN 'predicted_skip' END,
  CASE WHEN actual_failures IS NULL OR len(list_filter(actual_failures, lambda x: x IS NULL)) > 0 THEN 'actual_failures' END,
  CASE WHEN all_tests IS NULL OR len(list_filter(all_tests, lambda x: x IS NULL)) > 0 THEN 'all_tests' END,
  CASE WHEN mode IS NULL OR mode NOT IN ('shadow', 'conservative', 'standard', 'aggressive') THEN 'mode' END,
  CASE WHEN created_at IS NULL THEN 'created_at' END], lambda x: x IS NOT NULL) AS problems FROM runs""")  # fmt: skip
def ingest_validation(spark, d):
    return ingest.validated(table(spark, d, "runs")).select("ingest_seq", "problems")


_VALID = f"""(NOT {_BLANK.format(c='id')} AND NOT {_BLANK.format(c='repo_id')} AND NOT {_BLANK.format(c='sha')} AND pr_number IS NOT NULL AND created_at IS NOT NULL
  AND predicted_skip IS NOT NULL AND len(list_filter(predicted_skip, lambda x: x IS NULL)) = 0 AND actual_failures IS NOT NULL AND len(list_filter(actual_failures, lambda x: x IS NULL)) = 0
  AND all_tests IS NOT NULL AND len(list_filter(all_tests, lambda x: x IS NULL)) = 0 AND coalesce(mode IN ('shadow', 'conservative', 'standard', 'aggressive'), false))"""
_EPOCHS = f"""span AS (SELECT min(batch_id) AS lo, max(batch_id) AS hi FROM runs),
valid AS (SELECT *, nullif(regexp_replace(lower(id), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '') AS k, CASE WHEN coalesce(batch_id, lo) <= lo + (hi - lo) * 0.7 THEN 1 WHEN coalesce(batch_id, lo) <= lo + (hi - lo) * 0.85 THEN 2 ELSE 3 END AS epoch
  FROM runs, span WHERE {_VALID}),
steps AS (SELECT e.step, v.* FROM valid v JOIN (VALUES (1), (2), (3)) e(step) ON v.epoch <= e.step),
kept AS (SELECT * FROM steps WHERE k IS NULL UNION ALL SELECT * FROM steps WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY step, repo_id, k ORDER BY ingest_seq) = 1),
m AS (SELECT *, len(list_filter(actual_failures, lambda f: list_contains(predicted_skip, f))) AS missed, len(actual_failures) AS failures FROM kept)"""


def _replayed(spark: SparkSession, d: str) -> tuple[str, list[DataFrame]]:
    """The deliveries through ingest in three batches: (root, events of each)."""
    root = state_path(spark, "ingest")
    at = F.lit(AS_OF).cast("timestamp")
    return root, [ingest_batch(part, root, n, now=at) for n, part in enumerate(in_epochs(table(spark, d, "runs"), "batch_id", (0.7, 0.85)))]


@query("ingest_alert_history", f"""WITH {_EPOCHS.replace("(VALUES (1), (2), (3))", "(VALUES (3))")}, {_ROLL},
g AS (SELECT *, CASE WHEN recall < 0.95 THEN 'low' WHEN recall >= 0.98 THEN 'high' END AS signal FROM roll),
p AS (SELECT *, last_value(signal IGNORE NULLS) OVER (PARTITION BY repo_id ORDER BY created_at, ingest_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM g)
SELECT repo_id, ingest_seq, recall, CASE WHEN signal = 'low' AND prior IS DISTINCT FROM 'low' THEN 'fire' WHEN signal = 'high' AND prior = 'low' THEN 'recover' ELSE 'hold' END AS event FROM p""")  # fmt: skip
def ingest_alert_history(spark, d):
    """Transitions over the table that ingest in batches leaves: the same as over all valid runs at once."""
    root, _ = _replayed(spark, d)
    kept = messages(spark, root).winners()
    return analytics.alert_transitions(kept.select("repo_id", "ingest_seq", "created_at", "predicted_skip", "actual_failures", "all_tests"))


@query("ingest_alert_events", f"""WITH {_EPOCHS},
newest AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY step, repo_id ORDER BY created_at DESC, ingest_seq DESC) <= 20),
recalls AS (SELECT step, repo_id, {RECALL.format(f='sum(failures)', m='sum(missed)')} AS recall FROM newest GROUP BY 1, 2),
seen AS (SELECT r.* FROM recalls r JOIN (SELECT DISTINCT epoch, repo_id FROM valid) v ON v.epoch = r.step AND v.repo_id = r.repo_id),
wide AS (SELECT repo_id, max(recall) FILTER (step = 1) AS r1, max(recall) FILTER (step = 2) AS r2, max(recall) FILTER (step = 3) AS r3 FROM seen GROUP BY 1),
s1 AS (SELECT *, CASE WHEN r1 < 0.95 THEN 'fire' END AS e1, coalesce(r1 < 0.95, false) AS a1 FROM wide),
s2 AS (SELECT *, CASE WHEN r2 < 0.95 AND NOT a1 THEN 'fire' WHEN r2 >= 0.98 AND a1 THEN 'recover' END AS e2, CASE WHEN r2 < 0.95 THEN true WHEN r2 >= 0.98 THEN false ELSE a1 END AS a2 FROM s1),
s3 AS (SELECT *, CASE WHEN r3 < 0.95 AND NOT a2 THEN 'fire' WHEN r3 >= 0.98 AND a2 THEN 'recover' END AS e3 FROM s2)
SELECT repo_id, step - 1 AS batch, recall, event FROM (SELECT repo_id, 1 AS step, r1 AS recall, e1 AS event FROM s1 UNION ALL SELECT repo_id, 2, r2, e2 FROM s2 UNION ALL SELECT repo_id, 3, r3, e3 FROM s3) WHERE event IS NOT NULL""")  # fmt: skip
def ingest_alert_events(spark, d):
    """What ingest in three batches sent out: alerts decided after each batch, from the state the batch before left."""
    _, events = _replayed(spark, d)
    out = [e.select("repo_id", F.lit(n).alias("batch"), "recall", "event") for n, e in enumerate(events)]
    return functools.reduce(DataFrame.unionByName, out)


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Deliveries up to the middle batch number, and the later ones."""
    rows = table(spark, d, "runs").select("ingest_seq", "batch_id", "id", "repo_id", "mode")
    low, high = rows.agg(F.min("batch_id"), F.max("batch_id")).first()
    middle = ((low or 0) + (high or 0)) // 2
    return rows.where(F.col("batch_id") <= middle), rows.where(F.col("batch_id") > middle)


_HALF = "mid AS (SELECT (min(batch_id) + max(batch_id)) // 2 AS b FROM runs)"


@query("run_exists_antijoin", f"""WITH {_HALF} SELECT n.ingest_seq FROM runs n, mid WHERE n.batch_id > mid.b
  AND NOT EXISTS (SELECT 1 FROM runs o WHERE o.batch_id <= (SELECT b FROM mid) AND o.id = n.id AND o.repo_id = n.repo_id)""")  # fmt: skip
def run_exists_antijoin(spark, d):
    known, incoming = _halves(spark, d)
    return ingest.unknown_only(incoming, known, ["id", "repo_id"]).select("ingest_seq")


@query("upsert_latest", "SELECT repo_id, id, ingest_seq, mode FROM runs QUALIFY row_number() OVER (PARTITION BY repo_id, id ORDER BY ingest_seq DESC) = 1")
def upsert_latest(spark, d):
    known, incoming = _halves(spark, d)
    return ingest.upsert(known, incoming, ["repo_id", "id"], "ingest_seq").select("repo_id", "id", "ingest_seq", "mode")


@query("derived_minutes", """SELECT ingest_seq, coalesce(CAST(time_saved_minutes AS DOUBLE), len(coalesce(predicted_skip, [])) * 0.5) AS time_saved_minutes,
  epoch_us(date_trunc('millisecond', created_at)) AS created_us FROM runs""")  # fmt: skip
def derived_minutes(spark, d):
    return ingest.derive(table(spark, d, "runs")).select("ingest_seq", "time_saved_minutes", F.unix_micros("created_at").alias("created_us"))


# -- graphs --------------------------------------------------------------------------------------------------------

_LINKS = r"""raw AS (SELECT result_id, e.key AS p, unnest(e.value) AS c FROM (SELECT result_id, unnest(map_entries(dependency_graph)) AS e FROM layer1_results)),
links AS (SELECT DISTINCT * FROM (
  SELECT result_id, array_to_string(list_filter(string_split(replace(p, '\', '/'), '/'), lambda s: s NOT IN ('', '.')), '/') AS src,
         array_to_string(list_filter(string_split(replace(c, '\', '/'), '/'), lambda s: s NOT IN ('', '.')), '/') AS dst FROM raw WHERE c IS NOT NULL)
  WHERE src <> '' AND dst <> '')"""
_FILES = r"""named AS (SELECT result_id, array_to_string(list_filter(string_split(replace(e.key, '\', '/'), '/'), lambda s: s NOT IN ('', '.')), '/') AS path
  FROM (SELECT result_id, unnest(map_entries(dependency_graph)) AS e FROM layer1_results)),
k AS (SELECT result_id, path, 1 AS k FROM named WHERE path <> '' UNION ALL SELECT result_id, dst, 0 FROM links),
dist AS (SELECT result_id, path, CAST(CASE WHEN max(k) = 1 THEN 0.0 ELSE 0.2 END AS DOUBLE) AS distance FROM k GROUP BY 1, 2)"""
#: changed files of a graph: those that are imported and import nothing
_SEEDS = "seeds AS (SELECT DISTINCT result_id, dst AS f FROM links l WHERE NOT EXISTS (SELECT 1 FROM links m WHERE m.result_id = l.result_id AND m.src = l.dst))"
_IS_TEST = r"""(strpos({p}, '/__tests__/') > 0 OR regexp_matches({p}, '\.(test|spec)\.(ts|tsx|js)$') OR {p} LIKE '%\_test.go' ESCAPE '\' OR {p} LIKE '%\_spec.rb' ESCAPE '\'
  OR regexp_matches({p}, '(^|/)test_[^/]*\.py$') OR regexp_matches({p}, '_test\.py$'))"""


@query("import_links", f"WITH {_LINKS} SELECT result_id, src, dst FROM links")
def import_links(spark, d):
    return graph.links(table(spark, d, "layer1_results"))


def _changed(graphs: DataFrame) -> DataFrame:
    """Each graph with its changed files: those that are imported and import nothing."""
    links = graph.links(graphs)
    leaves = links.select("result_id", F.col("dst").alias("f")).join(links.select("result_id", F.col("src").alias("f")), ["result_id", "f"], "left_anti")
    return graphs.select("result_id", "dependency_graph").join(leaves.groupBy("result_id").agg(F.collect_set("f").alias("changed")), "result_id")


@query("blocking_candidates", f"""WITH RECURSIVE {_LINKS}, {_SEEDS},
walk(result_id, f) AS (SELECT result_id, f FROM seeds UNION SELECT w.result_id, l.src FROM walk w JOIN links l ON l.result_id = w.result_id AND l.dst = w.f)
SELECT result_id, f AS test_path FROM walk WHERE {_IS_TEST.format(p='f')}""")  # fmt: skip
def blocking_candidates(spark, d):
    return graph.blocking_tests(_changed(table(spark, d, "layer1_results")))


@query("graph_distance", f"WITH {_LINKS}, {_FILES} SELECT result_id, path, distance FROM dist")
def graph_distance(spark, d):
    return graph.key_distance(graph.file_links(table(spark, d, "layer1_results")))


@query("customer_reach", """WITH RECURSIVE edges AS (SELECT DISTINCT o_custkey AS src, (o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM customer) AS dst FROM orders),
walk(node) AS (SELECT * FROM (VALUES (CAST(7 AS BIGINT)), (77), (100)) UNION SELECT e.src FROM walk w JOIN edges e ON e.dst = w.node) SELECT node FROM walk""")  # fmt: skip
def customer_reach(spark, d):
    n = table(spark, d, "customer").count()
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % n).alias("dst"))
    return graph.dependents(edges, spark.createDataFrame([(7,), (77,), (100,)], "node bigint")).select("node")


@query("is_test_file", f"WITH {_LINKS}, {_FILES} SELECT DISTINCT path, {_IS_TEST.format(p='path')} AS is_test FROM k")
def test_files(spark, d):
    files = graph.files(table(spark, d, "layer1_results")).select("path").distinct()
    return files.select("path", is_test_file("path").alias("is_test"))


@query("run_full_suite", f"""WITH {_LINKS}, {_FILES} SELECT result_id,
  coalesce(bool_or(regexp_matches(path, '^(.*/)?[^/]*\\.types\\.ts$') OR regexp_matches(path, '^(.*/)?[^/]*Core\\.[^/]*$')), false) AS full_suite
  FROM (SELECT DISTINCT result_id FROM layer1_results) LEFT JOIN k USING (result_id) GROUP BY 1""")  # fmt: skip
def run_full_suite(spark, d):
    """One row a graph; a graph without files matches nothing."""
    graphs = table(spark, d, "layer1_results")
    found = graph.files(graphs).groupBy("result_id").agg(F.bool_or(matches_any("path", FULL_SUITE_GLOBS)).alias("full_suite"))
    return graphs.select("result_id").distinct().join(found, "result_id", "left").select("result_id", F.coalesce("full_suite", F.lit(False)).alias("full_suite"))


# -- vectors -------------------------------------------------------------------------------------------------------

_BAND = "CASE WHEN {s} > 0.85 THEN 'high' WHEN {s} BETWEEN 0.3 AND 0.7 THEN 'medium' ELSE 'low' END"
_COS = """v AS (SELECT b.vec_id AS query_id, a.vec_id AS key, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) b),
c AS (SELECT query_id, key, least(1.0, greatest(-1.0, list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y))))) AS score FROM v)"""
_HAM = """bits AS (SELECT vec_id, list_sum(list_transform(embedding, lambda e, i: CASE WHEN e > 0 THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS INTEGER) ELSE CAST(0 AS HUGEINT) END)) AS s FROM embeddings),
h AS (SELECT b.vec_id AS query_id, a.vec_id AS key, CAST(bit_count(xor(a.s, b.s)) AS INTEGER) AS distance FROM bits a, (SELECT * FROM bits WHERE vec_id % 100 = 0) b),
near AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, key) <= 50)"""


def _vectors(spark, d):
    """All vectors, and of these the queries: every hundredth id."""
    v = table(spark, d, "embeddings")
    return v, v.where("vec_id % 100 = 0")


@query("cosine_bands", f"WITH {_COS} SELECT query_id, key, round(score, 6) AS score, {_BAND.format(s='score')} AS band FROM c")
def cosine_bands(spark, d):
    return retrieval.cosine_bands(*_vectors(spark, d)).withColumn("score", F.round("score", 6))


@query("hamming_topk", f"WITH {_HAM} SELECT query_id, key, distance FROM near")
def hamming_topk(spark, d):
    return retrieval.hamming_nearest(*_vectors(spark, d))


@query("cosine_topk", f"WITH {_COS} SELECT query_id, key, round(score, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) <= 50")
def cosine_topk(spark, d):
    return retrieval.cosine_nearest(*_vectors(spark, d)).withColumn("score", F.round("score", 6))


@query("tiered_retrieval", f"WITH {_COS}, {_HAM} SELECT query_id, key, round(score, 6) AS score, {_BAND.format(s='score')} AS band FROM c JOIN near USING (query_id, key)")
def tiered_retrieval(spark, d):
    return retrieval.tiered(*_vectors(spark, d)).withColumn("score", F.round("score", 6))


@query("embedding_cache", """SELECT doc_id, CAST('0x' || substr(sha256(text), 1, 4) AS INTEGER) % 3 <> 0 AS hit, 'sha256:' || sha256(text) || ':dim4' AS key
  FROM documents WHERE text IS NOT NULL""")  # fmt: skip
def embedding_cache(spark, d):
    """Hits and misses of a cache that holds about two thirds of the contents, by their digest; copies share an entry."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("content"))
    held = docs.select(F.sha2("content", 256).alias("sha"), retrieval.content_key("content", 4).alias("key")).where(F.conv(F.substring("sha", 1, 4), 16, 10).cast("int") % 3 != 0)
    cache = held.select("key", F.array(*[F.lit(0.5)] * 4).alias("vector"), F.lit(4).alias("dim"), F.lit("stub").alias("model"))
    hits, misses = retrieval.cache_lookup(docs, cache, 4)
    return hits.select("doc_id", F.lit(True).alias("hit"), "key").unionByName(misses.select("doc_id", F.lit(False).alias("hit"), "key"))


# -- selection -----------------------------------------------------------------------------------------------------


def _bands(spark, d) -> DataFrame:
    """One score a test, from the leaderboard rows, in bands."""
    rows = table(spark, d, "flaky_rows").where("flake_score is not null and not isnan(flake_score)")
    best = rows.groupBy("repo_id", "test_path").agg(F.max("flake_score").alias("score"))
    return best.withColumn("band", F.when(F.col("score") > 0.85, "high").when((F.col("score") >= 0.3) & (F.col("score") <= 0.7), "medium").otherwise("low"))


def _candidates(spark, d) -> DataFrame:
    """Scored tests with their least distance in any graph of their repository; none where no graph has the file."""
    graphs = table(spark, d, "layer1_results")
    near = graph.key_distance(graph.file_links(graphs)).join(graphs.select("result_id", "repo_id"), "result_id")
    near = near.groupBy("repo_id", F.col("path").alias("test_path")).agg(F.min("distance").alias("distance"))
    return _bands(spark, d).select("repo_id", "test_path", F.col("score").alias("similarity")).join(near, ["repo_id", "test_path"], "left")


def _tests(spark, d) -> DataFrame:
    return table(spark, d, "tests").select("repo_id", F.col("path").alias("test_path"), "flake_score")


def _decided(spark, d) -> DataFrame:
    """Decisions on the medium band by folder name."""
    kind = F.when(F.col("test_path").contains("e2e"), "blocking").when(F.col("test_path").contains("unit"), "skip").otherwise("recommended")
    return _bands(spark, d).where("band = 'medium'").select("repo_id", "test_path", kind.alias("classification"))


def _graph_hits(spark, d) -> DataFrame:
    graphs = table(spark, d, "layer1_results")
    hits = graph.blocking_tests(_changed(graphs)).join(graphs.select("result_id", "repo_id"), "result_id")
    return hits.select("repo_id", "test_path").distinct()


_MERGE = f"""{_LINKS}, {_SEEDS},
walk(result_id, f) AS (SELECT result_id, f FROM seeds UNION SELECT w.result_id, l.src FROM walk w JOIN links l ON l.result_id = w.result_id AND l.dst = w.f),
hits AS (SELECT DISTINCT g.repo_id, w.f AS test_path FROM walk w JOIN layer1_results g ON g.result_id = w.result_id WHERE {_IS_TEST.format(p='w.f')}),
best AS (SELECT repo_id, test_path, max(flake_score) AS score FROM flaky_rows WHERE flake_score IS NOT NULL AND NOT isnan(flake_score) GROUP BY 1, 2),
bands AS (SELECT *, {_BAND.format(s='score')} AS band FROM best),
decided AS (SELECT repo_id, test_path, CASE WHEN contains(test_path, 'e2e') THEN 'blocking' WHEN contains(test_path, 'unit') THEN 'skip' ELSE 'recommended' END AS classification FROM bands WHERE band = 'medium'),
blocking AS (SELECT repo_id, test_path FROM hits UNION SELECT repo_id, test_path FROM bands WHERE band = 'high' UNION SELECT repo_id, test_path FROM decided WHERE classification = 'blocking'),
recommended AS (SELECT DISTINCT repo_id, test_path FROM decided WHERE classification = 'recommended' EXCEPT SELECT repo_id, test_path FROM blocking),
placed AS (SELECT * FROM blocking UNION SELECT * FROM recommended),
free AS (SELECT t.repo_id, t.path AS test_path, t.flake_score, row_number() OVER (PARTITION BY t.repo_id ORDER BY t.path, t.flake_score NULLS FIRST) AS place
  FROM tests t WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.repo_id = t.repo_id AND p.test_path = t.path)),
total AS (SELECT repo_id, count(*) AS n FROM tests GROUP BY 1),
buckets AS (SELECT repo_id, test_path, 'blocking' AS bucket FROM blocking UNION ALL SELECT repo_id, test_path, 'recommended' FROM recommended
  UNION ALL SELECT f.repo_id, f.test_path, 'skip' FROM free f JOIN total USING (repo_id) WHERE f.place <= floor(total.n * 0.5) AND coalesce(f.flake_score, 0.0) <= 0.02)"""


def _buckets(spark, d) -> DataFrame:
    return merge.merge_layers(_tests(spark, d), _graph_hits(spark, d), _bands(spark, d), _decided(spark, d), mode="standard", quarantine=0.02)


@query("merge_selection", f"WITH RECURSIVE {_MERGE} SELECT repo_id, test_path, bucket FROM buckets")
def merge_selection(spark, d):
    return _buckets(spark, d)


@query("selection_metrics", f"""WITH RECURSIVE {_MERGE}, mean AS (SELECT repo_id, {MEAN.format(x='score')} AS confidence FROM bands GROUP BY 1)
SELECT b.repo_id, CAST(count_if(bucket = 'blocking') AS BIGINT) AS blocking, CAST(count_if(bucket = 'recommended') AS BIGINT) AS recommended, CAST(count_if(bucket = 'skip') AS BIGINT) AS skipped,
  coalesce(any_value(confidence), 0.0) AS confidence, CAST(count_if(bucket = 'skip') * 0.5 AS DOUBLE) AS minutes_saved FROM buckets b LEFT JOIN mean ON mean.repo_id = b.repo_id GROUP BY 1""")  # fmt: skip
def selection_metrics(spark, d):
    return merge.selection_metrics(_buckets(spark, d), _bands(spark, d))


@query("logged_tests", f"""WITH RECURSIVE {_MERGE} SELECT repo_id, list_concat(coalesce(list(test_path ORDER BY test_path) FILTER (bucket = 'blocking'), []),
  coalesce(list(test_path ORDER BY test_path) FILTER (bucket = 'recommended'), []), coalesce(list(test_path ORDER BY test_path) FILTER (bucket = 'skip'), [])) AS all_tests FROM buckets GROUP BY 1""")  # fmt: skip
def logged_tests(spark, d):
    return merge.logged_tests(_buckets(spark, d))


_PASSES = """p AS (SELECT repo_id, test_path, total_runs % 3 AS pass, coalesce(total_runs, 0) AS position,
  CASE WHEN flake_score > 0.3 THEN 'blocking' WHEN flake_score > 0.05 THEN 'recommended' ELSE 'skip' END AS classification FROM flaky_rows WHERE total_runs IS NOT NULL AND flake_score IS NOT NULL AND NOT isnan(flake_score)),
k AS (SELECT *, CASE classification WHEN 'blocking' THEN 2 WHEN 'recommended' THEN 1 ELSE 0 END AS rank FROM p)"""


@query("consensus_union", f"WITH {_PASSES} SELECT repo_id, test_path, classification, pass FROM k QUALIFY row_number() OVER (PARTITION BY repo_id, test_path ORDER BY rank DESC, pass, position) = 1")
def consensus_union(spark, d):
    rows = table(spark, d, "flaky_rows").where("total_runs is not null and flake_score is not null and not isnan(flake_score)")
    kind = F.when(F.col("flake_score") > 0.3, "blocking").when(F.col("flake_score") > 0.05, "recommended").otherwise("skip")
    return merge.consensus(rows.select("repo_id", "test_path", (F.col("total_runs") % 3).alias("pass"), F.col("total_runs").alias("position"), kind.alias("classification")))


@query("pass_permutations", """SELECT result_id, list_sort(b) AS sorted, list_reverse(list_sort(b)) AS reversed,
  list_concat(list_filter(list_sort(b), lambda x, i: i % 2 = 1), list_filter(list_sort(b), lambda x, i: i % 2 = 0)) AS interleaved
  FROM (SELECT result_id, coalesce(blocking_candidates, []) AS b FROM layer1_results)""")  # fmt: skip
def pass_permutations(spark, d):
    rows = table(spark, d, "layer1_results").select("result_id", F.coalesce("blocking_candidates", F.array().cast("array<string>")).alias("b"))
    return rows.select("result_id", *(c.alias(n) for n, c in merge.pass_orders("b").items()))


# -- features ------------------------------------------------------------------------------------------------------


@query("serving_features", f"""WITH {R}, {_LINKS}, {_FILES},
near AS (SELECT g.repo_id, t.path AS test_path, min(t.distance) AS distance FROM dist t JOIN layer1_results g ON g.result_id = t.result_id GROUP BY 1, 2), lim AS (SELECT TIMESTAMPTZ '{AS_OF}+00' AS t),
cand AS (SELECT repo_id, test_path, max(flake_score) AS similarity FROM flaky_rows WHERE flake_score IS NOT NULL AND NOT isnan(flake_score) GROUP BY 1, 2),
repo AS (SELECT repo_id, count(*) AS n, count(DISTINCT CASE WHEN created_at > lim.t - INTERVAL 30 DAY AND created_at <= lim.t THEN pr_number END) AS prs FROM r, lim GROUP BY 1),
fx AS (SELECT repo_id, created_at, unnest(list_distinct(af)) AS test_path FROM r),
fail AS (SELECT repo_id, test_path, count(*) AS fails, max(created_at) AS last FROM fx GROUP BY 1, 2),
known AS (SELECT repo_id, path AS test_path, min(flake_score) AS flake, min(avg_duration_ms) AS ms FROM tests GROUP BY 1, 2)
SELECT c.repo_id, c.test_path, c.similarity AS embedding_similarity, coalesce(near.distance, 0.0) AS graph_distance, CASE WHEN n > 0 THEN coalesce(fails, 0) / CAST(n AS DOUBLE) ELSE 0.0 END AS failure_rate,
  coalesce(least((epoch_us(lim.t) - epoch_us(last)) / CAST(86400000000 AS DOUBLE), 365.0) / 365, 1.0) AS days_since_failure, coalesce(flake, 0.0) AS flakiness,
  coalesce(least(ms / 60000, 1.0), 0.0) AS exec_time, least(coalesce(prs, 0) / CAST(30 AS DOUBLE), 1.0) AS file_churn, CAST(0 AS DOUBLE) AS author_defect_rate
FROM cand c CROSS JOIN lim LEFT JOIN repo USING (repo_id) LEFT JOIN fail USING (repo_id, test_path) LEFT JOIN known USING (repo_id, test_path) LEFT JOIN near USING (repo_id, test_path)""")  # fmt: skip
def serving_features(spark, d):
    runs = counted_runs(spark, d, "created_at", "pr_number", "actual_failures")
    return features.serving_features(_candidates(spark, d), runs, table(spark, d, "tests"), F.lit(AS_OF).cast("timestamp"))


@query("training_features", f"""WITH {R}, x AS (SELECT repo_id, ingest_seq, pr_number, created_at, af, unnest(list_distinct(tt)) AS test_path FROM r WHERE created_at IS NOT NULL),
y AS (SELECT repo_id, ingest_seq, pr_number, created_at, test_path, CAST(list_contains(af, test_path) AS INTEGER) AS label FROM x WHERE test_path IS NOT NULL),
z AS (SELECT *, sum(label) OVER t AS fails, count(*) OVER t AS n, max(CASE WHEN label = 1 THEN epoch_us(created_at) END) OVER u AS last,
    max(epoch_us(created_at)) OVER (PARTITION BY repo_id, test_path, pr_number) AS pr_last FROM y
  WINDOW t AS (PARTITION BY repo_id, test_path), u AS (PARTITION BY repo_id, test_path ORDER BY epoch_us(created_at) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
q AS (SELECT DISTINCT repo_id, test_path, pr_number, pr_last FROM z WHERE pr_number IS NOT NULL),
a AS (SELECT z.repo_id, z.test_path, z.ingest_seq, count(q.pr_number) AS prs FROM z LEFT JOIN q ON q.repo_id = z.repo_id AND q.test_path = z.test_path AND q.pr_last >= epoch_us(z.created_at) - 2592000000000 GROUP BY 1, 2, 3)
SELECT z.repo_id, z.ingest_seq, z.test_path, label, fails / CAST(n AS DOUBLE) AS embedding_similarity, fails / CAST(n AS DOUBLE) AS failure_rate, CAST('0x' || substr(md5(z.test_path), 1, 4) AS INTEGER) % 6 / CAST(5 AS DOUBLE) AS graph_distance,
  coalesce(least((epoch_us(created_at) - last) / CAST(86400000000 AS DOUBLE), 365.0) / 365, 1.0) AS days_since_failure, CAST(CASE WHEN fails > 0 AND fails < n THEN 1 ELSE 0 END AS DOUBLE) AS flakiness,
  CAST(0.1 AS DOUBLE) AS exec_time, least(prs / CAST(30 AS DOUBLE), 1.0) AS file_churn, CAST(0 AS DOUBLE) AS author_defect_rate
FROM z JOIN a ON a.repo_id = z.repo_id AND a.test_path = z.test_path AND a.ingest_seq = z.ingest_seq""")  # fmt: skip
def training_features(spark, d):
    return features.training_features(counted_runs(spark, d, "created_at", "pr_number", "actual_failures", "all_tests"))


@query("label_distribution", f"""WITH {R}, x AS (SELECT af, unnest(list_distinct(tt)) AS t FROM r WHERE created_at IS NOT NULL)
SELECT count(*) AS rows, CAST(sum(CAST(list_contains(af, t) AS INTEGER)) AS BIGINT) AS positives, sum(CAST(list_contains(af, t) AS INTEGER)) / CAST(count(*) AS DOUBLE) AS positive_share FROM x WHERE t IS NOT NULL""")  # fmt: skip
def label_distribution(spark, d):
    rows = features.training_features(counted_runs(spark, d, "created_at", "pr_number", "actual_failures", "all_tests"))
    return model.label_shares(rows)


@query("ml_scores")
def ml_scores(spark, d):
    """A booster fitted on the training features, applied to the serving ones and ranked."""
    runs = counted_runs(spark, d, "created_at", "pr_number", "actual_failures", "all_tests")
    fitted = model.fit(features.training_features(runs))
    serving = features.serving_features(_candidates(spark, d), runs, table(spark, d, "tests"), F.lit(AS_OF).cast("timestamp"))
    return model.ranked(model.scored(fitted, serving), analytics.activity_gates(runs))


# -- diffs and decisions -------------------------------------------------------------------------------------------

_DIFF = r"""l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents),
c AS (SELECT doc_id, text, len(list_filter(x, lambda y: regexp_matches(y, '^\+(?:(?:export\s+)?(?:function|class)\s|(?:export\s+)?const\s+\w+\s*=\s*\()'))) AS added,
  len(list_filter(x, lambda y: y LIKE '-%' AND y NOT LIKE '---%')) AS removed,
  len(list_filter(x, lambda y: regexp_matches(y, '^[+-]') AND y NOT LIKE '+++%' AND y NOT LIKE '---%')) AS effective FROM l)"""


@query("diff_type", f"""WITH {_DIFF} SELECT doc_id, CASE WHEN text IS NULL OR trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' OR (added = 0 AND removed = 0) THEN 'unknown'
  WHEN added > removed THEN 'feature' ELSE 'bugfix' END AS kind, CAST(coalesce(effective, 0) AS BIGINT) AS effective FROM c""")  # fmt: skip
def diff_type(spark, d):
    return diffs.classified(table(spark, d, "documents"), key="doc_id", diff="text")


@query("diff_truncation", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS y, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
e AS (SELECT *, sum(CASE WHEN regexp_matches(y, '^[+-]') AND y NOT LIKE '+++%' AND y NOT LIKE '---%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n,
  regexp_matches(y, '^[+-]') AND y NOT LIKE '+++%' AND y NOT LIKE '---%' AS eff FROM l)
SELECT doc_id, md5(string_agg(y, chr(10) ORDER BY i) FILTER (NOT eff OR n <= 2000)) AS digest, md5(coalesce(string_agg(y, chr(10) ORDER BY i) FILTER (NOT eff OR n <= 2), '')) AS digest_2 FROM e GROUP BY 1""")  # fmt: skip
def diff_truncation(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(diffs.truncated("text")).alias("digest"), F.md5(diffs.truncated("text", 2)).alias("digest_2"))


_JSON = r"""\{"decisions":\[.*\]\}"""


@query("strict_decisions", r"""WITH j AS (SELECT doc_id, unnest(regexp_extract_all(text, '\{"decisions":\[.*\]\}')) AS body, generate_subscripts(regexp_extract_all(text, '\{"decisions":\[.*\]\}'), 1) AS answer FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, answer, CASE WHEN json_valid(body) THEN json_extract(CAST(body AS JSON), '$.decisions[*]') END AS b FROM j),
w AS (SELECT *, len(list_filter(b, lambda x: json_type(x, '$.test_path') = 'VARCHAR' AND json_type(x, '$.reasoning') = 'VARCHAR' AND json_type(x, '$.confidence') IN ('DOUBLE', 'BIGINT', 'UBIGINT')
  AND json_type(x, '$.classification') = 'VARCHAR' AND json_extract_string(x, '$.classification') IN ('blocking', 'recommended', 'skip'))) AS good FROM v)
SELECT doc_id, CAST(answer - 1 AS INTEGER) AS answer, CASE WHEN b IS NULL OR good < len(b) THEN NULL ELSE CAST(len(b) AS BIGINT) END AS decisions FROM w""")  # fmt: skip
def strict_decisions(spark, d):
    """Every answer in every text, with its number of decisions, null if any of it isn't as agreed."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(_JSON), F.lit(0))).alias("answer", "body")
    parsed = table(spark, d, "documents").where("text is not null").select("doc_id", found).withColumn("p", decisions.decisions_of("body"))
    return parsed.select("doc_id", "answer", F.when(F.col("p").isNotNull(), F.size("p").cast("bigint")).alias("decisions"))


@query("classified_candidates", f"""WITH best AS (SELECT repo_id, test_path, max(flake_score) AS score FROM flaky_rows WHERE flake_score IS NOT NULL AND NOT isnan(flake_score) GROUP BY 1, 2)
SELECT repo_id, test_path, CASE WHEN contains(test_path, 'e2e') THEN 'blocking' WHEN contains(test_path, 'unit') THEN 'skip' ELSE 'recommended' END AS classification FROM best WHERE score BETWEEN 0.3 AND 0.7""")  # fmt: skip
def classified_candidates(spark, d):
    """The medium band through the offline classifier."""
    return decisions.classify(_bands(spark, d).where("band = 'medium'"), decisions.rule_answer).select("repo_id", "test_path", "classification")


@query("orchestrated_selection")
def orchestrated_selection(spark, d):
    """All layers over the repositories that have a graph: changed are the files of the latest graph that are imported and import nothing, a test's text is its path."""
    graphs = table(spark, d, "layer1_results").where("dependency_graph is not null")
    latest = graphs.groupBy("repo_id").agg(F.max_by("result_id", "result_id").alias("result_id"))
    graphs = graphs.join(latest, ["repo_id", "result_id"])
    changes = _changed(graphs).join(graphs.select("result_id", "repo_id"), "result_id")
    added = F.array_join(F.transform(F.array_sort("changed"), lambda f: F.concat(F.lit("+"), F.regexp_replace(f, "[^A-Za-z]+", " "))), "\n")
    words = table(spark, d, "flaky_rows").select("repo_id", F.col("test_path").alias("path")).distinct().withColumn("content", F.regexp_replace("path", "[^A-Za-z]+", " "))
    runs = counted_runs(spark, d, "created_at", "pr_number", "actual_failures", "all_tests")
    found = orchestrate(changes.select("repo_id", added.alias("diff"), "changed"), graphs, words, runs, table(spark, d, "tests"), SelectionConfig(mode="standard"), embedder=hashing_embedder(64), dim=64, as_of=F.lit(AS_OF).cast("timestamp"))
    if found.failed:
        raise RuntimeError(f"failed layers: {found.failed}")
    return found.buckets
