"""Queries of sources, sinks, streams and of the smaller steps around a selection."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from runweave.operators import analytics, merge, model, prompts
from runweave.plans.core_queries import counted_runs, measured_runs
from runweave.plans.reference_queries import _EPOCHS, _MERGE, AS_OF, RECALL, WEEK, R, _bands, _decided, _graph_hits, _tests
from runweave.session import state_path
from runweave.sources import run_log
from runweave.sources.tables import stream, table
from runweave.streaming import runs as streams
from runweave.streaming.ingest import messages

QUERIES: dict = {}
ORACLE: dict = {}
LARGE = "quillmoor/harbor-monolith"


def query(name: str, sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


# -- sources and sinks ---------------------------------------------------------------------------------------------


@query("run_log_round_trip", """SELECT repo_id, id, pr_number, sha, mode, epoch_us(date_trunc('millisecond', created_at)) AS created_us, CAST(time_saved_minutes AS DOUBLE) AS minutes,
  coalesce(len(all_tests), -1) AS tests, md5(coalesce(array_to_string(all_tests, ','), '')) AS digest FROM runs""")  # fmt: skip
def run_log_round_trip(spark: SparkSession, d: str):
    """All runs written as JSON lines and read back."""
    path = state_path(spark, "log")
    run_log.append_run_log(table(spark, d, "runs").select(*run_log.RUN.names), path)
    back = run_log.read_run_log(spark, path)
    tests = F.coalesce(F.when(F.col("all_tests").isNotNull(), F.size("all_tests")), F.lit(-1)).cast("bigint")
    digest = F.md5(F.coalesce(F.array_join("all_tests", ","), F.lit("")))
    return back.select("repo_id", "id", "pr_number", "sha", "mode", F.unix_micros("created_at").alias("created_us"), F.col("time_saved_minutes").cast("double").alias("minutes"), tests.alias("tests"), digest.alias("digest"))


@query("runs_by_month", """SELECT repo_id, strftime(created_at AT TIME ZONE 'UTC', '%Y%m') AS month, count(*) AS runs FROM runs GROUP BY 1, 2""")
def runs_by_month(spark: SparkSession, d: str):
    """All runs written in the table's layout; counts of its partitions."""
    path = state_path(spark, "runs")
    run_log.write_runs(table(spark, d, "runs"), path)
    back = spark.read.schema("id string, repo_id string, yyyymm string").parquet(path)
    return back.groupBy("repo_id", F.col("yyyymm").alias("month")).agg(F.count(F.lit(1)).alias("runs"))


# -- streams -------------------------------------------------------------------------------------------------------


@query("streamed_weeks", f"""SELECT repo_id, {WEEK} AS week, count(*) AS runs, sum(CASE WHEN NOT isnan(time_saved_minutes) THEN CAST(time_saved_minutes AS DOUBLE) END) AS minutes_saved
  FROM runs WHERE created_at IS NOT NULL GROUP BY 1, 2""")  # fmt: skip
def streamed_weeks(spark: SparkSession, d: str):
    """Weekly totals of a stream of runs, in complete mode."""
    rows = stream(spark, d, "runs").select("repo_id", "created_at", "time_saved_minutes").where("created_at is not null")
    return streams.drained(streams.weekly_stream(rows), f"weeks_{uuid.uuid4().hex}", "complete")


@query("streamed_alerts", f"""WITH m AS (SELECT *, len(list_filter(af, lambda f: list_contains(ps, f))) AS missed, len(af) AS failures
  FROM (SELECT *, coalesce(predicted_skip, []) AS ps, coalesce(actual_failures, []) AS af FROM runs WHERE repo_id IS NOT NULL AND created_at IS NOT NULL)),
roll AS (SELECT repo_id, ingest_seq, created_at, {RECALL.format(f='sum(failures) OVER w', m='sum(missed) OVER w')} AS recall FROM m
  WINDOW w AS (PARTITION BY repo_id ORDER BY created_at, ingest_seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, CASE WHEN recall < 0.95 THEN 'low' WHEN recall >= 0.98 THEN 'high' END AS signal FROM roll),
p AS (SELECT *, last_value(signal IGNORE NULLS) OVER (PARTITION BY repo_id ORDER BY created_at, ingest_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM g),
e AS (SELECT repo_id, ingest_seq, recall, CASE WHEN signal = 'low' AND prior IS DISTINCT FROM 'low' THEN 'fire' WHEN signal = 'high' AND prior = 'low' THEN 'recover' END AS event FROM p)
SELECT * FROM e WHERE event IS NOT NULL""")  # fmt: skip
def streamed_alerts(spark: SparkSession, d: str):
    """Alerts of a stream of deliveries, by keyed state."""
    rows = stream(spark, d, "runs").select("repo_id", "ingest_seq", "created_at", "predicted_skip", "actual_failures")
    return streams.drained(streams.alert_stream(rows), f"alerts_{uuid.uuid4().hex}")


@query("streamed_ingest", f"""WITH {_EPOCHS} SELECT ingest_seq, repo_id, coalesce(CAST(time_saved_minutes AS DOUBLE), len(predicted_skip) * 0.5) AS time_saved_minutes, epoch_us(date_trunc('millisecond', created_at)) AS created_us
  FROM kept WHERE step = 3""")  # fmt: skip
def streamed_ingest(spark: SparkSession, d: str):
    """What the message table holds after a stream of all deliveries."""
    root = state_path(spark, "streamed")
    rows = stream(spark, d, "runs")
    streams.ingest_stream(rows, root, f"{root}/mark").awaitTermination()
    return messages(spark, root).winners().select("ingest_seq", "repo_id", "time_saved_minutes", F.unix_micros("created_at").alias("created_us"))


# -- around a selection --------------------------------------------------------------------------------------------


@query("runs_of_repo", f"WITH {R} SELECT ingest_seq, pr_number, CAST(len(af) AS BIGINT) AS failures FROM r WHERE repo_id = '{LARGE}'")
def runs_of_repo(spark: SparkSession, d: str):
    return analytics.for_repo(measured_runs(spark, d, "pr_number"), LARGE).select("ingest_seq", "pr_number", F.col("n_failed").alias("failures"))


@query("retrain_due", f"""WITH {R}, g AS (SELECT repo_id, count(*) AS run_count, max(created_at) AS last FROM r GROUP BY 1)
SELECT repo_id, run_count >= 100 AND (last IS NULL OR epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(last) >= 7 * 86400000000) AS due FROM g WHERE repo_id IS NOT NULL""")  # fmt: skip
def retrain_due(spark: SparkSession, d: str):
    """Repositories whose model is due, if each was last trained with its newest run."""
    runs = counted_runs(spark, d, "created_at").where("repo_id is not null")
    return analytics.retrain_due(analytics.activity_gates(runs), runs.select("repo_id", F.col("created_at").alias("trained_at")), F.lit(AS_OF).cast("timestamp"))


@query("effective_modes", f"""WITH {R}, n AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY ingest_seq DESC) <= 20),
s AS (SELECT repo_id, count(*) AS k, {RECALL.format(f='sum(failures)', m='sum(missed)')} AS recall FROM n GROUP BY 1)
SELECT repo_id, CASE WHEN k >= 20 AND recall < 0.99 THEN 'shadow' ELSE 'aggressive' END AS mode FROM s""")  # fmt: skip
def effective_modes(spark: SparkSession, d: str):
    return analytics.effective_modes(analytics.accuracy_floor(measured_runs(spark, d)), "aggressive")


@query("shadow_selection", f"WITH RECURSIVE {_MERGE} SELECT repo_id, test_path, bucket FROM buckets WHERE bucket <> 'skip'")
def shadow_selection(spark: SparkSession, d: str):
    """The selection in shadow mode: nothing may be left out."""
    return merge.merge_layers(_tests(spark, d), _graph_hits(spark, d), _bands(spark, d), _decided(spark, d), mode="shadow", quarantine=0.02)


@query("full_suite_selection", f"""WITH RECURSIVE {_MERGE}, whole AS (SELECT DISTINCT repo_id FROM layer1_results WHERE run_full_suite)
SELECT repo_id, test_path, 'blocking' AS bucket FROM (SELECT repo_id, test_path FROM blocking UNION SELECT repo_id, path FROM tests WHERE repo_id IN (SELECT repo_id FROM whole))
UNION ALL SELECT repo_id, test_path, 'recommended' FROM recommended c WHERE NOT EXISTS (SELECT 1 FROM tests t WHERE t.repo_id = c.repo_id AND t.path = c.test_path AND t.repo_id IN (SELECT repo_id FROM whole))""")  # fmt: skip
def full_suite_selection(spark: SparkSession, d: str):
    """The same where repositories with a change to shared files run everything."""
    whole = table(spark, d, "layer1_results").where("run_full_suite").select("repo_id").distinct()
    return merge.merge_layers(_tests(spark, d), _graph_hits(spark, d), _bands(spark, d), _decided(spark, d), mode="shadow", full_suite=whole)


@query("ranked_tests", f"""WITH {R}, g AS (SELECT repo_id, count(*) AS n FROM r GROUP BY 1),
best AS (SELECT repo_id, test_path, max(flake_score) AS score FROM flaky_rows WHERE flake_score IS NOT NULL AND NOT isnan(flake_score) GROUP BY 1, 2),
top AS (SELECT repo_id, max(score) AS top FROM best GROUP BY 1),
s AS (SELECT b.repo_id, test_path, CASE WHEN coalesce(n, 0) < 100 OR top = 0 THEN 0.5 ELSE score END AS score FROM best b JOIN top ON top.repo_id = b.repo_id LEFT JOIN g ON g.repo_id = b.repo_id)
SELECT repo_id, test_path, score, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, test_path) AS place FROM s""")  # fmt: skip
def ranked_tests(spark: SparkSession, d: str):
    """Scored tests in order, dormant repositories at 0.5 throughout."""
    gates = analytics.activity_gates(counted_runs(spark, d))
    return model.ranked(_bands(spark, d).select("repo_id", "test_path", "score"), gates).withColumn("place", F.col("place").cast("bigint"))


@query("flaky_warnings", f"""WITH {R}, e AS (SELECT repo_id, unnest(tt) AS test_path, 0 AS f FROM r UNION ALL SELECT repo_id, unnest(af), 1 FROM r),
s AS (SELECT repo_id, test_path, sum(1 - f) AS seen, sum(f) AS failed FROM e GROUP BY 1, 2)
SELECT repo_id, test_path FROM s WHERE seen > 0 AND failed / CAST(seen AS DOUBLE) > 0.15""")  # fmt: skip
def flaky_warnings(spark: SparkSession, d: str):
    """Tests a report warns of."""
    return analytics.flake_scores(counted_runs(spark, d, "actual_failures", "all_tests")).where("flake_score > 0.15").select("repo_id", "test_path")


@query("prompt_digests", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS y, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
e AS (SELECT *, regexp_matches(y, '^[+-]') AND y NOT LIKE '+++%' AND y NOT LIKE '---%' AS eff FROM l),
n AS (SELECT *, sum(CASE WHEN eff THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM e),
cut AS (SELECT doc_id, string_agg(y, chr(10) ORDER BY i) FILTER (NOT eff OR n <= 2000) AS body FROM n GROUP BY 1)
SELECT d.doc_id, md5('Tests:' || chr(10) || array_to_string(list_sort([coalesce(lang, '-'), coalesce(source, '-'), 'a']), chr(10)) || chr(10) || chr(10) || 'Change:' || chr(10) || coalesce(body, '')
  || CASE WHEN length(trim(coalesce(source, ''))) > 0 THEN chr(10) || chr(10) || 'Notes:' || chr(10) || source ELSE '' END) AS digest FROM documents d LEFT JOIN cut ON cut.doc_id = d.doc_id""")  # fmt: skip
def prompt_digests(spark: SparkSession, d: str):
    """Questions about every text as if it were a change, cut to their limit."""
    rows = table(spark, d, "documents").withColumn("paths", F.array(F.coalesce("lang", F.lit("-")), F.coalesce("source", F.lit("-")), F.lit("a")))
    return rows.select("doc_id", F.md5(prompts.prompt("paths", "text", "source")).alias("digest"))
