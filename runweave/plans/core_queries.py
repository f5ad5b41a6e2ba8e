"""Queries of the general data problems (p1, p2, p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.functions.expr import with_counts
from runweave.operators.graph import file_links
from runweave.operators.hierarchy import cyclic_files, graph_hierarchy
from runweave.operators.links import link_descendants, link_hierarchy
from runweave.operators.redelivery import once, replay
from runweave.operators.trailing import concentrated_days, trailing_totals
from runweave.sources.tables import table

RUN_COLUMNS = ["ingest_seq", "batch_id", "id", "repo_id", "created_at"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    deliveries = table(spark, sf_dir, "runs").select(*RUN_COLUMNS)
    surplus = replay(deliveries).surplus_rows(["ingest_seq"])
    return surplus if surplus is not None else deliveries.select("ingest_seq").where(F.lit(False))


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole winning rows, through the same table."""
    deliveries = table(spark, sf_dir, "runs")
    kept = replay(deliveries).winners()
    kept = kept if kept is not None else deliveries.where(F.lit(False))
    return kept.select("ingest_seq", "batch_id", "id", "repo_id", "pr_number", "sha", F.size(F.coalesce("all_tests", F.array())).alias("tests"), "mode", F.unix_micros("created_at").alias("created_us"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cyclic_files(table(spark, sf_dir, "layer1_results").select("result_id", "dependency_graph"))


def p2_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_hierarchy(table(spark, sf_dir, "layer1_results").select("result_id", "dependency_graph"))


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of what hangs below each file, and whether it is in a cycle."""
    found = graph_hierarchy(table(spark, sf_dir, "layer1_results").select("result_id", "dependency_graph"), descendants=False)
    return found.select("result_id", "file_path", "subtree_size", "in_cycle")


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from links in rows of their own."""
    found = link_hierarchy(file_links(table(spark, sf_dir, "layer1_results")), key="result_id", parent="src", child="dst")
    return found.select("result_id", "file_path", "subtree_size", "in_cycle")


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with every file below it, a row each, by joins alone."""
    found = link_descendants(file_links(table(spark, sf_dir, "layer1_results")), key="result_id", parent="src", child="dst")
    return found.select("result_id", F.col("node").alias("file_path"), "descendant")


def counted_runs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Runs, each once."""
    need = list(dict.fromkeys(["ingest_seq", "id", "repo_id", *columns]))
    return once(table(spark, sf_dir, "runs").select(*need), unique_seq=True)


def measured_runs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Runs, each once, with the counts of their arrays instead of these: the arrays stay in the scan."""
    need = list(dict.fromkeys(["ingest_seq", "id", "repo_id", *columns]))
    return once(with_counts(table(spark, sf_dir, "runs")).select(*need, "n_skipped", "n_failed", "n_listed", "n_missed"), unique_seq=True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concentrated_days(counted_runs(spark, sf_dir, "time_saved_minutes", "created_at"))


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trailing_totals(counted_runs(spark, sf_dir, "time_saved_minutes", "created_at"))
    return rows.select("repo_id", "run_day", "total_7", "avg_7", "rows_7", "total_30", "avg_30", "rows_30")


QUERIES = {"p1_found": p1_found, "p1_kept": p1_kept, "p2_found": p2_found, "p2_nodes": p2_nodes, "p2_sizes": p2_sizes, "p2_links": p2_links, "p2_descendants": p2_descendants, "p5_found": p5_found, "p5_totals": p5_totals}

_KEYED = r"""SELECT *, nullif(regexp_replace(lower(id), '[^\p{L}\p{N}]', '', 'g'), '') AS k FROM runs"""

#: runs, each once
ONCE = f"""SELECT * FROM ({_KEYED}) WHERE k IS NULL OR repo_id IS NULL
UNION ALL SELECT * FROM ({_KEYED}) WHERE k IS NOT NULL AND repo_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY repo_id, k ORDER BY ingest_seq) = 1"""

_DAILY = f"""once AS ({ONCE}),
daily AS (
  SELECT repo_id, CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS day,
         coalesce(sum(CASE WHEN NOT isnan(time_saved_minutes) THEN CAST(time_saved_minutes AS DOUBLE) END), 0.0) AS total,
         count(CASE WHEN NOT isnan(time_saved_minutes) THEN 1 END) AS valued, count(*) AS n
  FROM once WHERE created_at IS NOT NULL AND repo_id IS NOT NULL GROUP BY 1, 2),
spans AS (SELECT repo_id, min(day) AS first_day, max(day) AS last_day FROM daily GROUP BY 1),
calendar AS (SELECT repo_id, first_day, last_day, CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS run_date FROM spans),
filled AS (
  SELECT c.repo_id, c.first_day, c.run_date, coalesce(d.total, 0.0) AS total, coalesce(d.valued, 0) AS valued, coalesce(d.n, 0) AS n
  FROM calendar c LEFT JOIN daily d ON d.repo_id = c.repo_id AND d.day = c.run_date),
rolled AS (
  SELECT repo_id, first_day, run_date,
         sum(total) OVER w7 AS total_7, sum(valued) OVER w7 AS valued_7, sum(n) OVER w7 AS n_7,
         sum(total) OVER w30 AS total_30, sum(valued) OVER w30 AS valued_30, sum(n) OVER w30 AS n_30
  FROM filled
  WINDOW w7 AS (PARTITION BY repo_id ORDER BY run_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY repo_id ORDER BY run_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""

_EDGES = r"""pairs AS (SELECT result_id, unnest(map_entries(dependency_graph)) AS e FROM layer1_results),
raw AS (SELECT result_id, e.key AS p, unnest(CASE WHEN len(e.value) > 0 THEN e.value ELSE [NULL] END) AS c FROM pairs),
plain AS (
  SELECT result_id, array_to_string(list_filter(string_split(replace(p, '\', '/'), '/'), lambda s: s NOT IN ('', '.')), '/') AS p,
         array_to_string(list_filter(string_split(replace(c, '\', '/'), '/'), lambda s: s NOT IN ('', '.')), '/') AS c FROM raw),
edges AS (SELECT DISTINCT result_id, p, c FROM plain WHERE p <> '' AND c <> '')"""
_WALK = """walk(result_id, p, c) AS (SELECT result_id, p, c FROM edges
  UNION SELECT w.result_id, w.p, e.c FROM walk w JOIN edges e ON e.result_id = w.result_id AND e.p = w.c)"""

_SIZES = f"""WITH RECURSIVE {_EDGES}, {_WALK},
nodes AS (SELECT result_id, p AS file_path FROM plain WHERE p <> '' UNION SELECT result_id, c FROM edges),
below AS (SELECT result_id, p AS file_path, count(*) FILTER (c <> p) AS n, bool_or(c = p) AS in_cycle FROM walk GROUP BY 1, 2)
SELECT result_id, file_path, CAST(coalesce(n, 0) + 1 AS INTEGER) AS subtree_size, coalesce(in_cycle, false) AS in_cycle FROM nodes LEFT JOIN below USING (result_id, file_path)"""

ORACLE = {
    "p1_found": f"""WITH keyed AS ({_KEYED})
SELECT ingest_seq FROM keyed WHERE k IS NOT NULL AND repo_id IS NOT NULL
QUALIFY ingest_seq > min(ingest_seq) OVER (PARTITION BY repo_id, k)""",
    "p1_kept": f"""SELECT ingest_seq, batch_id, id, repo_id, pr_number, sha, CAST(len(coalesce(all_tests, [])) AS INTEGER) AS tests, mode,
       epoch_us(created_at) AS created_us FROM ({ONCE})""",
    "p5_found": f"""WITH {_DAILY}
SELECT repo_id, strftime(run_date, '%Y-%m-%d') AS run_day FROM rolled
WHERE run_date >= first_day + 29 AND total_30 >= 20 AND total_7 * 10 >= total_30 * 7""",
    "p5_totals": f"""WITH {_DAILY}
SELECT repo_id, strftime(run_date, '%Y-%m-%d') AS run_day,
       total_7, CASE WHEN valued_7 > 0 THEN total_7 / valued_7 END AS avg_7, CAST(n_7 AS BIGINT) AS rows_7,
       total_30, CASE WHEN valued_30 > 0 THEN total_30 / valued_30 END AS avg_30, CAST(n_30 AS BIGINT) AS rows_30
FROM rolled""",
    "p2_found": f"""WITH RECURSIVE {_EDGES}, {_WALK} SELECT DISTINCT result_id, p AS file_path FROM walk WHERE p = c""",
    "p2_sizes": _SIZES,
    "p2_links": _SIZES,
    "p2_descendants": f"""WITH RECURSIVE {_EDGES}, {_WALK} SELECT result_id, p AS file_path, c AS descendant FROM walk""",
}
