"""Queries of the training-data problems (p3, p4, p6, p7, p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.llm import cooccurrence
from runweave.llm.encoding import encode_texts
from runweave.llm.language import language_segments, languages, relabelled
from runweave.llm.leakage import leaked_items, without_leaks
from runweave.llm.topn import top_items
from runweave.operators.redelivery import once
from runweave.plans.core_queries import ONCE
from runweave.sources.tables import table

LEAST_TOGETHER = 5


def p3_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_items(table(spark, sf_dir, "flaky_rows"), group="repo_id", item="test_path", score="flake_score", n=10)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_top(spark, sf_dir).select("repo_id", "test_path")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of tests that fail together five times or more, with counts and surprise."""
    runs = table(spark, sf_dir, "runs").select("ingest_seq", "id", "repo_id", "all_tests", "actual_failures")
    # arrays shrink to hashes before the rows are told apart, so that the shuffle carries no paths
    slim = runs.withColumns({c: cooccurrence.hashed(c) for c in ("all_tests", "actual_failures")})
    counted = once(slim, unique_seq=True).select(F.col("repo_id").alias("grp"), F.col("ingest_seq").alias("rec"), F.col("all_tests").alias("at"), F.array_intersect("all_tests", "actual_failures").alias("af"))
    names = cooccurrence.names_of(runs, group="repo_id", marked="actual_failures")
    found = cooccurrence.pair_surprise(counted.where(F.col("grp").isNotNull()), names, least=LEAST_TOGETHER)
    return found.withColumnsRenamed({"grp": "repo_id", "item_a": "test_a", "item_b": "test_b"})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = (F.col("n_ab") >= LEAST_TOGETHER) & (F.col("n") * F.col("n_ab") >= 3 * F.col("n_a") * F.col("n_b"))
    return p4_pairs(spark, sf_dir).where(case).select("repo_id", "test_a", "test_b")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pairs(spark, sf_dir).select("repo_id", "test_a", "test_b", "n", "n_a", "n_b", "n_ab")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items leaked into them, with the words covered."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its leaked passages."""
    return without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language of every document, with its confidence."""
    return languages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relabelled(p8_languages(spark, sf_dir)).select("doc_id", "lang")


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence with its language and confidence."""
    return language_segments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"))


QUERIES = {"p3_found": p3_found, "p3_top": p3_top, "p4_found": p4_found, "p4_pairs": p4_pairs, "p4_counts": p4_counts, "p6_ids": p6_ids, "p7_found": p7_found, "p7_leaks": p7_leaks, "p7_clean": p7_clean, "p8_found": p8_found, "p8_languages": p8_languages, "p8_segments": p8_segments}

_BEST = """best AS (SELECT repo_id, test_path, max(flake_score) AS flake_score FROM flaky_rows
  WHERE flake_score IS NOT NULL AND NOT isnan(flake_score) AND repo_id IS NOT NULL AND test_path IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY flake_score DESC, test_path) AS INTEGER) AS rank FROM best)"""

_PAIRS = f"""baskets AS (
  SELECT ingest_seq, repo_id, list_distinct(coalesce(all_tests, [])) AS offers,
         list_distinct(list_intersect(coalesce(all_tests, []), coalesce(actual_failures, []))) AS af FROM ({ONCE}) WHERE repo_id IS NOT NULL),
offered AS (SELECT ingest_seq, repo_id, t, list_contains(af, t) AS failed FROM (SELECT ingest_seq, repo_id, af, unnest(offers) AS t FROM baskets) WHERE t IS NOT NULL),
failing AS (SELECT * FROM offered WHERE failed),
often AS (
  SELECT a.repo_id, a.t AS test_a, b.t AS test_b FROM failing a JOIN failing b ON a.ingest_seq = b.ingest_seq AND a.t < b.t
  GROUP BY 1, 2, 3 HAVING count(*) >= 5),
counts AS (
  SELECT o.repo_id, o.test_a, o.test_b, count(*) AS n, count_if(a.failed) AS n_a, count_if(b.failed) AS n_b, count_if(a.failed AND b.failed) AS n_ab
  FROM often o JOIN offered a ON a.repo_id = o.repo_id AND a.t = o.test_a JOIN offered b ON b.ingest_seq = a.ingest_seq AND b.t = o.test_b
  GROUP BY 1, 2, 3)"""

ORACLE = {
    "p3_found": f"WITH {_BEST} SELECT repo_id, test_path FROM ranked WHERE rank <= 10",
    "p3_top": f"WITH {_BEST} SELECT repo_id, test_path, flake_score, rank FROM ranked WHERE rank <= 10",
    "p4_found": f"WITH {_PAIRS} SELECT repo_id, test_a, test_b FROM counts WHERE n_ab >= 5 AND n * n_ab >= 3 * n_a * n_b",
    "p4_counts": f"""WITH {_PAIRS} SELECT repo_id, test_a, test_b, CAST(n AS BIGINT) AS n, CAST(n_a AS BIGINT) AS n_a,
  CAST(n_b AS BIGINT) AS n_b, CAST(n_ab AS BIGINT) AS n_ab FROM counts""",
}
