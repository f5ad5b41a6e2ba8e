"""All layers of a selection for many repositories at once: imports, embeddings, scores, decisions, merge and report.

Each layer is written as it is made, so that a failure shows where it happens; a layer that fails is logged and counts as empty, and the selection goes
on with what the others say.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.functions.expr import matches_any
from runweave.operators import analytics, decisions, diffs, embed, features, graph, merge, model
from runweave.plans.pipeline import selection_report
from runweave.session import materialize
from runweave.sources.config import SelectionConfig

_log = logging.getLogger(__name__)


@dataclass
class Selection:
    """What the layers found, and what came of it; all tables by repo_id."""

    blocking: DataFrame
    full_suite: DataFrame
    bands: DataFrame
    ranked: DataFrame
    decisions: DataFrame
    usage: DataFrame
    buckets: DataFrame
    metrics: DataFrame
    report: DataFrame
    failed: list[str] = field(default_factory=list)


def orchestrate(changes: DataFrame, graphs: DataFrame, files: DataFrame, runs: DataFrame, tests: DataFrame, config: SelectionConfig, *, embedder: embed.Embedder, dim: int,
                provider: decisions.Provider = decisions.rule_provider, model_path: str | None = None, as_of: F.Column | None = None) -> Selection:
    """The selection for changes(repo_id, diff, changed).

    graphs(repo_id, dependency_graph) one a repository, files(repo_id, path, content) the test files, runs that count once each, tests(repo_id, path,
    flake_score, avg_duration_ms). Medium bands are decided by the provider, in three passes where the diff adds features or the mode is
    conservative; scores come from the model at ``model_path``, 0.5 throughout where there is none.
    """
    spark, failed = changes.sparkSession, []
    now = F.current_timestamp() if as_of is None else as_of

    def layer(name: str, make: Callable[[], DataFrame], schema: str) -> DataFrame:
        return _open(spark, name, make, schema, failed)

    # 1: imports
    asked = graphs.select("repo_id", "dependency_graph").join(changes.select("repo_id", "changed"), "repo_id")
    hits = layer("imports", lambda: graph.blocking_tests(asked, key="repo_id"), "repo_id string, test_path string")
    named = changes.select("repo_id", F.explode("changed").alias("f"))
    full = layer("full suite", lambda: named.where(matches_any("f", config.run_all_tests_on)).select("repo_id").distinct(), "repo_id string")

    # 2: embeddings
    bands = layer("embeddings", lambda: embed.match_repos(files, changes.select("repo_id", F.col("diff").alias("content")), embedder, dim), "repo_id string, test_path string, score double, band string")

    # 3: scores of the candidates of all bands
    def score() -> DataFrame:
        near = graph.key_distance(graph.file_links(graphs, key="repo_id"), key="repo_id").select("repo_id", F.col("path").alias("test_path"), "distance")
        candidates = bands.select("repo_id", "test_path", F.col("score").alias("similarity")).join(near, ["repo_id", "test_path"], "left")
        served = features.serving_features(candidates, runs, tests, now)
        return model.ranked(model.scored_or_zero(model.load(model_path) if model_path else None, served), analytics.activity_gates(runs))

    ranked = layer("scores", score, "repo_id string, test_path string, score double, place bigint")

    # 4: decisions on the medium band
    medium = bands.where("band = 'medium'").select("repo_id", "test_path")
    told = changes.select("repo_id", "diff", F.lit(config.architecture_notes).alias("notes"))
    careful = told if config.mode == "conservative" else told.where(diffs.diff_kind("diff") == "feature")
    empty = "repo_id string, test_path string, classification string, pass int, confidence double, reasoning string"
    usage: list[DataFrame] = []

    def decide() -> DataFrame:
        found, used = decisions.classify_changes(medium, told, provider, careful.select("repo_id"))
        usage.append(materialize(used, "usage"))
        return found

    decided = layer("decisions", decide, empty)
    used = usage[0] if usage else changes.select("repo_id", F.lit(0).cast("bigint").alias("calls"), F.lit(0).cast("bigint").alias("tokens"), F.lit(True).alias("fallback_used"))

    scores = analytics.flake_scores(runs)
    known = tests.select("repo_id", F.col("path").alias("test_path")).join(scores, ["repo_id", "test_path"], "left")
    buckets = materialize(merge.merge_layers(known, hits, bands, decided, mode=config.mode, quarantine=config.flaky_test_quarantine, full_suite=full), "buckets")
    metrics = merge.selection_metrics(buckets, bands)
    report = selection_report(buckets, metrics, reasons=decided, runs_seen=analytics.activity_gates(runs), flaky=scores, config=config)
    return Selection(hits, full, bands, ranked, decided, used, buckets, metrics, report, failed)


def _open(spark: SparkSession, name: str, make: Callable[[], DataFrame], schema: str, failed: list[str]) -> DataFrame:
    try:
        return materialize(make(), name.replace(" ", "-"))
    except Exception as e:  # noqa: BLE001 - a layer that fails says nothing
        _log.warning("layer %s failed and counts as empty: %s", name, str(e)[:500])
        failed.append(name)
        return spark.createDataFrame([], schema)
