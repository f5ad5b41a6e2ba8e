"""The selection pipeline as one plan: graph hits, bands, decisions, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.functions.expr import is_test_file, matches_any
from runweave.operators import decisions, diffs, graph, imports, merge
from runweave.sources.config import SelectionConfig, ts_aliases
from runweave.sources.run_log import read_tree
from runweave.session import materialize


def static_analysis(spark: SparkSession, root: str, changed: list[str], globs: list[str], parsers=None) -> dict[str, DataFrame]:
    """links, blocking (test_path), errors (path, error) and full_suite (one row) of a source tree and its changed files."""
    files = read_tree(spark, root)
    parsed = materialize(imports.parse_imports(files, parsers), "parsed")
    links = materialize(imports.resolve_imports(parsed, files.select("path"), ts_aliases(root)), "links")
    seeds = spark.createDataFrame([(c,) for c in changed], "node string")
    reached = graph.dependents(links, seeds)
    return {
        "links": links,
        "blocking": reached.select(F.col("node").alias("test_path")).where(is_test_file("test_path")),
        "errors": parsed.where("error is not null").select("path", "error"),
        "full_suite": seeds.agg(F.coalesce(F.bool_or(matches_any("node", globs)), F.lit(False)).alias("full_suite")),
    }


def select_tests(graph_hits: DataFrame, bands: DataFrame, tests: DataFrame, diff: DataFrame, config: SelectionConfig, *, full_suite: DataFrame | None = None,
                 provider: decisions.Provider = decisions.rule_provider) -> DataFrame:
    """repo_id, test_path, bucket from ready-made layers. The medium band goes to the provider; diffs (repo_id, diff) that add features, and the
    conservative mode, have it asked three times in different order and take the most cautious answer of each test.
    """
    told = diff.select("repo_id", "diff", F.lit(config.architecture_notes).alias("notes"))
    careful = told if config.mode == "conservative" else told.where(diffs.diff_kind("diff") == "feature")
    decided, _ = decisions.classify_changes(bands.where("band = 'medium'").select("repo_id", "test_path"), told, provider, careful.select("repo_id"))
    return merge.merge_layers(tests, graph_hits, bands, decided, mode=config.mode, quarantine=config.flaky_test_quarantine, full_suite=full_suite)


def selection_report(buckets: DataFrame, metrics: DataFrame, *, reasons: DataFrame | None = None, runs_seen: DataFrame | None = None, flaky: DataFrame | None = None, config: SelectionConfig | None = None) -> DataFrame:
    """repo_id, report: the selection in Markdown.

    reasons(repo_id, test_path, reasoning) stand beside blocking tests, runs_seen(repo_id, run_count) tell how many runs of shadow mode are left, and
    flaky(repo_id, test_path, flake_score) names the tests above the threshold. A report lists tests, so it is as long as the selection it is about.
    """
    config = config or SelectionConfig()
    rows = buckets.where("bucket <> 'skip'")
    rows = rows.withColumn("reasoning", F.lit(None).cast("string")) if reasons is None else rows.join(reasons.groupBy("repo_id", "test_path").agg(F.min("reasoning").alias("reasoning")), ["repo_id", "test_path"], "left")
    line = F.concat(F.lit("| `"), "test_path", F.lit("` | "), F.coalesce("reasoning", F.lit("imports or similarity")), F.lit(" | "))
    item = F.concat(F.lit("- `"), "test_path", F.lit("`"))
    listed = lambda b, c: F.array_sort(F.collect_list(F.when(F.col("bucket") == b, c)))
    lists = rows.groupBy("repo_id").agg(listed("blocking", line).alias("b"), F.array_join(listed("recommended", item), "\n").alias("r"))
    out = metrics.join(lists, "repo_id", "left")
    counts = F.lit(None).cast("bigint").alias("run_count")
    out = out.select("*", counts) if runs_seen is None else out.join(runs_seen.select("repo_id", "run_count"), "repo_id", "left")
    if flaky is None:
        out = out.withColumn("f", F.lit(None).cast("string"))
    else:
        names = flaky.where(F.col("flake_score") > config.flaky_test_threshold).groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("`"), "test_path", F.lit("`")))), ", ").alias("f"))
        out = out.join(names, "repo_id", "left")
    sure = F.concat(F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("% |"))
    table = F.array_join(F.transform(F.coalesce("b", F.array().cast("array<string>")), lambda x: F.concat(x, sure)), "\n")
    total = F.col("blocking") + F.col("recommended") + F.col("skipped")
    share = F.when(total > 0, F.col("skipped") / F.when(total > 0, total) * 100).otherwise(0.0)
    left = F.greatest(F.lit(config.full_suite_every) - F.coalesce("run_count", F.lit(0)), F.lit(0))
    text = F.format_string("### Test selection%s\n\n%d blocking, %d recommended, %d skipped (%.1f%% of the tests, %.1f minutes saved)\n\n**Blocking**\n\n| Test | Reason | Confidence |\n|-|-|-|\n%s\n\n**Recommended**\n%s",
                           F.lit(" (shadow: everything runs)" if config.mode == "shadow" else ""), "blocking", "recommended", "skipped", share, "minutes_saved", table, F.coalesce("r", F.lit("")))
    shadow = F.format_string("\n\nSelection takes effect after %d more runs.", left) if config.mode == "shadow" else F.lit("")
    warned = F.when(F.col("f").isNotNull() & (F.col("f") != ""), F.concat(F.lit("\n\n**Flaky**: "), "f")).otherwise("")
    return out.select("repo_id", F.concat(text, shadow, warned).alias("report"))
