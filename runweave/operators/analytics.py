"""Run-history analytics: leaderboards, trends, recall and activity gates, for every repository at once.

All take runs that count once each (see ``redelivery.once``). Null arrays are empty; rows without ``created_at`` come last where time
orders and are left out of weekly trends. Ties are broken by ``ingest_seq``, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runweave.functions.expr import exact_avg, items, share_or_one, skipped_share, sunday_week, with_counts


def for_repo(runs: DataFrame, repo_id: str | None) -> DataFrame:
    return runs if repo_id is None else runs.where(F.col("repo_id") == F.lit(repo_id))


def shadow_progress(runs: DataFrame, target: int = 50) -> DataFrame:
    """repo_id, run_count, avg_skip_pct, progress_pct (run count against a target, 100 at most)."""
    counts = with_counts(runs).groupBy("repo_id").agg(F.count(F.lit(1)).alias("run_count"), exact_avg(skipped_share()).alias("avg_skip_pct"))
    return counts.withColumn("progress_pct", F.least(F.col("run_count") / F.lit(target) * 100, F.lit(100.0)))


def seen_and_failed(runs: DataFrame) -> DataFrame:
    """repo_id, test_path, seen, failed: one pass over the runs, one row a listed test or failure."""
    both = F.concat(F.transform(items("all_tests"), lambda t: F.struct(t.alias("t"), F.lit(0).alias("f"))), F.transform(items("actual_failures"), lambda t: F.struct(t.alias("t"), F.lit(1).alias("f"))))
    rows = runs.select("repo_id", F.explode(both).alias("e")).select("repo_id", F.col("e.t").alias("test_path"), F.col("e.f").alias("f"))
    return rows.groupBy("repo_id", "test_path").agg(F.sum(1 - F.col("f")).alias("seen"), F.sum("f").alias("failed"))


def flaky_leaderboard(runs: DataFrame, n: int = 50, more_than: int = 5) -> DataFrame:
    """repo_id, test_path, flake_score, total_runs: the n flakiest tests of each repository; score = failures / (listed + failures)."""
    rows = seen_and_failed(runs).withColumn("total_runs", F.col("seen") + F.col("failed")).where(F.col("total_runs") > more_than)
    rows = rows.withColumn("flake_score", F.col("failed") / F.col("total_runs"))
    place = F.row_number().over(W.partitionBy("repo_id").orderBy(F.col("flake_score").desc(), "test_path"))
    return rows.withColumn("_p", place).where(F.col("_p") <= n).select("repo_id", "test_path", "flake_score", "total_runs")


def flake_scores(runs: DataFrame) -> DataFrame:
    """repo_id, test_path, flake_score = failures / listings for tests that were listed; above 1 if failures weren't listed."""
    return seen_and_failed(runs).where(F.col("seen") > 0).select("repo_id", "test_path", (F.col("failed") / F.col("seen")).alias("flake_score"))


def accuracy_trend(runs: DataFrame) -> DataFrame:
    """repo_id, week (a Sunday), runs_with_failures, missed_failures, total_failures, accuracy_pct (100 without failures)."""
    rows = with_counts(runs).where(F.col("created_at").isNotNull()).select("repo_id", sunday_week("created_at").alias("week"), F.col("n_failed").alias("f"), F.col("n_missed").alias("m"))
    weekly = rows.groupBy("repo_id", "week").agg(F.count_if(F.col("f") > 0).alias("runs_with_failures"), F.sum("m").alias("missed_failures"), F.sum("f").alias("total_failures"))
    return weekly.withColumn("accuracy_pct", share_or_one(F.col("missed_failures"), F.col("total_failures")) * 100)


def savings_trend(runs: DataFrame) -> DataFrame:
    """repo_id, week, minutes_saved; null and NaN minutes add nothing."""
    minutes = F.col("time_saved_minutes").cast("double")
    rows = runs.where(F.col("created_at").isNotNull()).select("repo_id", sunday_week("created_at").alias("week"), F.when(~F.isnan(minutes), minutes).alias("m"))
    return rows.groupBy("repo_id", "week").agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("minutes_saved"))


def by_week(trend: DataFrame) -> DataFrame:
    """A weekly trend in order, for a reader: repositories, then weeks."""
    return trend.orderBy("repo_id", "week")


def newest_first() -> W:
    return W.partitionBy("repo_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("ingest_seq").desc())


def latest_per_repo(runs: DataFrame, n: int) -> DataFrame:
    """The n newest runs of each repository with their place; each task keeps n before the shuffle."""
    return runs.withColumn("place", F.row_number().over(newest_first())).where(F.col("place") <= n)


def recent_recall(runs: DataFrame, n: int = 20) -> DataFrame:
    """repo_id, recall, total_failures over the n newest runs; recall is 1 without failures."""
    rows = latest_per_repo(with_counts(runs).select("repo_id", "created_at", "ingest_seq", F.col("n_failed").alias("f"), F.col("n_missed").alias("m")), n)
    sums = rows.groupBy("repo_id").agg(F.sum("f").alias("total_failures"), F.sum("m").alias("m"))
    return sums.select("repo_id", share_or_one(F.col("m"), F.col("total_failures")).alias("recall"), "total_failures")


def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    """repo_id, place, pr_number, sha, mode, created_us, skip_pct, failure_count of the n newest runs."""
    return latest_per_repo(with_counts(runs), n).select("repo_id", "place", "pr_number", "sha", "mode", F.unix_micros("created_at").alias("created_us"), skipped_share().alias("skip_pct"), F.col("n_failed").alias("failure_count"))


ORDER = ("created_at", "ingest_seq")


def rolling_recall(runs: DataFrame, n: int = 20) -> DataFrame:
    """repo_id, ingest_seq, created_at, recall over the n runs up to each run in time order.

    The window runs within (repository, day), so a repository with a third of all runs is many tasks; each day gets the last n - 1
    runs before it from a table of day ends, which has a row a repository and day.
    """
    rows = with_counts(runs).where(F.col("created_at").isNotNull()).select("repo_id", "ingest_seq", "created_at", F.col("n_failed").alias("f"), F.col("n_missed").alias("m"))
    rows = rows.withColumn("day", F.to_date("created_at"))
    late = F.row_number().over(W.partitionBy("repo_id", "day").orderBy(*(F.col(c).desc() for c in ORDER)))
    ends = rows.withColumn("_p", late).where(F.col("_p") < n).groupBy("repo_id", "day").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "f", "m"))).alias("end"))
    # every day with an end has a run, so n - 1 days hold n - 1 runs at least
    earlier = F.flatten(F.collect_list("end").over(W.partitionBy("repo_id").orderBy("day").rowsBetween(-max(n - 1, 1), -1)))
    known = F.least(F.size("earlier"), F.lit(n - 1))
    carried = ends.select("repo_id", "day", earlier.alias("earlier")).where((F.size("earlier") > 0) & (known > 0))
    carried = carried.select("repo_id", "day", F.explode(F.slice("earlier", -known, known)).alias("e")).select("repo_id", "day", "e.*")
    marked = rows.withColumn("own", F.lit(True)).unionByName(carried.withColumn("own", F.lit(False)))
    back = W.partitionBy("repo_id", "day").orderBy(*ORDER).rowsBetween(-(n - 1), 0)
    recall = share_or_one(F.sum("m").over(back), F.sum("f").over(back))
    return marked.withColumn("recall", recall).where("own").select("repo_id", "ingest_seq", "created_at", "recall")


def alert_transitions(runs: DataFrame, low: float = 0.95, high: float = 0.98, n: int = 20) -> DataFrame:
    """repo_id, ingest_seq, recall, event (fire, recover, hold): hysteresis on the rolling recall.

    A run below ``low`` fires unless an alert is active, one at ``high`` or above recovers an active alert, in between the state holds.
    The state before a run is the last signal of its day so far, else the last signal of an earlier day.
    """
    signal = F.when(F.col("recall") < low, "low").when(F.col("recall") >= high, "high")
    rows = rolling_recall(runs, n).withColumns({"day": F.to_date("created_at"), "signal": signal})
    days = rows.groupBy("repo_id", "day").agg(F.max_by("signal", F.when(F.col("signal").isNotNull(), F.struct(*ORDER))).alias("_s"))
    before_day = F.last("_s", ignorenulls=True).over(W.partitionBy("repo_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1))
    days = days.select("repo_id", "day", before_day.alias("_carried"))
    so_far = W.partitionBy("repo_id", "day").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.last("signal", ignorenulls=True).over(so_far)).join(days, ["repo_id", "day"])
    low_before = F.coalesce(F.coalesce("_own", "_carried") == "low", F.lit(False))
    event = F.when((F.col("signal") == "low") & ~low_before, "fire").when((F.col("signal") == "high") & low_before, "recover").otherwise("hold")
    return rows.select("repo_id", "ingest_seq", "recall", event.alias("event"))


def accuracy_report(runs: DataFrame) -> DataFrame:
    """repo_id, skip_rate (mean over runs that list tests), recall, report (one line of text)."""
    ratio = F.when(F.col("n_listed") > 0, skipped_share())
    sums = with_counts(runs).groupBy("repo_id").agg(exact_avg(ratio).alias("skip_rate"), F.sum("n_failed").alias("f"), F.sum("n_missed").alias("m"), F.count(F.lit(1)).alias("n"))
    sums = sums.select("repo_id", F.coalesce("skip_rate", F.lit(0.0)).alias("skip_rate"), share_or_one(F.col("m"), F.col("f")).alias("recall"), "n")
    return sums.select("repo_id", "skip_rate", "recall", F.format_string("%d runs: %.1f%% skipped, recall %.1f%%", "n", F.col("skip_rate") * 100, F.col("recall") * 100).alias("report"))


def accuracy_floor(runs: DataFrame, window: int = 20, floor: float = 0.99) -> DataFrame:
    """repo_id, runs_seen, recall, below_floor: over the last ``window`` runs in order of arrival; never below with fewer runs."""
    place = F.row_number().over(W.partitionBy("repo_id").orderBy(F.col("ingest_seq").desc()))
    last = with_counts(runs).select("repo_id", "ingest_seq", F.col("n_failed").alias("f"), F.col("n_missed").alias("m")).withColumn("p", place).where(F.col("p") <= window)
    sums = last.groupBy("repo_id").agg(F.count(F.lit(1)).alias("runs_seen"), F.sum("f").alias("f"), F.sum("m").alias("m"))
    recall = share_or_one(F.col("m"), F.col("f"))
    return sums.select("repo_id", "runs_seen", recall.alias("recall"), ((F.col("runs_seen") >= window) & (recall < floor)).alias("below_floor"))


def dominant_repo(runs: DataFrame) -> DataFrame:
    """repo_id, runs of the repository with most runs, the first seen among equals."""
    counts = runs.groupBy("repo_id").agg(F.count(F.lit(1)).alias("runs"), F.min("ingest_seq").alias("first_seq"))
    return counts.orderBy(F.col("runs").desc(), "first_seq").limit(1).select("repo_id", "runs")


def activity_gates(runs: DataFrame, *, least: int = 100, every: int = 7) -> DataFrame:
    """repo_id, run_count, dormant (fewer than ``least`` runs), backstop (a multiple of ``every``)."""
    counts = runs.groupBy("repo_id").agg(F.count(F.lit(1)).alias("run_count"))
    return counts.select("repo_id", "run_count", (F.col("run_count") < least).alias("dormant"), ((F.col("run_count") > 0) & (F.col("run_count") % every == 0)).alias("backstop"))


def final_rows(deliveries: DataFrame) -> DataFrame:
    """Merge-on-read view: of rows equal in repo_id, created_at and id the last to arrive."""
    place = F.row_number().over(W.partitionBy("repo_id", "created_at", "id").orderBy(F.col("ingest_seq").desc()))
    return deliveries.withColumn("_p", place).where(F.col("_p") == 1).drop("_p")


def retrain_due(gates: DataFrame, trained: DataFrame, as_of: F.Column, *, least: int = 100, days: int = 7) -> DataFrame:
    """repo_id, due: enough runs, and never trained or at least ``days`` days ago. gates(repo_id, run_count), trained(repo_id, trained_at)."""
    rows = gates.join(trained.groupBy("repo_id").agg(F.max("trained_at").alias("last")), "repo_id", "left")
    old = F.col("last").isNull() | (F.unix_micros(as_of) - F.unix_micros("last") >= days * 86_400_000_000)
    return rows.select("repo_id", ((F.col("run_count") >= least) & old).alias("due"))


def effective_modes(floors: DataFrame, mode: str) -> DataFrame:
    """repo_id, mode: the configured mode, shadow where the recall is below the floor."""
    return floors.select("repo_id", F.when(F.col("below_floor"), "shadow").otherwise(mode).alias("mode"))
