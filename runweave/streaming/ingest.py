"""Ingest of one batch of run records: validate, derive, merge, alert.

``ingest_batch`` does for a micro-batch, or for any batch of deliveries, what an endpoint does for one record. Invalid records go beside the table
with their problems. Valid ones get what ingest derives and are merged into the message table, each run once. Then the repositories the batch
touched have their recall over the newest runs looked up, and the alert state decides between fire, recover and nothing.

Below the root lie ``messages`` (the table), ``invalid/batch=N``, ``alerts/events/batch=N`` and ``alerts/state``. A batch that is given again, as a
stream does after a failure, changes nothing: the merge finds its rows in the table, files of a batch are overwritten, and the state notes the last
batch it holds.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runweave.functions.expr import share_or_one, with_counts
from runweave.operators.analytics import latest_per_repo
from runweave.operators.ingest import derive, quarantine
from runweave.operators.redelivery import MessageTable
from runweave.session import materialize
from runweave.sources.store import PART, PartitionStore, dir_column

#: fixed values: recall below which an alert fires, from which it recovers, and the runs it is taken over
LOW, HIGH, NEWEST = 0.95, 0.98, 20
STATE = T.StructType([T.StructField("repo_id", T.StringType()), T.StructField("alert_fired_at", T.TimestampType()), T.StructField("recovered_at", T.TimestampType())])
EVENT = T.StructType([T.StructField("repo_id", T.StringType()), T.StructField("recall", T.DoubleType()), T.StructField("event", T.StringType())])
BUCKETS = 16
_log = logging.getLogger(__name__)


def messages(spark: SparkSession, root: str) -> MessageTable:
    return MessageTable(spark, f"{root}/messages")


def ingest_batch(batch: DataFrame, root: str, number: int, *, notify: Callable[[DataFrame], None] | None = None, now: F.Column | None = None) -> DataFrame:
    """Take a batch in and return its alert events (repo_id, recall, event). ``notify`` gets them too; if it fails, that is logged and ingest goes on."""
    spark = batch.sparkSession
    good, bad = quarantine(batch)
    bad.write.mode("overwrite").parquet(f"{root}/invalid/batch={number}")
    good = materialize(derive(good), "valid")
    table = messages(spark, root)
    table.merge(good)
    events = alert(spark, root, number, good.select("repo_id").distinct(), table, F.current_timestamp() if now is None else now)
    if notify is not None:
        try:
            notify(events)
        except Exception:  # noqa: BLE001 - a message that can't be sent must not stop ingest
            _log.exception("alerts of batch %s were not delivered", number)
    return events


def recent_recall_of(table: MessageTable, repos: DataFrame, n: int = NEWEST) -> DataFrame:
    """repo_id, recall over the n newest runs of some repositories, read from the newest months back until each has n runs or there are no more."""
    parts = sorted(table.rows.manifest()["parts"], reverse=True)
    months = 1
    while True:
        rows = table.rows.read(parts[:months])
        if rows is None:
            return repos.sparkSession.createDataFrame([], "repo_id string, recall double")
        slim = with_counts(rows.select("repo_id", "created_at", "ingest_seq", "predicted_skip", "actual_failures", "all_tests")).select("repo_id", "created_at", "ingest_seq", "n_failed", "n_missed")
        newest = latest_per_repo(slim.join(repos, "repo_id", "left_semi"), n)
        sums = newest.groupBy("repo_id").agg(F.sum("n_failed").alias("f"), F.sum("n_missed").alias("m"), F.count(F.lit(1)).alias("k"))
        sums = materialize(sums, "recalls")
        if months >= len(parts) or sums.where(F.col("k") >= n).count() == repos.count():
            return sums.select("repo_id", share_or_one(F.col("m"), F.col("f")).alias("recall"))
        months *= 2


def transitions(recalls: DataFrame, state: DataFrame, now: F.Column, *, low: float = LOW, high: float = HIGH) -> DataFrame:
    """repo_id, recall, event (fire, recover or null) and the state after it, for recalls(repo_id, recall) and state(repo_id, alert_fired_at, recovered_at)."""
    rows = recalls.join(state, "repo_id", "left")
    active = F.col("alert_fired_at").isNotNull() & F.col("recovered_at").isNull()
    event = F.when((F.col("recall") < low) & ~active, "fire").when((F.col("recall") >= high) & active, "recover")
    rows = rows.withColumn("event", event)
    fired = F.when(F.col("event") == "fire", now).otherwise(F.col("alert_fired_at"))
    recovered = F.when(F.col("event") == "recover", now).when(F.col("event") == "fire", F.lit(None).cast("timestamp")).otherwise(F.col("recovered_at"))
    return rows.select("repo_id", "recall", "event", fired.alias("alert_fired_at"), recovered.alias("recovered_at"))


def alert_state(spark: SparkSession, root: str) -> DataFrame:
    """repo_id, alert_fired_at, recovered_at of every repository that ever had an alert."""
    rows = PartitionStore(spark, f"{root}/alerts/state").read()
    return spark.createDataFrame([], STATE) if rows is None else rows.drop(PART)


def alert(spark: SparkSession, root: str, number: int, repos: DataFrame, table: MessageTable, now: F.Column) -> DataFrame:
    """The events of a batch, written once, and the state after it: only the buckets of repositories whose state changed are rewritten."""
    store, path = PartitionStore(spark, f"{root}/alerts/state"), f"{root}/alerts/events/batch={number}"
    base = store.version()
    done = store.manifest(base).get("note")
    if done is not None and done >= number:
        return spark.read.schema(EVENT).parquet(path)
    after = materialize(transitions(recent_recall_of(table, repos), alert_state(spark, root), now), "alerts")
    changed = after.where(F.col("event").isNotNull())
    changed.select("repo_id", "recall", "event").write.mode("overwrite").parquet(path)
    bucket = F.pmod(F.xxhash64("repo_id"), F.lit(BUCKETS)).cast("string")
    fresh = changed.select(*STATE.names).withColumn(PART, bucket)
    touched = sorted(r[0] for r in fresh.select(PART).distinct().collect())  # at most BUCKETS values
    old = store.read(touched, base) if touched else None
    whole = fresh if old is None else fresh.unionByName(old.join(fresh.select("repo_id"), "repo_id", "left_anti"))
    out = store.fresh("state")
    whole.withColumn("_dir", dir_column(PART)).write.partitionBy("_dir").parquet(out)
    store.commit(out, whole.schema, store.folders_below(out), set(touched), base, note=number)
    return spark.read.schema(EVENT).parquet(path)
