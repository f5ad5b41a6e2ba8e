"""Streaming ingest of runs, alerts with keyed state, and weekly trends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runweave.functions.expr import missed, size0
from runweave.session import state_path
from runweave.sources.run_log import RUN
from runweave.streaming.ingest import ingest_batch


def read_runs(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """A stream of run records from a folder of JSON lines."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("ingest_seq", T.LongType()), *RUN.fields])
    return spark.readStream.schema(schema).options(**options).json(folder)


def ingest_stream(runs: DataFrame, root: str, checkpoint: str, *, notify: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Run records into a message table, each once, invalid ones and alerts beside it (see ``ingest``).

    Every micro-batch goes whole to the table, however late its rows are: the table's identifier index finds repeats at any distance and
    keeps the least sequence number, and the table commits a batch by one manifest.
    """

    def take(batch: DataFrame, number: int) -> None:
        ingest_batch(batch, root, number, notify=notify)

    return runs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alert_stream(runs: DataFrame, *, low: float = 0.95, high: float = 0.98, window: int = 20) -> DataFrame:
    """repo_id, ingest_seq, recall, event (fire, recover) from a stream; per repository the state is its last ``window`` counts and whether an alert is active."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fails, misses, active = state.get if state.exists else ([], [], False)
        rows = pd.concat(list(parts)).sort_values(["created_at", "ingest_seq"])
        before = len(fails)
        f, m = (np.concatenate([np.asarray(old, np.int64), rows[c].to_numpy(np.int64)]) for old, c in ((fails, "f"), (misses, "m")))
        # sums over the window that ends at each new row, as differences of running totals
        last = np.arange(before, len(f)) + 1
        first = np.maximum(last - window, 0)
        failed, missed_ = (np.concatenate([[0], np.cumsum(x)])[last] - np.concatenate([[0], np.cumsum(x)])[first] for x in (f, m))
        recall = np.where(failed > 0, (failed - missed_) / np.maximum(failed, 1), 1.0)
        telling = np.flatnonzero((recall < low) | (recall >= high))
        bad = recall[telling] < low
        was_bad = np.concatenate([[active], bad[:-1]]) if len(bad) else bad
        turns = np.flatnonzero(bad != was_bad)
        at = telling[turns]
        state.update((f[-window:].tolist(), m[-window:].tolist(), bool(bad[-1]) if len(bad) else active))
        yield pd.DataFrame({"repo_id": [key[0]] * len(at), "ingest_seq": rows["ingest_seq"].to_numpy()[at], "recall": recall[at], "event": np.where(bad[turns], "fire", "recover")})

    slim = runs.where("repo_id is not null and created_at is not null").select("repo_id", "ingest_seq", "created_at", size0("actual_failures").alias("f"), missed().alias("m"))
    return slim.groupBy("repo_id").applyInPandasWithState(step, "repo_id string, ingest_seq bigint, recall double, event string", "fails array<int>, misses array<int>, active boolean", "append", GroupStateTimeout.NoTimeout)


def weekly_stream(runs: DataFrame, late: str = "7 days") -> DataFrame:
    """repo_id, week, runs, minutes_saved per week from Sunday, as a windowed aggregate with a watermark (the epoch was a Thursday: three days on is a Sunday)."""
    minutes = F.col("time_saved_minutes").cast("double")
    rows = runs.withWatermark("created_at", late).groupBy("repo_id", F.window("created_at", "7 days", "7 days", "3 days").alias("w"))
    sums = rows.agg(F.count(F.lit(1)).alias("runs"), F.sum(F.when(~F.isnan(minutes), minutes)).alias("minutes_saved"))
    return sums.select("repo_id", F.to_date("w.start").alias("week"), "runs", "minutes_saved")


def drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now and return the rows it put out."""
    mark = state_path(df.sparkSession, "stream")
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
