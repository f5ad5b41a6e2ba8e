"""Session set-up and the shared state folder."""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_swept: set[str] = set()
_open: list[list[str]] = []


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and rebalancing of skewed partitions switched on."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where the setting is absent a temporary folder is made and set, but only in local mode, where the driver runs every task; a cluster
    without the setting is an error, since its executors would each write to a disk of their own.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = have.get() if have.isDefined() else None
    if not known:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="runweave-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def app_dir(spark: SparkSession) -> str:
    """What this application writes below the shared folder; it goes when the driver's process ends."""
    app = spark.sparkContext.applicationId
    if app not in _swept:
        _swept.add(app)
        atexit.register(_quietly, drop_state, spark)
    return f"{shared_dir(spark)}/runweave/{app}"


def state_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the application's folder; every call gets its own."""
    path = f"{app_dir(spark)}/{what}-{uuid.uuid4().hex}"
    for held in _open:
        held.append(path)
    return path


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and outlives a lost executor."""
    spark = df.sparkSession
    path = state_path(spark, what)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def delete(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of materialized tables that no later plan reads."""
    for df in tables:
        if df is not None and (path := getattr(df, "_written", None)):
            delete(df.sparkSession, path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written inside the block are deleted at its end; results must have been used by then."""
    mine: list[str] = []
    _open.append(mine)
    try:
        yield
    finally:
        _open.remove(mine)
        for path in mine:
            delete(spark, path)


def drop_state(spark: SparkSession) -> None:
    """Delete everything this application wrote below the shared folder; results that still read from there can't be used after."""
    delete(spark, app_dir(spark))
    _shipped.discard(spark.sparkContext.applicationId)


def _quietly(f, *args) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        f(*args)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its scan has fewer (a few small files before costly Python work)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df




def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once an application, through a zip file in the shared folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    target = f"{app_dir(spark)}/runweave.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
