"""Readers and writers of run logs, test-runner results and source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("repo_id", T.StringType()), T.StructField("pr_number", T.LongType()), T.StructField("sha", T.StringType()),
    T.StructField("predicted_skip", T.ArrayType(T.StringType())), T.StructField("actual_failures", T.ArrayType(T.StringType())), T.StructField("all_tests", T.ArrayType(T.StringType())),
    T.StructField("mode", T.StringType()), T.StructField("time_saved_minutes", T.FloatType()), T.StructField("created_at", T.TimestampType()),
])

SOURCE_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".rb", ".go")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Run records of JSON lines. Broken lines are left out, a date that can't be read is null, a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], RUN)
    text = T.StructType([T.StructField(f.name, T.StringType() if f.name == "created_at" else f.dataType) for f in RUN.fields] + [T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", text, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return rows.where(F.col("_bad").isNull()).drop("_bad").withColumn("created_at", F.try_to_timestamp("created_at"))


def append_run_log(runs: DataFrame, path: str) -> None:
    """Append records as JSON lines with ISO times in UTC."""
    out = runs.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    out.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_runs(runs: DataFrame, path: str) -> None:
    """The table's layout: partitions of repository and month, files sorted by time within a task."""
    rows = runs.withColumn("yyyymm", F.date_format("created_at", "yyyyMM")).hint("rebalance", "repo_id", "yyyymm")
    rows.sortWithinPartitions("repo_id", "yyyymm", "created_at").write.mode("append").partitionBy("repo_id", "yyyymm").parquet(path)


def failed_test_files(spark: SparkSession, path: str, workspace: str = "") -> DataFrame:
    """path: failed files of test-runner results in JSON (a file, a folder or a glob), without the workspace's prefix; no rows if there is no such list.

    A failed entry without a path has a null one.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "path string")
    kind = "struct<testResults:array<struct<testFilePath:string,status:string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("r")).select(F.explode("r.testResults").alias("t"))
    name = F.col("t.testFilePath")
    root = workspace.rstrip("/") + "/"
    short = F.when(name.startswith(root), F.substr(name, F.lit(len(root) + 1))).otherwise(name) if workspace else name
    return rows.where("t.status = 'failed'").select(short.alias("path")).distinct()


def read_tree(spark: SparkSession, root: str, endings: tuple[str, ...] = SOURCE_ENDINGS, ignored: tuple[str, ...] = ("node_modules", ".git", "dist")) -> DataFrame:
    """path (below root), content of the source files of a tree; folders of the ignored names directly below the root are left out.

    Bytes that are no UTF-8 are replaced. A file that is listed but can't be read has a null content.
    """
    base = "file://" + root if root.startswith("/") else root
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    path = F.substr(F.regexp_replace("path", "^file:/+", "/"), F.lit(len(root.rstrip("/")) + 2)) if root.startswith("/") else F.substr("path", F.lit(len(root.rstrip("/")) + 2))
    wanted = F.lit(False)
    for e in endings:
        wanted = wanted | F.col("path").endswith(e)
    listed = reader.load(base).select(path.alias("path")).where(wanted & ~F.split("path", "/")[0].isin(*ignored))  # names only: nothing is opened
    read = reader.option("ignoreCorruptFiles", "true").load(base).select(path.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return listed.join(read.where(wanted), "path", "left")


def read_test_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content of the tests of a tree, in path order."""
    from runweave.functions.expr import is_test_file

    return read_tree(spark, root).where(is_test_file("path")).orderBy("path")
