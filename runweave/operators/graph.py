"""Import graphs: who depends on a changed file, and how far a file is from the graph's keys.

Graphs that arrive in a row are walked in the task that reads the row; links in rows of their own go through a frontier loop
of joins whose every round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runweave.functions.expr import is_test_file
from runweave.operators.hierarchy import links_of, plain_path
from runweave.operators.links import Found
from runweave.session import materialize


def file_links(graphs: DataFrame, *, graph: str = "dependency_graph", key: str = "result_id") -> DataFrame:
    """key, src, dst: a distinct row for each link in plain form (src imports dst), and one with a null dst for a file whose list is empty or null."""
    norm = lambda c: F.array_join(F.filter(F.split(F.regexp_replace(c, r"\\", "/"), "/"), lambda s: ~s.isin("", ".")), "/")
    pairs = graphs.select(key, F.explode(graph).alias("src", "d")).select(key, norm(F.col("src")).alias("src"), F.explode_outer("d").alias("dst"))
    return pairs.select(key, "src", F.nullif(norm(F.col("dst")), F.lit("")).alias("dst")).where(F.col("src") != "").distinct()


def links(graphs: DataFrame, *, graph: str = "dependency_graph", key: str = "result_id") -> DataFrame:
    """key, src, dst: distinct links in plain form; src imports dst."""
    return file_links(graphs, graph=graph, key=key).where(F.col("dst").isNotNull())


def files(graphs: DataFrame, *, graph: str = "dependency_graph", key: str = "result_id") -> DataFrame:
    """key, path: every file of each graph once, also those that neither import nor are imported."""
    rows = file_links(graphs, graph=graph, key=key)
    return rows.select(key, F.explode(F.array("src", "dst")).alias("path")).where(F.col("path").isNotNull()).distinct()


def dependents(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth): everything that reaches a seed over src -> dst links, seeds at depth 0; each node once, at its least depth.

    edges(src, dst), seeds(node). Only the frontier joins the links; the loop ends with the round that finds nothing new, so cycles do no harm and
    nothing is cut off. Found nodes are compacted every few rounds.
    """
    edges = materialize(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "links")
    frontier = materialize(seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "frontier")
    found, depth = Found(frontier), 0
    while not frontier.isEmpty():
        depth += 1
        step = edges.join(frontier.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
        frontier = materialize(step.join(found.rows.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        found.add(frontier)
    return found.rows


def blocking_tests(graphs: DataFrame, *, graph: str = "dependency_graph", key: str = "result_id", changed: str = "changed") -> DataFrame:
    """key, test_path: the tests among all files that reach one of the row's changed files, changed files included."""
    schema = T.StructType([T.StructField("_graph_key", graphs.schema[key].dataType), T.StructField("test_path", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for i in range(batch.num_rows):
                children = links_of(batch.column(1)[i].as_py())
                above: dict[str, list[str]] = {}
                for p, own in children.items():
                    for c in own:
                        above.setdefault(c, []).append(p)
                seen = {q for p in batch.column(2)[i].as_py() or () if (q := plain_path(p or ""))}
                work = list(seen)
                while work:
                    for p in above.get(work.pop(), ()):
                        if p not in seen:
                            seen.add(p)
                            work.append(p)
                keys += [batch.column(0)[i].as_py()] * len(seen)
                out += sorted(seen)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(out, pa.string())], ["_graph_key", "test_path"])

    rows = graphs.where(F.col(graph).isNotNull()).select(F.col(key).alias("_graph_key"), F.col(graph).alias("g"), F.col(changed).alias("c"))
    return rows.mapInArrow(run, schema).where(is_test_file("test_path")).withColumnRenamed("_graph_key", key)


def key_distance(edges: DataFrame, key: str = "result_id") -> DataFrame:
    """key, path, distance: 0 for the graph's keys, 0.2 for files that are only imported. edges as ``file_links`` gives them (a null dst is no file)."""
    keys = edges.select(key, F.col("src").alias("path"), F.lit(1).alias("k"))
    targets = edges.where(F.col("dst").isNotNull()).select(key, F.col("dst").alias("path"), F.lit(0).alias("k"))
    return keys.unionByName(targets).groupBy(key, "path").agg(F.when(F.max("k") == 1, 0.0).otherwise(0.2).alias("distance"))
