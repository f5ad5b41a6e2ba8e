"""Hierarchies of links that lie in rows of their own, of any size.

Graphs of at most ``gather`` links are brought together in a row each and peeled within a task (see ``hierarchy``), where
rows stream out and descendants are bits. Larger graphs go through joins. Their descendants are the closure of the links, as (ancestor, node)
rows that double their reach in each round, so a chain of n links takes log2(n) rounds; paths go down from the roots level by level. Where only
cycles are asked for no closure is made: nodes without a link in or out are trimmed again and again, and the strongly connected parts
of the rest are found by colours: the greatest name that reaches a node colours it, and the nodes of one colour that reach back to its
bearer form a part. A core that has become small enough is gathered.

Every round is written to the shared folder, so lineage stays short and a lost executor costs one round; what has been found is compacted
every few rounds, and superseded rounds are deleted. Loops end when a round finds nothing new.

Results are those of ``hierarchy.node_rows``: the same columns, ties and treatment of nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runweave.operators.hierarchy import NODE, Peeled, links_of, node_batches
from runweave.session import discard, materialize

GATHER, GATHER_CYCLES = 20_000, 1_000_000
SELF = "_graph_key"
COMPACT_EVERY = 8


class Found:
    """Materialized rows found round by round, rewritten as one table every few rounds, so that plans and file lists stay short."""

    def __init__(self, first: DataFrame):
        self.rows, self.pieces = first, [first]

    def add(self, more: DataFrame) -> None:
        if len(self.pieces) > COMPACT_EVERY:
            whole = materialize(self.rows, "found")
            discard(*self.pieces)
            self.rows, self.pieces = whole, [whole]
        self.pieces.append(more)  # the newest round stays as it is, since the next one reads it
        self.rows = self.rows.unionByName(more)


def _plain(c: str) -> F.Column:
    parts = F.split(F.regexp_replace(F.col(c), r"\\", "/"), "/")
    return F.array_join(F.filter(parts, lambda s: ~s.isin("", ".")), "/")


def plain_links(links: DataFrame, *, key: str, parent: str, child: str) -> DataFrame:
    """(_graph_key, p, c) in plain form, each once; a null c makes p a node without a link."""
    rows = links.select(F.col(key).alias(SELF), _plain(parent).alias("p"), F.nullif(_plain(child), F.lit("")).alias("c"))
    return materialize(rows.where(F.col(SELF).isNotNull() & (F.col("p") != "")).distinct(), "links")


def _gathered(rows: DataFrame) -> DataFrame:
    """A row a graph: its key and its links as entries of a file and a list of one."""
    entry = F.struct(F.col("p").alias("key"), F.when(F.col("c").isNotNull(), F.array("c")).alias("value"))
    return rows.groupBy(SELF).agg(F.collect_list(entry).alias("g"))


def _entries(value) -> list[tuple[str, list[str]]]:
    return [(e["key"], e["value"]) for e in value]


def link_hierarchy(links: DataFrame, *, key: str, parent: str = "parent", child: str = "child", gather: int = GATHER) -> DataFrame:
    """key and the columns of NODE for links(key, parent, child); a null child makes its parent a node without a link."""
    rows = plain_links(links, key=key, parent=parent, child=child)
    sizes = rows.groupBy(SELF).agg(F.count(F.lit(1)).alias("n"))
    small = rows.join(sizes.where(F.col("n") <= gather), SELF, "left_semi")
    schema = T.StructType([T.StructField(SELF, links.schema[key].dataType), *NODE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from node_batches(_entries(batch.column(1)[i].as_py()), batch.column(0)[i].as_py(), batch.schema.field(0).type)

    found = _gathered(small).mapInArrow(run, schema)
    large = materialize(rows.join(sizes.where(F.col("n") > gather), SELF, "left_semi"), "large")
    if not large.isEmpty():
        found = found.unionByName(_by_rounds(large))
    return found.withColumnRenamed(SELF, key)


def link_descendants(links: DataFrame, *, key: str, parent: str = "parent", child: str = "child") -> DataFrame:
    """key, node, descendant: a row for every node and every node below it; a node in a cycle is below itself."""
    rows = plain_links(links, key=key, parent=parent, child=child)
    return closure(rows.where("c is not null")).select(F.col(SELF).alias(key), F.col("n").alias("node"), F.col("d").alias("descendant"))


def link_cycles(links: DataFrame, *, key: str, parent: str = "parent", child: str = "child", gather: int = GATHER_CYCLES) -> DataFrame:
    """key, file_path: the nodes that reach themselves. Work in a task is linear in the links it gathers."""
    rows = plain_links(links, key=key, parent=parent, child=child).where("c is not null")
    found, large = _small_cycles(rows, gather)
    if not large.isEmpty():
        found = found.unionByName(_cyclic(large, gather))
    return found.distinct().select(F.col(SELF).alias(key), F.col("n").alias("file_path"))


def closure(edges: DataFrame) -> DataFrame:
    """(key, n, d): d can be reached from n over one link or more. Each round joins what the last one added with all pairs, on both sides."""
    fresh = materialize(edges.select(SELF, F.col("p").alias("n"), F.col("c").alias("d")).distinct(), "pairs")
    pairs = fresh
    while not fresh.isEmpty():
        ahead = fresh.select(SELF, "n", F.col("d").alias("m")).join(pairs.select(SELF, F.col("n").alias("m"), "d"), [SELF, "m"])
        behind = pairs.select(SELF, "n", F.col("d").alias("m")).join(fresh.select(SELF, F.col("n").alias("m"), "d"), [SELF, "m"])
        step = ahead.select(SELF, "n", "d").unionByName(behind.select(SELF, "n", "d")).distinct()
        added = materialize(step.join(pairs, [SELF, "n", "d"], "left_anti"), "fresh")
        whole = materialize(pairs.unionByName(added), "pairs")
        discard(fresh, pairs)
        pairs, fresh = whole, added
    return pairs


def _by_rounds(rows: DataFrame) -> DataFrame:
    edges = materialize(rows.where("c is not null").select(SELF, "p", "c"), "edges")
    nodes = materialize(rows.select(SELF, F.col("p").alias("n")).union(edges.select(SELF, "c")).distinct(), "nodes")
    pairs = closure(edges)
    below = pairs.groupBy(SELF, "n").agg(F.array_sort(F.collect_list("d")).alias("below"), F.bool_or(F.col("d") == F.col("n")).alias("cyc"))
    out = nodes.join(_paths(edges, nodes), [SELF, "n"], "left").join(below, [SELF, "n"], "left")
    own, cyc = F.coalesce("below", F.array().cast("array<string>")), F.coalesce("cyc", F.lit(False))
    return out.select(
        SELF, F.col("n").alias("file_path"), "path", (F.size("path") - 1).alias("depth"), F.col("path")[0].alias("root"), own.alias("descendants"),
        (F.size(own) + F.when(cyc, 0).otherwise(1)).alias("subtree_size"), cyc.alias("in_cycle"),
    )


def _paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, n, path) below the roots, breadth first."""
    roots = nodes.join(edges.select(SELF, F.col("c").alias("n")), [SELF, "n"], "left_anti")
    level = materialize(roots.withColumn("path", F.array("n")), "paths")
    found = Found(level)
    while not level.isEmpty():
        step = level.withColumnRenamed("n", "p").join(edges, [SELF, "p"]).groupBy(SELF, F.col("c").alias("n")).agg(F.min("path").alias("path"))
        level = materialize(step.join(found.rows.select(SELF, "n"), [SELF, "n"], "left_anti").withColumn("path", F.concat("path", F.array("n"))), "paths")
        found.add(level)
    return found.rows


def _small_cycles(edges: DataFrame, gather: int) -> tuple[DataFrame, DataFrame]:
    """(nodes in cycles of the graphs with few links, the links of the others)."""
    sizes = edges.groupBy(SELF).agg(F.count(F.lit(1)).alias("k"))
    small = edges.join(sizes.where(F.col("k") <= gather), SELF, "left_semi")
    schema = T.StructType([T.StructField(SELF, edges.schema[SELF].dataType), T.StructField("n", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names = [], []
            for i in range(batch.num_rows):
                found = sorted(Peeled(links_of(_entries(batch.column(1)[i].as_py()))).in_cycle)
                keys += [batch.column(0)[i].as_py()] * len(found)
                names += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(names, pa.string())], [SELF, "n"])

    return _gathered(small).mapInArrow(run, schema), materialize(edges.join(sizes.where(F.col("k") > gather), SELF, "left_semi").select(SELF, "p", "c"), "large")


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the given nodes."""
    return materialize(edges.join(nodes.withColumnRenamed("n", "p"), [SELF, "p"], "left_semi").join(nodes.withColumnRenamed("n", "c"), [SELF, "c"], "left_semi").select(SELF, "p", "c"), "within")


def _trim(edges: DataFrame) -> DataFrame:
    """Links left when nodes without a link in, or without one out, have gone again and again."""
    before = edges.count()
    while True:
        heads, tails = edges.select(SELF, F.col("p").alias("n")).distinct(), edges.select(SELF, F.col("c").alias("n")).distinct()
        both = materialize(heads.join(tails, [SELF, "n"], "left_semi"), "both")
        kept = _within(edges, both)
        after = kept.count()
        discard(both, edges)
        if after == before:
            return kept
        edges, before = kept, after


def _cyclic(edges: DataFrame, gather: int) -> DataFrame:
    """(key, n) of the nodes that reach themselves."""
    found = materialize(edges.where("p = c").select(SELF, F.col("p").alias("n")), "loops")
    edges = _trim(materialize(edges.where("p <> c"), "links"))
    while not edges.isEmpty():
        some, edges = _small_cycles(edges, gather)
        found = materialize(found.unionByName(some).distinct(), "cyclic")
        if edges.isEmpty():
            break
        colour = materialize(edges.select(SELF, F.col("p").alias("n")).distinct().withColumn("col", F.col("n")), "colour")
        while True:  # the greatest name that reaches a node
            sent = edges.join(colour.withColumnRenamed("n", "p"), [SELF, "p"]).select(SELF, F.col("c").alias("n"), "col")
            after = materialize(colour.unionByName(sent).groupBy(SELF, "n").agg(F.max("col").alias("col")), "colour")
            settled = after.join(colour, [SELF, "n", "col"], "left_anti").isEmpty()
            discard(colour)
            colour = after
            if settled:
                break
        front = materialize(colour.where("n = col"), "part")
        part = Found(front)
        while not front.isEmpty():  # nodes of the colour that reach its bearer
            back = edges.join(front.withColumnRenamed("n", "c"), [SELF, "c"]).select(SELF, F.col("p").alias("n"), "col").distinct()
            back = back.join(colour, [SELF, "n", "col"], "left_semi")
            front = materialize(back.join(part.rows, [SELF, "n", "col"], "left_anti"), "front")
            part.add(front)
        parts = part.rows
        many = parts.join(parts.groupBy(SELF, "col").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), [SELF, "col"], "left_semi").select(SELF, "n")
        found = materialize(found.unionByName(many).distinct(), "cyclic")
        gone = parts.select(SELF, "n")
        rest = edges.join(gone.withColumnRenamed("n", "p"), [SELF, "p"], "left_anti").join(gone.withColumnRenamed("n", "c"), [SELF, "c"], "left_anti")
        edges = _trim(materialize(rest.select(SELF, "p", "c"), "links"))
    return found
