"""Parent-child links to full hierarchies, cycles included.

One graph is worked on by bottom-up leaf peeling: a node without unpeeled children leaves, and sends its descendants and
subtree size to its parents, which forget nothing and are forgotten when the last parent has heard. What never leaves contains the cycles and what lies above them. The reverse of the peel order
then hands paths and depths down. A graph that arrives in one row is peeled in the task that reads the row, without a
shuffle; graphs whose links are spread over rows go through ``links.link_hierarchy``, which gathers graphs up to a bound of
links into a task and peels larger ones by distributed rounds.

Defined results: path, depth and root follow the parent of least (depth, path), so a file with several parents gets its shortest
path and among these the first in code-point order. Depth of a root is 0. Nodes without any root above them (they hang
on a cycle only) have null path, depth and root. A node is in a cycle if it reaches itself by one link or more, itself
included as its own child. Null graphs, null lists and null children give no links; an empty list gives a node without children. Repeated children count
once, blank paths are no files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES_AT_ONCE = 200_000
NODE = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("path", T.ArrayType(T.StringType())),
    T.StructField("depth", T.IntegerType()),
    T.StructField("root", T.StringType()),
    T.StructField("descendants", T.ArrayType(T.StringType())),
    T.StructField("subtree_size", T.IntegerType()),
    T.StructField("in_cycle", T.BooleanType()),
])


def plain_path(path: str) -> str:
    """Relative, single forward slashes, no '.' segments; '..' stays as written."""
    return "/".join(s for s in path.replace("\\", "/").split("/") if s not in ("", "."))


def links_of(graph) -> dict[str, set[str]]:
    """node -> children in plain form, every node a key; graph: pairs of a file and a list of files."""
    children: dict[str, set[str]] = {}
    for parent, imported in graph or ():
        p = plain_path(parent or "")
        if not p:
            continue
        own = children.setdefault(p, set())
        for child in imported or ():
            c = plain_path(child or "")
            if c:
                own.add(c)
                children.setdefault(c, set())
    return children


class Peeled:
    """Result of bottom-up leaf peeling: peel order, residual nodes, those of them in cycles, and each node's place below a root.

    Nothing here grows faster than the links: descendants and paths are made node by node as they are asked for.
    """

    def __init__(self, children: dict[str, set[str]]):
        self.children = children
        self.parents: dict[str, list[str]] = {n: [] for n in children}
        for p, own in children.items():
            for c in own:
                self.parents[c].append(p)
        self.order: list[str] = []
        waiting = {n: len(own) for n, own in children.items()}
        leaves = [n for n, w in waiting.items() if not w]
        while leaves:
            after = []
            for n in leaves:
                self.order.append(n)
                for p in self.parents[n]:
                    waiting[p] -= 1
                    if not waiting[p]:
                        after.append(p)
            leaves = after
        self.residual = {n for n, w in waiting.items() if w}
        self.parts: list[list[str]] = []
        self.in_cycle = self._cycles()

    def _cycles(self) -> set[str]:
        """Exact check on the residual: strongly connected parts of two or more nodes, and self-links. Parts come out children first."""
        rest = self.residual
        if not rest:
            return set()
        index: dict[str, int] = {}
        low: dict[str, int] = {}
        stack: list[str] = []
        on: set[str] = set()
        found: set[str] = set()
        for start in rest:
            if start in index:
                continue
            index[start] = low[start] = len(index)
            stack.append(start)
            on.add(start)
            work = [(start, iter(self.children[start]))]
            while work:
                n, it = work[-1]
                for c in it:
                    if c not in rest:
                        continue
                    if c not in index:
                        index[c] = low[c] = len(index)
                        stack.append(c)
                        on.add(c)
                        work.append((c, iter(self.children[c])))
                        break
                    if c in on:
                        low[n] = min(low[n], index[c])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[n])
                    if low[n] == index[n]:
                        part = []
                        while True:
                            m = stack.pop()
                            on.discard(m)
                            part.append(m)
                            if m == n:
                                break
                        self.parts.append(part)
                        if len(part) > 1 or n in self.children[n]:
                            found.update(part)
        return found

    def place(self) -> tuple[dict[str, str | None], dict[str, int]]:
        """(parent, depth) of every node below a root: residual nodes level by level, then the peeled ones in reverse peel order."""
        above: dict[str, str | None] = {n: None for n in self.children if not self.parents[n]}
        depth = dict.fromkeys(above, 0)

        def less(a: str, b: str) -> bool:
            """Whether the path to a comes before the one to b, both of one depth: they part where their parents first agree."""
            while above[a] != above[b]:
                a, b = above[a], above[b]
            return a < b

        level = [n for n in above if n in self.residual]
        while level:
            following: dict[str, str] = {}
            for n in level:
                for c in self.children[n]:
                    if c in self.residual and c not in depth and (c not in following or less(n, following[c])):
                        following[c] = n
            for c, n in following.items():
                above[c], depth[c] = n, depth[n] + 1
            level = list(following)
        for n in reversed(self.order):
            if n not in depth:
                best = None
                for p in self.parents[n]:
                    if p in depth and (best is None or depth[p] < depth[best] or depth[p] == depth[best] and less(p, best)):
                        best = p
                if best is not None:
                    above[n], depth[n] = best, depth[best] + 1
        return above, depth

    def below(self) -> Iterator[tuple[list[str], int, list[str]]]:
        """(nodes, their descendants as bits of an integer, the names the bits stand for), every node once, children before parents.

        A peeled node sends its descendants to its parents and forgets them when the last has heard, so what is held at a time is
        what lies between peeled children and waiting parents; bits make that an eighth of a byte a node. The nodes of a strongly connected part share theirs.
        """
        names = sorted(self.children)
        bit = {n: i for i, n in enumerate(names)}
        held: dict[str, int] = {}
        unheard = {n: len(ps) for n, ps in self.parents.items()}

        def gathered(nodes: list[str]) -> int:
            inside = set(nodes)
            bits = 0
            for n in nodes:
                for c in self.children[n]:
                    if c not in inside:
                        bits |= held[c]
                    bits |= 1 << bit[c]
            for n in nodes:
                for c in self.children[n]:
                    unheard[c] -= 1
                    if not unheard[c]:
                        held.pop(c, None)
            return bits

        for nodes in [*([n] for n in self.order), *self.parts]:
            bits = gathered(nodes)
            for n in nodes:
                if unheard[n]:
                    held[n] = bits
            yield nodes, bits, names


def _named(bits: int, names: list[str]) -> list[str]:
    """The names of the set bits, in order."""
    if not bits:
        return []
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return [names[i] for i in np.flatnonzero(np.unpackbits(raw, bitorder="little"))]


def node_rows(graph, descendants: bool = True) -> Iterator[dict]:
    """One dict per node of a graph, in the shape of NODE, as peeling reaches it; descendants are null if not asked for."""
    peeled = Peeled(links_of(graph))
    above, depth = peeled.place()
    for nodes, bits, names in peeled.below():
        count = bits.bit_count()
        own = _named(bits, names) if descendants else None
        for n in nodes:
            path = [n] if n in depth else None
            while path and above[path[-1]] is not None:
                path.append(above[path[-1]])
            size = count if n in peeled.in_cycle else count + 1
            yield {"file_path": n, "path": path and path[::-1], "depth": depth.get(n), "root": path[-1] if path else None,
                   "descendants": own, "subtree_size": size, "in_cycle": n in peeled.in_cycle}


_ARROW = pa.schema([pa.field("file_path", pa.string()), pa.field("path", pa.list_(pa.string())), pa.field("depth", pa.int32()), pa.field("root", pa.string()),
                    pa.field("descendants", pa.list_(pa.string())), pa.field("subtree_size", pa.int32()), pa.field("in_cycle", pa.bool_())])


def node_batches(graph, key, kind: pa.DataType, descendants: bool = True) -> Iterator[pa.RecordBatch]:
    """The rows of a graph in batches of at most about NAMES_AT_ONCE names, the key before them."""
    rows, names = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        body = pa.Table.from_pylist(rows, _ARROW)
        yield from pa.Table.from_arrays([pa.array([key] * len(rows), kind), *body.columns], ["_graph_key", *_ARROW.names]).to_batches()

    for row in node_rows(graph, descendants):
        rows.append(row)
        names += 1 + len(row["path"] or ()) + len(row["descendants"] or ())
        if names > NAMES_AT_ONCE:
            yield from flush()
            rows, names = [], 0
    if rows:
        yield from flush()


def graph_hierarchy(df: DataFrame, *, graph: str = "dependency_graph", key: str = "result_id", descendants: bool = True) -> DataFrame:
    """key and the columns of NODE: a row for each file of each row's graph. No shuffle. Without ``descendants`` that column is null and only sizes are made."""
    schema = T.StructType([T.StructField("_graph_key", df.schema[key].dataType), *NODE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a graph at a time
                yield from node_batches(batch.column(1)[i].as_py(), batch.column(0)[i].as_py(), batch.schema.field(0).type, descendants)

    found = df.where(F.col(graph).isNotNull()).select(F.col(key).alias("_graph_key"), F.col(graph).alias("g")).mapInArrow(run, schema)
    return found.withColumnRenamed("_graph_key", key)


def cyclic_files(df: DataFrame, *, graph: str = "dependency_graph", key: str = "result_id") -> DataFrame:
    """key, file_path: the files of each graph that reach themselves."""
    schema = T.StructType([T.StructField("_graph_key", df.schema[key].dataType), T.StructField("file_path", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, paths = [], []
            for i in range(batch.num_rows):
                found = sorted(Peeled(links_of(batch.column(1)[i].as_py())).in_cycle)
                keys += [batch.column(0)[i].as_py()] * len(found)
                paths += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(paths, pa.string())], ["_graph_key", "file_path"])

    found = df.where(F.col(graph).isNotNull()).select(F.col(key).alias("_graph_key"), F.col(graph).alias("g")).mapInArrow(run, schema)
    return found.withColumnRenamed("_graph_key", key)
