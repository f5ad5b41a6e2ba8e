import random

from runweave.operators.hierarchy import node_rows
from runweave.operators.links import link_cycles, link_descendants, link_hierarchy

SCHEMA = "g int, parent string, child string"


def check(df, graphs, gather):
    got = sorted((tuple(r) for r in link_hierarchy(df, key="g", gather=gather).collect()), key=str)
    want = []
    for g, graph in graphs.items():
        want += [(g, r["file_path"], r["path"], r["depth"], r["root"], r["descendants"], r["subtree_size"], r["in_cycle"]) for r in node_rows(graph)]
    assert got == sorted(want, key=str)


def test_rounds_and_gathered_agree(spark):
    rnd = random.Random(9)
    graphs = {}
    for g in range(12):
        n = rnd.randint(2, 6)
        graphs[g] = [(f"n{i}", [f"./n{rnd.randrange(n)}" for _ in range(rnd.choice([0, 1, 1, 2]))]) for i in range(n)]
    data = [(g, p, c) for g, graph in graphs.items() for p, cs in graph for c in (cs or [None])]
    df = spark.createDataFrame(data + data[:5] + [(None, "a", "b"), (0, "", "x")], SCHEMA)
    check(df, graphs, 100)
    check(df, graphs, 4)
    nodes = {(g, r["file_path"]): r for g, graph in graphs.items() for r in node_rows(graph)}
    assert sorted(map(tuple, link_descendants(df, key="g").collect())) == sorted((g, n, d) for (g, n), r in nodes.items() for d in r["descendants"])
    for gather in (100, 3, 0):
        assert sorted(map(tuple, link_cycles(df, key="g", gather=gather).collect())) == sorted(k for k, r in nodes.items() if r["in_cycle"])


def test_long_chain_by_doubling(spark):
    df = spark.createDataFrame([(1, f"n{i:03d}", f"n{i + 1:03d}") for i in range(100)], SCHEMA)
    assert link_descendants(df, key="g").count() == 100 * 101 // 2


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert link_hierarchy(none, key="g").count() == link_cycles(none, key="g").count() == link_descendants(none, key="g").count() == 0
