import random

from runweave.operators.hierarchy import Peeled, cyclic_files, graph_hierarchy, links_of, node_rows, plain_path

SCHEMA = "result_id bigint, dependency_graph map<string,array<string>>, file_path string"


def reach(children, start):
    seen, work = set(), list(children[start])
    while work:
        n = work.pop()
        if n not in seen:
            seen.add(n)
            work += children[n]
    return seen


def brute(children):
    """Per node: descendants, in cycle, shortest first path from a root."""
    parents = {n: [p for p in children if n in children[p]] for n in children}
    best = {n: (n,) for n in children if not parents[n]}
    changed = True
    while changed:
        changed = False
        for p in list(best):
            for c in children[p]:
                path = (*best[p], c)
                if c not in path[:-1] and (c not in best or (len(path), path) < (len(best[c]), best[c])):
                    best[c] = path
                    changed = True
    return {n: (sorted(reach(children, n)), n in reach(children, n), list(best[n]) if n in best else None) for n in children}


def test_plain_paths():
    assert plain_path("./a//b/./c.ts") == "a/b/c.ts"
    assert plain_path("\\a\\b") == "a/b"
    assert plain_path("/a/../b") == "a/../b"
    assert plain_path(" . ") == " . " and plain_path("./") == ""


def test_random_graphs_against_brute_force():
    rnd = random.Random(4)
    for _ in range(150):
        n = rnd.randint(1, 9)
        graph = [(f"n{i}", [f"n{rnd.randrange(n)}" for _ in range(rnd.choice([0, 1, 1, 2]))]) for i in range(n)]
        want = brute(links_of(graph))
        for r in node_rows(graph):
            below, cycle, path = want[r["file_path"]]
            assert r["descendants"] == below and r["in_cycle"] == cycle, graph
            assert r["path"] == path, graph
            assert r["depth"] == (len(path) - 1 if path else None) and r["root"] == (path[0] if path else None)


def test_deep_and_wide():
    deep = [(f"f{i}", [f"f{i + 1}"]) for i in range(3000)]
    peeled = Peeled(links_of(deep))
    assert not peeled.in_cycle and peeled.place()[1]["f3000"] == 3000
    assert {r["file_path"]: (len(r["path"]), len(r["descendants"])) for r in node_rows(deep)} == {f"f{i}": (i + 1, 3000 - i) for i in range(3001)}
    wide = {r["file_path"]: r["subtree_size"] for r in node_rows([("top", [f"c{i}" for i in range(5000)])])}
    assert wide["top"] == 5001 and wide["c7"] == 1


def test_what_is_held_stays_small():
    chain = Peeled(links_of([(f"f{i:05d}", [f"f{i + 1:05d}"]) for i in range(20_000)]))
    assert sum(1 for _ in chain.below()) == 20_001  # each set is forgotten once its parent has heard
    many = node_rows([(f"f{i}", [f"f{i + 1}"]) for i in range(2000)], descendants=False)
    assert {r["descendants"] for r in many} == {None}


def test_cycles_of_a_long_chain(spark):
    n = 100_000
    df = spark.createDataFrame([(1, {f"f{i}": [f"f{i + 1}"] for i in range(n)} | {f"f{n}": [f"f{n - 1}"]}, None)], SCHEMA)
    assert sorted(r["file_path"] for r in cyclic_files(df).collect()) == sorted([f"f{n - 1}", f"f{n}"])


def test_cycle_between_cycles():
    graph = [("a", ["b"]), ("b", ["a", "mid"]), ("mid", ["c"]), ("c", ["d"]), ("d", ["c", "leaf"]), ("up", ["a"]), ("self", ["./self"])]
    assert Peeled(links_of(graph)).in_cycle == {"a", "b", "c", "d", "self"}


def test_nulls_and_spellings(spark, rows):
    data = [(1, {"a": ["./b", None, ""], "b": ["a\\"], "": ["x"]}, "z"), (2, None, None), (3, {}, None), (4, {"x": None, "y": []}, None), (5, {"./p": ["p"]}, None)]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(cyclic_files(df)) == [(1, "a"), (1, "b"), (5, "p")]
    found = graph_hierarchy(df)
    assert rows(found.select("result_id", "file_path")) == [(1, "a"), (1, "b"), (4, "x"), (4, "y"), (5, "p")]
    assert graph_hierarchy(df.where("result_id > 100")).count() == 0
