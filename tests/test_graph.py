import random

import pytest

from codeloom.operators import graph as G
from codeloom.operators import search as S
from codeloom.operators import structure as C
from codeloom.operators import traverse as T
from codeloom.operators.graph import Graph

NODES = "project string, label string, qn string, name string, path string, start_line int, end_line int, docstring string, decorators array<string>, is_package boolean"


def node(qn, label="Function", project=None, **x):
    return (project or qn.split(".")[0], label, qn, x.get("name", qn.rpartition(".")[2]), x.get("path"), x.get("line"), None, None, x.get("decorators"), x.get("package"))


@pytest.fixture
def make(spark):
    def f(nodes, edges):
        return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(a, r, b, None) for a, r, b in edges], "src string, rel string, dst string, version string"))

    return f


@pytest.fixture
def tiny(make):
    names = ["p.a", "p.b", "p.c", "p.d", "p.self", "p.lone"]
    calls = [("p.a", "p.b"), ("p.b", "p.a"), ("p.b", "p.c"), ("p.c", "p.d"), ("p.d", "p.b"), ("p.self", "p.self"), ("p.a", "p.b")]
    return make([node(n) for n in names], [(a, "CALLS", b) for a, b in calls] + [("p.a", "CALLS", "p.gone")])


def one(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "qn string")


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("a&b", ("and", "a&b")), (" a & b & ", ("and", "a&b")), ("a&", ("pattern", "a&")), ("a|b", ("pattern", "a|b")), ("a | b", ("pattern", "a|b")), ("a|b*", ("regex", "a|b*")), ("un*att", ("regex", "un.*att")), ("un.*att", ("regex", "un.*att")),
        ("find the node", ("and", "find&node")), ("the of", ("pattern", "the of")), ("a+b", ("regex", "a+b")), ("x.y.z", ("exact", "x.y.z")), ("x.y", ("pattern", "x.y")), ("x.1.z", ("pattern", "x.1.z")), ("plain", ("pattern", "plain")), (".*a&b", ("regex", ".*a&b")),
    ],
)
def test_strategies(query, want):
    assert S.strategy_of(query) == want


def test_search_is_literal(make, rows):
    g = make([node("p.a_b", name="a_b"), node("p.axb", name="axb"), node("p.pct", name="50%"), node("p.up", name="UP", decorators=["@Cached"]), node("q.a_b", name="a_b"), node("p.null", name=None)], [])
    assert rows(S.find_nodes(g, "A_B"), "qn") == [("p.a_b",), ("q.a_b",)]
    assert rows(S.find_nodes(g, "0%"), "qn") == [("p.pct",)]
    assert rows(S.find_nodes(g, "up", case=True)) == []
    assert rows(S.find_nodes(g, r"\D_\D", strategy="regex"), "qn") == [("p.a_b",), ("q.a_b",)]
    assert rows(S.find_nodes(g, "a", project="q", labels=None), "qn") == [("q.a_b",)]
    assert rows(S.find_nodes(g, "up", decorator="cached"), "qn") == [("p.up",)]


def test_exact_falls_back_to_parts(make, rows):
    g = make([node("p.m.f"), node("p.m.g", name="x.m.f")], [])
    assert rows(S.find_nodes(g, "p.m.f"), "qn") == [("p.m.f",)]
    assert rows(S.find_nodes(g, "x.m.f"), "qn") == [("p.m.g",)]


def test_fuzzy_steps(make, rows):
    g = make([node("p.tensor.dim"), node("p.other.dim"), node("p.x.Tensor_dim", name="Tensor_dim"), node("p.y.zoom", name="zoom")], [])
    got = {r[0]: r[1:] for r in rows(S.fuzzy_search(g, ["p.tensor.dim", "tensor.dim.py", "other.dim", "TENSOR.zoom", "ZOOM", "oo", "nothing"], "p"), "request", "qn", "quality")}
    assert got == {"p.tensor.dim": ("p.tensor.dim", "exact"), "tensor.dim.py": ("p.tensor.dim", "exact"), "other.dim": ("p.other.dim", "exact"), "TENSOR.zoom": ("p.y.zoom", "fuzzy"), "ZOOM": ("p.y.zoom", "fuzzy"), "oo": ("p.y.zoom", "fuzzy")}


def test_reachable_includes_the_start_on_a_cycle_only(spark, tiny, rows):
    assert rows(T.reachable(tiny, one(spark, "p.a"), "CALLS", depth=2), "qn", "depth") == [("p.a", 2), ("p.b", 1), ("p.c", 2), ("p.gone", 1)]
    assert rows(T.reachable(tiny, one(spark, "p.self", "p.lone"), "CALLS"), "start", "qn", "depth") == [("p.self", "p.self", 1)]
    assert rows(T.reachable(tiny, one(spark, "p.a"), "CALLS", depth=1, reverse=True), "qn") == [("p.b",)]


def test_paths_and_cycles(spark, tiny, rows):
    assert rows(T.cycles(tiny, one(spark, "p.b", "p.self"), "CALLS", depth=4).selectExpr("array_join(path, '>') p", "depth")) == [("p.b>p.a>p.b", 2), ("p.b>p.c>p.d>p.b", 3)]
    pairs = spark.createDataFrame([("p.a", "p.d"), ("p.a", "p.lone")], "src string, dst string")
    assert rows(T.shortest_path(tiny, pairs, "CALLS")) == [("p.a", "p.d", 3, "p.a>p.b>p.c>p.d")]
    assert [r[0] for r in rows(T.trails(tiny, one(spark, "p.self"), "CALLS", depth=3).selectExpr("array_join(path, '>')"))] == ["p.self>p.self"]
    assert rows(T.walks(tiny, one(spark, "p.self"), "CALLS", depth=2), "qn", "depth") == [("p.self", 1), ("p.self", 2)]


def test_dependency_tree_marks_what_it_has_seen(spark, tiny, rows):
    assert rows(T.dependency_tree(tiny, one(spark, "p.a"), "CALLS", depth=4), "parent", "qn", "depth", "circular") == [("p.a", "p.b", 1, False), ("p.a", "p.gone", 1, False), ("p.b", "p.a", 2, True), ("p.b", "p.c", 2, False), ("p.c", "p.d", 3, False), ("p.d", "p.b", 4, True)]


@pytest.mark.parametrize("seed", range(2))
def test_reachability_against_breadth_first_search(spark, make, seed):
    rnd = random.Random(seed)
    names = [f"p.n{i}" for i in range(15)]
    pairs = {(rnd.choice(names), rnd.choice(names)) for _ in range(25)}
    g = make([node(n) for n in names], [(a, "CALLS", b) for a, b in pairs])
    want = {}
    for s in names:
        front, seen = {s}, {}
        for d in range(1, 5):
            front = {b for a, b in pairs if a in front} - set(seen)
            seen |= dict.fromkeys(front, d)
        want |= {(s, n): d for n, d in seen.items()}
    assert {(r["start"], r["qn"]): r["depth"] for r in T.reachable(g, one(spark, *names), "CALLS", depth=4).collect()} == want


def test_inheritance_takes_the_nearest(make, rows):
    # a diamond: d inherits b and c, both inherit a; and a cycle
    cls = [node(f"p.{x}", "Class") for x in "abcdxy"]
    g = make(cls, [("p.d", "INHERITS", "p.b"), ("p.d", "INHERITS", "p.c"), ("p.b", "INHERITS", "p.a"), ("p.c", "INHERITS", "p.a"), ("p.x", "INHERITS", "p.y"), ("p.y", "INHERITS", "p.x")] + [(f"p.{c}", "DEFINES_METHOD", f"p.{c}.{m}") for c, m in ("am", "an", "cm", "dm")])
    assert rows(C.ancestors(g).where("qn = 'p.d'"), "ancestor", "depth") == [("p.a", 2), ("p.b", 1), ("p.c", 1)]
    assert rows(C.inherited_methods(g).where("qn in ('p.b', 'p.d')"), "qn", "method", "found") == [("p.b", "m", "p.a.m"), ("p.b", "n", "p.a.n"), ("p.d", "m", "p.d.m"), ("p.d", "n", "p.a.n")]
    assert rows(C.overrides(g)) == [("p.c.m", "p.a.m"), ("p.d.m", "p.c.m")]


def test_inheritance_of_any_depth(make, rows):
    # a chain of 300 classes, methods at its ends only; a cycle of 5
    chain, cycle = [f"p.c{i}" for i in range(300)], [f"p.y{i}" for i in range(5)]
    up = [*zip(chain, chain[1:]), *zip(cycle, [*cycle[1:], cycle[0]])]
    g = make([node(c, "Class") for c in chain + cycle], [(a, "INHERITS", b) for a, b in up] + [(c, "DEFINES_METHOD", f"{c}.m") for c in (chain[0], chain[-1])])
    got = {(r["qn"], r["ancestor"]): r["depth"] for r in C.ancestors(g).collect()}
    assert got == {(chain[i], chain[j]): j - i for i in range(300) for j in range(i + 1, 300)} | {(cycle[i], cycle[(i + d) % 5]): d for i in range(5) for d in range(1, 5)}
    assert rows(C.overrides(g)) == [("p.c0.m", "p.c299.m")]
    assert rows(C.inherited_methods(g).where("qn in ('p.c0', 'p.c1')"), "qn", "found", "depth") == [("p.c0", "p.c0.m", 0), ("p.c1", "p.c299.m", 298)]


def test_edges_are_a_set_with_both_ends(tiny, rows):
    assert len(rows(G.upsert_edges(tiny.edges, tiny.nodes))) == 6


def test_last_write_wins(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), (None, 9, "z"), ("b", None, "y")], "k string, at int, v string")
    assert rows(G.upsert_nodes(df, "k", df["at"])) == [("a", 2, None), ("b", None, "y")]


def test_deleting(make, rows):
    g = make([node("p", "Project"), node("p.a"), node("p.ab"), node("p.a.x"), node("q", "Project"), node("ext.one", "ExternalPackage", "ext"), node("ext.two", "ExternalPackage", "ext")], [("p.a.x", "CALLS", "p.ab"), ("p.ab", "CALLS", "p.ab"), ("p", "DEPENDS_ON_EXTERNAL", "ext.one"), ("p", "DEPENDS_ON_EXTERNAL", "ext.two"), ("q", "DEPENDS_ON_EXTERNAL", "ext.two")])
    cut = G.delete_prefix(g, "p.a")
    assert rows(cut.nodes.where("project = 'p'"), "qn") == [("p",), ("p.ab",)]
    assert rows(cut.edges.where("rel = 'CALLS'"), "src") == [("p.ab",)]
    left = G.delete_project(g, "p")
    assert rows(left.nodes, "qn") == [("ext.two",), ("q",)] and rows(left.edges, "src", "dst") == [("q", "ext.two")]


def test_written_and_read(spark, tiny, tmp_path, rows):
    G.write_graph(tiny, str(tmp_path / "g"))
    back = G.read_graph(spark, str(tmp_path / "g"))
    assert rows(back.nodes, "qn", "label") == rows(tiny.nodes, "qn", "label") and rows(back.edges, "src", "rel", "dst") == rows(tiny.edges, "src", "rel", "dst")


def test_package_roll_up_stops_at_gaps(make, rows):
    g = make([node("p.a", "Folder", package=True), node("p.a.b", "Folder", package=False), node("p.a.c", "Folder", package=True), node("p.a.b.f", "File"), node("p.a.c.g", "File"), node("p.a.c.g.h")], [("p.a.c.g", "DEFINES", "p.a.c.g.h")])
    assert rows(C.package_tree(g)) == [("p.a", 1, 1), ("p.a.c", 1, 1)]
