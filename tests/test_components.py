import random

import pytest

from codeloom.operators import components as K
from codeloom.operators import structure
from codeloom.operators.graph import Graph


def pairs_of(edges):
    up, out = {}, {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    for s in up:
        front, seen, d = {s}, {s}, 0
        while front:
            front, d = {b for a in front for b in up.get(a, ())} - seen, d + 1
            seen |= front
            out |= {(s, b): d for b in front}
    return out


def random_graph(spark, seed):
    rnd = random.Random(seed)
    names = [f"p.c{i}" for i in range(60)]
    edges = [(rnd.choice(names), rnd.choice(names)) for _ in range(45)] + [(f"q.k{i}", f"q.k{i + 1}") for i in range(30)]
    rnd.shuffle(edges)
    own = [(c, f"{c}.m{rnd.randrange(4)}") for c in [*names, "q.k3", "q.k20", "q.k30", "r.alone"] for _ in range(2)]
    rows = [(a, "INHERITS", b) for a, b in edges] + [(c, "DEFINES_METHOD", m) for c, m in own]
    return edges, own, Graph(None, spark.createDataFrame(rows, "src string, rel string, dst string"))


@pytest.mark.parametrize(("heap", "most", "block"), [(3, 1000, 5), (1000, 12, 1000)])
def test_closed_by_component(spark, monkeypatch, heap, most, block):
    # heaps of three edges, blocks of five rows; and components over 12 edges, which are doubled
    monkeypatch.setattr(K.components, "__defaults__", (heap,))
    monkeypatch.setattr(K.split, "__defaults__", (most,))
    monkeypatch.setattr(K.closed, "__defaults__", (None, block))
    edges, own, g = random_graph(spark, heap)
    pairs = pairs_of(edges)
    got = structure.ancestors(g).collect()
    assert len(got) == len(pairs) and {(r["qn"], r["ancestor"]): r["depth"] for r in got} == pairs
    best, over = {}, {}
    last = lambda m: m.rpartition(".")[2]
    for (c, a), d in [*pairs.items(), *(((c, c), 0) for c in dict(own))]:
        for x, m in own:
            if x == a:
                best[c, last(m)] = min(best.get((c, last(m)), (99, "")), (d, m))
                over |= {n: min(over.get(n, (99, "")), (d, m)) for y, n in own if y == c and last(n) == last(m) and d}
    got = structure.inherited_methods(g).collect()
    assert len(got) == len(best) and {(r["qn"], r["method"]): (r["depth"], r["found"]) for r in got} == best
    assert {r["src"]: r["dst"] for r in structure.overrides(g).collect()} == {m: v for m, (_, v) in over.items()}


def test_pairs_are_neither_shuffled_nor_stored(spark):
    edges = spark.createDataFrame([(f"p.c{k}.o{i}", "INHERITS", f"p.c{k}.o{i + 1}") for k in range(50) for i in range(20)], "src string, rel string, dst string")
    df = structure.ancestors(Graph(None, edges))
    assert df.count() == 50 * 210
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("MapInArrow")


def test_inherited_methods_are_closed_in_the_tasks(spark, rows):
    edges = [("p.a", "INHERITS", "p.b"), ("p.b", "INHERITS", "p.c"), ("p.c", "DEFINES_METHOD", "p.c.m"), ("p.a", "DEFINES_METHOD", "p.a.m")]
    g = Graph(None, spark.createDataFrame(edges, "src string, rel string, dst string"))
    got = structure.inherited_methods(g)
    assert got._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")
    assert rows(got, "qn", "found", "depth") == [("p.a", "p.a.m", 0), ("p.b", "p.c.m", 1), ("p.c", "p.c.m", 0)]
    assert rows(structure.overrides(g)) == [("p.a.m", "p.c.m")]
