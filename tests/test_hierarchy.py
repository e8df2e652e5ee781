import datetime as dt
import random

import pytest

from codeloom.operators.hierarchy import descendants, hierarchy, latest_nodes, tree_stats

SCHEMA = "repo_name string, id string, name string, parent_id string, created_at timestamp_ntz, updated_at timestamp_ntz, nid string, v int, top string"
DAY = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def nodes(spark, triples, group="r"):
    return latest_nodes(spark.createDataFrame([(group, i, f"n{i}", p, DAY(0), DAY(d), "x", 1, "t") for i, p, d in triples], SCHEMA))


def brute(parents):
    out = {}
    for x in parents:
        seen, at = [], x
        while at is not None and at not in seen:
            seen.append(at)
            at = parents[at] if parents[at] in parents else None
        if at is None:
            out[x] = (seen[-1], len(seen) - 1)
        else:
            cycle = seen[seen.index(at) :]
            out[x] = (min(cycle), -1 if x in cycle else -2)
    return out


def test_small_tree(spark, rows):
    t = hierarchy(nodes(spark, [("a", None, 1), ("b", " A ", 1), ("c", "b", 1), ("d", "nowhere", 1), ("e", "", 1)]))
    assert rows(t, "id", "root_id", "depth", "path") == [("a", "a", 0, "/na"), ("b", "a", 1, "/na/nb"), ("c", "a", 2, "/na/nb/nc"), ("d", "d", 0, "/nd"), ("e", "e", 0, "/ne")]
    assert rows(descendants(t), "folder_id", "below_id", "distance") == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


def test_the_latest_row_counts_and_groups_are_apart(spark, rows):
    rs = [("r", "a", "n", None), ("r", "b", "n", "a"), ("r", "b", "n", None), ("s", "c", None, "a")]
    df = spark.createDataFrame([(g, i, n, p, DAY(0), DAY(k if i != "b" else 9 - k), "x", 1, "t") for k, (g, i, n, p) in enumerate(rs)], SCHEMA)
    assert rows(hierarchy(latest_nodes(df)), "id", "root_id", "depth") == [("a", "a", 0), ("b", "a", 1), ("c", "c", 0)]


def test_cycles(spark, rows):
    t = hierarchy(nodes(spark, [("a", "a", 1), ("b", "c", 1), ("c", "d", 1), ("d", "b", 1), ("e", "d", 1), ("f", "e", 1), ("g", None, 1)]))
    assert rows(t, "id", "root_id", "depth") == [("a", "a", -1), ("b", "b", -1), ("c", "b", -1), ("d", "b", -1), ("e", "b", -2), ("f", "b", -2), ("g", "g", 0)]
    assert rows(tree_stats(t, nodes(spark, [(x, None, 1) for x in "abcdefg"])))[0] == ("r", 7, 1, 0, 4, 2)


def test_empty(spark):
    assert hierarchy(nodes(spark, [])).collect() == []


def test_nulls_in_any_column(spark, rows):
    df = spark.createDataFrame([(None, None, None, None, None, None, None, None, None), (None, "x", None, None, None, None, None, None, None), (None, "y", None, "X", None, None, None, None, None)], SCHEMA)
    assert rows(hierarchy(latest_nodes(df)), "id", "root_id", "depth", "path") == [("x", "x", 0, "/"), ("y", "x", 1, "//")]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_against_walking_up(spark, seed):
    rnd = random.Random(seed)
    ids = [f"k{i:03d}" for i in range(60)]
    parents = {x: rnd.choice([None, *ids, *ids[: i + 1], "missing"]) if rnd.random() < 0.9 else None for i, x in enumerate(ids)}
    parents |= {f"z{i}": f"z{i - 1}" if i else None for i in range(30)}  # deeper than a round
    given = nodes(spark, [(i, p, 1) for i, p in parents.items()])
    # few levels and salted parents, only levels, only pairs
    for levels, hot in ((3, 2), (40, 100), (0, 1)):
        t = hierarchy(given, levels=levels, hot=hot).collect()
        assert {r["id"]: (r["root_id"], r["depth"]) for r in t} == brute(parents)
        for r in t:
            if r["depth"] >= 0:
                line = [r["id"]]
                while parents.get(line[0]) in parents:
                    line.insert(0, parents[line[0]])
                assert (r["path"], r["ancestors"]) == ("".join(f"/n{i}" for i in line), line[:-1])
    flat = hierarchy(given, paths=False, levels=3, hot=2).collect()
    assert {r["id"]: (r["root_id"], r["depth"]) for r in flat} == brute(parents)


def test_long_cycles_with_long_tails(spark):
    ring = {f"r{i:03d}": f"r{(i + 1) % 50:03d}" for i in range(50)}
    tail = {f"t{i:03d}": f"t{i - 1:03d}" if i else "r007" for i in range(70)}
    t = hierarchy(nodes(spark, [(i, p, 1) for i, p in (ring | tail | {"root": None, "leaf": "root"}).items()]), levels=2).collect()
    assert {r["id"]: (r["root_id"], r["depth"]) for r in t} == brute(ring | tail | {"root": None, "leaf": "root"})
