"""Inheritance closed within connected components.

All ancestor pairs of many small hierarchies are far more than their edges, so pairs are neither shuffled nor stored:
edges are brought together by component, once, and each task closes whole components as it hands on its rows.

Components come from 64-bit hashes of names. Edges that lie together are joined by their task first, some hundred
thousand at a time; only nodes that several such heaps know make links between heaps, whose stars are contracted. Two
names of one hash just share a component; within it names are compared in full.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.lineage import cut, stored

#: Edges a task joins at once; edges of a component that one task closes; rows it closes at once.
HEAP, MOST, BLOCK = 200_000, 2_000, 8_000


def _roots(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least node of each edge's component."""
    nodes, ids = np.unique(np.concatenate([src, dst]), return_inverse=True)
    s, d = ids[: len(src)], ids[len(src) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[s], label[d])
        new = label.copy()
        for ends in (s, d, label[s], label[d]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == label).all():
            return nodes[label[s]]
        label = new


def _heaps(edges: DataFrame, heap: int) -> DataFrame:
    """edges (`src, dst`) with the root of their component within a heap."""
    hashed = edges.select("src", "dst", F.xxhash64("src").alias("hs"), F.xxhash64("dst").alias("hd"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in _ended(batches):
            held += [b] if b is not None and b.num_rows else []
            if held and (b is None or sum(x.num_rows for x in held) >= heap):
                t = pa.Table.from_batches(held).combine_chunks()
                root = _roots(t["hs"].to_numpy(), t["hd"].to_numpy())
                yield from t.select(["src", "dst"]).append_column("root", pa.array(root, pa.int64())).to_batches(max_chunksize=10_000)
                held = []

    return hashed.mapInArrow(run, "src string, dst string, root bigint")


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _contracted(links: DataFrame) -> DataFrame:
    """`root, comp` of links (`root, low`): large and small stars in turn until nothing changes."""
    star = cut(links.where("root <> low").select(F.col("root").alias("a"), F.col("low").alias("b")).distinct())
    mark = None
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        star = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        star = cut(down.join(low, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return star.select(F.col("a").alias("root"), F.col("b").alias("comp"))
        mark = now


def components(edges: DataFrame, heap: int = HEAP) -> DataFrame:
    """`src, dst, comp`: edges with their component."""
    rows = stored(_heaps(edges, heap), "heaps", "zstd")
    ends = rows.select(F.xxhash64("src").alias("node"), "root").unionByName(rows.select(F.xxhash64("dst").alias("node"), "root"))
    shared = cut(ends.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high"))
    if shared.isEmpty():
        out = rows.withColumnRenamed("root", "comp")
    else:
        comps = _contracted(ends.join(shared, "node").select("root", "low"))
        out = rows.join(comps, "root", "left").withColumn("comp", F.coalesce("comp", "root")).drop("root")
    gc.collect()
    edges.sparkSession._jvm.System.gc()  # shuffles that are done leave the disk
    return out.select("src", "dst", "comp")


def members(edges: DataFrame) -> DataFrame:
    """`h, comp`: the hashes of the nodes of `components` edges."""
    ends = edges.select(F.xxhash64("src").alias("h"), "comp").unionByName(edges.select(F.xxhash64("dst").alias("h"), "comp"))
    return ends.groupBy("h").agg(F.min("comp").alias("comp"))


def split(edges: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame | None]:
    """Edges of `components` in components of up to so many edges, and the others if there are any."""
    large = cut(edges.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") > most).select("comp"))
    if large.isEmpty():
        return edges, None
    return edges.join(large, "comp", "left_anti"), edges.join(large, "comp", "left_semi")


def _spread(at: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of `at` each row belongs to and the row's place, of the rows that start at first[at], count[at] of them."""
    n = count[at]
    who = np.repeat(np.arange(len(at)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + first[at][who]


def _offsets(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.bincount(keys, minlength=n)
    return np.cumsum(count) - count, count


def _levels(src: np.ndarray, dst: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Depth by depth the pairs (node, ancestor) that are met first."""
    edges = np.unique(src * n + dst)
    src, dst = edges // n, edges % n
    first, count = _offsets(src, n)
    depth, new, seen = 1, edges, edges
    while len(new):
        v, a = new // n, new % n
        yield depth, v, a
        who, place = _spread(a, first, count)
        v, a = v[who], dst[place]
        new = np.unique((v * n + a)[v != a])
        new = new[~np.isin(new, seen, assume_unique=True)]
        seen, depth = np.concatenate([seen, new]), depth + 1


def _pairs(src, dst, names: pa.Array, *_) -> Iterator[list]:  # noqa: ANN001
    for depth, v, a in _levels(src, dst, len(names)):
        yield [names.take(pa.array(v)), names.take(pa.array(a)), pa.array(np.full(len(v), depth, np.int32))]


def _methods(src, dst, names: pa.Array, cls: np.ndarray, method: pa.Array, found: pa.Array, over: bool) -> Iterator[list]:  # noqa: ANN001
    """Rows `qn, method, found, depth`; with over `src, dst` of the methods that override one."""
    called = method.dictionary_encode(null_encoding="encode")
    k, called, n = called.indices.to_numpy().astype(np.int64), called.dictionary, max(1, len(called.dictionary))
    order = pc.array_sort_indices(found, null_placement="at_start").to_numpy()
    order = order[np.argsort(cls[order], kind="stable")]  # by class, then by name
    cls, k, found = cls[order], k[order], found.take(pa.array(order))
    first, count = _offsets(cls, len(names))
    own = cls * n + k
    every, at = np.unique(own, return_index=True)
    if over:
        seen, wanted = every[:0], every
        sorted_ = np.argsort(own, kind="stable")
        low, high = np.searchsorted(own[sorted_], every), np.searchsorted(own[sorted_], every, "right")
    else:
        seen = every
        yield [names.take(pa.array(every // n)), called.take(pa.array(every % n)), found.take(pa.array(at)), pa.array(np.zeros(len(at), np.int32))]
    for depth, v, a in _levels(src, dst, len(names)):
        who, place = _spread(a, first, count)
        key = v[who] * n + k[place]
        if over:
            key, place = (x[np.isin(key, wanted)] for x in (key, place))
        key, place = (x[~np.isin(key, seen)] for x in (key, place))
        if not len(key):
            continue
        by = np.lexsort((_rank(found, place), key))
        key, where = np.unique(key[by], return_index=True)
        place, seen = place[by][where], np.concatenate([seen, key])
        if over:
            i = np.searchsorted(every, key)
            who, m = _spread(i, low, high - low)
            yield [found.take(pa.array(sorted_[m])), found.take(pa.array(place[who]))]
        else:
            yield [names.take(pa.array(key // n)), called.take(pa.array(key % n)), found.take(pa.array(place)), pa.array(np.full(len(key), depth, np.int32))]


def _rank(found: pa.Array, place: np.ndarray) -> np.ndarray:
    return pc.rank(found.take(pa.array(place)), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()


def closed(edges: DataFrame, schema: str, what: str, own: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Rows of the schema from edges of `components`: `pairs`, or with methods (own: `cls, found, method, comp`) `inherited` or `overrides`."""
    rows = edges.select("comp", F.lit(None).cast("string").alias("method"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("edge"))
    if own is not None:
        rows = rows.unionByName(own.select("comp", "method", F.col("cls").alias("a"), F.col("found").alias("b"), F.lit(False).alias("edge")))
    columns = [c.split()[0] for c in schema.split(", ")]

    def close(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        edge = t["edge"].to_numpy()
        up, rest = t.filter(pa.array(edge)), t.filter(pa.array(~edge))
        text = lambda *xs: pa.concat_arrays([c for x in xs for c in x.chunks] or [pa.array([], pa.string())])
        names = text(up["a"], up["b"], rest["a"]).dictionary_encode(null_encoding="encode")
        ids, names = names.indices.to_numpy().astype(np.int64), names.dictionary
        n = up.num_rows
        src, dst, cls = ids[:n], ids[n : 2 * n], ids[2 * n :]
        made = _pairs(src, dst, names) if what == "pairs" else _methods(src, dst, names, cls, text(rest["method"]), text(rest["b"]), what == "overrides")
        for arrays in made:
            yield from pa.Table.from_arrays(arrays, columns).to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in _ended(batches):
            if b is not None and b.num_rows:
                held.append(b)
            if not held or b is not None and sum(x.num_rows for x in held) < block:
                continue
            t = pa.Table.from_batches(held)
            comp = t["comp"].to_numpy()
            whole = len(t) if b is None else int(np.searchsorted(comp, comp[-1]))  # the last may go on
            if whole:
                yield from close(t.slice(0, whole))
            held = t.slice(whole).to_batches()

    return rows.repartition("comp").sortWithinPartitions("comp").mapInArrow(run, schema)
