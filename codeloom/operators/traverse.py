"""Variable-length paths.

Reachable nodes come level by level: each level joins the frontier with the edges and drops nodes seen before, so a
level shuffles its frontier and the edges stay where they are (cut once, partitioned by source). Where the length of a
path is part of the answer, levels keep nodes seen before. Enumerations of paths carry the path and grow with the number
of paths; they are meant for small depths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.graph import Graph
from codeloom.operators.lineage import cut


def _hops(graph: Graph, rels: tuple[str, ...], reverse: bool) -> DataFrame:
    near, far = ("dst", "src") if reverse else ("src", "dst")
    parts = int(graph.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(graph.rel(*rels).select(F.col(near).alias("at"), F.col(far).alias("to")).distinct().repartition(parts, "at"))


def reachable(graph: Graph, starts: DataFrame, *rels: str, depth: int = 5, reverse: bool = False) -> DataFrame:
    """`start, qn, depth`: nodes within 1..depth hops of each start (`qn`) and their least distance.

    A start is in its own answer only if it lies on a cycle within the depth.
    """
    hops = _hops(graph, rels, reverse)
    front = cut(starts.select(F.col("qn").alias("start"), F.col("qn")).distinct())
    seen = None
    for d in range(1, depth + 1):
        step = front.join(hops, front.qn == hops["at"]).select("start", F.col("to").alias("qn")).distinct()
        if seen is not None:
            step = step.join(seen.select("start", "qn"), ["start", "qn"], "left_anti")
        front = cut(step)
        if front.isEmpty():
            break
        level = front.withColumn("depth", F.lit(d))
        seen = level if seen is None else seen.unionByName(level)
    return seen if seen is not None else front.withColumn("depth", F.lit(0))


def walks(graph: Graph, starts: DataFrame, *rels: str, depth: int = 3) -> DataFrame:
    """`start, qn, depth`: nodes with each length of a walk of 1..depth hops that ends at them."""
    hops = _hops(graph, rels, False)
    front = cut(starts.select(F.col("qn").alias("start"), F.col("qn")).distinct())
    out = None
    for d in range(1, depth + 1):
        front = cut(front.join(hops, front.qn == hops["at"]).select("start", F.col("to").alias("qn")).distinct())
        level = front.withColumn("depth", F.lit(d))
        out = level if out is None else out.unionByName(level)
    return out


def trails(graph: Graph, starts: DataFrame, *rels: str, depth: int = 3) -> DataFrame:
    """`start, path, depth`: all paths of 1..depth hops without a repeated edge; nodes may repeat. Meant for small depths."""
    hops = _hops(graph, rels, False)
    front = starts.select(F.col("qn").alias("start"), F.array("qn").alias("path"), F.expr("cast(array() as array<string>)").alias("used")).distinct()
    out = None
    for d in range(1, depth + 1):
        edge = F.concat_ws("\x1f", "at", "to")
        front = cut(front.join(hops, F.element_at("path", -1) == hops["at"]).where(~F.array_contains("used", edge)).select("start", F.concat("path", F.array("to")).alias("path"), F.concat("used", F.array(edge)).alias("used")))
        level = front.select("start", "path", F.lit(d).alias("depth"))
        out = level if out is None else out.unionByName(level)
    return out


def shortest_path(graph: Graph, pairs: DataFrame, *rels: str, depth: int = 6) -> DataFrame:
    """`src, dst, depth, path` of each pair: one shortest path, the least by its names joined by `>`.

    Each level keeps one path per (src, node): the least of those of its length, which holds the least of all longer
    ones; a pair leaves the frontier when it is answered.
    """
    hops = _hops(graph, rels, False)
    wanted = cut(pairs.select("src", "dst").distinct())
    front = cut(wanted.select("src", F.col("src").alias("qn"), F.col("src").alias("path")).distinct())
    seen = front.select("src", "qn").limit(0)
    out = None
    for d in range(1, depth + 1):
        step = front.join(hops, front.qn == hops["at"]).select("src", F.col("to").alias("qn"), F.concat_ws(">", "path", "to").alias("path"))
        step = step.groupBy("src", "qn").agg(F.min("path").alias("path")).join(seen, ["src", "qn"], "left_anti")
        front = cut(step)
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("src", "qn"))
        hit = front.withColumnRenamed("qn", "dst").join(wanted, ["src", "dst"]).select("src", "dst", F.lit(d).alias("depth"), "path")
        out = hit if out is None else out.unionByName(hit)
    return out if out is not None else wanted.select("src", "dst", F.lit(0).alias("depth"), F.lit("").alias("path")).limit(0)


def cycles(graph: Graph, starts: DataFrame, *rels: str, depth: int = 4) -> DataFrame:
    """`start, path, depth`: the closed paths of 2..depth hops from each start that return to it once; self-loops don't count."""
    hops = _hops(graph, rels, False).where(F.col("at") != F.col("to"))
    front = starts.select(F.col("qn").alias("start"), F.array("qn").alias("path")).distinct()
    out = None
    for d in range(1, depth + 1):
        step = cut(front.join(hops, F.element_at("path", -1) == hops["at"]).where((F.col("to") == F.col("start")) | ~F.array_contains("path", F.col("to"))).select("start", F.concat("path", F.array("to")).alias("path")))
        closed = F.element_at("path", -1) == F.col("start")
        front = step.where(~closed)
        if d >= 2:
            level = step.where(closed).withColumn("depth", F.lit(d))
            out = level if out is None else out.unionByName(level)
    return out


def dependency_tree(graph: Graph, starts: DataFrame, *rels: str, depth: int = 3, children: int = 50) -> DataFrame:
    """`start, parent, qn, depth, circular`: the breadth-first tree of each start.

    A node expands where it occurs first (least depth, then least parent); its later occurrences are leaves marked as
    circular. Of a parent's children the first `children` by name count.
    """
    hops = _hops(graph, rels, False)
    by = Window.partitionBy("at").orderBy("to")
    hops = cut(hops.withColumn("n", F.row_number().over(by)).where(F.col("n") <= children).select("at", "to"))
    front = cut(starts.select(F.col("qn").alias("start"), "qn").distinct())
    seen = front.select("start", "qn")
    out = None
    for d in range(1, depth + 1):
        step = front.join(hops, front.qn == hops["at"]).select("start", F.col("qn").alias("parent"), F.col("to").alias("qn"))
        step = step.join(seen.withColumn("old", F.lit(True)), ["start", "qn"], "left")
        first = Window.partitionBy("start", "qn").orderBy("parent")
        step = cut(step.withColumn("circular", F.col("old").isNotNull() | (F.row_number().over(first) > 1)).select("start", "parent", "qn", F.lit(d).alias("depth"), "circular"))
        out = step if out is None else out.unionByName(step)
        front = step.where("not circular").select("start", "qn")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return out


def containment(graph: Graph, root: str, depth: int = 10) -> DataFrame:
    """`qn, label, depth` of all below a node in the folder tree, by its name: names are nested, so no join is needed."""
    n = root.count(".") + 1
    inside = graph.label("Folder", "File").where(F.col("qn").startswith(root + "."))
    level = F.size(F.split("qn", r"\.")) - n
    return inside.select("qn", "label", level.alias("depth")).where(F.col("depth") <= depth)


def ancestor_packages(graph: Graph) -> DataFrame:
    """`package, qn`: each package folder with itself and the files and folders below it, over containment."""
    packages = graph.label("Folder").where("is_package").select("qn")
    below = graph.rel("CONTAINS_FILE", "CONTAINS_FOLDER").select(F.col("src").alias("package"), F.col("dst").alias("qn")).join(packages.withColumnRenamed("qn", "package"), "package", "left_semi")
    return packages.select(F.col("qn").alias("package"), "qn").unionByName(below)
