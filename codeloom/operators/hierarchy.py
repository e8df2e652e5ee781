"""Parent-child rows to full hierarchies.

Frontiers start at the roots and are joined level by level with the children, which are kept partitioned by their
parent, so a round shuffles its frontier alone; the children of a hot parent are spread over salts, and a frontier row,
of which there is one a parent, is repeated for these. Most nodes lie within the first `LEVELS` levels. What is deeper
are thin chains, for which a round a level would be dear: there ancestor pairs are doubled (a node's pair leads 2^k
levels up after k rounds) until they end at the last frontier. Nodes whose pairs never do hang on a cycle: the nodes
that pairs of theirs still lead to once their number falls no more are exactly the cycles', and the smallest id is
carried along.

Nodes are numbered once, so rounds shuffle numbers; names and ids are only carried where paths are asked for.

Defined results: a null or blank id is no node; of several rows of an id the one with the latest updated_at counts (on a
tie the latest created_at, then the greatest texts); a parent that is null, blank, unknown or of another group makes a
root; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.keys import norm_id
from codeloom.operators.lineage import cut

#: Levels by frontiers before chains are shortened.
LEVELS = 12
#: Children of a parent above which they are spread over several keys.
HOT = 1_000_000


def latest_nodes(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id", name_col: str = "name", group_col: str = "repo_name") -> DataFrame:
    """One row `num, nid, id, name, grp, up` per node; num is its number, up that of its parent, a node of the same group, else null."""
    version = F.struct(
        F.col("updated_at").alias("u"), F.col("created_at").alias("c"), F.col(id_col).alias("id"), F.col(name_col).alias("name"), F.col(group_col).alias("grp"), norm_id(parent_col).alias("parent")
    )
    one = rows.select(norm_id(id_col).alias("nid"), version.alias("v")).where("nid is not null").groupBy("nid").agg(F.max("v").alias("v"))
    one = cut(one.select(F.monotonically_increasing_id().alias("num"), "nid", "v.id", "v.name", "v.grp", "v.parent"))
    above = one.select(F.col("nid").alias("parent"), F.col("grp").alias("pgrp"), F.col("num").alias("up"))
    return one.join(above, "parent", "left").select("num", "nid", "id", "name", "grp", F.when(F.col("grp").eqNullSafe(F.col("pgrp")), F.col("up")).alias("up"))


def hierarchy(nodes: DataFrame, paths: bool = True, levels: int = LEVELS, hot: int = HOT) -> DataFrame:
    """`nid, id, root_id, depth, path, ancestors` of each node (of `latest_nodes`).

    path: the names from the root, with a slash before each; ancestors: the ids from the root to the parent; both only
    with `paths`, as they are most of what is shuffled. On a cycle depth is -1, below one -2; root_id is then the
    cycle's smallest id, path and ancestors are null.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = F.coalesce("name", F.lit(""))
    nodes = cut(nodes.select("num", "nid", "id", "up", *([name.alias("name")] if paths else [])))
    # over how many salts the children of a node are spread; 0 if it has none
    spread = nodes.where("up is not null").groupBy("up").agg(F.ceil(F.count("*") / F.lit(hot)).cast("int").alias("salts"))
    nodes = cut(nodes.join(spread.withColumnRenamed("up", "num"), "num", "left").withColumn("salts", F.coalesce("salts", F.lit(0))))
    salt = F.pmod(F.xxhash64("num"), F.col("over")).cast("int")
    kids = nodes.where("up is not null").join(spread.withColumnRenamed("salts", "over"), "up").withColumn("salt", salt).drop("over")
    kids = cut(kids.repartition(parts, "up", "salt"))
    carried = ["path", "ancestors"] if paths else []
    start = {"path": F.concat(F.lit("/"), F.col("name")), "ancestors": F.expr("cast(array() as array<string>)")} if paths else {}
    front = cut(nodes.where("up is null").select("num", "nid", "id", "salts", F.col("id").alias("root_id"), F.lit(0).alias("depth"), *(start[c].alias(c) for c in carried)))
    reached, empty = [front], False
    for _ in range(levels):
        above = front.where("salts > 0").select(F.col("num").alias("up"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("up_id"), "root_id", "depth", *carried)
        longer = {"path": F.concat("path", F.lit("/"), F.col("name")), "ancestors": F.concat("ancestors", F.array("up_id"))} if paths else {}
        front = cut(above.join(kids, ["up", "salt"]).select("num", "nid", "id", "salts", "root_id", (F.col("depth") + 1).alias("depth"), *(longer[c].alias(c) for c in carried)))
        if empty := front.isEmpty():
            break
        reached.append(front)
    done = reduce(DataFrame.unionByName, reached)
    out = ["nid", "id", "root_id", "depth", *carried]
    lists = ["names", "ids"] if paths else []
    first = {"names": F.array("name"), "ids": F.array("id")} if paths else {}
    none = {"names": F.expr("cast(array() as array<string>)"), "ids": F.expr("cast(array() as array<string>)")}
    left = nodes.where("up is not null").join(done.select("num"), "num", "left_anti")
    left = cut(left.select("num", "nid", "id", F.col("up").alias("to"), F.lit(1).alias("far"), F.col("id").alias("least"), F.lit(False).alias("ends"), *(first[c].alias(c) for c in lists)))
    if left.isEmpty():
        return done.select(*out)
    ends = front.where("salts > 0") if not empty else front
    stops = ends.select("num", "nid", "id", F.col("num").alias("to"), F.lit(0).alias("far"), F.lit(None).cast("string").alias("least"), F.lit(True).alias("ends"), *(none[c].alias(c) for c in lists))
    found = [stops]
    # pairs of nodes above each other, twice as far apart every round, until none reaches the last frontier any more
    while not empty:
        upper = reduce(DataFrame.unionByName, found).unionByName(left).select(F.col("num").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"), F.col("least").alias("least2"), F.col("ends").alias("ends2"), *(F.col(c).alias(f"{c}2") for c in lists))
        left = cut(left.join(upper, "to").select("num", "nid", "id", F.col("to2").alias("to"), (F.col("far") + F.col("far2")).alias("far"), F.least("least", "least2").alias("least"), F.col("ends2").alias("ends"), *(F.concat(f"{c}2", c).alias(c) for c in lists)))
        hit = left.where("ends")
        left = left.where("not ends")
        if hit.isEmpty():
            break
        found.append(hit)
    if len(found) > 1:
        top = ends.select(F.col("num").alias("to"), "root_id", "depth", *carried, F.col("id").alias("top_id"))
        deep = reduce(DataFrame.unionByName, found[1:]).join(top, "to")
        longer = {"path": F.concat("path", F.lit("/"), F.array_join("names", "/")), "ancestors": F.concat("ancestors", F.array("top_id"), F.slice("ids", 1, F.size("ids") - 1))} if paths else {}
        done = done.select(*out).unionByName(deep.select("nid", "id", "root_id", (F.col("depth") + F.col("far")).alias("depth"), *(longer[c].alias(c) for c in carried)))
    if left.isEmpty():
        return done.select(*out)
    wrong = _circular(left.select("num", "nid", "id", "to", "least"))
    return done.select(*out).unionByName(wrong.select("nid", "id", "root_id", "depth", *(F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("ancestors", "array<string>")) if paths)))


def _circular(pairs: DataFrame) -> DataFrame:
    """`nid, id, root_id, depth` of nodes that hang on cycles, from pairs `num, nid, id, to, least` that lead equally far up.

    least is the smallest id below `to` on the way. Once a doubling leaves the number of nodes led to and all `least`s as
    they were, the nodes led to are the cycles' and `least` is the smallest of a whole cycle.
    """
    state = None
    while True:
        now = pairs.agg(F.count_distinct("to"), F.count(F.when(F.col("changed"), 1))).first() if state else (-1, -1)
        if state and now[0] == state[0] and now[1] == 0:
            break
        state = now
        upper = pairs.select(F.col("num").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        pairs = cut(pairs.join(upper, "to").select("num", "nid", "id", F.col("to2").alias("to"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("changed")))
    on = pairs.select(F.col("to").alias("num")).distinct().withColumn("on", F.lit(True))
    roots = pairs.join(on, "num").select(F.col("num").alias("to"), F.col("least").alias("root_id"))
    return pairs.join(on, "num", "left").join(roots, "to").select("nid", "id", "root_id", F.when(F.col("on"), -1).otherwise(-2).alias("depth"))


def descendants(tree: DataFrame) -> DataFrame:
    """`folder_id, below_id, distance`: every node below every node, from the ancestors in `hierarchy`."""
    return tree.where("ancestors is not null").select(F.posexplode("ancestors").alias("at", "folder_id"), F.col("id").alias("below_id"), (F.col("depth") - F.col("at")).alias("distance")).select("folder_id", "below_id", "distance")


def tree_stats(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per group: folders, roots, the greatest depth, folders on and below cycles."""
    d = F.col("depth")
    return (
        tree.join(nodes.select("nid", "grp"), "nid").groupBy(F.col("grp").alias("repo_name"))
        .agg(F.count("*").alias("n_folders"), F.count(F.when(d == 0, 1)).alias("n_roots"), F.max("depth").alias("max_depth"), F.count(F.when(d == -1, 1)).alias("n_on_cycle"), F.count(F.when(d == -2, 1)).alias("n_below_cycle"))
    )
