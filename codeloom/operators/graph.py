"""A labelled property graph as two DataFrames, and its one-hop patterns.

nodes: `project, label, qn, name, path, start_line, end_line, docstring, decorators, is_package`, unique by qn.
edges: `src, rel, dst, version`, a set. Both can be laid out by `write_graph`, partitioned by label and relation, so a
scan of a label or relation reads its folder alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CODE_LABELS = ("Function", "Method", "Class")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def label(self, *labels: str) -> DataFrame:
        return self.nodes.where(F.col("label").isin(*labels))

    def rel(self, *rels: str) -> DataFrame:
        return self.edges.where(F.col("rel").isin(*rels))


def write_graph(graph: Graph, path: str) -> None:
    """Stores a graph as parquet, nodes by project and label, edges by relation and sorted by their source."""
    graph.nodes.write.partitionBy("project", "label").mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.sortWithinPartitions("rel", "src").write.partitionBy("rel").mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def expand(graph: Graph, start: DataFrame, *rels: str, reverse: bool = False, optional: bool = False, key: str = "qn") -> DataFrame:
    """start (with a column `key`) joined to its neighbours over any of the relations: adds `rel, to`.

    optional keeps rows without a neighbour (their rel and to are null). Nothing is broadcast by force; the planner does
    it for sides below its threshold.
    """
    near, far = ("dst", "src") if reverse else ("src", "dst")
    hops = graph.rel(*rels).select(F.col(near).alias(key), "rel", F.col(far).alias("to"))
    return start.join(hops, key, "left" if optional else "inner")


def with_nodes(graph: Graph, rows: DataFrame, key: str = "to", columns: tuple[str, ...] = ("name", "label")) -> DataFrame:
    """rows joined with columns of the nodes their `key` names; rows whose node doesn't exist are dropped."""
    return rows.join(graph.nodes.select(F.col("qn").alias(key), *columns), key)


def without(graph: Graph, nodes: DataFrame, rel: str, reverse: bool = False) -> DataFrame:
    """The nodes that have no edge of a relation (leaving them, or entering if reverse)."""
    return nodes.join(graph.rel(rel).select(F.col("dst" if reverse else "src").alias("qn")), "qn", "left_anti")


def between(graph: Graph, keys: DataFrame, *rels: str) -> DataFrame:
    """The edges of the relations with both ends among keys (`qn`)."""
    ends = keys.select("qn").distinct()
    return graph.rel(*rels).join(ends.withColumnRenamed("qn", "src"), "src", "left_semi").join(ends.withColumnRenamed("qn", "dst"), "dst", "left_semi")


def entry_points(graph: Graph, keys: DataFrame, *rels: str) -> DataFrame:
    """The keys that no other key points at, among those with an edge to another key."""
    inner = between(graph, keys, *rels).where("src <> dst")
    return inner.select(F.col("src").alias("qn")).distinct().join(inner.select(F.col("dst").alias("qn")), "qn", "left_anti")


def incident(graph: Graph, keys: DataFrame) -> DataFrame:
    """`qn, direction, rel, other` of all edges at the keys."""
    ends = keys.select("qn").distinct()
    out = graph.edges.join(ends.withColumnRenamed("qn", "src"), "src", "left_semi").select(F.col("src").alias("qn"), F.lit("out").alias("direction"), "rel", F.col("dst").alias("other"))
    into = graph.edges.join(ends.withColumnRenamed("qn", "dst"), "dst", "left_semi").select(F.col("dst").alias("qn"), F.lit("in").alias("direction"), "rel", F.col("src").alias("other"))
    return out.unionByName(into)


def upsert_nodes(rows: DataFrame, key: str, *newest_first: Column) -> DataFrame:
    """One row per key, the last one written: the greatest by the given columns (give enough of them for a total order).

    Chosen by an aggregate, so each task sends one row per key at most, and a key with a third of all rows is no hot
    task. Null keys are dropped.
    """
    rest = [c for c in rows.columns if c != key]
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*newest_first)).alias("v"))
    return last.select(key, "v.*").select(*rows.columns)


def upsert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges as a set whose both ends exist."""
    ids = nodes.select("qn")
    one = edges.dropDuplicates(["src", "rel", "dst"])
    return one.join(ids.withColumnRenamed("qn", "src"), "src", "left_semi").join(ids.withColumnRenamed("qn", "dst"), "dst", "left_semi")


def delete_prefix(graph: Graph, prefix: str) -> Graph:
    """Without the node of this name and all below it, and without their edges."""
    gone = lambda c: (F.col(c) == prefix) | F.col(c).startswith(prefix + ".")
    return Graph(graph.nodes.where(~gone("qn")), graph.edges.where(~gone("src") & ~gone("dst")))


def delete_files(graph: Graph, path: str, suffix: bool = False) -> Graph:
    """Without the files of this path (or whose path ends so, at a folder's name), all they define, and the edges of either."""
    hit = (F.col("path") == path) | (F.col("path").endswith("/" + path) if suffix else F.lit(False))
    files = graph.label("File").where(hit).select("qn")
    own = graph.rel("DEFINES").join(files.withColumnRenamed("qn", "src"), "src", "left_semi").select(F.col("dst").alias("qn"))
    members = graph.rel("DEFINES_METHOD").join(own.withColumnRenamed("qn", "src"), "src", "left_semi").select(F.col("dst").alias("qn"))
    gone = files.unionByName(own).unionByName(members).distinct()
    edges = graph.edges.join(gone.withColumnRenamed("qn", "src"), "src", "left_anti").join(gone.withColumnRenamed("qn", "dst"), "dst", "left_anti")
    return Graph(graph.nodes.join(gone, "qn", "left_anti"), edges)


def delete_all(graph: Graph) -> Graph:
    """Nothing, with the same columns."""
    return Graph(graph.nodes.where(F.lit(False)), graph.edges.where(F.lit(False)))


def delete_project(graph: Graph, project: str) -> Graph:
    """Without a project's nodes and edges, and without the external packages that no other project depends on."""
    gone = graph.nodes.where(F.col("project") == project).select("qn")
    uses = graph.rel("DEPENDS_ON_EXTERNAL")
    only = uses.where(F.col("src") == project).join(uses.where(F.col("src") != project).select("dst"), "dst", "left_anti").select(F.col("dst").alias("qn"))
    gone = gone.unionByName(only)
    edges = graph.edges.join(gone.withColumnRenamed("qn", "src"), "src", "left_anti").join(gone.withColumnRenamed("qn", "dst"), "dst", "left_anti")
    return Graph(graph.nodes.join(gone, "qn", "left_anti"), edges)


def copy_project(graph: Graph, project: str, to: str) -> Graph:
    """A project's nodes and the edges among them, under another project's name."""
    renamed = lambda c: F.concat(F.lit(to), F.expr(f"substring({c}, {len(project) + 1})"))
    inside = lambda c: (F.col(c) == project) | F.col(c).startswith(project + ".")
    nodes = graph.nodes.where(inside("qn")).withColumn("qn", renamed("qn")).withColumn("project", F.lit(to))
    edges = graph.edges.where(inside("src") & inside("dst")).withColumn("src", renamed("src")).withColumn("dst", renamed("dst"))
    return Graph(nodes, edges)


def set_values(rows: DataFrame, key: str, updates: DataFrame, column: str) -> DataFrame:
    """rows with `column` taken from updates (`key, column`) where they have a value."""
    new = updates.where(F.col(column).isNotNull()).groupBy(key).agg(F.max(column).alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*rows.columns)
