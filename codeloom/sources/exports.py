"""Graphs exported as one JSON document, and paper feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.graph import Graph

_EXPORT = "nodes array<struct<node_id: bigint, labels: array<string>, properties: map<string,string>>>, relationships array<struct<from_id: bigint, to_id: bigint, type: string, properties: map<string,string>>>, metadata map<string,string>"


def read_export(spark: SparkSession, path: str) -> Graph:
    """The graph of an export: ids become qualified names, the first label counts, lists in properties are JSON."""
    doc = spark.read.schema(_EXPORT).json(path, multiLine=True)
    n = doc.select(F.explode("nodes").alias("n")).select("n.*")
    p = lambda k: F.try_element_at("properties", F.lit(k))
    named = n.select("node_id", F.coalesce(p("qualified_name"), p("name")).alias("qn"), F.get("labels", F.lit(0)).alias("label"), "properties")
    nodes = named.select(
        F.substring_index("qn", ".", 1).alias("project"), "label", "qn", p("name").alias("name"), p("path").alias("path"), p("start_line").cast("int").alias("start_line"), p("end_line").cast("int").alias("end_line"),
        p("docstring").alias("docstring"), F.from_json(p("decorators"), "array<string>").alias("decorators"), p("is_package").cast("boolean").alias("is_package"),
    )
    r = doc.select(F.explode("relationships").alias("r")).select("r.*")
    ids = named.select("node_id", "qn")
    edges = r.join(ids.select(F.col("node_id").alias("from_id"), F.col("qn").alias("src")), "from_id").join(ids.select(F.col("node_id").alias("to_id"), F.col("qn").alias("dst")), "to_id")
    return Graph(nodes, edges.select("src", F.col("type").alias("rel"), "dst", F.try_element_at("properties", F.lit("version_spec")).alias("version")).distinct())


_PAPER = "id string, title string, summary string, published string, upvotes int, citations int"


def papers_from_json(feeds: DataFrame, text: str = "text") -> DataFrame:
    """`id, title, summary, published, upvotes, citations` of JSON feeds (an array of papers each)."""
    return feeds.select(F.explode(F.from_json(text, f"array<struct<{_PAPER.replace(' ', ': ').replace(',: ', ', ')}>>")).alias("p")).select("p.*")


def papers_from_xml(feeds: DataFrame, text: str = "text") -> DataFrame:
    """The same of Atom feeds; an entry's id is the last part of its address."""
    entry = "struct<id: string, title: string, summary: string, published: string>"
    rows = feeds.select(F.explode(F.from_xml(text, f"entry array<{entry}>", {"rowTag": "feed"}).getField("entry")).alias("e"))
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return rows.select(F.substring_index("e.id", "/", -1).alias("id"), squeeze("e.title").alias("title"), squeeze("e.summary").alias("summary"), "e.published", F.lit(None).cast("int").alias("upvotes"), F.lit(None).cast("int").alias("citations"))
