"""Lines of texts: slices, searches with merged context, extracted mentions, parsed tool output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """The lines of a text, ended by `\\n` or `\\r\\n`; a final line end starts no line; null and empty texts have none."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text.isNull() | (text == ""), F.expr("cast(array() as array<string>)")).otherwise(F.split(body, r"\r?\n", -1))


def snippet(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end (from 1, both included) of a text; null if the range is none."""
    own = lines(text)
    return F.when((start >= 1) & (end >= start), F.array_join(F.slice(own, start, F.greatest(F.lit(0), F.least(end, F.size(own)) - start + 1)), "\n"))


def grep(texts: DataFrame, key: str, text: str, pattern: str, context: int = 1) -> DataFrame:
    """`key, start_line, end_line, n_matches`: regions of lines around matches; regions that touch are one.

    Regions are found per text by a window; only matching lines leave the scan.
    """
    hits = texts.select(key, F.posexplode(lines(F.col(text))).alias("at", "line")).where(F.col("line").rlike(pattern)).select(key, (F.col("at") + 1).alias("n"))
    total = texts.select(F.col(key), F.size(lines(F.col(text))).alias("total"))
    w = Window.partitionBy(key).orderBy("n")
    far = F.col("n") - context > F.lag("n").over(w) + context + 1
    marked = hits.withColumn("new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("region", F.sum("new").over(w))
    regions = marked.groupBy(key, "region").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("n_matches"))
    return regions.join(total, key).select(key, F.greatest(F.lit(1), F.col("a") - context).alias("start_line"), F.least(F.col("total"), F.col("b") + context).alias("end_line"), "n_matches")


def mentions(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """`key, mention`: the different matches of a pattern in each text, lower case."""
    found = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), F.lower)))
    return texts.where(F.col(text).isNotNull()).select(key, found.alias("mention"))


def requirement(spec: Column) -> tuple[Column, Column]:
    """The name and the version part of a dependency such as `name[extra]>=1.0`."""
    p = r"^\s*([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*([^;#]*)"
    return F.regexp_extract(spec, p, 1), F.trim(F.regexp_extract(spec, p, 2))


def blame(reports: DataFrame, key: str, text: str) -> DataFrame:
    """`key, line, sha, author, at`: one row per line of porcelain blame output. A commit's header appears once; later lines carry it forward."""
    rows = reports.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("at_row", "row"))
    head = F.regexp_extract("row", r"^([0-9a-f]{40}) \d+ (\d+)", 1)
    rows = rows.withColumn("sha", F.when(head != "", head)).withColumn("line", F.when(head != "", F.regexp_extract("row", r"^[0-9a-f]{40} \d+ (\d+)", 1).cast("int")))
    w = Window.partitionBy(key).orderBy("at_row")
    rows = rows.withColumn("sha", F.last("sha", ignorenulls=True).over(w))
    field = lambda name: F.max(F.when(F.col("row").startswith(name + " "), F.expr(f"substring(row, {len(name) + 2})")))
    commits = rows.groupBy(key, "sha").agg(field("author").alias("author"), F.timestamp_seconds(field("author-time").cast("bigint")).alias("time"))
    return rows.where("line is not null").select(key, "line", "sha").join(commits, [key, "sha"]).select(key, "line", "sha", "author", F.date_format("time", "yyyy-MM-dd").alias("at"))


def name_status(reports: DataFrame, key: str, text: str) -> DataFrame:
    """`key, path, action`: the changes of name-status output; a rename deletes its old path and adds its new one."""
    rows = reports.select(key, F.explode(F.split(F.col(text), "\n")).alias("row")).where(F.col("row").rlike("^[ACDMRT]"))
    f = F.split("row", "\t")
    kind = F.substring("row", 1, 1)
    one = F.array(F.struct(f[1].alias("path"), F.when(kind == "A", "add").when(kind == "D", "delete").otherwise("modify").alias("action")))
    moved = F.array(F.struct(f[1].alias("path"), F.lit("delete").alias("action")), F.struct(F.get(f, F.lit(2)).alias("path"), F.lit("add").alias("action")))
    copied = F.array(F.struct(F.get(f, F.lit(2)).alias("path"), F.lit("add").alias("action")))
    return rows.select(key, F.explode(F.when(kind == "R", moved).when(kind == "C", copied).otherwise(one)).alias("c")).select(key, "c.path", "c.action")
