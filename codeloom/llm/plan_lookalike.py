"""Problem 10 over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.lookalike import look_classes, lookalike_pairs, looks, normalized
from codeloom.operators.lineage import cut
from codeloom.sources.tables import table


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(cut(looks(table(spark, sf_dir, "documents"))))


def p10_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(table(spark, sf_dir, "documents"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of a look with several texts, the look's class (its least doc_id), the representative of its text, and how many documents look the same but differ from it."""
    hashes = cut(looks(table(spark, sf_dir, "documents")))
    texts = look_classes(hashes)
    name = texts.groupBy("look_hash").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("n"))
    return hashes.join(texts.select("text_hash", "rep", "copies"), "text_hash").join(name, "look_hash").select("doc_id", "class_id", F.col("rep").alias("text_id"), (F.col("n") - F.col("copies")).alias("n_links"))


QUERIES = {"p10_found": p10_found, "p10_normalized": p10_normalized, "p10_classes": p10_classes}
SQL: dict[str, str] = {}
