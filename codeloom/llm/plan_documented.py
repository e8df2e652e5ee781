"""Problem 4 over the code contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.documented import documented
from codeloom.sources.tables import table


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented(table(spark, sf_dir, "code_contexts"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pairs(spark, sf_dir).select("qualified_name")


def p4_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many functions have their documentation where."""
    return p4_pairs(spark, sf_dir).groupBy("element_type", "found_in").agg(F.count("*").alias("n_functions"))


QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs, "p4_sources": p4_sources}
SQL: dict[str, str] = {}
