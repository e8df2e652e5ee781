"""Problem 2 over the code files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.handwritten import file_kinds
from codeloom.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_kinds(table(spark, sf_dir, "code_files")).select("file_id")


def p2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files of each repository are of each kind; `hand-written` is the rest."""
    files = table(spark, sf_dir, "code_files")
    kinds = files.select("file_id", "repo_name").dropDuplicates(["file_id"]).join(file_kinds(files), "file_id", "left")
    return kinds.groupBy("repo_name", F.coalesce("kind", F.lit("hand-written")).alias("kind")).agg(F.count("*").alias("n_files"))


QUERIES = {"p2_found": p2_found, "p2_kinds": p2_kinds}
SQL: dict[str, str] = {}
