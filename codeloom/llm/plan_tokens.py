"""Problems 8 and 9 over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.packing import pack
from codeloom.llm.tokenids import token_counts, token_ids
from codeloom.sources.tables import table

#: Tokens of a container.
CAPACITY = 2048


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`container_id, doc_id, piece_no, start_token, n_tokens`; container_id is null for texts that take no room."""
    sizes = token_counts(table(spark, sf_dir, "documents"))
    sizes = sizes.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    items = sizes.select(F.concat_ws("/", "doc_id", F.hex("dh"), "copy").alias("item"), F.col("n_tokens").alias("size"))
    return pack(items, CAPACITY).select(
        "container_id", F.split("item", "/")[0].cast("bigint").alias("doc_id"), "piece_no", F.col("start").alias("start_token"), F.col("size").alias("n_tokens")
    )


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers are used, and how much of them is filled."""
    rows = p9_containers(spark, sf_dir).where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("load"))
    return rows.agg(F.count("*").alias("n_containers"), F.sum("load").alias("n_tokens"), F.max("load").alias("fullest"), F.round(F.sum("load") / (F.count("*") * CAPACITY), 4).alias("filled"))


QUERIES = {"p8_ids": p8_ids, "p8_counts": p8_counts, "p9_containers": p9_containers, "p9_fill": p9_fill}
SQL: dict[str, str] = {}
