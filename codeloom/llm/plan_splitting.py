"""Problem 7 over the embedding tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.splitting import oversized, pieces
from codeloom.sources.tables import table


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(oversized(table(spark, sf_dir, "embedding_tasks"), table(spark, sf_dir, "code_files")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task that is cut has a first piece, once."""
    return p7_pieces(spark, sf_dir).where("piece_no = 1").select("qualified_name")


def p7_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each task that is cut: its pieces, the lines they cover and those that they repeat."""
    p = p7_pieces(spark, sf_dir).groupBy("qualified_name")
    return p.agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), (F.sum(F.col("end_line") - F.col("start_line") + 1) - 4 * (F.count("*") - 1)).alias("n_lines"))


_WIDE = """
with t as (select * from embedding_tasks where qualified_name is not null qualify row_number() over (partition by qualified_name order by coalesce(created_at, '-inf'::double) desc, task_id desc) = 1),
f as (select repo_name, file_path, any_value(code) code from code_files where code is not null group by 1, 2),
n as (select t.qualified_name, t.start_line, t.end_line,
      case when code = '' then 0 else len(string_split(replace(code, chr(13) || chr(10), chr(10)), chr(10))) - (code like '%' || chr(10))::int end n
      from t join f using (repo_name, file_path)),
c as (select qualified_name, start_line, least(end_line, n) end_line from n where start_line >= 1 and end_line >= start_line and least(end_line, n) - start_line + 1 > 40)
"""
QUERIES = {"p7_found": p7_found, "p7_pieces": p7_pieces, "p7_sizes": p7_sizes}
SQL = {
    "p7_found": _WIDE + "select qualified_name from c",
    "p7_sizes": _WIDE + "select qualified_name, start_line, cast(end_line as int) end_line, cast(end_line - start_line + 1 as bigint) n_lines from c",
}
