import numpy as np
import pytest

from codeloom.operators import vector as V
from codeloom.operators.structure import import_distance, nearest_definitions

SCHEMA = "vec_id bigint, embedding array<float>, list string, salt int, query string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "l", 1, "q") for i, v in enumerate(vectors)], SCHEMA)


@pytest.mark.parametrize("hot", [100_000, 50])
def test_index_against_all_rows(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(V, "HOT_LIST", hot)
    rng = np.random.default_rng(3)
    df = frame(spark, [*(rng.normal(size=16) + 3 * np.eye(16)[i % 8] for i in range(800)), None, np.zeros(16)])
    queries = df.where("vec_id % 40 = 0")
    exact = V.neighbours(df, queries, "vec_id", "embedding", 5)
    index = V.Index(df, "vec_id", "embedding")
    assert index.rows.count() == 800  # every row that has a direction
    assert rows(index.search(queries, 5, index.lists)) == rows(exact.where("query < 800"))
    assert V.recall(index.search(queries, 5, 10), exact.where("query < 800"), "vec_id").first()["recall"] >= 0.9


def test_empty_index(spark):
    df = frame(spark, [None])
    assert V.Index(df, "vec_id", "embedding").search(df).collect() == []


def test_nearest_definitions_against_all_pairs(spark, rows):
    import random

    rnd = random.Random(4)
    names = [".".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4))) for _ in range(40)]
    df = spark.createDataFrame([(rnd.choice("xy"), p, f"{p}.{i}") for i, p in enumerate(names)], "key string, path string, qn string")
    from pyspark.sql import functions as F

    asked = df.select("key", "path").distinct()
    pairs = asked.withColumnRenamed("path", "asked").join(df, "key").withColumn("d", import_distance(F.col("asked"), F.col("path")))
    brute = pairs.groupBy("key", "asked").agg(F.min(F.struct("d", "qn")).alias("v")).select("key", "asked", "v.qn", "v.d")
    assert rows(nearest_definitions(asked, df)) == rows(brute)
