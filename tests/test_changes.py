import datetime as dt

from codeloom.operators.diff import bursts, dependents, snapshot_diff
from codeloom.streaming import changes as H

T0 = dt.datetime(2025, 1, 1)
AT = lambda s: T0 + dt.timedelta(seconds=s)
SCHEMA = "path string, action string, at timestamp_ntz, seq bigint"


def test_snapshots(spark, rows):
    a = spark.createDataFrame([("same", "1"), ("changed", "1"), ("gone", "1"), ("null", None)], "k string, h string")
    b = spark.createDataFrame([("same", "1"), ("changed", "2"), ("new", None), ("null", None)], "k string, h string")
    assert rows(snapshot_diff(a, b, "k", digest="h")) == [("changed", "modified"), ("gone", "removed"), ("new", "added")]


def test_bursts(spark, rows):
    c = [("p", "f", "add", AT(0), 1), ("p", "f", "modify", AT(1), 2), ("p", "g", "add", AT(1), 3), ("p", "f", "delete", AT(5), 4), ("q", "f", "add", AT(1), 5), ("p", "g", "modify", AT(1), 6)]
    df = spark.createDataFrame(c, "project string, path string, action string, ts timestamp_ntz, seq bigint")
    assert rows(bursts(df, "project", "path", "action", "ts", "seq"), "project", "path", "action") == [("p", "f", "delete"), ("p", "f", "modify"), ("p", "g", "modify"), ("q", "f", "add")]


def test_dependents(spark, rows):
    imports = spark.createDataFrame([("a", "b"), ("c", "b"), ("b", "a")], "src string, dst string")
    assert rows(dependents(imports, spark.createDataFrame([("b",), ("a",)], "qn string"))) == [("c",)]


def test_stream_gives_what_one_batch_gives(spark, tmp_path, rows):
    batches = [[("f", "add", AT(0), 1), ("g", "add", AT(0), 2)], [("f", "delete", AT(9), 3), ("h", "add", AT(3), 4)], [("g", "modify", AT(2), 5), ("f", "modify", AT(4), 6)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    whole = spark.read.parquet(*(str(tmp_path / "in" / str(i)) for i in range(3)))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    assert rows(H.live(H.run(spark, stream)), "path", "action") == rows(H.merged(whole).where("action <> 'delete'"), "path", "action") == [("g", "modify"), ("h", "add")]


def test_nothing_to_stream(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    assert H.run(spark, spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).collect() == []
