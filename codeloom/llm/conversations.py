"""Conversations put together again from a stream of message rows.

The stream's state is keyed by session and message, so every state row is of bounded size, however long a session is:
copies of one message are merged in it as they arrive (content of any copy that has some). Event time is when a row
reached the source (its file's modification time), which is never behind the watermark because files are read in that
order; how late a message is by its own clock doesn't matter, it is buffered with the others. When the watermark has
passed a period of arrival, the period is closed: its messages leave the state, its sessions are validated in that
micro-batch and their exchanges are written. A session whose messages were closed in several periods has been judged too
early: it is revised from all its messages when the results are read, so the answer doesn't depend on how many
micro-batches there were, nor on the order of the files. Rows dropped behind the watermark are counted, and if there are
any (a file that carries an old time), the stream is run again with a watermark that no row can be behind.

When the source has ended, an end marker moves the watermark past everything, which closes what is still open. State,
offsets and output lie in the shared folder, so the work goes on after a loss.

Validation sorts messages by session and time over all tasks; each task checks its runs of them, and the runs are joined
at their ends, so no task holds a whole hot session.

Defined results: ids of sessions are equal after trimming and ignoring case, a blank one names none; times are read as
seconds, milli-, micro- or nanoseconds by their size, one that isn't positive is none; a message without id breaks its
session; repeated rows are copies of one message; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.keys import norm_id, trimmed
from codeloom.operators.lineage import own_dir, stored

#: A period of arrival that is closed as a whole; how far files may be out of order.
PERIOD, DELAY = "1 hour", "10 minutes"
#: A delay that no row exceeds.
_ALL = "36500 days"
#: Files of a micro-batch at most.
FILES = 10_000
#: How roles are written.
ROLES = {"user": "u", "human": "u", "assistant": "a", "ai": "a", "bot": "a", "system": "s"}
#: The end marker's session and time.
_END, _FAR = "\x00end", "2200-01-01 00:00:00"
#: Fixed values, as a Java character class: what can't be seen.
_UNSEEN = r"\s\p{Z}\p{Cc}\p{Cf}\x{115f}\x{1160}\x{3164}\x{ffa0}\x{2800}\x{fe00}-\x{fe0f}\x{034f}"
_MESSAGE = "session_key string, id string, role string, t bigint, seen boolean"
_EXCHANGE = "session_key string, user_message_id string, reply_message_id string"


def epoch_ms(col: Column) -> Column:
    """Milliseconds of an epoch time of any usual unit; null if it isn't positive."""
    size = lambda n: col < F.lit(10**n)
    return F.when(col <= 0, None).when(size(11), col * 1000).when(size(14), col).when(size(17), (col / 1000).cast("bigint")).otherwise((col / 1_000_000).cast("bigint"))


def prepared(messages: DataFrame) -> DataFrame:
    """`session_key, id, role, t, seen`: what validation needs of a row; the texts stay behind. role is null where it isn't known."""
    role = F.lower(trimmed("role"))
    code = F.lit(None).cast("string")
    for name, short in ROLES.items():
        code = F.when(role == name, short).otherwise(code)
    return messages.select(norm_id("session_id").alias("session_key"), "id", code.alias("role"), epoch_ms(F.col("created_at")).alias("t"), F.coalesce(F.col("content").rlike(f"[^{_UNSEEN}]"), F.lit(False)).alias("seen"), *(["event"] if "event" in messages.columns else [])).where("session_key is not null")


def merged(rows: DataFrame, *also: Column | str) -> DataFrame:
    """One row per message of each session: a role and the latest time that some copy has, and whether one has visible content."""
    return rows.groupBy("session_key", "id", *also).agg(F.max("role").alias("role"), F.max("t").alias("t"), F.max("seen").alias("seen"))


def conversation_stream(rows: DataFrame, delay: str = DELAY, period: str = PERIOD) -> DataFrame:
    """The streaming operator: rows of `prepared` with their `event` to the messages of closed periods."""
    return merged(rows.withWatermark("event", delay), F.window("event", period)).drop("window")


class Store:
    """What a stream has closed, in a shared folder: messages and exchanges of each micro-batch, written idempotently."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base

    def add(self, messages: DataFrame, batch: int) -> None:
        """Keeps the messages that a micro-batch closed and validates their sessions."""
        path = f"{self.base}/messages/batch={batch}"
        messages.where(F.col("session_key") != _END).write.mode("overwrite").parquet(path)
        own = self.spark.read.schema(_MESSAGE).parquet(path)
        if own.isEmpty():
            return
        exchanges(own).write.mode("overwrite").parquet(f"{self.base}/exchanges/batch={batch}")

    def read(self, name: str, schema: str) -> DataFrame:
        if not self._holds(name):
            return self.spark.createDataFrame([], schema + ", batch int")
        return self.spark.read.schema(schema + ", batch int").option("basePath", f"{self.base}/{name}").parquet(f"{self.base}/{name}")

    def _holds(self, name: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def result(self) -> DataFrame:
        """`session_key, user_message_id, reply_message_id` of all that was closed: as validated, or revised from all messages where a session was closed in parts."""
        messages, found = self.read("messages", _MESSAGE), self.read("exchanges", _EXCHANGE).drop("batch")
        parts = messages.groupBy("session_key").agg(F.min("batch").alias("a"), F.max("batch").alias("b"))
        reopened = stored(parts.where("a < b").select("session_key"), "reopened")
        if reopened.isEmpty():
            return found
        again = merged(messages.join(reopened, "session_key", "left_semi"))
        return found.join(reopened, "session_key", "left_anti").unionByName(exchanges(again))


def replay(spark: SparkSession, path: str, files: int = FILES, delay: str = DELAY) -> Store:
    """Runs the stream over all files at a path, in micro-batches of so many files, until its end."""
    store = Store(spark, f"{own_dir(spark)}/talk-{uuid.uuid4().hex}")
    schema = spark.read.parquet(path).schema
    # as a pattern, since the stream's source takes a single file only so
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")
    rows = prepared(source.select("*", F.col("_metadata.file_modification_time").alias("event")))
    marker = "session_key string, id string, role string, t bigint, seen boolean, event timestamp"
    end = f"{store.base}/end"
    spark.createDataFrame([], marker).write.parquet(end)
    rows = rows.unionByName(spark.readStream.schema(marker).parquet(end))
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.numRecentProgressUpdates": "1000000"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    dropped = 0
    try:
        for closing in (False, True):
            if closing:
                spark.range(1).select(F.lit(_END).alias("session_key"), F.lit("").alias("id"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("bigint").alias("t"), F.lit(False).alias("seen"), F.lit(_FAR).cast("timestamp").alias("event")).coalesce(1).write.mode("append").parquet(end)
            sink = conversation_stream(rows, delay).writeStream.foreachBatch(store.add).option("checkpointLocation", f"{store.base}/progress").outputMode("append").trigger(availableNow=True).start()
            sink.awaitTermination()
            dropped += sum(op["numRowsDroppedByWatermark"] for p in sink.recentProgress for op in p["stateOperators"])
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return replay(spark, path, files, _ALL) if dropped and delay != _ALL else store


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of messages sorted by session and order: the exchanges inside each run of a session, and the run's two ends."""
    part, cols = TaskContext.get().partitionId(), ["session_key", "part", "kind", "first", "first_role", "last", "last_role", "ok"]
    run: list | None = None
    for b in batches:
        s, ids, role, ok = (b[c].to_numpy() for c in ("session_key", "id", "role", "ok"))
        if not len(s):
            continue
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(s)]))
        sound = np.logical_and.reduceat(ok.astype(bool), starts)
        turn = np.flatnonzero((role == "u") | (role == "a"))
        same = group[turn[1:]] == group[turn[:-1]] if len(turn) else np.zeros(0, bool)
        before, after = turn[:-1][same], turn[1:][same]
        np.logical_and.at(sound, group[before], role[before] != role[after])
        pair = (role[before] == "u") & (role[after] == "a")
        u, a = before[pair], after[pair]
        out = [pd.DataFrame({"session_key": s[u], "part": part, "kind": "exchange", "first": ids[u], "first_role": "u", "last": ids[a], "last_role": "a", "ok": True})]
        firsts, lasts = np.full(len(starts), -1), np.full(len(starts), -1)
        lasts[group[turn]] = turn
        firsts[group[turn[::-1]]] = turn[::-1]
        pick = lambda values, at: [values[i] if i >= 0 else None for i in at]
        ends = [list(r) for r in zip(s[starts], [part] * len(starts), ["run"] * len(starts), pick(ids, firsts), pick(role, firsts), pick(ids, lasts), pick(role, lasts), sound.tolist(), strict=True)]
        if run is not None and run[0] == ends[0][0]:  # goes on from the batch before
            more, ends[0] = ends[0], run
            run[7] = run[7] and more[7]
            if more[4] is not None:
                if run[6] == more[4]:
                    run[7] = False
                elif run[6] == "u":
                    out.append(pd.DataFrame([(run[0], part, "exchange", run[5], "u", more[3], "a", True)], columns=cols))
                if run[4] is None:
                    run[3], run[4] = more[3], more[4]
                run[5], run[6] = more[5], more[6]
        elif run is not None:
            ends.insert(0, run)
        run = ends.pop()
        yield pd.concat([*out, pd.DataFrame(ends, columns=cols)], ignore_index=True)
    if run:
        yield pd.DataFrame([tuple(run)], columns=cols)


def exchanges(messages: DataFrame) -> DataFrame:
    """`session_key, user_message_id, reply_message_id` of the sound sessions of merged messages."""
    spark = messages.sparkSession
    by = ["session_key", F.col("t").asc_nulls_first(), F.coalesce(F.col("role") != "u", F.lit(True)), "id"]
    ok = F.col("id").isNotNull() & F.col("role").isNotNull() & F.col("t").isNotNull() & F.col("seen")
    rows = messages.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    runs = stored(rows.select("session_key", "id", "role", ok.alias("ok")).mapInPandas(_runs, "session_key string, part int, kind string, first string, first_role string, last string, last_role string, ok boolean"), "runs")
    ends = runs.where("kind = 'run'")
    turns = ends.where("first is not null")
    w = Window.partitionBy("session_key").orderBy("part")
    turns = turns.withColumn("before", F.lag("last").over(w)).withColumn("before_role", F.lag("last_role").over(w)).withColumn("next", F.lead("first").over(w))
    fits = F.when(F.col("before").isNull(), F.col("first_role") == "u").otherwise(F.col("before_role") != F.col("first_role")) & F.when(F.col("next").isNull(), F.col("last_role") == "a").otherwise(True)
    sound = ends.groupBy("session_key").agg(F.min("ok").alias("ok")).where("ok").join(turns.groupBy("session_key").agg(F.min(fits).alias("fits")).where("fits"), "session_key").select("session_key")
    inside = runs.where("kind = 'exchange'").select("session_key", F.col("first").alias("user_message_id"), F.col("last").alias("reply_message_id"))
    across = turns.where("before_role = 'u' and first_role = 'a'").select("session_key", F.col("before").alias("user_message_id"), F.col("first").alias("reply_message_id"))
    return inside.unionByName(across).join(sound, "session_key", "left_semi")


def conversations(spark: SparkSession, messages_path: str, sessions: DataFrame, files: int = FILES) -> DataFrame:
    """`session_id, user_message_id, reply_message_id`: the exchanges of all sound conversations of known sessions."""
    found = replay(spark, messages_path, files).result()
    known = sessions.select(norm_id("id").alias("session_key"), "id").where("session_key is not null").groupBy("session_key").agg(F.min("id").alias("session_id"))
    return found.join(known, "session_key").select("session_id", "user_message_id", "reply_message_id").distinct()
