"""A table kept current from a stream of changes.

Each micro-batch merges its changes per path and writes a new version of the state in the shared folder: what the batch
touches is taken out by an anti-join, what it adds or modifies goes in. A version is named by its batch, so a batch that
runs again after a loss writes the same version once more and nothing is applied twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.diff import last_change
from codeloom.operators.lineage import own_dir

_STATE = "path string, action string, at timestamp_ntz, seq bigint"


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state (`path, action, at, seq`) after changes of the same columns: the later of two rows wins, whatever their order of arrival."""
    both = state.unionByName(changes.select("path", "action", "at", "seq"))
    return both.groupBy("path").agg(F.max_by(F.struct("action", "at", "seq"), F.struct("at", "seq")).alias("v")).select("path", "v.*")


def run(spark: SparkSession, changes: DataFrame) -> DataFrame:
    """Runs a stream of changes until its end; the final state, deletions included as rows of action `delete`."""
    base = f"{own_dir(spark)}/state-{uuid.uuid4().hex}"
    empty = spark.createDataFrame([], _STATE)

    def version(batch: int) -> DataFrame:
        return spark.read.schema(empty.schema).parquet(f"{base}/{batch}") if batch >= 0 else empty

    def step(df: DataFrame, batch: int) -> None:
        merged = df.groupBy("path").agg(F.max_by(F.struct("action", "at", "seq"), F.struct("at", "seq")).alias("v")).select("path", "v.*")
        apply_changes(version(batch - 1), merged).write.mode("overwrite").parquet(f"{base}/{batch}")

    q = changes.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}-progress").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress
    return version(-1 if last is None else int(last["batchId"]))


def live(state: DataFrame) -> DataFrame:
    """The paths that are there."""
    return state.where("action <> 'delete'")


def merged(changes: DataFrame) -> DataFrame:
    """The last action per path of a batch."""
    return last_change(changes, "path", action="action", order=["at", "seq"])
