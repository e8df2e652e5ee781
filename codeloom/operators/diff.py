"""Differences of snapshots, and changes merged."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gaps in a stretch of time within which bursts are found first.
STRETCH = 4096
_UNITS = ("seconds", "minutes", "hours", "days")


def micros_of(gap: str) -> float:
    """Microseconds of a gap such as `2 seconds`."""
    n, unit = gap.split()
    return timedelta(**{next(u for u in _UNITS if u.startswith(unit.rstrip("s"))): float(n)}) / timedelta(microseconds=1)



def snapshot_diff(old: DataFrame, new: DataFrame, *key: str, digest: str) -> DataFrame:
    """`key, change` (added, removed, modified) of two snapshots with one row per key; equal digests (nulls too) are no change."""
    a = old.select(*key, F.col(digest).alias("_a"), F.lit(True).alias("_in_a"))
    b = new.select(*key, F.col(digest).alias("_b"), F.lit(True).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return a.join(b, list(key), "full").select(*key, change.alias("change")).where("change is not null")


def last_change(changes: DataFrame, *key: str, action: str, order: list[Column | str]) -> DataFrame:
    """The last action per key."""
    return changes.groupBy(*key).agg(F.max_by(action, F.struct(*order)).alias(action))


def bursts(changes: DataFrame, project: str, path: str, action: str, at: str, tie: str, gap: str = "2 seconds") -> DataFrame:
    """`project, start, end, path, action`: changes of a project closer than the gap make a burst; in it the last action per path counts.

    A change that comes a gap or more after the one before it starts a burst. Which one that is takes two passes over
    stretches of time, so that no task holds all changes of a project: bursts inside a stretch, then their joints.
    """
    us = F.unix_micros(F.col(at).cast("timestamp"))
    wide = F.lit(int(micros_of(gap))).cast("bigint")
    rows = changes.withColumn("_us", us).withColumn("_block", F.floor(F.col("_us") / (wide * F.lit(STRETCH).cast("bigint"))))
    inside = Window.partitionBy(project, "_block").orderBy("_us")
    rows = rows.withColumn("_new", F.coalesce(F.col("_us") - F.lag("_us").over(inside) >= wide, F.lit(True)).cast("int"))
    rows = rows.withColumn("_part", F.sum("_new").over(inside))
    # one row per run of changes inside a stretch: few, whatever the number of changes
    runs = rows.groupBy(project, "_block", "_part").agg(F.min("_us").alias("_a"), F.max("_us").alias("_b"))
    order = Window.partitionBy(project).orderBy("_a")
    runs = runs.withColumn("_first", F.coalesce(F.col("_a") - F.lag("_b").over(order) >= wide, F.lit(True)).cast("int")).withColumn("_burst", F.sum("_first").over(order))
    spans = runs.groupBy(project, "_burst").agg(F.min("_a").alias("_start"), F.max("_b").alias("_end"))
    runs = runs.select(project, "_block", "_part", "_burst").join(spans, [project, "_burst"])
    merged = rows.groupBy(project, "_block", "_part", path).agg(F.max(F.struct(at, tie, action)).alias("_v")).join(runs, [project, "_block", "_part"])
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return merged.groupBy(project, time(F.col("_start")).alias("start"), time(F.col("_end") + wide).alias("end"), path).agg(F.max("_v").alias("_v")).select(project, "start", "end", path, F.col(f"_v.{action}").alias(action))


def dependents(imports: DataFrame, changed: DataFrame) -> DataFrame:
    """The files (`src`) that import a changed one (`qn`), less the changed ones themselves."""
    rows = imports.join(changed.withColumnRenamed("qn", "dst"), "dst", "left_semi").select(F.col("src").alias("qn")).distinct()
    return rows.join(changed, "qn", "left_anti")
