"""Filling containers of fixed capacity by bounded-space online best-fit.

Each task takes its items in a fixed random order and keeps at most OPEN bins open. The open bins stand in a bitset with
a bit for each amount of free space, so the bin that an item fills best is the lowest set bit from the item's size
on; if too many bins are open, the fullest (the lowest set bit) closes. Tasks hold ITEMS items, so bins that are still
open at a task's end are few against those it closed; where there are several tasks, those bins are packed once more, as
items. The order is that of a hash of the items, so a task that runs again gives the same bins.

Defined results: items of size 0 get no bin (null); an item above the capacity is divided into pieces of full capacity
and a rest, no other item is; sizes are placed as they are, repeated rows are separate items.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.lineage import stored

#: Open bins of a task; items of a task.
OPEN, ITEMS = 512, 250_000


class Bins:
    """Bounded-space best-fit with bins named 0, 1, 2, ..."""

    def __init__(self, capacity: int, most_open: int = OPEN) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.bits, self.open, self.made = 0, 0, 0
        self.by_space: dict[int, list[int]] = {}

    def _put(self, name: int, space: int) -> None:
        if not space:
            return
        self.by_space.setdefault(space, []).append(name)
        self.bits |= 1 << space
        self.open += 1
        if self.open > self.most_open:
            self._take(self.bits)

    def _take(self, bits: int) -> tuple[int, int]:
        space = (bits & -bits).bit_length() - 1
        names = self.by_space[space]
        name = names.pop()
        if not names:
            self.bits ^= 1 << space
        self.open -= 1
        return name, space

    def place(self, size: int) -> int:
        """The bin of an item of 1..capacity."""
        fits = self.bits >> size << size
        if fits:
            name, space = self._take(fits)
        else:
            name, space = self.made, self.capacity
            self.made += 1
        self._put(name, space - size)
        return name

    def left_open(self) -> set[int]:
        return {n for names in self.by_space.values() for n in names}


def _packed(items: DataFrame, capacity: int, tasks: int, level: int, most_open: int) -> DataFrame:
    """items (`item`, `size`, ...) with `bin`, and `open` where it was open at the end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, part = Bins(capacity, most_open), TaskContext.get().partitionId()
        held = []
        for b in batches:
            b["bin"] = [bins.place(s) for s in b["size"].tolist()]
            held.append(b)
        left = bins.left_open()
        for b in held:
            b["open"] = b["bin"].isin(left)
            b["bin"] = [f"{level}-{part}-{n}" for n in b["bin"]]
            yield b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", bin string, open boolean"
    order = [F.xxhash64("item"), F.col("item")]
    return items.repartition(tasks, F.xxhash64("item")).sortWithinPartitions(*order).mapInPandas(run, schema)


def pack(items: DataFrame, capacity: int, most_open: int = OPEN, per_task: int = ITEMS) -> DataFrame:
    """`item, piece_no, start, size, container_id` for items `item` (a unique string), `size`."""
    items = stored(items, "items")
    whole = F.floor(F.col("size") / capacity).cast("int")
    rest = (F.col("size") % capacity).cast("int")
    full = items.where(F.col("size") >= capacity).select("item", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece_no"))
    full = full.select("item", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("start"), F.lit(capacity).alias("size"), F.concat_ws("-", F.lit("f"), "item", "piece_no").alias("container_id"))
    none = items.where("size = 0").select("item", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("container_id"))
    part = items.where(rest > 0).select("item", whole.alias("piece_no"), (whole.cast("bigint") * capacity).alias("start"), rest.alias("size"))
    tasks = max(1, -(-part.count() // per_task))
    done = _packed(part, capacity, tasks, 0, most_open)
    if tasks > 1:
        done = stored(done, "packed")
        loads = done.where("open").groupBy(F.col("bin").alias("item")).agg(F.sum("size").cast("int").alias("size"))
        again = _packed(stored(loads, "loads"), capacity, max(1, -(-tasks * most_open // per_task)), 1, most_open).select(F.col("item").alias("bin"), F.col("bin").alias("merged"))
        kept = done.where("not open").withColumn("merged", F.lit(None).cast("string"))
        done = done.where("open").join(again, "bin").select(*kept.columns).unionByName(kept).withColumn("bin", F.coalesce("merged", "bin"))
    placed = done.select("item", "piece_no", "start", "size", F.col("bin").alias("container_id"))
    return placed.unionByName(full).unionByName(none)
