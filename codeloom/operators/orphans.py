"""References to records that do not exist, were deleted, or came later.

Parents and references are cut into ranges of the 64-bit hash of (entity, key). Each range keeps its parents as arrays
sorted by that hash; batches of references are looked up in them by binary search (numpy, no loop over rows), and a hit
counts only if the key itself is equal, so colliding hashes do no harm. Hash ranges are even for distinct parents;
ranges that hold many references (a hot key) are split by a salt, for which their parents are repeated.

Defined results: a null or blank reference is no reference; keys are equal after trimming and ignoring case; a row
without a time of its own can't be `late` and has a null period; repeated rows count once; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.keys import micros, month_of, norm_id

#: References that one task looks up at a time, and parents of one range.
RANGE_ROWS = 200_000

_FOUND = "ref_table string, repo_name string, row_key string, reason string, own_us bigint"


@dataclass(frozen=True)
class Parent:
    """A table that is referred to. `scope`: a column that a reference must share, if any."""

    entity: str
    rows: DataFrame
    key: str
    created_us: Column
    updated_us: Column
    scope: str | None = None


@dataclass(frozen=True)
class Reference:
    """A column that refers to `entity`. `row_key` names the row in the report."""

    table: str
    entity: str
    rows: DataFrame
    key: str
    row_key: str
    own_us: Column
    repo: str = "repo_name"


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def _search(hashes: np.ndarray, keys: np.ndarray, wanted: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The position of each wanted (hash, name) in the sorted arrays, or -1."""
    at, found = np.searchsorted(hashes, wanted, "left"), np.full(len(wanted), -1)
    live = np.arange(len(wanted))
    while len(live):
        live = live[at[live] < len(hashes)]
        live = live[hashes[at[live]] == wanted[live]]
        hit = keys[at[live]] == names[live]
        found[live[hit]] = at[live[hit]]
        live = live[~hit]
        at[live] += 1
    return found


def _probe(refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    """The reason of each reference of a range, from the range's parents sorted by hash."""
    own = parents[parents["kind"] == 0].sort_values("h", kind="stable")
    scoped = parents[parents["kind"] == 1].sort_values("h", kind="stable")
    at = _search(own["h"].to_numpy(), own["k"].to_numpy(object), refs["h"].to_numpy(), refs["k"].to_numpy(object))
    inside = _search(scoped["h"].to_numpy(), scoped["k"].to_numpy(object), refs["hs"].to_numpy(), refs["ks"].to_numpy(object))
    hit = at >= 0

    def taken(col: str, df: pd.DataFrame, pos: np.ndarray) -> np.ndarray:
        values = np.append(df[col].to_numpy(float), np.nan)
        return values[np.where(pos >= 0, pos, len(values) - 1)]

    updated, deleted, rows = (taken(c, own, at) for c in ("updated_us", "deleted_us", "n_rows"))
    created = taken("created_us", scoped, inside)
    with np.errstate(invalid="ignore"):
        gone = hit & ~np.isnan(deleted) & ((np.nan_to_num(rows) == 0) | (deleted > updated))
        late = (inside >= 0) & (created > refs["own_us"].to_numpy(float, na_value=np.nan))
    reason = np.select([gone, inside < 0, late], ["deleted", "missing", "late"], "")
    out = refs[["ref_table", "repo_name", "row_key"]].assign(reason=reason, own_us=refs["own_us"].astype("Int64"))
    return out[reason != ""].drop_duplicates()


def find_orphans(references: list[Reference], parents: list[Parent], deletions: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows `ref_table, repo_name, row_key, reason, period` of all references that do not resolve.

    deletions: columns `entity, record_id, deleted_at`. Reasons, the first that applies: *deleted*, the log has the id
    and no row has it or the last deletion is later than the record's last update; *missing*, no row (in the reference's
    scope); *late*, the record was created after the row's own time.
    """
    spark = deletions.sparkSession
    rows = _union([
        p.rows.select(
            F.lit(p.entity).alias("entity"), norm_id(p.key).alias("key"),
            (F.coalesce(F.col(p.scope), F.lit("")) if p.scope else F.lit("")).alias("scope"),
            p.created_us.cast("bigint").alias("created_us"), p.updated_us.cast("bigint").alias("updated_us"),
        ).where("key is not null")
        for p in parents
    ])
    log = deletions.select(F.lower(F.trim("entity")).alias("entity"), norm_id("record_id").alias("key"), micros("deleted_at").alias("deleted_us"))
    log = log.where("key is not null and deleted_us is not null")
    by_scope = rows.groupBy("entity", "key", "scope").agg(
        F.min("created_us").alias("created_us"), F.max("updated_us").alias("updated_us"), F.count("*").alias("n_rows")
    )
    by_key = (
        by_scope.select("entity", "key", "updated_us", "n_rows", F.lit(None).cast("bigint").alias("deleted_us"))
        .unionByName(log.select("entity", "key", F.lit(None).cast("bigint").alias("updated_us"), F.lit(0).cast("bigint").alias("n_rows"), "deleted_us"))
        .groupBy("entity", "key")
        .agg(F.max("updated_us").alias("updated_us"), F.sum("n_rows").alias("n_rows"), F.max("deleted_us").alias("deleted_us"))
    )
    joined = F.concat_ws("\x1f", "entity", "key")
    nothing = F.lit(None).cast("bigint")
    known = (
        by_key.select(F.lit(0).alias("kind"), joined.alias("k"), F.xxhash64(joined).alias("rk"), F.xxhash64(joined).alias("h"), "updated_us", "deleted_us", "n_rows", nothing.alias("created_us"))
        .unionByName(by_scope.select(
            F.lit(1).alias("kind"), F.concat_ws("\x1f", joined, "scope").alias("k"), F.xxhash64(joined).alias("rk"), F.xxhash64(F.concat_ws("\x1f", joined, "scope")).alias("h"),
            nothing.alias("updated_us"), nothing.alias("deleted_us"), F.lit(1).cast("bigint").alias("n_rows"), "created_us",
        ))
    )
    scoped = {p.entity for p in parents if p.scope}
    refs = _union([
        r.rows.select(
            F.lit(r.table).alias("ref_table"), F.col(r.repo).alias("repo_name"), F.col(r.row_key).alias("row_key"),
            F.concat_ws("\x1f", F.lit(r.entity), norm_id(r.key)).alias("k"), norm_id(r.key).alias("key"),
            (F.coalesce(F.col(r.repo), F.lit("")) if r.entity in scoped else F.lit("")).alias("scope"), r.own_us.cast("bigint").alias("own_us"),
        ).where("key is not null")
        for r in references
    ])
    refs = refs.withColumn("ks", F.concat_ws("\x1f", "k", "scope")).withColumn("h", F.xxhash64("k")).withColumn("hs", F.xxhash64("ks"))
    if ranges is None:
        n = known.count()
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    # the upper 31 bits of the hash, cut into equal ranges
    in_range = lambda c: F.floor((F.shiftrightunsigned(F.col(c), 33)) * F.lit(ranges) / F.lit(1 << 31)).cast("int")
    refs = refs.withColumn("rng", in_range("h"))
    # one row a range; whether it is broadcast is left to the planner
    load = refs.groupBy("rng").count().select("rng", F.ceil(F.col("count") / F.lit(RANGE_ROWS)).cast("int").alias("salts"))
    refs = refs.join(load, "rng").withColumn("salt", F.pmod(F.xxhash64("ref_table", "repo_name", "row_key", "own_us"), F.col("salts")).cast("int"))
    known = known.withColumn("rng", in_range("rk")).join(load, "rng")
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    cols = ["ref_table", "repo_name", "row_key", "k", "ks", "h", "hs", "own_us"]
    found = (
        refs.select("rng", "salt", *cols).groupBy("rng", "salt")
        .cogroup(known.select("rng", "salt", "kind", "k", "h", "created_us", "updated_us", "deleted_us", "n_rows").groupBy("rng", "salt"))
        .applyInPandas(_probe, _FOUND)
    )
    return found.select("ref_table", "repo_name", "row_key", "reason", month_of(F.col("own_us")).alias("period")).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """How many rows do not resolve, per table, month and reason."""
    return orphans.groupBy("ref_table", "period", "reason").agg(F.count("*").alias("n_rows"))
