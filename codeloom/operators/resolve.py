"""Call resolution as staged joins.

Every way to resolve a call gives candidates with a rank; the least rank of a call counts, the nearest candidate within
it, the least name on a tie. The ways, in order: an import (through re-exports of up to three packages); a typed
variable, or self and cls, through the class and its ancestors; super, through the ancestors; the same module; imports
of whole modules; and last any definition of the same simple name, by distance of the modules' names. Names that are
builtins are dropped first, imports of the standard library after them.
"""

from __future__ import annotations

import builtins
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.graph import Graph
from codeloom.operators.lineage import cut
from codeloom.operators.structure import ancestors, nearest_definitions

BUILTINS = tuple(sorted(x for x in dir(builtins) if not x.startswith("_") and x[:1].islower()))
#: Re-exports that a name is followed through.
HOPS = 3


def outside_standard(imports: DataFrame, column: str = "target") -> DataFrame:
    """Imports without those of the standard library (the running Python's list)."""
    return imports.where(~F.substring_index(column, ".", 1).isin(*sorted(sys.stdlib_module_names)))


def followed(imports: DataFrame, registry: DataFrame) -> DataFrame:
    """`module, name, qn`: what an imported name is, through re-exports of packages."""
    via = imports.where("name <> '*'").select(F.concat_ws(".", "module", "name").alias("full"), F.col("target").alias("next"))
    known = registry.select(F.col("qn").alias("full"), F.lit(True).alias("known"))
    rows = imports.where("name <> '*'").select("module", "name", F.col("target").alias("full")).distinct()
    found = None
    for _ in range(HOPS + 1):
        rows = rows.join(known, "full", "left")
        hit = rows.where("known").select("module", "name", F.col("full").alias("qn"))
        found = hit if found is None else found.unionByName(hit)
        rows = rows.where("known is null").drop("known").join(via, "full").select("module", "name", F.col("next").alias("full"))
    return found.distinct()


def class_names(rows: DataFrame) -> DataFrame:
    """`module, name, cls`: the classes that a name in a module stands for, by import or of the module itself."""
    classes = rows.where("kind = 'def' and label = 'Class'").select("qn", "module", "name")
    own = classes.select("module", "name", F.col("qn").alias("cls"))
    imported = followed(rows.where("kind = 'import'"), classes).select("module", "name", F.col("qn").alias("cls"))
    return own.unionByName(imported).distinct()


def inheritance(rows: DataFrame) -> DataFrame:
    """`src, rel, dst, n`: classes and their bases, as far as those resolve; n keeps their order."""
    bases = rows.where("kind = 'base'").select("module", "qn", F.col("target").alias("name"), "n")
    found = bases.join(class_names(rows), ["module", "name"]).select(F.col("qn").alias("src"), F.lit("INHERITS").alias("rel"), F.col("cls").alias("dst"), "n")
    return found.where("src <> dst").distinct()


def methods_of(rows: DataFrame) -> DataFrame:
    """`cls, method, qn, depth, line`: the methods of each class, its own and those of its ancestors; by depth and line they are in the order in which Python-like lookups by breadth find them."""
    edges = inheritance(rows)
    own = rows.where("kind = 'def' and label = 'Method'").select(F.regexp_replace("qn", r"\.[^.]*$", "").alias("cls"), F.col("name").alias("method"), "qn")
    up = ancestors(Graph(rows, edges), ordered=True).select(F.col("qn").alias("cls"), "ancestor", "depth", "line")
    inherited = up.join(own.withColumnRenamed("cls", "ancestor"), "ancestor").select("cls", "method", "qn", "depth", "line")
    return own.select("cls", "method", "qn", F.lit(0).alias("depth"), F.expr("cast(array() as array<int>)").alias("line")).unionByName(inherited)


def resolve_calls(rows: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """`caller, name, line, callee, way`: the calls of `python_code.read` rows that resolve; with `only` (`caller, name, line`), of these calls."""
    rows = cut(rows)
    registry = rows.where("kind = 'def'").select("qn", "name", "module", "label")
    calls = rows.where("kind = 'call'").select("module", F.col("qn").alias("caller"), F.col("name").alias("callee_name"), F.col("target").alias("cls"), F.col("n").alias("line"), "types").where(~F.col("callee_name").isin(*BUILTINS)).dropDuplicates(["caller", "callee_name", "line"])
    if only is not None:
        calls = calls.join(only.select("caller", F.col("name").alias("callee_name"), "line").distinct(), ["caller", "callee_name", "line"], "left_semi")
    parts = F.split("callee_name", r"\.")
    calls = calls.withColumn("id", F.xxhash64("caller", "callee_name", "line")).withColumn("first", parts[0]).withColumn("last", F.element_at(parts, -1)).withColumn("receiver", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".")))
    calls = cut(calls.withColumn("rest", F.when(F.size(parts) > 1, F.expr("substring(callee_name, length(first) + 1)")).otherwise("")))
    imported = cut(followed(rows.where("kind = 'import'"), registry).unionByName(rows.where("kind = 'import' and name <> '*'").select("module", "name", F.col("target").alias("qn"))).distinct())
    methods = cut(methods_of(rows))
    names = registry.select("qn")
    take = lambda df, rank, way: df.select("id", F.col("qn").alias("callee"), F.lit(rank).alias("rank"), F.lit(way).alias("way"))
    direct = calls.join(imported.withColumnRenamed("name", "first"), ["module", "first"]).withColumn("qn", F.concat("qn", "rest")).join(names, "qn", "left_semi")
    via_class = lambda typed: typed.join(methods.withColumnRenamed("method", "last").withColumnRenamed("line", "bases"), ["cls", "last"])
    kinds = class_names(rows)
    typed = calls.where("receiver is not null").withColumn("name", F.try_element_at("types", F.col("receiver"))).where("name is not null").drop("cls").join(kinds, ["module", "name"])
    static = calls.where("receiver is not null").drop("cls").join(kinds.withColumnRenamed("name", "receiver"), ["module", "receiver"])
    near = lambda df: df.groupBy("id").agg(F.min(F.struct("depth", "bases", "qn")).alias("v")).select("id", F.col("v.qn").alias("qn"))
    same = calls.withColumn("qn", F.concat_ws(".", "module", "callee_name")).join(names, "qn", "left_semi")
    nested = calls.where("caller <> module").withColumn("qn", F.concat_ws(".", "caller", "callee_name")).join(names, "qn", "left_semi")
    whole = calls.where("receiver is null").join(rows.where("kind = 'import' and name = '*'").select("module", F.col("target").alias("star")), "module").withColumn("qn", F.concat_ws(".", "star", "callee_name")).join(names, "qn", "left_semi")
    ranked = [
        take(nested, 0, "nested"), take(direct, 1, "import"), take(near(via_class(typed)), 2, "typed"), take(near(via_class(calls.where("receiver in ('self', 'cls')"))), 3, "self"), take(near(via_class(calls.where("receiver = 'super'")).where("depth > 0")), 4, "super"),
        take(near(via_class(static)), 5, "class"), take(same, 6, "module"), take(whole, 7, "star"),
    ]
    found = ranked[0]
    for r in ranked[1:]:
        found = found.unionByName(r)
    best = found.groupBy("id").agg(F.min(F.struct("rank", "callee", "way")).alias("v")).select("id", "v.callee", "v.way")
    # the last resort sees only what is left, once per (module, name) instead of once per call
    left = calls.join(best, "id", "left_anti").where("receiver is null or receiver not in ('self', 'cls', 'super')")
    asked = left.select(F.col("last").alias("key"), F.col("module").alias("path"))
    nearest = nearest_definitions(asked, registry.select(F.col("name").alias("key"), F.col("module").alias("path"), "qn")).select(F.col("path").alias("module"), F.col("key").alias("last"), "qn")
    guessed = left.join(nearest, ["module", "last"]).select("id", F.col("qn").alias("callee"), F.lit("nearest").alias("way"))
    return calls.select("id", "caller", F.col("callee_name").alias("name"), "line").join(best.unionByName(guessed), "id").drop("id")


def call_edges(resolved: DataFrame) -> DataFrame:
    """CALLS edges as a set; calls of a function by itself are kept out."""
    return resolved.where("caller <> callee").select(F.col("caller").alias("src"), F.lit("CALLS").alias("rel"), F.col("callee").alias("dst"), F.lit(None).cast("string").alias("version")).distinct()
