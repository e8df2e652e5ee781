"""Context around nodes: resolved identifiers, folders, modules, and the checks and seeds of a built graph."""

from __future__ import annotations

import builtins

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators import graph as G
from codeloom.operators import text as X
from codeloom.operators.graph import Graph
from codeloom.operators.search import fuzzy_search

#: Relations that results are enriched with by default.
ENRICHING = ("CALLS", "INHERITS", "OVERRIDES", "IMPORTS", "DEFINES", "DEFINES_METHOD", "BINDS_TO")
CONTAINING = ("CONTAINS_FOLDER", "CONTAINS_FILE", "DEFINES", "DEFINES_METHOD")


def find_folders(graph: Graph, wanted: str, cap: int = 100) -> DataFrame:
    """`qn, path` of the folders with this name or path (a slash at its end aside); if there is none, of those that begin so."""
    bare = wanted.rstrip("/")
    rank = F.when((F.col("qn") == bare) | (F.rtrim("path", F.lit("/")) == bare), 0).when(F.col("qn").startswith(bare) | F.col("path").startswith(bare), 1)
    rows = graph.label("Folder").withColumn("rank", rank).where("rank is not null")
    best = rows.agg(F.min("rank").alias("best"))
    return rows.join(F.broadcast(best), F.col("rank") == F.col("best")).select("qn", "path").orderBy("qn").limit(cap)  # one row


def resolve_identifier(graph: Graph, identifier: str, current: str | None = None) -> DataFrame:
    """`qn, label` of what an identifier names, by the first way that finds something: the current project (`.`), a project, a folder's path, a folder, a file (by path or name), a class."""
    if identifier == "." and current:
        identifier = current
    path, label = F.rtrim("path", F.lit("/")) == identifier.rstrip("/"), F.col("label")
    way = (
        F.when((label == "Project") & (F.col("qn") == identifier), 0).when((label == "Folder") & path, 1).when((label == "Folder") & (F.col("qn") == identifier), 2)
        .when((label == "File") & (path | (F.col("qn") == identifier)), 3).when((label == "Class") & ((F.col("qn") == identifier) | (F.col("name") == identifier)), 4)
    )
    return graph.nodes.withColumn("way", way).where("way is not null").orderBy("way", "qn").limit(1).select("qn", "label")


def children(graph: Graph, starts: DataFrame, depth: int = 1, labels: tuple[str, ...] | None = None) -> DataFrame:
    """`start, qn, label, depth`: what lies below nodes within some levels of containment; labels filter the answer, not the way there."""
    hops = graph.rel(*CONTAINING).select(F.col("src").alias("at"), F.col("dst").alias("to"))
    front = starts.select(F.col("qn").alias("start"), "qn")
    out = None
    for d in range(1, depth + 1):
        front = front.join(hops, front.qn == hops["at"]).select("start", F.col("to").alias("qn"))
        level = front.withColumn("depth", F.lit(d))
        out = level if out is None else out.unionByName(level)
    rows = out.join(graph.nodes.select("qn", "label"), "qn")
    return (rows if labels is None else rows.where(F.col("label").isin(*labels))).select("start", "qn", "label", "depth")


def enrich(graph: Graph, found: DataFrame, *rels: str) -> DataFrame:
    """`src, rel, dst` among the results of a search; none if there is a single result."""
    rels = rels or ENRICHING
    several = found.select("qn").distinct().agg((F.count("*") > 1).alias("several")).where("several")
    return G.between(graph, found, *rels).select("src", "rel", "dst").join(F.broadcast(several.select(F.lit(True).alias("on"))), F.lit(True), "left_semi")  # one row


def find_many(graph: Graph, queries: list[str], project: str | None = None, cap: int = 50) -> DataFrame:
    """`query, qn, name, label` for a list of queries, up to `cap` each: the first is read by its strategy, the others as parts of names."""
    from codeloom.operators.search import find_nodes

    parts = [find_nodes(graph, q, project, cap=cap, strategy=None if i == 0 else "pattern").select(F.lit(q).alias("query"), "qn", "name", "label") for i, q in enumerate(dict.fromkeys(queries[:50]))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def code_lookup(graph: Graph, files: DataFrame, requests: list[str], project: str) -> DataFrame:
    """`request, qn, path, start_line, end_line, code`: the lines of the best node for each request; files: `path, code`."""
    best = fuzzy_search(graph, requests, project).select("request", "qn").join(graph.nodes.select("qn", "start_line", "end_line"), "qn")
    homes = graph.rel("DEFINES").select(F.col("dst").alias("qn"), "src").join(graph.label("File").select(F.col("qn").alias("src"), "path"), "src")
    rows = best.join(homes.select("qn", "path"), "qn", "left").join(files.select("path", F.col("code").alias("_code")), "path", "left")
    return rows.select("request", "qn", "path", "start_line", "end_line", X.snippet(F.col("_code"), F.col("start_line"), F.col("end_line")).alias("code"))


def by_file(graph: Graph, keys: DataFrame) -> DataFrame:
    """`file, path, n, members`: nodes (`qn`) grouped by the file that defines them, methods by that of their class; members hold `start_line, qn` in this order."""
    direct = graph.rel("DEFINES").select(F.col("dst").alias("qn"), F.col("src").alias("file"))
    methods = graph.rel("DEFINES_METHOD").select(F.col("dst").alias("m"), F.col("src").alias("qn")).join(direct, "qn").select(F.col("m").alias("qn"), "file")
    homes = direct.unionByName(methods).join(graph.label("File").select(F.col("qn").alias("file"), "path"), "file")
    rows = keys.select("qn").distinct().join(homes, "qn").join(graph.nodes.select("qn", "start_line"), "qn")
    return rows.groupBy("file", "path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("start_line", "qn"))).alias("members"))


def module_context(code: Column) -> Column:
    """The lines that open a module before its first definition: imports, constants, includes, package clauses; comments and blank lines are left out."""
    own = X.lines(code)
    defines = r"^\s*(?:export\s+)?(?:default\s+)?(?:pub(?:\([a-z]+\))?\s+)?(?:public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+|async\s+)*(?:def|class|func|function|fn|interface|enum|struct|impl|trait|record|type\s+\w+\s+(?:struct|interface)|local\s+function)\b|^\s*@"
    first = F.array_position(F.transform(own, lambda x: x.rlike(defines)), True)
    head = F.when(first > 0, F.slice(own, 1, (first - 1).cast("int"))).otherwise(own)
    noise = r"^\s*(?:#(?!include|define|if|ifdef|ifndef|pragma)|//|--|/?\*|$)"
    return F.array_join(F.filter(head, lambda x: ~x.rlike(noise)), "\n")


def external_stubs(calls: DataFrame, imports: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls of imported names that no definition answers: nodes `qn, name, external_module`, and edges `src, dst, n` with their counts."""
    known = registry.select("qn")
    first = F.substring_index("name", ".", 1)
    via = imports.where("name <> '*'").select("module", F.col("name").alias("first"), "target")
    rows = calls.withColumn("first", first).join(via, ["module", "first"]).withColumn("qn_called", F.concat("target", F.expr("substring(name, length(first) + 1)")))
    outside = rows.join(known.withColumnRenamed("qn", "qn_called"), "qn_called", "left_anti")
    edges = outside.groupBy(F.col("qn").alias("src"), F.col("qn_called").alias("dst")).agg(F.count("*").alias("n"))
    nodes = outside.select(F.col("qn_called").alias("qn"), F.substring_index("qn_called", ".", -1).alias("name"), F.regexp_replace("qn_called", r"\.[^.]*$", "").alias("external_module")).distinct()
    return nodes, edges


def kept_calls(calls: DataFrame, imports: DataFrame, local: DataFrame, standard: list[str], tracked: DataFrame | None = None, bindings: DataFrame | None = None) -> DataFrame:
    """Calls (`module, name, ...`) with `keep`: unqualified names that aren't imported, names of local modules (`module`), of tracked externals (`package`) and of native bindings (`name`) are kept, those of the standard library and of other externals aren't."""
    first = F.substring_index("name", ".", 1)
    via = imports.where("name <> '*'").groupBy("module", F.col("name").alias("first")).agg(F.min("target").alias("target"))
    rows = calls.withColumn("first", first).join(via, ["module", "first"], "left").withColumn("root", F.coalesce(F.substring_index("target", ".", 1), F.when(F.instr("name", ".") > 0, F.col("first"))))
    flag = lambda df, col, to, name: rows.join(df.select(F.col(col).alias(to)).distinct().withColumn(name, F.lit(True)), to, "left")
    rows = flag(local.select(F.substring_index("module", ".", 1).alias("module")), "module", "root", "_local")
    for df, col, name in ((tracked, "package", "_tracked"), (bindings, "name", "_bound")):
        if df is None:
            rows = rows.withColumn(name, F.lit(None).cast("boolean"))
        else:
            rows = rows.join(df.select(F.col(col).alias("root" if col == "package" else "_last")).distinct().withColumn(name, F.lit(True)), "root", "left") if col == "package" else rows.withColumn("_last", F.substring_index("name", ".", -1)).join(df.select(F.col(col).alias("_last")).distinct().withColumn(name, F.lit(True)), "_last", "left").drop("_last")
    keep = F.when(F.col("root").isNull(), True).when(F.col("_local"), True).when(F.col("_tracked"), True).when(F.col("_bound"), True).when(F.col("root").isin(*standard), False).otherwise(F.col("target").isNull())
    return rows.withColumn("keep", keep).select(*calls.columns, "keep")


def binding_edges(bindings: DataFrame, registry: DataFrame, parts: int | None = None) -> DataFrame:
    """BINDS_TO edges from native-binding definitions (`qn, simple_name`) to every function or method of that name.

    A name of many bindings and targets makes their product, so both sides are made sets before the join (its pairs then
    differ, nothing is shuffled after it), and the targets are spread over some parts, as many as shuffles have unless
    given; a binding is copied to those that have targets of its name.
    """
    parts = parts or int(registry.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    target = registry.where(F.col("label").isin("Function", "Method")).select(F.col("name").alias("simple_name"), F.col("qn").alias("dst"), F.pmod(F.xxhash64("qn"), F.lit(parts)).alias("part"))
    target = target.repartition(parts, "simple_name", "part").distinct()  # one shuffle for the set and the join
    held = target.groupBy("simple_name", "part").agg(F.min("dst").alias("one")).where("one is not null")  # of the same columns, so of the same shuffle
    source = bindings.select("simple_name", "qn").distinct().join(held.select("simple_name", "part"), "simple_name")
    return source.join(target, ["simple_name", "part"]).where("qn <> dst").select(F.col("qn").alias("src"), F.lit("BINDS_TO").alias("rel"), "dst", F.lit(None).cast("string").alias("version"))


def builtin_nodes(spark, project: str = "builtins") -> DataFrame:  # noqa: ANN001
    """Function nodes of the language's builtins."""
    names = sorted(x for x in dir(builtins) if callable(getattr(builtins, x)) and x[:1].islower())
    rows = [(project, "Function", f"{project}.{n}", n, None, None, None, None, None, None) for n in names]
    return spark.createDataFrame(rows, "project string, label string, qn string, name string, path string, start_line int, end_line int, docstring string, decorators array<string>, is_package boolean")


def edge_check(expected: DataFrame, graph: Graph, rel: str = "CALLS", tolerance: float = 0.05) -> DataFrame:
    """`rel, expected, actual, missing, ok`: stored edges against those that should be there (`src, dst`)."""
    want, have = expected.select("src", "dst").distinct(), graph.rel(rel).select("src", "dst").distinct()
    marks = want.withColumn("w", F.lit(1)).join(have.withColumn("h", F.lit(1)), ["src", "dst"], "full")
    sums = marks.agg(F.count("w").alias("expected"), F.count("h").alias("actual"), F.count(F.when(F.col("w").isNotNull() & F.col("h").isNull(), 1)).alias("missing"))
    return sums.select(F.lit(rel).alias("rel"), "expected", "actual", "missing", (F.col("missing") <= F.col("expected") * tolerance).alias("ok"))


def numbered(rows: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """rows with their place (from 0) in a total order, by ranges over all tasks: each task numbers its own rows and adds how many are in the ranges before."""
    from codeloom.operators.lineage import cut

    ranged = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part").orderBy(*order)
    # one row a task
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.withColumn("_at", F.row_number().over(own) - 1).join(sizes.select("_part", "_before"), "_part").withColumn(name, (F.col("_at") + F.col("_before")).cast("bigint")).drop("_part", "_at", "_before")


def queue_batches(tasks: DataFrame, key: str, priority: str, at: str, size: int = 100, *tie: str) -> DataFrame:
    """`key, priority, batch`: the latest task of each key, the highest priority first, then the oldest, in batches."""
    latest = tasks.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(at).alias("at"), *(F.col(c).alias(f"t{i}") for i, c in enumerate(tie)), F.col(priority).alias("p"))).alias("v"))
    placed = numbered(latest.select(key, F.col("v.p").alias(priority), F.col("v.at").alias(at)), F.col(priority).desc_nulls_last(), F.col(at).asc_nulls_last(), key)
    return placed.select(key, priority, F.floor(F.col("number") / F.lit(size)).cast("bigint").alias("batch"))


def global_stats(graph: Graph) -> DataFrame:
    """`kind, name, n, n_projects`: nodes by label and edges by relation over all projects."""
    nodes = graph.nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"), F.count_distinct("project").alias("n_projects"))
    edges = graph.edges.groupBy(F.lit("edge").alias("kind"), F.col("rel").alias("name")).agg(F.count("*").alias("n"), F.count_distinct(F.substring_index("src", ".", 1)).alias("n_projects"))
    return nodes.unionByName(edges)
