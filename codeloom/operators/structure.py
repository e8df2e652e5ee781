"""Structure, context and call-graph summaries.

Each side of an answer (callers, callees, methods, bases, ...) is aggregated by the node it belongs to before it is
joined, so optional parts never multiply one another. Collected lists are sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.components import closed, components, members, split
from codeloom.operators.graph import Graph
from codeloom.operators.lineage import cut


def names(col: Column | str) -> Column:
    """A sorted list of the different values, as text."""
    return F.array_join(F.array_sort(F.collect_set(col)), ",")


def children_by_label(graph: Graph) -> DataFrame:
    """`qn, label, n`: how many children of each label a container has (folders, files, classes)."""
    hops = graph.rel("CONTAINS_FOLDER", "CONTAINS_FILE", "DEFINES", "DEFINES_METHOD").select(F.col("src").alias("qn"), "dst")
    return hops.join(graph.nodes.select(F.col("qn").alias("dst"), "label"), "dst").groupBy("qn", "label").agg(F.count("*").alias("n"))


def folder_children(graph: Graph, parent: str) -> DataFrame:
    """`position, qn, name, label, child_count` of a folder's children: folders first, then by name in any case."""


    kids = graph.rel("CONTAINS_FOLDER", "CONTAINS_FILE").where(F.col("src") == parent).select(F.col("dst").alias("qn")).distinct()
    rows = kids.join(graph.nodes.select("qn", "name", "label"), "qn")
    counts = graph.rel("CONTAINS_FOLDER", "CONTAINS_FILE", "DEFINES").join(kids.withColumnRenamed("qn", "src"), "src", "left_semi").groupBy(F.col("src").alias("qn")).agg(F.count("*").alias("child_count"))
    rows = rows.join(counts, "qn", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0).cast("bigint")))
    w = Window.partitionBy().orderBy(F.when(F.col("label") == "Folder", 0).otherwise(1), F.lower("name"), "qn")  # the children of one folder
    return rows.select(F.row_number().over(w).alias("position"), "qn", "name", "label", "child_count")


def file_symbols(graph: Graph, depth: int = 2) -> DataFrame:
    """`file, qn, label, depth`: what each file defines; from depth 2 on with the methods of its classes."""
    files = graph.label("File").select(F.col("qn").alias("file"))
    own = graph.rel("DEFINES").select(F.col("src").alias("file"), F.col("dst").alias("qn")).join(files, "file", "left_semi")
    own = own.join(graph.nodes.select("qn", "label"), "qn")
    first = own.select("file", "qn", "label", F.lit(1).alias("depth"))
    if depth < 2:
        return first
    methods = graph.rel("DEFINES_METHOD").select(F.col("src").alias("qn"), "dst")
    return first.unionByName(own.where("label = 'Class'").join(methods, "qn").select("file", F.col("dst").alias("qn"), F.lit("Method").alias("label"), F.lit(2).alias("depth")))


def class_methods(graph: Graph) -> DataFrame:
    """`qn, n_methods, methods`: each class with the names of its methods in the order of their lines."""
    m = graph.rel("DEFINES_METHOD").select(F.col("src").alias("qn"), F.col("dst").alias("m")).join(graph.label("Method").select(F.col("qn").alias("m"), "name", "start_line"), "m")
    return m.groupBy("qn").agg(F.count("*").alias("n_methods"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "name"))), lambda x: x["name"]), ",").alias("methods"))


def project_info(graph: Graph) -> DataFrame:
    """Per project: packages, other folders, files, and whether it is made of packages."""
    label = F.col("label")
    rows = graph.nodes.groupBy("project").agg(
        F.count(F.when((label == "Folder") & F.col("is_package"), 1)).alias("n_packages"), F.count(F.when((label == "Folder") & ~F.col("is_package"), 1)).alias("n_folders"), F.count(F.when(label == "File", 1)).alias("n_files")
    )
    return rows.withColumn("structure", F.when(F.col("n_packages") > 0, "package").otherwise("flat"))


def module_counts(graph: Graph) -> DataFrame:
    """`qn, n_functions, n_classes, n_methods` of each file."""
    symbols = file_symbols(graph)
    one = lambda label: F.count(F.when(F.col("label") == label, 1))
    counts = symbols.groupBy(F.col("file").alias("qn")).agg(one("Function").alias("n_functions"), one("Class").alias("n_classes"), one("Method").alias("n_methods"))
    rows = graph.label("File").select("qn").join(counts, "qn", "left")
    return rows.select("qn", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_functions", "n_classes", "n_methods")))


def package_tree(graph: Graph, least: int = 0) -> DataFrame:
    """`package, n_modules, n_nodes`: the nodes in all files below each package, each file counted once per package above it.

    A file's packages are the prefixes of its name up to the first that is no package, so the roll-up is one explosion
    and one aggregate with partial sums, for trees of any depth.
    """
    sizes = module_counts(graph).select("qn", (F.col("n_functions") + F.col("n_classes") + F.col("n_methods")).alias("n")).where(F.col("n") >= least)
    parts = F.split("qn", r"\.")
    above = sizes.select("qn", "n", F.size(parts).alias("k"), F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("at", "package"))
    packages = graph.label("Folder").where("is_package").select(F.col("qn").alias("package"))
    held = above.join(packages, "package")
    # only through consecutive packages: from the file upwards without a gap


    up = Window.partitionBy("qn").orderBy(F.col("at").desc())
    held = held.withColumn("gap", F.col("k") - 2 - F.col("at") - (F.row_number().over(up) - 1)).where("gap = 0")
    return held.groupBy("package").agg(F.count("*").alias("n_modules"), F.sum("n").alias("n_nodes"))


def first_names(edges: DataFrame, key: str, other: str, most: int = 30, parts: int = 64) -> DataFrame:
    """`qn, n, names`: how many different nodes each key has, and the first names of them.

    A key's nodes are cut down to the first names in each of some parts first, so that no list grows with a hub.
    """
    part = F.pmod(F.xxhash64(other), F.lit(parts))
    by = Window.partitionBy(key, part).orderBy(other)
    one = edges.select(key, other).distinct()
    firsts = one.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most).groupBy(key).agg(F.slice(F.array_sort(F.collect_list(other)), 1, most).alias("names"))
    counts = one.groupBy(key).agg(F.count("*").alias("n"))
    return counts.join(firsts, key).select(F.col(key).alias("qn"), "n", F.array_join("names", ",").alias("names"))


def call_context(graph: Graph) -> DataFrame:
    """`qn, n_callers, n_callees, callers, callees` of each function; the lists hold the first 30 names."""
    calls = graph.rel("CALLS")
    into = first_names(calls, "dst", "src").select("qn", F.col("n").alias("n_callers"), F.col("names").alias("callers"))
    out = first_names(calls, "src", "dst").select("qn", F.col("n").alias("n_callees"), F.col("names").alias("callees"))
    rows = graph.label("Function", "Method").select("qn").join(into, "qn", "left").join(out, "qn", "left")
    zero, none = F.lit(0).cast("bigint"), F.lit("")
    return rows.select("qn", F.coalesce("n_callers", zero).alias("n_callers"), F.coalesce("n_callees", zero).alias("n_callees"), F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))


def class_hierarchy(graph: Graph) -> DataFrame:
    """`qn, bases, subclasses, n_methods`: the direct bases and subclasses of each class."""
    inherits = graph.rel("INHERITS")
    up = inherits.groupBy(F.col("src").alias("qn")).agg(names("dst").alias("bases"))
    down = inherits.groupBy(F.col("dst").alias("qn")).agg(names("src").alias("subclasses"))
    methods = class_methods(graph).select("qn", "n_methods")
    rows = graph.label("Class").select("qn").join(up, "qn", "left").join(down, "qn", "left").join(methods, "qn", "left")
    return rows.select("qn", F.coalesce("bases", F.lit("")).alias("bases"), F.coalesce("subclasses", F.lit("")).alias("subclasses"), F.coalesce("n_methods", F.lit(0).cast("bigint")).alias("n_methods"))


def module_calls(graph: Graph) -> DataFrame:
    """`src_file, dst_file, n_calls`: calls between the files that define their ends, within a file where both are equal."""
    home = graph.rel("DEFINES").join(graph.label("File").select(F.col("qn").alias("src")), "src", "left_semi").select(F.col("src").alias("file"), F.col("dst").alias("qn"))
    calls = graph.rel("CALLS").select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    rows = calls.join(home.select(F.col("qn").alias("caller"), F.col("file").alias("src_file")), "caller").join(home.select(F.col("qn").alias("callee"), F.col("file").alias("dst_file")), "callee")
    return rows.groupBy("src_file", "dst_file").agg(F.count("*").alias("n_calls"))


def module_call_graph(graph: Graph, file: str, top: int = 30) -> DataFrame:
    """`direction, other, n_calls` of a file: internal calls, and the busiest outgoing and incoming files."""
    calls = module_calls(graph)
    inner = calls.where((F.col("src_file") == file) & (F.col("dst_file") == file)).select(F.lit("internal").alias("direction"), F.col("dst_file").alias("other"), "n_calls")
    out = calls.where((F.col("src_file") == file) & (F.col("dst_file") != file)).orderBy(F.desc("n_calls"), "dst_file").limit(top).select(F.lit("outgoing").alias("direction"), F.col("dst_file").alias("other"), "n_calls")
    into = calls.where((F.col("dst_file") == file) & (F.col("src_file") != file)).orderBy(F.desc("n_calls"), "src_file").limit(top).select(F.lit("incoming").alias("direction"), F.col("src_file").alias("other"), "n_calls")
    return inner.unionByName(out).unionByName(into)


def package_call_graph(graph: Graph) -> DataFrame:
    """`src_package, dst_package, n_calls` between different packages; a file's package is its name without the last part."""
    package = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    rows = module_calls(graph).select(package("src_file").alias("src_package"), package("dst_file").alias("dst_package"), "n_calls")
    return rows.where("src_package <> dst_package").groupBy("src_package", "dst_package").agg(F.sum("n_calls").alias("n_calls"))


def key_functions(graph: Graph, top: int | None = 20) -> DataFrame:
    """`qn, n_callers, n_callees, score` of the functions that files define, by 0.6 callers + 0.4 callees."""
    calls = graph.rel("CALLS")
    into = calls.groupBy(F.col("dst").alias("qn")).agg(F.countDistinct("src").alias("n_callers"))
    out = calls.groupBy(F.col("src").alias("qn")).agg(F.countDistinct("dst").alias("n_callees"))
    homes = graph.rel("DEFINES").select(F.col("dst").alias("qn"))
    rows = graph.label("Function").select("qn").join(homes, "qn", "left_semi").join(into, "qn", "left").join(out, "qn", "left")
    zero = F.lit(0).cast("bigint")
    rows = rows.select("qn", F.coalesce("n_callers", zero).alias("n_callers"), F.coalesce("n_callees", zero).alias("n_callees"))
    rows = rows.withColumn("score", F.round(F.col("n_callers") * 0.6 + F.col("n_callees") * 0.4, 6))
    return rows if top is None else rows.orderBy(F.desc("score"), "qn").limit(top)


def imports_of(graph: Graph, text: str, cap: int | None = 100) -> DataFrame:
    """`src, dst` of imports whose file has the text in its path or name."""
    files = graph.label("File").where(F.col("path").contains(text) | F.col("qn").contains(text)).select(F.col("qn").alias("src"))
    rows = graph.rel("IMPORTS").join(files, "src", "left_semi").select("src", "dst").distinct()
    return rows if cap is None else rows.orderBy("src", "dst").limit(cap)


def external_dependencies(graph: Graph) -> DataFrame:
    """`project, package, version`: the version is the edge's."""
    deps = graph.rel("DEPENDS_ON_EXTERNAL").select(F.col("src").alias("project"), F.col("dst").alias("qn"), "version")
    return deps.join(graph.label("ExternalPackage").select("qn", "name"), "qn").select("project", F.col("name").alias("package"), "version")


def project_stats(graph: Graph) -> DataFrame:
    """`project, kind, name, n`: nodes by label and edges by relation of each project (by the project of their source)."""
    nodes = graph.nodes.groupBy("project", F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    edges = graph.edges.groupBy(F.substring_index("src", ".", 1).alias("project"), F.lit("edge").alias("kind"), F.col("rel").alias("name")).agg(F.count("*").alias("n"))
    return nodes.unionByName(edges)


def code_context(graph: Graph, qn: str, most: int = 30) -> DataFrame:
    """`part, value`: all that is known around a node: its file, callers, callees, imports of its file and files that import it, bases, methods."""
    calls, defines = graph.rel("CALLS"), graph.rel("DEFINES")
    part = lambda df, name: df.select(F.lit(name).alias("part"), F.col("value")).distinct()
    first = lambda df: df.orderBy("value").limit(most)
    home = defines.where(F.col("dst") == qn).select(F.col("src").alias("value")).distinct()
    imports = graph.rel("IMPORTS")
    sides = [
        part(home, "file"), first(part(calls.where(F.col("dst") == qn).select(F.col("src").alias("value")), "caller")), first(part(calls.where(F.col("src") == qn).select(F.col("dst").alias("value")), "callee")),
        part(imports.join(home.withColumnRenamed("value", "src"), "src", "left_semi").select(F.col("dst").alias("value")), "import"), part(imports.join(home.withColumnRenamed("value", "dst"), "dst", "left_semi").select(F.col("src").alias("value")), "imported_by"),
        part(graph.rel("INHERITS").where(F.col("src") == qn).select(F.col("dst").alias("value")), "base"), part(graph.rel("DEFINES_METHOD").where(F.col("src") == qn).select(F.col("dst").alias("value")), "method"),
    ]
    out = sides[0]
    for s in sides[1:]:
        out = out.unionByName(s)
    return out


def ancestors(graph: Graph, rel: str = "INHERITS", ordered: bool = False) -> DataFrame:
    """`qn, ancestor, depth`: all ancestors of each class with their least distance; cycles end where they began.

    ordered adds `line`, the places of the bases on the way (`n` of the edges, 0 where it is null; empty if they have no such column), the first of
    least distance: by depth and line the ancestors of a class are in the breadth-first order of their declaration.
    Pairs are made within components (`components`); in components of many edges, or where places count, they are doubled.
    """
    if ordered and "n" in graph.edges.columns:
        return _doubled(graph.rel(rel))
    small, large = split(components(_links(graph, rel)))
    pairs = closed(small, "qn string, ancestor string, depth int", "pairs")
    if large is not None:
        pairs = pairs.unionByName(_doubled(large).drop("line"))
    return pairs.withColumn("line", F.expr("cast(array() as array<int>)")) if ordered else pairs


def _links(graph: Graph, rel: str = "INHERITS") -> DataFrame:
    return graph.rel(rel).where("src <> dst").select("src", "dst")


def _doubled(edges: DataFrame) -> DataFrame:
    """`qn, ancestor, depth, line` of edges: pairs up to 2^k apart come from k rounds, so deep hierarchies take few; the first round without a new pair is the last."""
    placed = "n" in edges.columns
    line = F.array(F.coalesce("n", F.lit(0)).cast("int")) if placed else None
    way = F.struct(F.lit(1).alias("depth"), line.alias("line")) if placed else F.struct(F.lit(1).alias("depth"))
    pairs = cut(edges.where("src <> dst").groupBy(F.col("src").alias("qn"), F.col("dst").alias("ancestor")).agg(F.min(way).alias("way")))
    before, n = 0, pairs.count()
    while n != before:
        upper = pairs.select(F.col("qn").alias("ancestor"), F.col("ancestor").alias("next"), F.col("way").alias("more"))
        both = [(F.col("way.depth") + F.col("more.depth")).alias("depth")] + ([F.concat("way.line", "more.line").alias("line")] if placed else [])
        longer = pairs.join(upper, "ancestor").select("qn", F.col("next").alias("ancestor"), F.struct(*both).alias("way")).where("qn <> ancestor")
        pairs = cut(pairs.unionByName(longer).groupBy("qn", "ancestor").agg(F.min("way").alias("way")))
        before, n = n, pairs.count()
    return pairs.select("qn", "ancestor", "way.*", *([] if placed else [F.expr("cast(array() as array<int>)").alias("line")]))


def _own_methods(graph: Graph) -> DataFrame:
    return graph.rel("DEFINES_METHOD").select(F.col("src").alias("cls"), F.col("dst").alias("found"), F.substring_index("dst", ".", -1).alias("method"))


def _in_components(graph: Graph, schema: str, what: str, by_pairs: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Methods and the hierarchy of their classes closed by component; by_pairs answers from pairs and methods where components are large or places count."""
    own = _own_methods(graph)
    if "n" in graph.edges.columns:
        return by_pairs(_doubled(graph.rel("INHERITS")), own)
    small, large = split(components(_links(graph)))
    own = own.withColumn("h", F.xxhash64("cls"))
    rest = own if large is None else own.join(members(large), "h", "left_anti")
    out = closed(small, schema, what, rest.join(members(small), "h", "left").withColumn("comp", F.coalesce("comp", "h")))
    return out if large is None else out.unionByName(by_pairs(_doubled(large), own.join(members(large), "h", "left_semi")))


def inherited_methods(graph: Graph) -> DataFrame:
    """`qn, method, found, depth`: each method name a class gets, from itself (0) or its nearest ancestor, the one declared first on a tie (the least name if the order isn't known)."""
    def by_pairs(pairs: DataFrame, own: DataFrame) -> DataFrame:
        up = pairs.join(own.withColumnRenamed("cls", "ancestor"), "ancestor").select("qn", "method", "depth", "line", "found")
        every = own.select(F.col("cls").alias("qn"), "method", F.lit(0).alias("depth"), F.expr("cast(array() as array<int>)").alias("line"), "found").unionByName(up)
        return every.groupBy("qn", "method").agg(F.min(F.struct("depth", "line", "found")).alias("v")).select("qn", "method", "v.found", "v.depth")

    return _in_components(graph, "qn string, method string, found string, depth int", "inherited", by_pairs)


def overrides(graph: Graph) -> DataFrame:
    """`src, dst`: each method and the one it overrides, of its class's nearest ancestor that has one of the same name, the one declared first on a tie."""
    def by_pairs(pairs: DataFrame, own: DataFrame) -> DataFrame:
        mine, theirs = own.select("cls", F.col("found").alias("m"), "method"), own.select(F.col("cls").alias("ancestor"), F.col("found").alias("dst"), "method")
        found = mine.join(pairs.withColumnRenamed("qn", "cls"), "cls").join(theirs, ["ancestor", "method"]).groupBy(F.col("m").alias("src")).agg(F.min(F.struct("depth", "line", "dst")).alias("v"))
        return found.select("src", F.col("v.dst").alias("dst"))

    return _in_components(graph, "src string, dst string", "overrides", by_pairs)


def import_distance(caller: Column, candidate: Column) -> Column:
    """How far a candidate's module lies from a caller's, by their dotted names: the longer length less the common prefix, one less below the caller's package."""
    a, b = F.split(caller, r"\."), F.split(candidate, r"\.")
    common = F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, same: F.struct((s["n"] + (s["on"] & same).cast("int")).alias("n"), (s["on"] & same).alias("on")), lambda s: s["n"])
    package = F.array_join(F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - 1)), ".")
    near = candidate.startswith(F.concat(package, F.lit(".")))
    return F.greatest(F.size(a), F.size(b)) - common - near.cast("int")


def nearest_definitions(asked: DataFrame, defs: DataFrame, other: bool = False) -> DataFrame:
    """`key, path, qn, d`: for each asked `key, path` the definition (`key, path, qn`) of that key at the least `import_distance`, the least qn on a tie; with `other` not the asked path itself.

    Definitions are gathered by every prefix of their path and by length, of which each group keeps its least name (or
    two); an asked path meets these groups at its own prefixes. So a name that everything defines makes no pairs.
    """
    def prefixes(df: DataFrame) -> DataFrame:
        parts = F.split("path", r"\.")
        return df.withColumn("size", F.size(parts)).withColumn("c", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn("prefix", F.array_join(F.slice(parts, F.lit(1), F.col("c")), "."))

    groups = prefixes(defs).withColumnRenamed("size", "n")
    by = ["key", "prefix", "c", "n"]
    if other:
        groups = groups.select(*by, "qn").distinct().withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("qn"))).where("place <= 2").drop("place")
    else:
        groups = groups.groupBy(*by).agg(F.min("qn").alias("qn"))
    met = prefixes(asked.select("key", "path").distinct()).join(groups, ["key", "prefix", "c"])
    if other:
        met = met.where("qn <> path")
    near = (F.col("size") >= 2) & (F.col("c") >= F.col("size") - 1) & (F.col("n") >= F.col("size"))
    d = F.greatest("size", "n") - F.col("c") - near.cast("int")
    return met.groupBy("key", "path").agg(F.min(F.struct(d.alias("d"), "qn")).alias("v")).select("key", "path", "v.qn", "v.d")


def best_match(wanted: Column, candidate: Column) -> Column:
    """How many parts of two dotted names are equal, place by place."""
    return F.size(F.filter(F.zip_with(F.split(wanted, r"\."), F.split(candidate, r"\."), lambda x, y: F.coalesce(x == y, F.lit(False))), lambda same: same))
