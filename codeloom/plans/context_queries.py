"""Queries on context, checks and seeds of the graph, and on tables that stand for tool output."""

from __future__ import annotations

import builtins
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators import context as K
from codeloom.operators import diff as D
from codeloom.operators import graph as G
from codeloom.operators import text as X
from codeloom.operators import vector as V
from codeloom.operators.graph import Graph
from codeloom.operators.resolve import call_edges, resolve_calls
from codeloom.plans.property_graph import BUSIEST, busiest, tpch_graph
from codeloom.plans.property_graph import SQL as GRAPH
from codeloom.sources import brace_code, manifests, python_code
from codeloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _graph(name: str, sql: str | None, f: Callable[[Graph], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(tpch_graph(spark, sf_dir))
    if sql:
        SQL[name] = f"with {GRAPH} {sql}"


def _tables(name: str, sql: str | None, f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(lambda t: table(spark, sf_dir, t))
    if sql:
        SQL[name] = sql


_graph("find_folders_exact", "select qn, path from nodes where label = 'Folder' and path = 'ASIA'", lambda g: K.find_folders(g, "ASIA/"))
_graph("find_folders_prefix", "select qn, path from nodes where label = 'Folder' and starts_with(path, 'ASIA/NATIO') order by qn limit 100", lambda g: K.find_folders(g, "ASIA/NATIO"))
_IDS = ("tpch", "ASIA/", "tpch.EUROPE", "tpch.part")
_graph(
    "resolve_identifier", "select 'tpch' asked, 'tpch' qn, 'Project' label union all select 'ASIA/', qn, label from nodes where label = 'Folder' and path = 'ASIA' union all select 'tpch.EUROPE', qn, label from nodes where label = 'Folder' and qn = 'tpch.EUROPE'",
    lambda g: _union([K.resolve_identifier(g, i).select(F.lit(i).alias("asked"), "qn", "label") for i in _IDS]),
)
_graph(
    "get_children_depth", "select 'tpch.ASIA' start, label, depth, count(*) n from (select n.qn, n.label, 1 depth from edges e join nodes n on n.qn = e.dst where e.src = 'tpch.ASIA' and rel like 'CONTAINS%' union all select n.qn, n.label, 2 from edges e join edges f on f.src = e.dst join nodes n on n.qn = f.dst where e.src = 'tpch.ASIA' and e.rel like 'CONTAINS%' and f.rel like 'CONTAINS%') where label in ('Folder', 'File') group by all",
    lambda g: K.children(g, K.resolve_identifier(g, "ASIA"), 2, ("Folder", "File")).groupBy("start", "label", "depth").agg(F.count("*").alias("n")),
)
_graph("enrich_with_relationships", f", top as ({BUSIEST.format(60)}) select src, rel, dst from edges where src in (from top) and dst in (from top)", lambda g: K.enrich(g, busiest(g, 60)))
_graph("find_nodes_list", "select q as query, qn, name, label from nodes join (values ('red'), ('bolt'), ('o77')) v(q) on contains(lower(name), q) where label in ('Function', 'Method', 'Class') qualify row_number() over (partition by q order by qn) <= 50", lambda g: K.find_many(g, ["red", "bolt", "o77"]))
_graph(
    "nodes_with_module_context", ", h as (select src file, dst qn from edges where rel = 'DEFINES' union all select d.src, m.dst from edges m join edges d on d.dst = m.src and d.rel = 'DEFINES' where m.rel = 'DEFINES_METHOD') select file, f.path, count(*) n, string_agg(n.qn, ',' order by n.start_line, n.qn) members from h join nodes n on n.qn = h.qn join nodes f on f.qn = h.file where n.label in ('Function', 'Method') group by all",
    lambda g: K.by_file(g, g.label("Function", "Method")).withColumn("members", F.array_join(F.transform("members", lambda x: x["qn"]), ",")),
)
_graph("global_stats", "select 'node' kind, label name, count(*) n, count(distinct project) n_projects from nodes group by 2 union all select 'edge', rel, count(*), count(distinct split_part(src, '.', 1)) from edges group by 2", K.global_stats)
_graph("post_load_edge_check", "select 'CALLS' rel, count(*) expected, count(*) actual, 0::bigint missing, true ok from calls", lambda g: K.edge_check(g.rel("CALLS"), g))
_graph("edge_check_missing", "select 'CALLS' rel, count(*) expected, count(*) filter (src >= 'tpch.part.p5') actual, count(*) filter (src < 'tpch.part.p5') missing, count(*) filter (src < 'tpch.part.p5') <= count(*) * 0.05 ok from calls", lambda g: K.edge_check(g.rel("CALLS"), Graph(g.nodes, g.edges.where("src >= 'tpch.part.p5'"))))
_graph("binding_edges", "select a.pqn src, b.pqn dst from fun a join fun b on a.p_name = b.p_name and a.pqn <> b.pqn where a.p_size = 1", lambda g: K.binding_edges(g.label("Function").where("start_line = 1").select("qn", F.col("name").alias("simple_name")), g.nodes).select("src", "dst"))
_graph("delete_all", "select count(*) n_before, 0::bigint n_nodes, 0::bigint n_edges from nodes", lambda g: _left(g, G.delete_all(g)))
_graph("delete_files", "select label, count(*) n from nodes where not (label = 'File' and ends_with(path, '/c20.py')) and qn not in (select dst from edges where rel = 'DEFINES' and src in (select fqn from geo where c_custkey = 20)) and qn not in (select mqn from mth where cqn in (select cqn from cls where o_custkey = 20)) group by 1", lambda g: G.delete_files(g, "c20.py", suffix=True).nodes.groupBy("label").agg(F.count("*").alias("n")))
_graph("dependents", "select distinct src qn from edges where rel = 'IMPORTS' and dst in (select fqn from geo where c_custkey % 10 = 0) and src not in (select fqn from geo where c_custkey % 10 = 0)", lambda g: D.dependents(g.rel("IMPORTS"), g.label("File").where(F.substring_index("qn", ".c", -1).cast("bigint") % 10 == 0).select("qn")))


def _left(before: Graph, after: Graph) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(before.nodes, "n_before").crossJoin(one(after.nodes, "n_nodes")).crossJoin(one(after.edges, "n_edges"))  # one row each


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_NAMES = ", ".join(f"('{n}')" for n in sorted(x for x in dir(builtins) if callable(getattr(builtins, x)) and x[:1].islower()))
_tables("builtin_nodes", f"select 'builtins.' || n qn, n as name, 'Function' label from (values {_NAMES}) v(n)", lambda t: K.builtin_nodes(t("region").sparkSession).select("qn", "name", "label"))
_tables(
    "embedding_queue", "with l as (select qualified_name, priority, created_at from embedding_tasks where qualified_name is not null qualify row_number() over (partition by qualified_name order by created_at desc nulls last, task_id desc) = 1) select qualified_name, priority, (row_number() over (order by priority desc nulls last, created_at nulls last, qualified_name) - 1) // 100 as batch from l",
    lambda t: K.queue_batches(t("embedding_tasks"), "qualified_name", "priority", "created_at", 100, "task_id"),
)
# calls of parts by other parts, as if read from files: a part is a function of the module of its brand, and each module imports some names
_CALL_ROWS = """d as (select p_partkey k, 'm.' || p_brand as module, 'm.' || p_brand || '.p' || p_partkey qn from part),
c as (select distinct a, b from (select l_partkey a, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) b from lineitem) where a <> b),
r as (select x.qn caller, y.qn callee, case when (a + b) % 3 = 0 then 'import' when x.module = y.module then 'module' else 'nearest' end way from c join d x on x.k = a join d y on y.k = b)"""


def _call_rows(t: Callable[[str], DataFrame]) -> DataFrame:
    d = t("part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("m."), "p_brand").alias("module")).withColumn("qn", F.concat("module", F.lit(".p"), "k")).withColumn("name", F.concat(F.lit("p"), "k"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    c = t("lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(order).alias("b")).where("a <> b").distinct()
    pairs = c.join(d.select(F.col("k").alias("a"), F.col("module").alias("ma"), F.col("qn").alias("qa")), "a").join(d.select(F.col("k").alias("b"), F.col("qn").alias("qb"), F.col("name").alias("nb")), "b")
    columns = [x.split()[:2] for x in python_code.SCHEMA.split(", ")]

    def rows(df: DataFrame, **given) -> DataFrame:
        return df.select(*((given[n] if n in given else F.lit(None)).cast(kind).alias(n) for n, kind in columns))

    defs = rows(d, module=F.col("module"), kind=F.lit("def"), qn=F.col("qn"), label=F.lit("Function"), name=F.col("name"))
    calls = rows(pairs, module=F.col("ma"), kind=F.lit("call"), qn=F.col("qa"), name=F.when((F.col("a") + F.col("b")) % 3 == 0, F.concat(F.lit("i_"), "nb")).otherwise(F.col("nb")), n=F.lit(1))
    imports = rows(pairs.where("(a + b) % 3 = 0"), module=F.col("ma"), kind=F.lit("import"), name=F.concat(F.lit("i_"), "nb"), target=F.col("qb"), n=F.lit(1)).dropDuplicates(["module", "name", "target"])
    return defs.unionByName(calls).unionByName(imports)


_tables("resolve_calls", f"with {_CALL_ROWS} select caller, callee, way from r", lambda t: resolve_calls(_call_rows(t)).select("caller", "callee", "way"))
_tables("build_calls", f"with {_CALL_ROWS} select distinct caller src, callee dst from r", lambda t: call_edges(resolve_calls(_call_rows(t))).select("src", "dst"))


def _external(t: Callable[[str], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls of suppliers' functions by parts: a part's module imports the supplier's package; every other package is the project's own."""
    l = t("lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    calls = l.select(F.concat(F.lit("m"), F.col("l_partkey") % 7).alias("module"), F.concat(F.lit("m.p"), "l_partkey").alias("qn"), F.concat(F.lit("s"), "l_suppkey", F.lit(".f"), "l_linenumber").alias("name"))
    imports = l.select(F.concat(F.lit("m"), F.col("l_partkey") % 7).alias("module"), F.concat(F.lit("s"), "l_suppkey").alias("name"), F.concat(F.lit("pkg"), "l_suppkey").alias("target")).distinct()
    registry = t("supplier").where("s_suppkey % 2 = 0").crossJoin(F.broadcast(t("region").sparkSession.range(1, 8))).select(F.concat(F.lit("pkg"), "s_suppkey", F.lit(".f"), "id").alias("qn"))  # seven rows
    return calls, imports, registry


_tables("external_stubs", "select 'm.p' || l_partkey src, 'pkg' || l_suppkey || '.f' || l_linenumber dst, count(*) n from lineitem where l_suppkey % 2 = 1 group by all", lambda t: K.external_stubs(*_external(t))[1])
_tables("external_stub_nodes", "select distinct 'pkg' || l_suppkey || '.f' || l_linenumber qn, 'f' || l_linenumber as name, 'pkg' || l_suppkey external_module from lineitem where l_suppkey % 2 = 1", lambda t: K.external_stubs(*_external(t))[0])


def _filtered(t: Callable[[str], DataFrame]) -> DataFrame:
    calls, imports, _ = _external(t)
    calls = calls.unionByName(t("part").select(F.lit("m0").alias("module"), F.concat(F.lit("m.p"), "p_partkey").alias("qn"), F.lit("plain").alias("name")))
    local = t("supplier").where("s_suppkey % 4 = 1").select(F.concat(F.lit("pkg"), "s_suppkey", F.lit(".core")).alias("module"))
    tracked = t("supplier").where("s_suppkey % 4 = 2").select(F.concat(F.lit("pkg"), "s_suppkey").alias("package"))
    return K.kept_calls(calls, imports, local, ["pkg3"], tracked).groupBy("name", "keep").agg(F.count("*").alias("n"))


_tables("local_call_filter", "select 's' || l_suppkey || '.f' || l_linenumber as name, l_suppkey % 4 in (1, 2) as keep, count(*) n from lineitem group by all union all select 'plain', true, count(*) from part", _filtered)
_tables(
    "extract_module_context", None,
    lambda t: t("code_files").where("code is not null").select("file_id", K.module_context(F.col("code")).alias("context")).where("context <> ''"),
)
_LOOKED = ["tpch.part.p5", "part.p6.py", "p8", "tpch.part.p11"]
_graph(
    "node_code_lookup", "select r request, pqn qn, fpath path, p_size start_line, p_size + 9 end_line, array_to_string(list_transform(range(p_size, p_size + 10), lambda i: 'line ' || i), chr(10)) code from fun join geo using (fqn) join (values ('tpch.part.p5', 5), ('part.p6.py', 6), ('tpch.part.p11', 11)) v(r, k) on p_partkey = k",
    lambda g: K.code_lookup(g, g.label("File").select("path", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n").alias("code")), [r for r in _LOOKED if r != "p8"], "tpch"),
)
# texts as tools write them, put together from the tables
_tables(
    "pep508_split", "select p_partkey id, replace(p_name, ' ', '-') as name, '>=' || p_size || '.' || p_partkey % 7 as version from part",
    lambda t: _requirements(t),
)
_tables(
    "blame_parse", """with l as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey)::int as line, o_orderpriority, o_orderdate from orders)
    select o_custkey path, line, lpad(o_orderkey::varchar, 40, '0') sha, o_orderpriority author, strftime(o_orderdate, '%Y-%m-%d') "at" from l""",
    lambda t: _blame(t),
)
_tables(
    "git_diff_changes", "select o_custkey repo, 'src/o' || o_orderkey || '.py' path, case o_orderstatus when 'O' then 'add' when 'F' then 'modify' else 'delete' end as action from orders union all select o_custkey, 'src/new' || o_orderkey || '.py', 'add' from orders where o_orderstatus not in ('O', 'F')",
    lambda t: _name_status(t),
)
_tables(
    "manifest_dependencies", "select p_brand || '/requirements.txt' path, 'dep' || p_partkey as name, '==' || p_size as version, 'main' dependency_group from part where p_partkey % 3 = 0 union all select p_brand || '/package.json', 'dep' || p_partkey, '^' || p_size, 'dev' from part where p_partkey % 3 = 1 union all select p_brand || '/go.mod', 'x.org/dep' || p_partkey, 'v1.' || p_size || '.0', 'main' from part where p_partkey % 3 = 2",
    lambda t: _manifests(t),
)
_tables(
    "relative_import_resolve", "select 'p.a' || s_nationkey || case when s_suppkey % 2 = 0 then '' else '.b' || s_suppkey end || '.n' || s_suppkey target from supplier",
    lambda t: python_code.read(t("supplier").select(F.lit("p").alias("project"), F.concat(F.lit("p/a"), "s_nationkey", F.lit("/b"), "s_suppkey", F.lit("/c.py")).alias("path"), F.concat(F.lit("from "), F.when(F.col("s_suppkey") % 2 == 0, "..").otherwise("."), F.lit(" import n"), "s_suppkey", F.lit("\n")).alias("code"))).where("kind = 'import'").select("target"),
)


def _requirements(t: Callable[[str], DataFrame]) -> DataFrame:
    spec = F.concat(F.regexp_replace("p_name", " ", "-"), F.when(F.col("p_partkey") % 2 == 0, "[extra]").otherwise(""), F.lit(" >="), "p_size", F.lit("."), F.col("p_partkey") % 7, F.when(F.col("p_partkey") % 3 == 0, " ; python_version > '3.8'").otherwise("  # pinned"))
    name, version = X.requirement(F.col("spec"))
    return t("part").select(F.col("p_partkey").alias("id"), spec.alias("spec")).select("id", name.alias("name"), version.alias("version"))


def _texts(rows: DataFrame, key: str, order: str, line: Column) -> DataFrame:
    """`key, text`: lines put together in order, per key."""
    return rows.select(key, F.struct(F.col(order).alias("o"), line.alias("l")).alias("v")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("v")), lambda x: x["l"]), "\n").alias("text"))


def _blame(t: Callable[[str], DataFrame]) -> DataFrame:
    rows = t("orders").withColumn("line", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    sha = F.lpad(F.col("o_orderkey").cast("string"), 40, "0")
    line = F.concat(sha, F.lit(" 1 "), "line", F.lit(" 1\nauthor "), "o_orderpriority", F.lit("\nauthor-time "), F.unix_seconds(F.col("o_orderdate").cast("timestamp")), F.lit("\n\tx = "), "o_custkey")
    return X.blame(_texts(rows, "o_custkey", "o_orderkey", line).withColumnRenamed("o_custkey", "path"), "path", "text")


def _name_status(t: Callable[[str], DataFrame]) -> DataFrame:
    old = F.concat(F.lit("src/o"), "o_orderkey", F.lit(".py"))
    line = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("A\t"), old)).when(F.col("o_orderstatus") == "F", F.concat(F.lit("M\t"), old)).otherwise(F.concat(F.lit("R090\t"), old, F.lit("\tsrc/new"), "o_orderkey", F.lit(".py")))
    return X.name_status(_texts(t("orders"), "o_custkey", "o_orderkey", line).withColumnRenamed("o_custkey", "repo"), "repo", "text")


def _manifests(t: Callable[[str], DataFrame]) -> DataFrame:
    one = lambda k, file, line, head="", tail="": _texts(t("part").where(F.col("p_partkey") % 3 == k), "p_brand", "p_partkey", line).select(F.concat("p_brand", F.lit("/" + file)).alias("path"), F.concat(F.lit(head), "text", F.lit(tail)).alias("text"))
    pins = one(0, "requirements.txt", F.concat(F.lit("dep"), "p_partkey", F.lit("=="), "p_size", F.lit("  # pin")))
    package = one(1, "package.json", F.concat(F.lit('"dep'), "p_partkey", F.lit('": "^'), "p_size", F.lit('",')), '{"devDependencies": {', '"": ""}}')
    go = one(2, "go.mod", F.concat(F.lit("\tx.org/dep"), "p_partkey", F.lit(" v1."), "p_size", F.lit(".0")), "module m\nrequire (\n", "\n)\n")
    return manifests.read(_union([pins, package.withColumn("text", F.regexp_replace("text", ',"": ""', "")), go]))


def _searched(t: Callable[[str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    rows = t("embeddings").select("vec_id", "embedding")
    queries = rows.where("vec_id % 100 = 0")
    return V.Index(rows, "vec_id", "embedding").search(queries, 10, PROBES), V.neighbours(rows, queries, "vec_id", "embedding", 10)


#: The share of lists that a query of the embeddings looks into; they lie in no clusters, so it is large.
PROBES = 0.7
_tables("vector_index_search", None, lambda t: _searched(t)[0])
_tables("vector_index_recall", None, lambda t: V.recall(*_searched(t), "vec_id"))
_tables(
    "dynamic_imports", "select 'p.m' || p_partkey || '.f' qn, 'importlib.import_module' as name, 'pkg' || p_size || '.x' target from part union all select 'p.m' || p_partkey || '.f', 'getattr', 'm.' || 'a' || p_size from part",
    lambda t: python_code.read(t("part").select(F.lit("p").alias("project"), F.concat(F.lit("m"), "p_partkey", F.lit(".py")).alias("path"), F.concat(F.lit("import importlib\ndef f():\n    m = importlib.import_module('pkg"), "p_size", F.lit(".x')\n    return getattr(m, 'a"), "p_size", F.lit("')\n")).alias("code"))).where("kind = 'dynamic'").select("qn", "name", "target"),
)


def _braces(t: Callable[[str], DataFrame]) -> DataFrame:
    return brace_code.read(t("code_files").where("code is not null").dropDuplicates(["repo_name", "file_path"]), "repo_name", "file_path", "code")


_tables("extract_code", None, lambda t: _braces(t).where("kind = 'def'").groupBy("label").agg(F.count("*").alias("n"), F.count("docstring").alias("n_documented")))
_tables("code_imports", None, lambda t: _braces(t).where("kind = 'import'").select("module", "name", "target").distinct())
_tables("code_calls", None, lambda t: _braces(t).where("kind = 'call'").groupBy("qn").agg(F.count("*").alias("n")))
# the functions that stand at a line's start, which in Go are all of them
_tables(
    "extract_go_functions", r"""with f as (select repo_name, file_path, min(code) code from code_files where file_path like '%.go' and code is not null group by all),
    m as (select repo_name, regexp_replace(file_path, '\.go$', '') p, unnest(regexp_extract_all(replace(code, chr(13), ''), '(?m)^func ([A-Za-z_]\w*)\(', 1)) fn from f)
    select distinct case when starts_with(p, repo_name || '/') then replace(p, '/', '.') else repo_name || '.' || replace(p, '/', '.') end || '.' || fn qn from m""",
    lambda t: brace_code.read(t("code_files").where("file_path like '%.go' and code is not null").groupBy("repo_name", "file_path").agg(F.min("code").alias("code")), "repo_name", "file_path", "code").where("kind = 'def' and label = 'Function'").select("qn").distinct(),
)
