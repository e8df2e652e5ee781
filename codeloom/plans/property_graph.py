"""A property graph over the test tables, in DataFrames and in SQL.

Regions and nations are folders (nations are packages), customers files, orders classes, line numbers of an order its
methods, parts functions, suppliers external packages. A part is defined in the file of customer 3/4 of its key; it
calls the part of the next line of an order; a class inherits from the previous order of its customer; a file imports
the file of the next customer of its nation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators.graph import Graph
from codeloom.sources.tables import table



def _node(rows: DataFrame, label: str, qn, name, path=None, start=None, end=None, doc=None, decorators=None, package=None) -> DataFrame:
    text, num = (lambda c: F.lit(None).cast("string") if c is None else c), (lambda c: F.lit(None).cast("int") if c is None else c.cast("int"))
    return rows.select(
        F.lit("tpch").alias("project"), F.lit(label).alias("label"), qn.alias("qn"), name.alias("name"), text(path).alias("path"), num(start).alias("start_line"), num(end).alias("end_line"), text(doc).alias("docstring"),
        (F.lit(None).cast("array<string>") if decorators is None else decorators).alias("decorators"), (F.lit(None).cast("boolean") if package is None else F.lit(package)).alias("is_package"),
    )


def _edge(rows: DataFrame, rel: str, src, dst, version=None) -> DataFrame:
    return rows.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"), (F.lit(None).cast("string") if version is None else version).alias("version"))


def tpch_graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: table(spark, sf_dir, name)
    c, dot = F.col, lambda *parts: F.concat_ws(".", *parts)
    regions, nations = t("region"), t("nation").join(t("region"), F.expr("n_regionkey = r_regionkey"))
    region, nation = dot(F.lit("tpch"), c("r_name")), dot(F.lit("tpch"), c("r_name"), c("n_name"))
    geo = t("customer").join(nations, F.expr("c_nationkey = n_nationkey")).withColumn("fqn", dot(nation, F.concat(F.lit("c"), "c_custkey"))).withColumn("fpath", F.concat_ws("/", "r_name", "n_name", F.concat(F.lit("c"), "c_custkey", F.lit(".py"))))
    home = geo.select("c_custkey", "fqn")
    orders = t("orders").join(home, F.expr("o_custkey = c_custkey")).select("o_orderkey", "o_custkey", "o_orderpriority", "fqn", dot("fqn", F.concat(F.lit("o"), "o_orderkey")).alias("cqn"))
    lines = t("lineitem").select("l_orderkey", "l_linenumber").distinct().join(orders.select("o_orderkey", "cqn"), F.expr("l_orderkey = o_orderkey"))
    mqn = dot("cqn", F.concat(F.lit("l"), "l_linenumber"))
    parts = t("part").withColumn("c_custkey", F.expr("p_partkey * 3 div 4")).join(home, "c_custkey")
    part = F.concat(F.lit("tpch.part.p"), "p_partkey")
    suppliers, project = t("supplier"), regions.groupBy().agg(F.lit("tpch").alias("p"))
    supplier = F.concat(F.lit("ext.s"), "s_suppkey")
    nodes = [
        _node(project, "Project", c("p"), c("p"), F.lit("/")), _node(regions, "Folder", region, c("r_name"), c("r_name"), package=False), _node(nations, "Folder", nation, c("n_name"), F.concat_ws("/", "r_name", "n_name"), package=True),
        _node(geo, "File", c("fqn"), c("c_name"), c("fpath")), _node(orders, "Class", c("cqn"), F.concat(F.lit("o"), "o_orderkey"), doc=c("o_orderpriority")),
        _node(lines, "Method", mqn, F.concat(F.lit("l"), "l_linenumber"), start=c("l_linenumber") * 10, end=c("l_linenumber") * 10 + 5), _node(parts, "Function", part, c("p_name"), start=c("p_size"), end=c("p_size") + 9, doc=c("p_type"), decorators=F.array("p_brand", "p_type")),
        _node(suppliers, "ExternalPackage", supplier, c("s_name")),
    ]
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    calls = t("lineitem").select("l_orderkey", c("l_partkey").alias("a"), F.lead("l_partkey").over(order).alias("b")).where("a <> b").select("a", "b").distinct()
    bases = orders.withColumn("base", F.lag("cqn").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("base is not null")
    imports = geo.withColumn("next", F.lead("fqn").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).where("next is not null")
    p = lambda k: F.concat(F.lit("tpch.part.p"), k)
    edges = [
        _edge(regions, "CONTAINS_FOLDER", F.lit("tpch"), region), _edge(nations, "CONTAINS_FOLDER", region, nation), _edge(geo, "CONTAINS_FILE", nation, c("fqn")), _edge(orders, "DEFINES", c("fqn"), c("cqn")), _edge(parts, "DEFINES", c("fqn"), part),
        _edge(lines, "DEFINES_METHOD", c("cqn"), mqn), _edge(calls, "CALLS", p("a"), p("b")), _edge(bases, "INHERITS", c("cqn"), c("base")), _edge(imports, "IMPORTS", c("fqn"), c("next")),
        _edge(t("lineitem").select("l_partkey", "l_suppkey").distinct(), "BINDS_TO", p("l_partkey"), F.concat(F.lit("ext.s"), "l_suppkey")), _edge(suppliers, "DEPENDS_ON_EXTERNAL", F.lit("tpch"), supplier, c("s_nationkey").cast("string")),
    ]
    return Graph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges))


#: The same graph as common table expressions.
SQL = """
geo as (select c_custkey, c_name, c_nationkey, r_name, n_name, 'tpch.' || r_name || '.' || n_name pk, 'tpch.' || r_name || '.' || n_name || '.c' || c_custkey fqn, r_name || '/' || n_name || '/c' || c_custkey || '.py' fpath
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
cls as (select o_orderkey, o_custkey, o_orderpriority, fqn, fqn || '.o' || o_orderkey cqn from orders join geo on o_custkey = c_custkey),
mth as (select cqn, l_linenumber ln, cqn || '.l' || l_linenumber mqn from (select distinct l_orderkey, l_linenumber from lineitem) join cls on l_orderkey = o_orderkey),
fun as (select p.*, fqn, 'tpch.part.p' || p_partkey pqn from part p join geo on c_custkey = p_partkey * 3 // 4),
nodes as (
  select 'tpch' project, 'Project' label, 'tpch' qn, 'tpch' name, '/' path, null::int start_line, null::int end_line, null::varchar docstring, null::varchar[] decorators, null::boolean is_package
  union all select 'tpch', 'Folder', 'tpch.' || r_name, r_name, r_name, null, null, null, null, false from region
  union all select 'tpch', 'Folder', 'tpch.' || r_name || '.' || n_name, n_name, r_name || '/' || n_name, null, null, null, null, true from nation join region on n_regionkey = r_regionkey
  union all select 'tpch', 'File', fqn, c_name, fpath, null, null, null, null, null from geo
  union all select 'tpch', 'Class', cqn, 'o' || o_orderkey, null, null, null, o_orderpriority, null, null from cls
  union all select 'tpch', 'Method', mqn, 'l' || ln, null, ln * 10, ln * 10 + 5, null, null, null from mth
  union all select 'tpch', 'Function', pqn, p_name, null, p_size, p_size + 9, p_type, [p_brand, p_type], null from fun
  union all select 'tpch', 'ExternalPackage', 'ext.s' || s_suppkey, s_name, null, null, null, null, null, null from supplier),
calls as (select distinct 'tpch.part.p' || a src, 'tpch.part.p' || b dst from (select l_partkey a, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) b from lineitem) where a <> b),
edges as (
  select 'tpch' src, 'CONTAINS_FOLDER' rel, 'tpch.' || r_name dst, null::varchar as version from region
  union all select 'tpch.' || r_name, 'CONTAINS_FOLDER', 'tpch.' || r_name || '.' || n_name, null from nation join region on n_regionkey = r_regionkey
  union all select pk, 'CONTAINS_FILE', fqn, null from geo
  union all select fqn, 'DEFINES', cqn, null from cls
  union all select fqn, 'DEFINES', pqn, null from fun
  union all select cqn, 'DEFINES_METHOD', mqn, null from mth
  union all select src, 'CALLS', dst, null from calls
  union all select cqn, 'INHERITS', base, null from (select cqn, lag(cqn) over (partition by o_custkey order by o_orderkey) base from cls) where base is not null
  union all select fqn, 'IMPORTS', nxt, null from (select fqn, lead(fqn) over (partition by c_nationkey order by c_custkey) nxt from geo) where nxt is not null
  union all select distinct 'tpch.part.p' || l_partkey, 'BINDS_TO', 'ext.s' || l_suppkey, null from lineitem
  union all select 'tpch', 'DEPENDS_ON_EXTERNAL', 'ext.s' || s_suppkey, s_nationkey::varchar from supplier)
"""


def busiest(graph: Graph, n: int = 1) -> DataFrame:
    """`qn` of the functions with most callees, the least name first on a tie."""
    return graph.rel("CALLS").groupBy(F.col("src").alias("qn")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "qn").limit(n).select("qn")


#: The same in SQL.
BUSIEST = "select src qn from calls group by 1 order by count(*) desc, src limit {}"
