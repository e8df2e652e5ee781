"""Queries on the property graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import graph as G
from codeloom.operators import search as S
from codeloom.operators import structure as C
from codeloom.operators import traverse as T
from codeloom.operators.graph import Graph
from codeloom.plans.property_graph import BUSIEST, busiest, tpch_graph
from codeloom.plans.property_graph import SQL as GRAPH

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None, f: Callable[[Graph], DataFrame], recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(tpch_graph(spark, sf_dir))
    if sql:
        SQL[name] = f"with {'recursive ' if recursive else ''}{GRAPH} {sql}"


_LIST = ["part.p1", "tpch.part.p7", "TPCH.part.p9", "AFRICA", "nowhere"]
_WANTED = "'tpch.part.p1', 'tpch.part.p7', 'TPCH.part.p9', 'tpch.AFRICA', 'tpch.nowhere'"
_REQUESTS = ["tpch.part.p5", "part.p6.py", "AFRICA.NATION_0.c20.o1", "p8", "tensor.ring", "red.o1", "Small Ring", "widg", "o77", "zzz"]
_CODE = "label in ('Function', 'Method', 'Class')"

# scans, filters, search
_query("scan_label", "select qn, name from nodes where label = 'Function'", lambda g: g.label("Function").select("qn", "name"))
_query("scan_all", "select label, count(*) n, count(path) n_paths from nodes group by 1", lambda g: g.nodes.groupBy("label").agg(F.count("*").alias("n"), F.count("path").alias("n_paths")))
_query("index_lookup", "select qn, label, name from nodes where qn = 'tpch.part.p7' or path = 'ASIA' or is_package", lambda g: g.nodes.where("qn = 'tpch.part.p7' or path = 'ASIA' or is_package").select("qn", "label", "name"))
_query("label_filter", f"select label, count(*) n from nodes where {_CODE} group by 1", lambda g: g.label(*G.CODE_LABELS).groupBy("label").agg(F.count("*").alias("n")))
_query("project_scope", "select label, count(*) n from nodes where project = 'tpch' and starts_with(qn, 'tpch.') group by 1", lambda g: g.nodes.where((F.col("project") == "tpch") & F.col("qn").startswith("tpch.")).groupBy("label").agg(F.count("*").alias("n")))
_query(
    "search_exact",
    f""", w as (select qn, name, label, path from nodes where qn in ({_WANTED})), d as (select dst qn, src from edges where rel = 'DEFINES' and dst in ({_WANTED})), h as (select d.qn, min(fpath) file_path from d join geo on fqn = d.src group by 1)
    select distinct w.qn, name, label, coalesce(path, file_path) path from w left join h on h.qn = w.qn""",
    lambda g: S.search_exact(g, _LIST, "tpch"),
)
for _name, _q, _strategy, _cond in (
    ("search_contains", "ring", "pattern", "contains(lower(name), 'ring')"),
    ("search_or", "Red|bolt", "pattern", "(contains(lower(name), 'red') or contains(lower(name), 'bolt'))"),
    ("search_and", "BLUE&bolt", "and", "contains(lower(name), 'blue') and contains(lower(name), 'bolt')"),
    ("search_regex", r"(red|blue)\D+[tg]", "regex", r"regexp_full_match(name, '(red|blue)\D+[tg]', 'i')"),
):
    _query(_name, f"select qn, name, label, path from nodes where {_CODE} and {_cond}", lambda g, q=_q, s=_strategy: S.find_nodes(g, q, strategy=s, cap=None))
_query("find_nodes_top", f"select qn, name, label, path from nodes where {_CODE} and contains(lower(name), 'red') and contains(lower(name), 'widget') order by qn limit 50", lambda g: S.find_nodes(g, "red the widget"))
_query("find_nodes_exact", f"select qn, name, label, path from nodes where {_CODE} and qn = 'tpch.part.p3'", lambda g: S.find_nodes(g, "tpch.part.p3", project="tpch"))
_query("decorator_filter", "select qn, decorators[1] brand from nodes where label = 'Function' and len(list_filter(decorators, lambda d: contains(lower(d), 'brand#1'))) > 0", lambda g: g.label("Function").where(S.has_decorator("BRAND#1")).select("qn", F.element_at("decorators", 1).alias("brand")))
_FUZZY = " union all ".join(
    f"""select '{r}' request, qn, name, label, case when qn = '{b}' then 1 when qn = 'tpch.{b}' then 2 when ends_with(qn, '.{'.'.join(p[-2:])}') then 3 {"when " + " and ".join(f"contains(lower(qn), '{x.lower()}')" for x in p) + " then 4" if len(p) > 1 else ""}
    when lower(name) = '{p[-1].lower()}' then 5 when contains(lower(name), '{b.lower()}') then 6 end step from nodes where {_CODE}"""
    for r in _REQUESTS
    for b in [r.removesuffix(".py")]
    for p in [b.split(".")]
)
_PICK = "case when step <= 2 then 'exact' when step = 3 then 'suffix' when step = 4 then 'partial' else 'fuzzy' end quality"
_query("fuzzy_search", f"select request, qn, name, label, {_PICK} from ({_FUZZY}) where step is not null qualify row_number() over (partition by request order by step, qn) = 1", lambda g: S.fuzzy_search(g, _REQUESTS, "tpch"))
_query("fuzzy_search_all", f"select request, qn, name, label, {_PICK} from (select *, min(step) over (partition by request) best from ({_FUZZY}) where step is not null) where step = best qualify row_number() over (partition by request order by qn) <= 50", lambda g: S.fuzzy_search(g, _REQUESTS, "tpch", cap=50))
_query(
    "node_info_batch", f"select request, r.qn, n.start_line, n.end_line, f.path from (select * from ({_FUZZY}) where step is not null qualify row_number() over (partition by request order by step, qn) = 1) r join nodes n using (qn) left join edges e on e.rel = 'DEFINES' and e.dst = qn left join nodes f on f.qn = e.src",
    lambda g: (
        S.fuzzy_search(g, _REQUESTS, "tpch").select("request", "qn").join(g.nodes.select("qn", "start_line", "end_line"), "qn")
        .join(g.rel("DEFINES").select(F.col("dst").alias("qn"), "src"), "qn", "left").join(g.label("File").select(F.col("qn").alias("src"), "path"), "src", "left").select("request", "qn", "start_line", "end_line", "path")
    ),
)
_query(
    "null_strip", "select qn, '{' || array_to_string(list_filter(['\"label\":\"' || label || '\"', '\"path\":\"' || path || '\"', '\"docstring\":\"' || docstring || '\"'], lambda x: x is not null), ',') || '}' as doc from nodes where label <> 'Method'",
    lambda g: g.nodes.where("label <> 'Method'").select("qn", S.compact("label", "path", "docstring").alias("doc")),
)

# patterns
_query("expand_one_hop", "select e.src, e.dst, n.name from edges e join nodes n on n.qn = e.dst where rel = 'DEFINES'", lambda g: G.with_nodes(g, G.expand(g, g.label("File").select("qn"), "DEFINES")).select(F.col("qn").alias("src"), F.col("to").alias("dst"), "name"))
_query("expand_multi_type", "select src, rel, count(*) n from edges where rel in ('CONTAINS_FILE', 'CONTAINS_FOLDER') group by all", lambda g: G.expand(g, g.label("Folder", "Project").select("qn"), "CONTAINS_FILE", "CONTAINS_FOLDER").groupBy(F.col("qn").alias("src"), "rel").agg(F.count("*").alias("n")))
_query("expand_reverse", "select dst qn, count(*) n from edges where rel = 'CALLS' group by 1", lambda g: G.expand(g, g.label("Function").select("qn"), "CALLS", reverse=True).groupBy("qn").agg(F.count("*").alias("n")))
_query(
    "expand_two_hops", "select a.src file, count(*) n from edges a join edges b on b.src = a.dst and b.rel = 'DEFINES_METHOD' where a.rel = 'DEFINES' group by 1",
    lambda g: G.expand(g, G.expand(g, g.label("File").select("qn"), "DEFINES").select(F.col("qn").alias("file"), F.col("to").alias("mid")), "DEFINES_METHOD", key="mid").groupBy("file").agg(F.count("*").alias("n")),
)
_query("expand_optional", "select qn, count(e.dst) n from nodes left join edges e on e.src = qn and e.rel = 'BINDS_TO' where label = 'Function' group by 1", lambda g: G.expand(g, g.label("Function").select("qn"), "BINDS_TO", optional=True).groupBy("qn").agg(F.count("to").alias("n")))
_query("anti_pattern", "select qn from nodes where label = 'Class' and qn not in (select dst from edges where rel = 'INHERITS')", lambda g: G.without(g, g.label("Class"), "INHERITS", reverse=True).select("qn"))
_query("anti_pattern_files", "select qn from nodes where label = 'File' and qn not in (select src from edges where rel = 'IMPORTS')", lambda g: G.without(g, g.label("File"), "IMPORTS").select("qn"))
_query("co_membership", "select a.src file, c.src caller, c.dst callee from calls c join edges a on a.rel = 'DEFINES' and a.dst = c.src join edges b on b.rel = 'DEFINES' and b.dst = c.dst and b.src = a.src", lambda g: (
    g.rel("CALLS").select(F.col("src").alias("caller"), F.col("dst").alias("callee")).join(g.rel("DEFINES").select(F.col("src").alias("file"), F.col("dst").alias("caller")), "caller")
    .join(g.rel("DEFINES").select(F.col("src").alias("file"), F.col("dst").alias("callee")), ["callee", "file"]).select("file", "caller", "callee")
))
_query("non_equi_filter", "select count(*) n from edges a join edges b on a.src = b.dst where a.rel = 'CALLS' and b.rel = 'CALLS' and a.dst = b.src and a.src < a.dst", lambda g: (
    g.rel("CALLS").select("src", "dst").where("src < dst").join(g.rel("CALLS").select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).agg(F.count("*").alias("n"))
))
_TOP100 = f"top as ({BUSIEST.format(100)})"
_query("keyed_unwind", f", {_TOP100} select qn, name, start_line from top join nodes using (qn)", lambda g: busiest(g, 100).join(g.nodes.select("qn", "name", "start_line"), "qn"))
_query("map_relationships", f", {_TOP100} select src, rel, dst from edges where src in (from top) and dst in (from top) and rel in ('CALLS', 'BINDS_TO')", lambda g: G.between(g, busiest(g, 100), "CALLS", "BINDS_TO").select("src", "rel", "dst"))
_query(
    "relationship_text", f", {_TOP100} select n.name || '.' || src || ' : [' || string_agg(dst, ', ' order by dst) || ']' as line from calls join nodes n on n.qn = src where src in (from top) and dst in (from top) group by src, n.name",
    lambda g: G.between(g, busiest(g, 100), "CALLS").groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), ", ").alias("d")).join(g.nodes.select(F.col("qn").alias("src"), "name"), "src").select(F.concat("name", F.lit("."), "src", F.lit(" : ["), "d", F.lit("]")).alias("line")),
)
_query("entry_points", "select src qn from edges where rel = 'IMPORTS' except select dst from edges where rel = 'IMPORTS'", lambda g: G.entry_points(g, g.label("File"), "IMPORTS"))
_query("incident_edges", f", top as ({BUSIEST.format(5)}) select src qn, 'out' direction, rel, dst other from edges where src in (from top) union all select dst, 'in', rel, src from edges where dst in (from top)", lambda g: G.incident(g, busiest(g, 5)))
_query("find_by_property", "select qn, label from nodes where docstring = '1-URGENT' or docstring = 'ECONOMY'", lambda g: g.nodes.where(F.col("docstring").isin("1-URGENT", "ECONOMY")).select("qn", "label"))
_query("graph_summary", "select 'node' kind, label name, count(*) n from nodes group by 2 union all select 'edge', rel, count(*) from edges group by 2", lambda g: g.nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n")).unionByName(g.edges.groupBy(F.lit("edge").alias("kind"), F.col("rel").alias("name")).agg(F.count("*").alias("n"))))

# traversals
_STEPS = """, top as ({start}), lv as (
  select qn start, qn, 0 depth from top union
  select lv.start, e.{far}, lv.depth + 1 from lv join calls e on e.{near} = lv.qn where lv.depth < {depth})"""
_query("find_calls_out", _STEPS.format(start=BUSIEST.format(1), near="src", far="dst", depth=5) + " select start, qn, min(depth)::int depth from lv where depth > 0 group by 1, 2", lambda g: T.reachable(g, busiest(g), "CALLS", depth=5), True)
_query("find_calls_in", _STEPS.format(start=BUSIEST.format(2), near="dst", far="src", depth=2) + " select start, qn, min(depth)::int depth from lv where depth > 0 group by 1, 2", lambda g: T.reachable(g, busiest(g, 2), "CALLS", depth=2, reverse=True), True)
_query("trace_reachable", _STEPS.format(start=BUSIEST.format(1), near="src", far="dst", depth=4) + " select distinct start, qn, depth::int depth from lv where depth > 0", lambda g: T.walks(g, busiest(g), "CALLS", depth=4), True)
_query(
    "trails", f", top as ({BUSIEST.format(1)}) select t.qn start, t.qn || '>' || a.dst as path, 1 depth from top t join calls a on a.src = t.qn union all select t.qn, t.qn || '>' || a.dst || '>' || b.dst, 2 from top t join calls a on a.src = t.qn join calls b on b.src = a.dst",
    lambda g: T.trails(g, busiest(g), "CALLS", depth=2).select("start", F.array_join("path", ">").alias("path"), "depth"),
)
_query(
    "trace_path", f""", ends as (select a.qn src, b.qn dst from (select qn from ({BUSIEST.format(1)})) a, (select max(qn) qn from nodes where label = 'Function') b),
    h as (select src, src qn, src p, 0 d from ends union all select src, dst, min(p) p, d + 1 from (select h.src, c.dst, h.p || '>' || c.dst p, h.d from h join calls c on c.src = h.qn where h.d < 3) group by src, dst, d)
    select src, dst, d::int depth, p path from (select h.src, h.qn dst, h.d, h.p from h join ends e on e.src = h.src and e.dst = h.qn where d > 0 qualify row_number() over (partition by h.src, h.qn order by d, p) = 1)""",
    lambda g: T.shortest_path(g, busiest(g).select(F.col("qn").alias("src")).join(F.broadcast(g.label("Function").agg(F.max("qn").alias("dst")))), "CALLS", depth=3), True,
)
_query(
    "detect_cycles", f", top as ({BUSIEST.format(1)}), e as (select * from calls where src <> dst) select t.qn start, t.qn || '>' || a.dst || '>' || t.qn as path, 2 depth from top t join e a on a.src = t.qn join e b on b.src = a.dst and b.dst = t.qn union all select t.qn, t.qn || '>' || a.dst || '>' || b.dst || '>' || t.qn, 3 from top t join e a on a.src = t.qn join e b on b.src = a.dst and b.dst <> t.qn join e c on c.src = b.dst and c.dst = t.qn",
    lambda g: T.cycles(g, busiest(g), "CALLS", depth=3).select("start", F.array_join("path", ">").alias("path"), "depth"),
)
_query(
    "dependency_tree", f""", top as ({BUSIEST.format(1)}), k as (select src, dst from calls qualify row_number() over (partition by src order by dst) <= 50),
    l1 as (select t.qn start, t.qn parent, k.dst qn, k.dst = t.qn circular from top t join k on k.src = t.qn),
    l2 as (select l1.start, l1.qn parent, k.dst qn, (k.dst = l1.start or k.dst in (select qn from l1) or row_number() over (partition by k.dst order by l1.qn) > 1) circular from l1 join k on k.src = l1.qn where not l1.circular)
    select start, parent, qn, 1 depth, circular from l1 union all select start, parent, qn, 2, circular from l2""",
    lambda g: T.dependency_tree(g, busiest(g), "CALLS", depth=2),
)
_query("containment_descend", "select qn, label, (len(string_split(qn, '.')) - 2)::int depth from nodes where label in ('Folder', 'File') and starts_with(qn, 'tpch.ASIA.')", lambda g: T.containment(g, "tpch.ASIA"))
_query("zero_or_more", "select qn package, qn from nodes where is_package union all select src, dst from edges join nodes on qn = src and is_package where rel in ('CONTAINS_FILE', 'CONTAINS_FOLDER')", lambda g: T.ancestor_packages(g))
_query("bounded_mixed", "select src qn, dst, 1 hops from edges where rel = 'DEFINES' union all select a.src, b.dst, 2 from edges a join edges b on b.src = a.dst and b.rel = 'DEFINES_METHOD' where a.rel = 'DEFINES'", lambda g: C.file_symbols(g).select(F.col("file").alias("qn"), F.col("qn").alias("dst"), F.col("depth").alias("hops")))

# structure and context
_query("get_children", "select e.src qn, n.label, count(*) n from edges e join nodes n on n.qn = e.dst where rel in ('CONTAINS_FOLDER', 'CONTAINS_FILE', 'DEFINES', 'DEFINES_METHOD') group by all", C.children_by_label)
_query(
    "folder_children", """, k as (select n.*, (select count(*) from edges x where x.src = n.qn and x.rel in ('CONTAINS_FOLDER', 'CONTAINS_FILE', 'DEFINES')) child_count from edges e join nodes n on n.qn = e.dst where e.src = 'tpch.EUROPE' and e.rel in ('CONTAINS_FOLDER', 'CONTAINS_FILE'))
    select row_number() over (order by case when label = 'Folder' then 0 else 1 end, lower(name), qn)::int as position, qn, name, label, child_count from k""", lambda g: C.folder_children(g, "tpch.EUROPE"),
)
_query("file_children", "select a.src file, n.label, count(*) n from edges a join nodes n on n.qn = a.dst where a.rel = 'DEFINES' group by all union all select a.src, 'Method', count(*) from edges a join edges b on b.src = a.dst and b.rel = 'DEFINES_METHOD' where a.rel = 'DEFINES' group by 1", lambda g: C.file_symbols(g).groupBy("file", "label").agg(F.count("*").alias("n")))
_query("class_children", "select cqn qn, count(*) n_methods, string_agg('l' || ln, ',' order by ln * 10, 'l' || ln) methods from mth group by 1", C.class_methods)
_query("project_structure", "select project, count(*) filter (label = 'Folder' and is_package) n_packages, count(*) filter (label = 'Folder' and not is_package) n_folders, count(*) filter (label = 'File') n_files, 'package' as structure from nodes group by 1", C.project_info)
_query(
    "module_info", "select f.qn, count(distinct e.dst) filter (starts_with(e.dst, 'tpch.part.')) n_functions, count(distinct e.dst) filter (not starts_with(e.dst, 'tpch.part.')) n_classes, count(m.dst) n_methods from nodes f left join edges e on e.src = f.qn and e.rel = 'DEFINES' left join edges m on m.src = e.dst and m.rel = 'DEFINES_METHOD' where f.label = 'File' group by 1",
    C.module_counts,
)
_query(
    "package_tree", ", d as (select src, dst from edges where rel = 'DEFINES'), s as (select g.fqn, g.pk, (select count(*) from d where src = g.fqn) + (select count(*) from d join edges m on m.src = d.dst and m.rel = 'DEFINES_METHOD' where d.src = g.fqn) n from geo g) select pk package, count(*) n_modules, sum(n)::bigint n_nodes from s group by 1",
    C.package_tree,
)
_CALLERS = "i as (select dst qn, count(distinct src) n_callers, array_to_string(list_slice(list_sort(list(src)), 1, 30), ',') callers from calls group by 1), o as (select src qn, count(distinct dst) n_callees, array_to_string(list_slice(list_sort(list(dst)), 1, 30), ',') callees from calls group by 1)"
_query("function_call_context", f", {_CALLERS} select qn, coalesce(n_callers, 0) n_callers, coalesce(n_callees, 0) n_callees, coalesce(callers, '') callers, coalesce(callees, '') callees from nodes left join i using (qn) left join o using (qn) where label in ('Function', 'Method')", C.call_context)
_query(
    "class_hierarchy", ", h as (select * from edges where rel = 'INHERITS') select n.qn, coalesce((select string_agg(dst, ',' order by dst) from h where src = n.qn), '') bases, coalesce((select string_agg(src, ',' order by src) from h where dst = n.qn), '') subclasses, (select count(*) from edges m where m.src = n.qn and m.rel = 'DEFINES_METHOD') n_methods from nodes n where label = 'Class'",
    C.class_hierarchy,
)
_CALLS = ", mc as (select a.src src_file, b.src dst_file, count(*) n_calls from calls c join edges a on a.rel = 'DEFINES' and a.dst = c.src join edges b on b.rel = 'DEFINES' and b.dst = c.dst group by 1, 2)"
_query("module_calls", _CALLS + " select * from mc", C.module_calls)
_query(
    "module_call_graph", _CALLS + """, f as (select min(fqn) v from geo) select 'internal' direction, dst_file other, n_calls from mc, f where src_file = v and dst_file = v
    union all (select 'outgoing', dst_file, n_calls from mc, f where src_file = v and dst_file <> v order by n_calls desc, dst_file limit 30) union all (select 'incoming', src_file, n_calls from mc, f where dst_file = v and src_file <> v order by n_calls desc, src_file limit 30)""",
    lambda g: C.module_call_graph(g, g.label("File").agg(F.min("qn")).first()[0]),
)
_query("package_call_graph", _CALLS + ", p as (select regexp_replace(src_file, '\\.[^.]*$', '') s, regexp_replace(dst_file, '\\.[^.]*$', '') d, n_calls from mc) select s src_package, d dst_package, sum(n_calls)::bigint n_calls from p where s <> d group by all", C.package_call_graph)
_KEY = f", {_CALLERS}, k as (select pqn qn, coalesce(n_callers, 0) n_callers, coalesce(n_callees, 0) n_callees, round(coalesce(n_callers, 0) * 0.6::double + coalesce(n_callees, 0) * 0.4::double, 6) score from fun left join i on i.qn = pqn left join o on o.qn = pqn)"
_query("key_functions", _KEY + " select * from k order by score desc, qn limit 20", C.key_functions)
_query("key_functions_all", _KEY + " select * from k", lambda g: C.key_functions(g, None))
_query("find_module_imports", "select src, dst from edges join nodes on qn = src where rel = 'IMPORTS' and (contains(path, 'NATION_1/') or contains(qn, 'NATION_1/'))", lambda g: C.imports_of(g, "NATION_1/", None))
_query("imported_by", "select dst qn, src importer from edges where rel = 'IMPORTS'", lambda g: G.expand(g, g.label("File").select("qn"), "IMPORTS", reverse=True).select("qn", F.col("to").alias("importer")))
_query("external_dependencies", "select 'tpch' project, s_name package, s_nationkey::varchar as version from supplier", C.external_dependencies)
_query("project_stats", "select project, 'node' kind, label name, count(*) n from nodes group by all union all select split_part(src, '.', 1), 'edge', rel, count(*) from edges group by all", C.project_stats)
_query(
    "explore_code_context", """, v as (select 'tpch.part.p1' qn), h as (select src from edges where rel = 'DEFINES' and dst = 'tpch.part.p1')
    select 'file' part, src as value from h union all (select distinct 'caller', src from calls, v where dst = qn order by 2 limit 30) union all (select distinct 'callee', dst from calls, v where src = qn order by 2 limit 30)
    union all select 'import', dst from edges where rel = 'IMPORTS' and src in (from h) union all select 'imported_by', src from edges where rel = 'IMPORTS' and dst in (from h)""", lambda g: C.code_context(g, "tpch.part.p1"),
)
_UP = ", anc as (select src qn, dst ancestor, 1 depth from edges where rel = 'INHERITS' union all select a.qn, e.dst, a.depth + 1 from anc a join edges e on e.rel = 'INHERITS' and e.src = a.ancestor)"
_query("ancestors", _UP + " select qn, ancestor, depth::int depth from anc", C.ancestors, True)
_query(
    "inherited_methods", _UP + ", own as (select cqn qn, 'l' || ln method, mqn found, 0 depth from mth), every as (select * from own union all select a.qn, o.method, o.found, a.depth from anc a join own o on o.qn = a.ancestor) select qn, method, found, depth::int depth from every qualify row_number() over (partition by qn, method order by depth, found) = 1",
    C.inherited_methods, True,
)
_query("overrides", _UP + " select m.mqn src, o.mqn dst from mth m join anc a on a.qn = m.cqn join mth o on o.cqn = a.ancestor and o.ln = m.ln qualify row_number() over (partition by m.mqn order by a.depth, o.mqn) = 1", C.overrides, True)
_DIST = "greatest(len(a), len(b)) - coalesce(list_position(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] is not distinct from b[i]), false) - 1, len(a)) - (starts_with(d, array_to_string(a[:len(a) - 1], '.') || '.'))::int"
_query(
    "import_distance", f", e as (select x.src s, y.src d, string_split(x.src, '.') a, string_split(y.src, '.') b from calls c join edges x on x.rel = 'DEFINES' and x.dst = c.src join edges y on y.rel = 'DEFINES' and y.dst = c.dst) select ({_DIST})::int distance, count(*) n from e group by 1",
    lambda g: C.module_calls(g).select(C.import_distance(F.col("src_file"), F.col("dst_file")).alias("distance"), "n_calls").groupBy("distance").agg(F.sum("n_calls").alias("n")),
)
_query("best_match", "select dst qn, (len(list_filter(list_zip(string_split(src, '.'), string_split(dst, '.')), lambda x: x[1] = x[2])))::int score from edges where rel = 'IMPORTS'", lambda g: g.rel("IMPORTS").select(F.col("dst").alias("qn"), C.best_match(F.col("src"), F.col("dst")).alias("score")))

# changes of the stored graph


def _two_projects(g: Graph) -> Graph:
    """The graph and a copy of its project beside it."""
    copy = G.copy_project(g, "tpch", "copy")
    return Graph(g.nodes.unionByName(copy.nodes), g.edges.unionByName(copy.edges))


_query("delete_prefix", "select label, count(*) n from nodes where not (qn = 'tpch.ASIA' or starts_with(qn, 'tpch.ASIA.')) group by 1", lambda g: G.delete_prefix(g, "tpch.ASIA").nodes.groupBy("label").agg(F.count("*").alias("n")))
_query("delete_prefix_edges", "select rel, count(*) n from edges where not (src = 'tpch.ASIA' or starts_with(src, 'tpch.ASIA.') or dst = 'tpch.ASIA' or starts_with(dst, 'tpch.ASIA.')) group by 1", lambda g: G.delete_prefix(g, "tpch.ASIA").edges.groupBy("rel").agg(F.count("*").alias("n")))
_query(
    "delete_project", "select 'copy' || substr(qn, 5) qn from nodes where qn = 'tpch' or starts_with(qn, 'tpch.')",
    lambda g: G.delete_project(_two_projects(g), "tpch").nodes.select("qn"),
)
_query("copy_project", "select project, replace(qn, 'tpch', 'copy') qn from (select 'copy' project, qn from nodes where (qn = 'tpch' or starts_with(qn, 'tpch.')) and label in ('Project', 'Folder', 'File'))", lambda g: G.copy_project(g, "tpch", "copy").nodes.where(F.col("label").isin("Project", "Folder", "File")).select("project", "qn"))
_query("edge_upsert", "select rel, count(*) n from edges where (src in (select qn from nodes)) and dst in (select qn from nodes) group by 1", lambda g: G.upsert_edges(g.edges.unionByName(g.edges), g.nodes).groupBy("rel").agg(F.count("*").alias("n")))
_query("set_property", "select qn, case when is_package then 'package ' || name else docstring end docstring from nodes where label in ('Folder', 'Function')", lambda g: G.set_values(g.label("Folder", "Function"), "qn", g.label("Folder").where("is_package").select("qn", F.concat(F.lit("package "), "name").alias("docstring")), "docstring").select("qn", "docstring"))
