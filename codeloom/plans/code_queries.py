"""Queries over the code tables: listings, snapshots, upserts, snippets, extracted definitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import diff as D
from codeloom.operators import files as L
from codeloom.operators import text as X
from codeloom.operators.graph import set_values, upsert_nodes
from codeloom.operators.resolve import outside_standard, resolve_calls
from codeloom.operators.search import as_list
from codeloom.operators.structure import nearest_definitions
from codeloom.sources import python_code
from codeloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None, f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(lambda t: table(spark, sf_dir, t))
    if sql:
        SQL[name] = sql


#: The moment between two snapshots.
_T = "2026-01-01"
_RULES = ["# generated", "vendor/", "*.min.js", "!public/*.min.js", "/dist", "src/**/m0*", "data/?*/", "lib/[bc]*"]
_IGNORED = ", ".join(f"'{x}'" for x in L.IGNORED)
_RULE_SQL = " ".join(f"when regexp_matches(file_path, '{p}') then {str(not back).lower()}" for p, back in reversed([r for r in map(L.rule_pattern, _RULES) if r]))
_FILES = "files as (select distinct repo_name, file_path from code_files)"

_query(
    "scan_repo_files", f"select repo_name, file_path from (select distinct repo_name, file_path, string_split(file_path, '/') p from code_files) where not list_has_any(p[:len(p) - 1], [{_IGNORED}]) and len(list_filter(p[:len(p) - 1], lambda x: ends_with(x, '.egg-info') or ends_with(x, '.dist-info'))) = 0",
    lambda t: t("code_files").where(~L.is_ignored(F.col("file_path"))).select("repo_name", "file_path").distinct(),
)
_query("gitignore_filter", f"select distinct repo_name, file_path from code_files where not case {_RULE_SQL} else false end", lambda t: t("code_files").where(~L.ignored_by(F.col("file_path"), _RULES)).select("repo_name", "file_path").distinct())
_EXT = "case lower(regexp_extract(file_path, '\\.([A-Za-z0-9_]+)$', 1)) " + " ".join(f"when '{e}' then '{n}'" for n, es in L.LANGUAGES.items() for e in es.split()) + " end"
_query("detect_language", f"select {_EXT} as language, count(*) n from code_files group by 1", lambda t: t("code_files").groupBy(L.language(F.col("file_path")).alias("language")).agg(F.count("*").alias("n")))
_query("size_cap_filter", f"select file_id, strlen(code) n_bytes from code_files where strlen(code) <= {L.SIZE_CAP}", lambda t: t("code_files").where(F.octet_length("code") <= L.SIZE_CAP).select("file_id", F.octet_length("code").cast("bigint").alias("n_bytes")))
_IND = ", ".join(f"'{x}'" for x in L.INDICATORS)
_query(
    "build_folders", f"with {_FILES}, p as (select repo_name, string_split(file_path, '/') p from files), l as (select repo_name, p, unnest(range(1, len(p))) k from p), o as (select repo_name, array_to_string(p[:k], '/') path, max((k = len(p) - 1 and p[len(p)] in ({_IND}))::int) = 1 is_package from l group by 1, 2) select repo_name project, repo_name || '.' || replace(path, '/', '.') qn, regexp_extract(path, '[^/]*$') as name, path, is_package from o",
    lambda t: L.folders(t("code_files"), "repo_name", "file_path"),
)
_query(
    "build_files", f"with {_FILES} select repo_name project, repo_name || '.' || replace(regexp_replace(file_path, '\\.[^./]*$', ''), '/', '.') qn, regexp_extract(file_path, '[^/]*$') as name, lower(regexp_extract(file_path, '\\.([A-Za-z0-9_]+)$', 1)) as extension, file_path path, case when contains(file_path, '/') then repo_name || '.' || replace(regexp_extract(file_path, '^(.*)/[^/]*$', 1), '/', '.') else repo_name end parent from files",
    lambda t: L.files_with_parents(t("code_files"), "repo_name", "file_path"),
)
_query(
    "list_folder_structure", f"""with {_FILES}, p as (select repo_name, string_split(file_path, '/') p from files), l as (select repo_name, p, unnest(range(1, least(3, len(p)) + 1)) k from p),
    o as (select distinct repo_name project, array_to_string(p[:k - 1], '/') parent, p[k] as name, k < len(p) is_folder from l), r as (select *, row_number() over (partition by project, parent order by is_folder desc, lower(name), name) as position from o)
    select project, parent, name, is_folder, position::int as position from r where position <= 20 union all select project, parent, count(*) || ' more', false, 21 from r where position > 20 group by 1, 2""",
    lambda t: L.listing(t("code_files"), "repo_name", "file_path"),
)
_query("signature_hash", "select context_id, sha256(code_snippet) digest from code_contexts where code_snippet is not null", lambda t: t("code_contexts").where("code_snippet is not null").select("context_id", F.sha2("code_snippet", 256).alias("digest")))
_LATEST = "(select * from code_contexts where qualified_name is not null qualify row_number() over (partition by qualified_name order by indexed_at desc nulls last, context_id desc) = 1)"
_query("node_upsert", f"select qualified_name, context_id, lower(trim(element_type)) label, start_line, end_line from {_LATEST}", lambda t: upsert_nodes(t("code_contexts").select("qualified_name", "context_id", F.lower(F.trim("element_type")).alias("label"), "start_line", "end_line", "indexed_at"), "qualified_name", F.col("indexed_at"), F.col("context_id")).drop("indexed_at"))


def _definitions(rows: DataFrame) -> DataFrame:
    return upsert_nodes(rows.select("qualified_name", F.sha2("code_snippet", 256).alias("digest"), "indexed_at", "context_id"), "qualified_name", F.col("indexed_at"), F.col("context_id"))


_query(
    "definition_diff", f"""with a as (select qualified_name, sha256(code_snippet) d from code_contexts where qualified_name is not null and indexed_at < timestamp '{_T}' qualify row_number() over (partition by qualified_name order by indexed_at desc, context_id desc) = 1),
    b as (select qualified_name, sha256(code_snippet) d from {_LATEST}) select qualified_name, case when a.qualified_name is null then 'added' when b.qualified_name is null then 'removed' else 'modified' end change from a full join b using (qualified_name) where a.qualified_name is null or b.qualified_name is null or a.d is distinct from b.d""",
    lambda t: D.snapshot_diff(_definitions(t("code_contexts").where(F.col("indexed_at") < F.lit(_T).cast("timestamp_ntz"))), _definitions(t("code_contexts")), "qualified_name", digest="digest"),
)
_STATE = "(select repo_name, file_path, max(content_hash) h from code_files where last_modified {} timestamp '" + _T + "' group by 1, 2)"
_query(
    "file_state_diff", f"select repo_name, file_path, case when a.h is null and a.k is null then 'added' when b.k is null then 'removed' else 'modified' end change from (select *, 1 k from {_STATE.format('<')}) a full join (select *, 1 k from {_STATE.format('>=')}) b using (repo_name, file_path) where a.k is null or b.k is null or a.h is distinct from b.h",
    lambda t: D.snapshot_diff(*(t("code_files").where(c).groupBy("repo_name", "file_path").agg(F.max("content_hash").alias("h")) for c in (f"last_modified < timestamp_ntz'{_T}'", f"last_modified >= timestamp_ntz'{_T}'")), "repo_name", "file_path", digest="h"),
)
_LINES = "case when code is null or code = '' then cast([] as varchar[]) else string_split(regexp_replace(replace(code, chr(13) || chr(10), chr(10)), '\\n\\z', ''), chr(10)) end"
_query(
    "code_snippet", f"select task_id, md5(array_to_string(l[start_line:least(end_line, len(l))], chr(10))) digest from (select task_id, start_line, end_line, {_LINES} l from embedding_tasks join (select repo_name, file_path, any_value(code) code from code_files where code is not null group by 1, 2) using (repo_name, file_path)) where start_line >= 1 and end_line >= start_line",
    lambda t: t("embedding_tasks").where("start_line >= 1 and end_line >= start_line").join(t("code_files").where("code is not null").groupBy("repo_name", "file_path").agg(F.first("code").alias("code")), ["repo_name", "file_path"]).select("task_id", F.md5(X.snippet(F.col("code"), F.col("start_line"), F.col("end_line"))).alias("digest")),
)
_query("embedding_candidates", "select element_type, count(*) n from (select lower(trim(element_type)) element_type from code_contexts) where element_type in ('function', 'method') group by 1", lambda t: t("code_contexts").select(F.lower(F.trim("element_type")).alias("element_type")).where(F.col("element_type").isin("function", "method")).groupBy("element_type").agg(F.count("*").alias("n")))
_query(
    "list_normalise", "select context_id, array_to_string(case when d is null or trim(d) = '' then [] when starts_with(d, '[') then json_extract_string(d, '$[*]') else [d] end, '|') as items from (select context_id, case when context_id % 2 = 0 then to_json(parameters)::varchar when len(parameters) > 0 then parameters[1] end d from code_contexts)",
    lambda t: t("code_contexts").select("context_id", F.when(F.col("context_id") % 2 == 0, F.to_json("parameters")).when(F.size("parameters") > 0, F.get("parameters", F.lit(0))).alias("d")).select("context_id", F.array_join(as_list(F.col("d")), "|").alias("items")),
)
_IMPORT = r"(?m)^import\s[^;]*?from\s+['\"](\.[^'\"]*)['\"]"
_JS = f"""f as (select distinct repo_name, file_path, code from code_files where regexp_matches(file_path, '\\.(js|ts)$') and code is not null), i as (select repo_name, file_path, unnest(regexp_extract_all(code, '{_IMPORT.replace("'", "''")}', 1)) target from f)"""


def _js_imports(t: Callable[[str], DataFrame]) -> DataFrame:
    """`repo_name, file_path, module`: relative imports of JavaScript and TypeScript files, as paths without extension."""
    f = t("code_files").where(F.col("file_path").rlike(r"\.(js|ts)$")).select("repo_name", "file_path", "code").distinct()
    rows = f.select("repo_name", "file_path", F.explode(F.regexp_extract_all("code", F.lit(_IMPORT), F.lit(1))).alias("target")).distinct()
    folder = F.regexp_extract("file_path", r"^(.*/)?[^/]*$", 1)
    return rows.select("repo_name", "file_path", F.concat(folder, F.regexp_replace("target", r"^\./", "")).alias("module"))


_query("parse_imports", f"with {_JS} select distinct repo_name, file_path, regexp_extract(file_path, '^(.*/)?[^/]*$', 1) || regexp_replace(target, '^\\./', '') as module from i", _js_imports)
_query(
    "import_to_module", f"with {_JS}, m as (select distinct repo_name, file_path, regexp_extract(file_path, '^(.*/)?[^/]*$', 1) || regexp_replace(target, '^\\./', '') as module from i) select distinct m.repo_name, m.file_path, c.file_path target from m join code_files c on c.repo_name = m.repo_name and regexp_replace(c.file_path, '\\.[^./]*$', '') = m.module",
    lambda t: _js_imports(t).join(t("code_files").select("repo_name", F.col("file_path").alias("target"), F.regexp_replace("file_path", r"\.[^./]*$", "").alias("module")).distinct(), ["repo_name", "module"]).select("repo_name", "file_path", "target"),
)
_query(
    "resolve_nearest", f"""with d as (select distinct repo_name, qualified_name qn, regexp_extract(qualified_name, '[^.]*$') as name from {_LATEST} where lower(trim(element_type)) in ('function', 'method')),
    e as (select a.qn asked, b.qn found, string_split(a.qn, '.') a, string_split(b.qn, '.') b from d a join d b on a.name = b.name and a.repo_name = b.repo_name and a.qn <> b.qn)
    select asked, found from (select asked, found, greatest(len(a), len(b)) - coalesce(list_position(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] is not distinct from b[i]), false) - 1, len(a)) - (starts_with(found, array_to_string(a[:len(a) - 1], '.') || '.'))::int d from e) qualify row_number() over (partition by asked order by d, found) = 1""",
    lambda t: _nearest(t),
)


def _nearest(t: Callable[[str], DataFrame]) -> DataFrame:
    """For each function the nearest other one of its repository and simple name."""
    d = upsert_nodes(t("code_contexts").select("qualified_name", "repo_name", F.lower(F.trim("element_type")).alias("kind"), "indexed_at", "context_id"), "qualified_name", F.col("indexed_at"), F.col("context_id")).where("kind in ('function', 'method')")
    d = d.select(F.concat_ws("\x1f", "repo_name", F.substring_index("qualified_name", ".", -1)).alias("key"), F.col("qualified_name").alias("path"), F.col("qualified_name").alias("qn"))
    return nearest_definitions(d, d, other=True).select(F.col("path").alias("asked"), F.col("qn").alias("found"))


_query("manifest_parse", "select file_id, json_extract_string(code, '$.name') as name, json_extract_string(code, '$.version') as version from code_files where ends_with(file_path, '.json') and json_valid(code) and not regexp_matches(code, ',\\s*[}\\]]') and json_extract_string(code, '$.name') is not null", lambda t: (
    t("code_files").where(F.col("file_path").endswith(".json")).select("file_id", F.from_json("code", "name string, version string, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("j")).where("j._bad is null and j.name is not null").select("file_id", "j.name", "j.version")
))


def _python(t: Callable[[str], DataFrame]) -> DataFrame:
    files = t("code_files").where("code is not null").dropDuplicates(["repo_name", "file_path"])
    return python_code.read(files, "repo_name", "file_path", "code")


_query("extract_definitions", None, lambda t: _python(t).where("kind = 'def'").select("qn", "label", "start_line", "end_line", "docstring", F.array_join("decorators", ",").alias("decorators"), "digest"))
_query("extract_variables", None, lambda t: _python(t).where("kind = 'var'").select("qn", "start_line", "end_line", "digest"))
_query("python_imports", None, lambda t: outside_standard(_python(t).where("kind = 'import'")).select("module", "name", "target").distinct())
#: A small package: re-exports, inheritance, typed variables, nested functions.
_REPO = [
    ("app/__init__.py", "from .core import Engine\nfrom .tools import *\n"),
    ("app/core.py", "import os\nfrom app.tools import clean\n\nclass Base:\n    def start(self):\n        self.check()\n\n    def check(self):\n        return clean(1)\n\nclass Engine(Base):\n    def start(self):\n        super().start()\n        self.check()\n        os.getcwd()\n        len([1])\n"),
    ("app/tools.py", "def clean(x):\n    def inner():\n        return x\n    return inner()\n\ndef helper():\n    return clean(2)\n"),
    ("main.py", "from app import Engine\nimport app.tools\nfrom app import helper as h\n\ndef run(e: Engine):\n    e.check()\n    d = Engine()\n    d.start()\n    app.tools.helper()\n    lonely()\n\nrun(None)\n"),
    ("other/far.py", "def lonely():\n    pass\n"),
    ("broken.py", "def x(:\n"),
]
_CALLS = [
    ("p.app.core.Base.start", "p.app.core.Base.check", "self"), ("p.app.core.Base.check", "p.app.tools.clean", "import"), ("p.app.core.Engine.start", "p.app.core.Base.start", "super"), ("p.app.core.Engine.start", "p.app.core.Base.check", "self"),
    ("p.app.tools.clean", "p.app.tools.clean.inner", "nested"), ("p.app.tools.helper", "p.app.tools.clean", "module"), ("p.main.run", "p.app.core.Base.check", "typed"), ("p.main.run", "p.app.core.Engine", "import"), ("p.main.run", "p.app.core.Engine.start", "typed"),
    ("p.main.run", "p.app.tools.helper", "import"), ("p.main.run", "p.other.far.lonely", "nearest"), ("p.main", "p.main.run", "module"),
]


def _fixture(t: Callable[[str], DataFrame]) -> DataFrame:
    files = t("region").sparkSession.createDataFrame([("p", *x) for x in _REPO], "project string, path string, code string")
    return python_code.read(files)


_query("resolve_calls_package", f"select * from (values {', '.join(map(str, _CALLS))}) v(caller, callee, way)", lambda t: resolve_calls(_fixture(t)).select("caller", "callee", "way").distinct())
_query("embedding_upsert", "select vec_id, coalesce(case when vec_id % 3 = 0 then label + 100 end, label) label from embeddings", lambda t: set_values(t("embeddings").select("vec_id", "label"), "vec_id", t("embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.col("label") + 100).alias("label")), "label"))
