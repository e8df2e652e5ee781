import json

import pytest
from pyspark.sql import functions as F

from codeloom.operators import files as L
from codeloom.operators import text as X
from codeloom.operators import vector as V
from codeloom.operators.resolve import call_edges, resolve_calls
from codeloom.plans.code_queries import _CALLS, _REPO
from codeloom.sources import exports, manifests, python_code


@pytest.mark.parametrize(
    ("rules", "path", "ignored"),
    [
        (["*.log"], "a/x.log", True), (["*.log", "!keep.log"], "a/keep.log", False), (["!keep.log", "*.log"], "keep.log", True), (["build/"], "build/x", True), (["build/"], "build", False), (["build"], "src/build/y", True), (["/build"], "src/build", False), (["a/*.py"], "a/b/c.py", False),
        (["a/**/c.py"], "a/b/x/c.py", True), (["a/**/c.py"], "a/c.py", True), (["?.py"], "ab.py", False), (["[ab].py"], "b.py", True), (["[!ab].py"], "b.py", False), (["# x", "", "\\#x"], "#x", True), (["a.b"], "axb", False),
    ],
)
def test_ignore_rules(spark, rules, path, ignored):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(L.ignored_by(F.col("p"), rules)).first()[0] is ignored


def test_languages_and_folders(spark, rows):
    df = spark.createDataFrame([("r", "a/b/x.PY"), ("r", "a/index.js"), ("r", "top"), ("r", "a/b/x.PY")], "repo string, path string")
    assert rows(df.select("path", L.language(F.col("path")).alias("l")).distinct()) == [("a/b/x.PY", "python"), ("a/index.js", "javascript"), ("top", None)]
    assert rows(L.folders(df, "repo", "path"), "qn", "is_package") == [("r.a", True), ("r.a.b", False)]
    assert rows(L.files_with_parents(df, "repo", "path"), "qn", "parent") == [("r.a.b.x", "r.a.b"), ("r.a.index", "r.a"), ("r.top", "r")]


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("Cargo.toml", '[dependencies]\nserde = "1"\ntokio = {version = "1.2", features = []}\n[dev-dependencies]\nx = "2"', [("serde", "1", "main"), ("tokio", "1.2", "main"), ("x", "2", "dev")]),
        ("Gemfile", "gem 'rails', '~> 7'\n# gem 'no'\ngem \"pg\"", [("rails", "~> 7", "main"), ("pg", "", "main")]),
        ("composer.json", '{"require": {"php": ">=8", "a/b": "^1"}, "require-dev": {"c/d": "2"}}', [("a/b", "^1", "main"), ("c/d", "2", "dev")]),
        ("App.csproj", '<Project><ItemGroup><PackageReference Include="X" Version="1"/><PackageReference Include="Y"><Version>2</Version></PackageReference></ItemGroup></Project>', [("X", "1", "main"), ("Y", "2", "main")]),
        ("pyproject.toml", '[tool.poetry.dependencies]\npython = "^3"\na = "^1"\n[tool.poetry.group.docs.dependencies]\nb = {version = "2"}', [("a", "^1", "main"), ("b", "2", "docs")]),
        ("pyproject.toml", "[broken", []), ("App.csproj", "<x", []), ("package.json", "[1]", []), ("other.txt", "a==1", []),
    ],
)
def test_manifests(path, text, want):
    assert manifests.dependencies(path, text) == want


def test_export(spark, tmp_path, rows):
    doc = {"nodes": [{"node_id": 1, "labels": ["Function"], "properties": {"qualified_name": "p.f", "name": "f", "start_line": "3", "decorators": '["@a"]'}}, {"node_id": 2, "labels": ["Project"], "properties": {"name": "p"}}], "relationships": [{"from_id": 2, "to_id": 1, "type": "DEFINES", "properties": {}}, {"from_id": 2, "to_id": 9, "type": "DEFINES", "properties": {}}], "metadata": {}}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    g = exports.read_export(spark, str(tmp_path / "g.json"))
    assert rows(g.nodes, "qn", "label", "start_line", "decorators") == [("p", "Project", None, None), ("p.f", "Function", 3, ["@a"])]
    assert rows(g.edges, "src", "rel", "dst") == [("p", "DEFINES", "p.f")]


def test_feeds(spark, rows):
    xml = "<feed><entry><id>http://x/abs/1.2</id><title>A\n b</title><summary>s</summary><published>2025-01-01</published></entry><entry><id>z/2</id><title>B</title></entry></feed>"
    assert rows(exports.papers_from_xml(spark.createDataFrame([(xml,)], "text string")), "id", "title") == [("1.2", "A b"), ("2", "B")]
    js = '[{"id": "1", "title": "t", "upvotes": 3}]'
    assert rows(exports.papers_from_json(spark.createDataFrame([(js,), (None,)], "text string")), "id", "title", "upvotes") == [("1", "t", 3)]


def test_calls_of_a_package(spark, rows):
    files = spark.createDataFrame([("p", *x) for x in _REPO] + [("p", "n.py", None), ("p", "x.js", "f()")], "project string, path string, code string")
    read = python_code.read(files)
    assert rows(read.where("kind = 'error'"), "module") == [("p.broken",)]
    got = resolve_calls(read)
    assert rows(got.select("caller", "callee", "way").distinct()) == sorted(_CALLS)
    assert ("p.app.core.Engine.start", "p.app.core.Base.start") in rows(call_edges(got), "src", "dst")


def test_definitions(spark, rows):
    code = "import os\nX = 1\n_y = 2\n@dec(1)\nclass A:\n    '''Doc.'''\n    z: int = 3\n    @staticmethod\n    def f(x):\n        local = 1\n        def g():\n            pass\n"
    read = python_code.read(spark.createDataFrame([("p", "m/__init__.py", code)], "project string, path string, code string"))
    assert rows(read.where("kind = 'def'"), "qn", "label", "start_line", "docstring", "decorators") == [("p.m.A", "Class", 4, "Doc.", ["dec"]), ("p.m.A.f", "Method", 8, None, ["staticmethod"]), ("p.m.A.f.g", "Function", 11, None, [])]
    assert rows(read.where("kind = 'var'"), "qn") == [("p.m.A.z",), ("p.m.X",)]


def test_lines_and_snippets(spark):
    cases = [(None, None), ("", None), ("a", "a"), ("a\r\nb\n", "a\nb"), ("a\n\n", "a\n")]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [r[0] or None for r in df.select(X.snippet(F.col("t"), F.lit(1), F.lit(9))).collect()] == [w for _, w in cases]


def test_grep_merges_what_touches(spark, rows):
    text = "\n".join("hit" if i in (1, 3, 8) else "no" for i in range(1, 11))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    assert rows(X.grep(df, "k", "t", "hit", 1)) == [(1, 1, 4, 2), (1, 7, 9, 1)]


def test_neighbours_in_blocks(spark, rows):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(20)] + [(99, None), (98, [0.0, 0.0, 0.0])], "k bigint, v array<float>")
    q = df.where("k in (0, 7, 14)")
    assert rows(V.neighbours(df, q, "k", "v", 4, block=2)) == rows(V.neighbours(df, q, "k", "v", 4))
    assert len(V.neighbours(df, q, "k", "v", 4).collect()) == 12
    assert V.neighbours(df, q.where("false"), "k", "v").collect() == []


def test_embeddings_take_whole_texts(spark):
    start = "word " * 500
    df = spark.createDataFrame([(1, start + "alpha"), (2, start + "omega " * 300), (3, None)], "k int, t string")
    whole = {r[0]: r[1] for r in V.embed(df, "k", "t").collect()}
    assert whole[1] != whole[2] and not any(whole[3])
    cut = {r[0]: r[1] for r in V.embed(df, "k", "t", most=1843).collect()}
    assert cut[1] == cut[2]


def test_every_call_and_whole_constants():
    code = "".join(f"f{i}()\n" for i in range(6000)) + "A = '" + "x" * 600 + "y'\n"
    found = python_code.read_file("p", "m.py", code)
    assert [r["name"] for r in found if r["kind"] == "call"] == [f"f{i}" for i in range(6000)]
    digest = lambda c: [r["digest"] for r in python_code.read_file("p", "m.py", c) if r["kind"] == "var"]
    assert digest(code) != digest(code.replace("xy'", "xz'"))


def test_relative_imports_are_read_by_the_library(spark, rows, monkeypatch):
    from codeloom.plans import context_queries

    targets = lambda path, code: [r["target"] for r in python_code.read_file("p", path, code) if r["kind"] == "import"]
    assert targets("p/a/b.py", "from . import x\nfrom ..x import y\n") == ["p.a.x", "p.x.y"] and targets("p/a/b/c.py", "from . import x\n") == ["p.a.b.x"]
    reads = []
    read = python_code.read
    monkeypatch.setattr(python_code, "read", lambda *a, **k: reads.append(a) or read(*a, **k))
    got = rows(context_queries.QUERIES["relative_import_resolve"](spark, "/root/testdata/sf0.001"))
    assert len(got) == 10 and all(t.startswith("p.a") for (t,) in got) and len(reads) == 1


def test_no_file_carries_the_roots_of_its_project(spark, rows):
    code = "import m1, os as o, p.x, m2.y as z\nfrom m3.k import q\nfrom m4 import *\nfrom . import w\nfrom outside import v\n"
    files = [("p", f"m{i}.py", code if i == 0 else "x = 1\n") for i in range(3000)] + [("q", "a/m1.py", "import m1, a\n"), ("q", "q.py", "import q, a.b\n"), (None, "n.py", "import n\n")]
    read = python_code.read(spark.createDataFrame(files, "project string, path string, code string").repartition(4))
    imports = read.where("kind = 'import'")
    assert rows(imports.where("module = 'p.m0'"), "name", "target") == [("*", "p.m4"), ("m1", "p.m1"), ("o", "os"), ("p", "p"), ("q", "p.m3.k.q"), ("v", "outside.v"), ("w", "p.w"), ("z", "p.m2.y")]
    assert rows(imports.where("module like 'q%'"), "module", "name", "target") == [("q.a.m1", "a", "q.a"), ("q.a.m1", "m1", "m1"), ("q.q", "a", "q.a"), ("q.q", "q", "q")]
    assert read.columns == [c.split()[0] for c in python_code.SCHEMA.split(", ")] and rows(read.groupBy("kind").count().where("kind = 'var'"), "count") == [(2999,)]
    assert "collect_set" not in read._jdf.queryExecution().optimizedPlan().toString()
