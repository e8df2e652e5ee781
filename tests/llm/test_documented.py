import datetime as dt

import pytest

from codeloom.llm.documented import capture, documented, is_trivial

SCHEMA = "context_id bigint, qualified_name string, element_type string, file_path string, code_snippet string, docstring string, parameters array<string>, indexed_at timestamp_ntz, v int, code string"
GOOD = "Splits the input at blank lines."


@pytest.mark.parametrize(
    "text",
    [
        None, "", "  ", "None", "null", "N/A", "TODO", "todo(team): describe the parameters here", "FIXME document this before the release", "...", "-----", "TBD", "No description.", "Missing documentation.", "docstring", "Auto-generated method stub", "Placeholder text, to be replaced by a real description.",
        "{@inheritDoc}", "@param items items\n@returns", ":param items:\n:return:", "Args:\n    items:\nReturns:", "load_big_file", "LOAD BIG FILE", "loadBigFile()", "Loads file.", "Load the big file", "# pylint: disable=too-many-locals", "noqa: C901", "type: ignore[arg-type]", "eslint-disable-next-line no-shadow",
        "Copyright (c) 2024 the project authors. All rights reserved.", "SPDX-License-Identifier: MIT", "items.clear(); return limit;", "result = old_lookup(items, limit)", "if limit > 3: return items", "go:generate stringer", "XXX",
    ],
)
def test_trivial(text):
    assert is_trivial(text, "load_big_file", ["items", "limit"])


@pytest.mark.parametrize(
    "text",
    [
        GOOD, "No lock is taken here; callers already hold it.", "Used by the watcher: called once per burst with all changed paths.", "Undo for the last move: puts each lock back under its former parent.", "Placeholder tokens are swapped for the real ones before saving.", "Missing commits are created on the way.",
        "Description and title of the diff are kept apart on purpose.", "TODO: later\nReturns nothing if it fails.", "@param items the worker to start from", "True if at least one node points back.", "\u8fd4\u56de\u6240\u6709\u6587\u4ef6", "Return the digest for a given key, or nothing.", "pylint: disable=x\nKeeps the newest entry of all.",
    ],
)
def test_meaningful(text):
    assert not is_trivial(text, "load_big_file", ["items", "limit"])


@pytest.mark.parametrize(
    ("path", "snippet", "above", "inside"),
    [
        ("a.py", f"# {GOOD}\n@cached(ttl=(1, '('))\ndef f(a=')', b={{'(': 1}}) -> dict:\n    return a\n", GOOD, ""), ("a.py", f'def f(\n    a,  # )\n):\n    r"""{GOOD}"""\n    x = 1\n', "", GOOD), ("a.py", f"async def f():\n    # note\n    '''{GOOD}\n    More.'''\n", "", f"{GOOD}\n    More."),
        ("a.py", f"# {GOOD}\n\ndef f(): pass", "", ""), ("a.py", f'def f():\n    x = "{GOOD}"\n', "", ""), ("a.py", f'def f():\n    b"""{GOOD}"""\n', "", ""), ("a.js", f"/**\n * {GOOD}\n */\nexport function f(a) {{\n  const r = /[({{]+/g; // }}\n  return `}}${{a}}`;\n}}", GOOD, ""),
        ("a.go", f"// {GOOD}\n// More.\nfunc (s *T) F(x int) error {{\n\tc := '{{'\n\treturn nil\n}}\n", f"{GOOD}\nMore.", ""), ("a.java", f"    /** {GOOD} */\n    @Override\n    public int f(List<String> a) {{ return 1; }}", GOOD, ""), ("a.js", f"function f() {{\n  // {GOOD}\n}}", "", ""),
        ("a.java", f"/* {GOOD} */\r\npublic void f() {{\r\n  x(\"}}\");\r\n}}\r\n", GOOD, ""),
    ],
)
def test_captured(path, snippet, above, inside):
    got = capture(snippet, path)
    assert got[:2] == (above, inside)
    assert not above or above.split("\n")[0] not in got[2]


def test_long_snippets_are_read_whole():
    body = "    x = f('(')\n" * 20_000
    assert capture(f'def f():\n    """{GOOD}"""\n{body}', "a.py")[1] == GOOD
    assert capture(f"// {GOOD}\nfunction f() {{\n{'  a({b: [1]});' * 20_000}\n", "a.js")[0] == GOOD


def row(i, qn, snippet="def f(): pass", doc=GOOD, kind="Function", at=1, path="a.py"):
    return (i, qn, kind, path, snippet, doc, ["a"], dt.datetime(2025, 1, at), 1, "c")


def test_found(spark, rows):
    given = [
        row(1, "m.f"), row(2, "m.old", at=1), row(3, "m.old", doc=None, at=2), row(4, "m.cls", kind="Class"), row(5, "m.kind", kind=" METHOD "), row(6, "m.blank", snippet=" \n"), row(7, "m.none", snippet=None), row(8, None), row(9, "m.code", snippet=f"# {GOOD}\ndef g(): pass", doc="None"),
        row(10, "m.tie", doc=None), row(11, "m.tie"), row(12, "m.f", at=1), (13, None, None, None, None, None, None, None, None, None), (14, "m.bare", "function", None, "def f(): pass", GOOD, None, None, None, None),
    ]
    got = documented(spark.createDataFrame(given, SCHEMA))
    assert rows(got, "qualified_name", "found_in") == [("m.bare", "docstring"), ("m.code", "comment"), ("m.f", "docstring"), ("m.kind", "docstring"), ("m.tie", "docstring")]
    assert documented(spark.createDataFrame([], SCHEMA)).collect() == []
