import re

import pytest

from codeloom.sources import brace_code
from codeloom.sources.brace_code import read_file

JS = """import def, { a as b, c } from '../lib/x';
import * as ns from "./y";
export { d } from './index';
const fs = require('fs');
// "import z from 'no'"
const LIMIT = 3;

/** What it does. */
export class Box extends Base {
  constructor(n) { super(n); this.open(n); }
  async open(x = "}{") { return helper(x, ns.go(1)); }
}
export const arrow = async (p, q) => { return p(q); };
function helper(x) { function inner() { return b(x); } return inner(); }
exports.out = function () { helper(1); };
"""
TS = "export interface Shape extends Base { area(): number }\nenum Kind { A, B }\nexport function f<T>(a: T): void { g(a); }\n"
JAVA = "package p.q;\nimport java.util.List;\nimport static a.B.*;\n/** Doc. */\npublic class A extends B implements C, D {\n  private int n = f(1);\n  @Override\n  public List<String> run(int a) throws E {\n    if (a > 0) { this.go(a); }\n    return new ArrayList<>(a);\n  }\n  A(int x) { super(x); }\n  enum K { X, Y }\n}\ninterface I { void m(); }\n"
GO = 'package m\n\nimport (\n\t"fmt"\n\tx "a/b"\n)\n\nvar Limit = 3\n\ntype T struct {\n\tA int\n}\n\n// Go runs.\nfunc (t *T) Go(a int) error {\n\treturn helper(a, x.Y())\n}\n\nfunc helper(a int, b int) error { return nil }\n'
RUST = "use crate::a::{b, c::{self, d as e}};\nuse std::fmt::*;\npub struct S { x: i32 }\nimpl Show for S {\n    fn show(&self) -> String { format(self.x) }\n}\nfn main() { let s = S::new(1); }\n"
CPP = '#include "util/x.h"\n#include <vector>\nclass A : public B, C {\n public:\n  int f(int x) const { return g(x); }\n};\nint A2::h(int y) {\n  return A2::k(y);\n}\n'
LUA = "local m = require('a.b')\nlocal function f(x)\n  if x then return m.g(x) end\nend\nfunction M.h(y)\n  f(y)\nend\n"


def of(path, code):
    rows = read_file("p", path, code)
    pick = lambda kind, *cols: [tuple(r.get(c) for c in cols) for r in rows if r["kind"] == kind]
    return pick


def test_javascript():
    pick = of("src/app/m.js", JS)
    assert pick("def", "qn", "label") == [("p.src.app.m.Box", "Class"), ("p.src.app.m.Box.constructor", "Method"), ("p.src.app.m.Box.open", "Method"), ("p.src.app.m.arrow", "Function"), ("p.src.app.m.helper", "Function"), ("p.src.app.m.helper.inner", "Function"), ("p.src.app.m.out", "Function")]
    assert pick("def", "docstring")[0] == ("What it does.",) and pick("def", "start_line", "end_line")[0] == (9, 12)
    assert pick("import", "name", "target") == [("b", "p.src.lib.x.a"), ("c", "p.src.lib.x.c"), ("def", "p.src.lib.x.default"), ("ns", "p.src.app.y"), ("d", "p.src.app.d"), ("fs", "fs")]
    assert pick("base", "qn", "target") == [("p.src.app.m.Box", "Base")] and [n for n, _ in pick("var", "name", "qn")] == ["fs", "LIMIT"]
    calls = set(pick("call", "qn", "name"))
    assert {("p.src.app.m.Box.constructor", "self.open"), ("p.src.app.m.Box.open", "helper"), ("p.src.app.m.Box.open", "ns.go"), ("p.src.app.m.helper.inner", "b"), ("p.src.app.m.helper", "inner"), ("p.src.app.m.out", "helper")} <= calls
    assert not any(n in ("super", "constructor", "open") for _, n in calls)


def test_typescript():
    pick = of("t.ts", TS)
    assert pick("def", "qn", "label") == [("p.t.Shape", "Interface"), ("p.t.Kind", "Enum"), ("p.t.f", "Function")]
    assert pick("base", "target") == [("Base",)] and ("p.t.f", "g") in pick("call", "qn", "name")


def test_java():
    pick = of("q/A.java", JAVA)
    assert pick("def", "qn", "label") == [("p.q.A.A", "Class"), ("p.q.A.A.run", "Method"), ("p.q.A.A.A", "Method"), ("p.q.A.A.K", "Enum"), ("p.q.A.I", "Interface")]
    assert pick("import", "name", "target") == [("List", "java.util.List"), ("*", "a.B")]
    assert [b for (b,) in pick("base", "target")] == ["B", "C", "D"] and ("p.q.A.A.run", "self.go") in pick("call", "qn", "name")


def test_go_rust_cpp_lua():
    pick = of("a/m.go", GO)
    assert pick("def", "qn", "label") == [("p.a.m.T", "Struct"), ("p.a.m.T.Go", "Method"), ("p.a.m.helper", "Function")] and pick("def", "docstring")[1] == ("Go runs.",)
    assert pick("import", "name", "target") == [("fmt", "fmt"), ("x", "a.b")] and ("p.a.m.T.Go", "x.Y") in pick("call", "qn", "name") and pick("var", "name") == [("Limit",)]
    pick = of("m.rs", RUST)
    assert pick("def", "qn", "label") == [("p.m.S", "Struct"), ("p.m.S.show", "Method"), ("p.m.main", "Function")]
    assert pick("import", "name", "target") == [("b", "p.a.b"), ("c", "p.a.c"), ("e", "p.a.c.d"), ("*", "std.fmt")] and pick("base", "qn", "target") == [("p.m.S", "Show")]
    pick = of("m.cpp", CPP)
    assert pick("def", "qn", "label") == [("p.m.A", "Class"), ("p.m.A.f", "Method"), ("p.m.A2.h", "Method")] and [b for (b,) in pick("base", "target")] == ["B", "C"]
    assert pick("import", "target") == [("p.util.x",), ("vector",)]
    pick = of("m.lua", LUA)
    assert pick("def", "qn") == [("p.m.f",), ("p.m.M.h",)] and pick("import", "name", "target") == [("m", "a.b")] and ("p.m.M.h", "f") in pick("call", "qn", "name")


@pytest.mark.parametrize("code", ["", "{", "}}}", "class", "function (", "/* open", "'", "x" * 100_000 + "(", "class A {" * 500])
@pytest.mark.parametrize("path", ["a.js", "a.java", "a.go", "a.rs", "a.cpp", "a.lua", "a.txt"])
def test_odd_texts(path, code):
    assert all(re.fullmatch("def|var|import|base|call", r["kind"]) for r in read_file("p", path, code))


def test_files(spark, rows):
    df = spark.createDataFrame([("p", "m.js", "function f() { g(); }", 1), ("p", None, "x", 2), ("p", "m.go", None, 3), (None, "n.js", "function h() {}", 4)], "project string, path string, code string, module int")
    got = brace_code.read(df)
    assert rows(got.where("kind in ('def', 'call')"), "kind", "qn", "name") == [("call", "p.m.f", "g"), ("def", ".n.h", "h"), ("def", "p.m.f", "f")]
    assert brace_code.read(df.limit(0)).collect() == []
