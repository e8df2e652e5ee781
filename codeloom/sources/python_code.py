"""Definitions, imports, bases, variables and calls of Python files, in one pass per file.

The syntax tree never leaves the worker; what does are rows of one schema, by `kind`:
  def: qn, label (Function, Method, Class), lines, docstring, decorators, digest of the source
  var: qn of a public module or class variable, lines, digest
  import: name (local; `*` for all), target (full name)
  base: qn (class), target (as written), n (its place)
  dynamic: qn (the definition around), name (of the function that imports or gets), target (module, or attribute of a name), n (line)
  call: qn (caller, or the module), name (as written), target (class around the caller), n (line); types: local variables whose class shows
Files that don't parse give one row of kind `error`.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "module string, kind string, qn string, label string, name string, target string, n int, start_line int, end_line int, docstring string, decorators array<string>, digest string, types map<string,string>"
#: Rows that a task hands on at once.
BATCH = 20_000


def module_name(project: str, path: str) -> str:
    """`project.folder.file` of a path; a first folder named like the project counts once; `__init__` is its folder."""
    parts = path.removesuffix(".py").replace("\\", "/").strip("/").split("/")
    parts = parts[1:] if parts[0] == project and len(parts) > 1 else parts
    parts = parts[:-1] if parts[-1] == "__init__" else parts
    return ".".join([project, *parts])


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (left := _dotted(node.value)):
        return f"{left}.{node.attr}"
    if isinstance(node, ast.Call):
        return _dotted(node.func)
    return None


def _attributes(node: ast.ClassDef) -> dict[str, str]:
    """`self.name` -> class, of the attributes that the class or its methods annotate or set to a new object."""
    types: dict[str, str] = {}
    for s in node.body:
        if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name) and (t := _dotted(s.annotation)):
            types[f"self.{s.target.id}"] = t
        if not isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        given = {a.arg: t for a in s.args.args if a.annotation is not None and (t := _dotted(a.annotation))}
        for n in ast.walk(s):
            for target in n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []:
                if not (name := _dotted(target)) or not name.startswith("self."):
                    continue
                if isinstance(n, ast.AnnAssign) and (t := _dotted(n.annotation)):
                    types[name] = t
                elif isinstance(n.value, ast.Call) and (t := _dotted(n.value.func)) and t.rpartition(".")[2][:1].isupper():
                    types[name] = t
                elif isinstance(n.value, ast.Name) and n.value.id in given:
                    types[name] = given[n.value.id]
    return types


class _Reader(ast.NodeVisitor):
    def __init__(self, module: str, code: str, is_package: bool) -> None:
        self.module, self.lines, self.package = module, code.split("\n"), is_package
        self.scope: list[tuple[str, str]] = []  # (name, F or C)
        self.rows: list[dict] = []
        self.types: list[dict[str, str]] = [{}]
        self.attributes: list[dict[str, str]] = []  # of the classes around: the classes of `self`'s attributes

    @property
    def qn(self) -> str:
        return ".".join([self.module, *(n for n, _ in self.scope)])

    @property
    def owner(self) -> str | None:
        """The class around the current function."""
        for i in range(len(self.scope) - 1, -1, -1):
            if self.scope[i][1] == "C":
                return ".".join([self.module, *(n for n, _ in self.scope[: i + 1])])
        return None

    def add(self, kind: str, **values: object) -> None:
        self.rows.append({"module": self.module, "kind": kind} | values)

    def digest(self, node: ast.AST) -> str:
        return hashlib.sha256("\n".join(self.lines[node.lineno - 1 : node.end_lineno]).encode()).hexdigest()

    def _define(self, node: ast.AST, label: str) -> None:
        self.add(
            "def", qn=f"{self.qn}.{node.name}", label=label, name=node.name, start_line=min([node.lineno, *(d.lineno for d in node.decorator_list)]), end_line=node.end_lineno, docstring=ast.get_docstring(node),
            decorators=[x for d in node.decorator_list if (x := _dotted(d))], digest=self.digest(node),
        )
        for d in node.decorator_list:
            if name := _dotted(d):
                self._call(name, d.lineno)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._define(node, "Class")
        for k, b in enumerate(node.bases):
            if name := _dotted(b):
                self.add("base", qn=f"{self.qn}.{node.name}", target=name, n=k)
        self.scope.append((node.name, "C"))
        self.attributes.append(_attributes(node))
        self._body(node.body)
        self.attributes.pop()
        self.scope.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self._define(node, "Method" if self.scope and self.scope[-1][1] == "C" else "Function")
        types = dict(self.attributes[-1]) if self.attributes else {}
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            note = a.annotation
            if isinstance(note, ast.Constant) and isinstance(note.value, str):
                types[a.arg] = note.value
            elif note is not None and (t := _dotted(note)):
                types[a.arg] = t
        for n in ast.walk(node):
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and (t := _dotted(n.value.func)) and t.rpartition(".")[2][:1].isupper():
                types |= {name: t for x in n.targets if (name := _dotted(x))}
        self.scope.append((node.name, "F"))
        self.types.append(types)
        self._body(node.body)
        self.types.pop()
        self.scope.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def _body(self, body: list[ast.stmt]) -> None:
        for s in body:
            if isinstance(s, (ast.Assign, ast.AnnAssign)) and (not self.scope or self.scope[-1][1] == "C"):
                for x in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    if isinstance(x, ast.Name) and not x.id.startswith("_"):
                        self.add("var", qn=f"{self.qn}.{x.id}", label="Variable", name=x.id, start_line=s.lineno, end_line=s.end_lineno, digest=hashlib.sha256(ast.unparse(s).encode()).hexdigest())
            self.visit(s)

    def visit_Module(self, node: ast.Module) -> None:
        self._body(node.body)

    def _call(self, name: str, line: int) -> None:
        first = name.split(".")[0]
        types = {k: v for k, v in self.types[-1].items() if k == first or name.startswith(k + ".")}
        self.add("call", qn=self.qn, name=name, target=self.owner, n=line, types=types)

    def visit_Call(self, node: ast.Call) -> None:
        name = _dotted(node.func)
        text = [a.value if isinstance(a, ast.Constant) and isinstance(a.value, str) else None for a in node.args]
        if name in ("importlib.import_module", "import_module", "__import__") and text[:1] != [None] and text:
            self.add("dynamic", qn=self.qn, name=name, target=text[0], n=node.lineno)
        elif name == "getattr" and len(text) > 1 and text[1] and (of := _dotted(node.args[0])):
            self.add("dynamic", qn=self.qn, name=name, target=f"{of}.{text[1]}", n=node.lineno)
        if name:
            self._call("super." + node.func.attr if isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Call) and _dotted(node.func.value.func) == "super" else name, node.lineno)
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            local = a.asname or a.name.split(".")[0]
            self.add("import", name=local, target=a.name if a.asname else local, n=node.lineno, head=a.name.split(".")[0])

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        if node.level:
            parts = self.module.split(".")
            up = node.level - 1 if self.package else node.level
            base = ".".join([*parts[: max(1, len(parts) - up)], *([node.module] if node.module else [])])
        else:
            base = node.module or ""
        head = None if node.level else base.split(".")[0]
        for a in node.names:
            self.add("import", name="*" if a.name == "*" else a.asname or a.name, target=base if a.name == "*" else f"{base}.{a.name}", n=node.lineno, head=head)


def read_file(project: str, path: str, code: str) -> list[dict]:
    """The rows of one file; an absolute import has its target as written, and the first part of it as `head`."""
    module = module_name(project, path)
    try:
        tree = ast.parse(code.removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError) as e:
        return [{"module": module, "kind": "error", "name": str(e)[:200]}]
    r = _Reader(module, code.removeprefix("﻿"), path.endswith("__init__.py"))
    r.visit(tree)
    return r.rows


def roots_of(files: DataFrame) -> DataFrame:
    """`project, root`: the top folders and files of each project's Python files (`project, path`), a row each."""
    return files.where(F.col("path").endswith(".py")).select("project", F.regexp_replace(F.substring_index("path", "/", 1), r"\.py$", "").alias("root")).distinct()


def read(files: DataFrame, project: str = "project", path: str = "path", code: str = "code", roots: DataFrame | None = None) -> DataFrame:
    """Rows of SCHEMA of all Python files; roots (`roots_of` them, unless those of more files are given) tell which imports are the project's own.

    An import meets its root by a join of what was read, so no file carries the roots of its project. Other rows have
    keys that spread them by module.
    """
    py = files.where(F.col(path).endswith(".py") & F.col(code).isNotNull() & F.col(project).isNotNull()).select(F.col(project).alias("project"), F.col(path).alias("path"), F.col(code).alias("code"))
    own = (roots_of(py) if roots is None else roots).where("root <> project").select(F.col("project").alias("_project"), F.col("root").alias("_key"), F.lit(True).alias("_own"))
    schema = f"{SCHEMA}, _project string, head string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in schema.split(", ")]
        frame = lambda rows: pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in cols})
        rows: list[dict] = []
        for b in batches:
            for p, f, c in zip(b["project"], b["path"], b["code"], strict=True):
                rows += [x | {"_project": p} for x in read_file(p, f, c)]
                if len(rows) >= BATCH:
                    yield frame(rows)
                    rows = []
        yield frame(rows)

    found = py.mapInPandas(run, schema).withColumn("_key", F.coalesce("head", F.concat(F.lit("\n"), "module"))).join(own, ["_project", "_key"], "left")
    target = F.when(F.col("head").isNotNull() & F.col("_own"), F.concat_ws(".", "_project", "target")).otherwise(F.col("target"))
    return found.withColumn("target", target).select(*(c.split()[0] for c in SCHEMA.split(", ")))
