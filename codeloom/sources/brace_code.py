"""Definitions, imports, bases, variables and calls of languages with braces (and Lua), in one pass per file.

A partial extractor: no syntax tree, but the text with comments and literals blanked out (so that places stay the same),
the extents of its braces, and patterns for what defines something. It finds functions (declared, assigned or arrow),
methods, classes, interfaces, enumerations, structs and traits by name, what they extend, the comment right above them,
variables of the outermost level, imports, and calls by name with the definition around them. It doesn't see anonymous
functions, macros, overloads apart, nor code put together at run time. Rows are those of `python_code`, with labels
Interface, Enum and Struct besides.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources.python_code import SCHEMA

LANGUAGES = {"js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js", "java": "java", "go": "go", "rs": "rust", "c": "cpp", "h": "cpp", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "java", "php": "java", "lua": "lua"}
_C_NOTES = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_LITERALS = {
    "js": re.compile(_C_NOTES + r"""|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|(?<=[(,=:\[!&|?{};])\s*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"""),
    "java": re.compile(_C_NOTES + r'''|"""[\s\S]*?"""|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*\''''),
    "go": re.compile(_C_NOTES + r"""|"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\.)+'"""),
    "rust": re.compile(_C_NOTES + r"""|"(?:[^"\\]|\\[\s\S])*"|'(?:[^'\\\n]|\\.[^']*)'"""),
    "cpp": re.compile(_C_NOTES + r"""|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)+'"""),
    "lua": re.compile(r"""--\[\[[\s\S]*?(?:\]\]|\Z)|--[^\n]*|\[\[[\s\S]*?\]\]|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""),
}
#: Per language what defines something: label and a pattern on blanked text with the group `n` of the name, and `b` of the bases.
_DEFINES = {
    "js": [
        ("Class", r"\b(?:abstract\s+)?class\s+(?P<n>[A-Za-z_$][\w$]*)(?:[^{;]*?\bextends\s+(?P<b>[\w$.]+))?[^{;]*\{"), ("Interface", r"\binterface\s+(?P<n>[A-Za-z_$][\w$]*)\s*(?:<[^{]*>)?\s*(?:extends\s+(?P<b>[\w$.,\s]+?))?\s*\{"), ("Enum", r"\benum\s+(?P<n>[A-Za-z_$][\w$]*)\s*\{"),
        ("Function", r"\bfunction\s*\*?\s*(?P<n>[A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\s*\("), ("Function", r"(?m)^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<n>[A-Za-z_$][\w$]*)\s*(?::[^=\n]*)?=\s*(?:async\s+)?(?:function\b|(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[A-Za-z_$][\w$]*)\s*(?::[^=\n{]*)?=>)"),
        ("Function", r"(?m)^[ \t]*(?:module\.)?exports\.(?P<n>[A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?(?:function\b|\([^()]*\)\s*=>)"), ("Function", r"(?m)^[ \t]*[A-Za-z_$][\w$]*\.prototype\.(?P<n>[A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?function\b"),
        ("Member", r"(?m)^[ \t]*(?:(?:public|private|protected|static|readonly|abstract|override|async|get|set)\s+)*\*?\s*(?P<n>[A-Za-z_$#][\w$]*)\s*(?:<[^(\n]*>)?\s*\([^;{}]*\)\s*(?::[^;{}=]*)?\{"),
    ],
    "java": [
        ("Class", r"\b(?:class|record)\s+(?P<n>[A-Za-z_]\w*)(?:[^{;]*?(?:\bextends|\bimplements|:)\s+(?P<b>[\w.<>,\s]+?))?[^{;\w]*\{"), ("Interface", r"\b(?:@\s*)?(?:interface|trait)\s+(?P<n>[A-Za-z_]\w*)(?:[^{;]*?\bextends\s+(?P<b>[\w.<>,\s]+?))?[^{;]*\{"), ("Enum", r"\benum\s+(?P<n>[A-Za-z_]\w*)[^{;]*\{"),
        ("Function", r"\bfunction\s+&?(?P<n>[A-Za-z_]\w*)\s*\("), ("Member", r"(?m)^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|internal|static|final|abstract|native|synchronized|default|virtual|override|async|strictfp)\s+)*(?:<[^>{]*>\s*)?(?!return\b|new\b|else\b|throw\b)(?:[\w.?]+(?:<[^;{}()]*>)?(?:\[\])*\s+)?(?P<n>[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+)?\{"),
    ],
    "go": [("Struct", r"\btype\s+(?P<n>[A-Za-z_]\w*)(?:\[[^\]]*\])?\s+struct\s*\{"), ("Interface", r"\btype\s+(?P<n>[A-Za-z_]\w*)(?:\[[^\]]*\])?\s+interface\s*\{"), ("Function", r"(?m)^func\s+(?:\(\s*\w*\s*\*?(?P<o>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<n>[A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\(")],
    "rust": [("Struct", r"\b(?:struct|union)\s+(?P<n>[A-Za-z_]\w*)"), ("Enum", r"\benum\s+(?P<n>[A-Za-z_]\w*)"), ("Interface", r"\btrait\s+(?P<n>[A-Za-z_]\w*)"), ("Impl", r"\bimpl\b(?:\s*<[^{]*?>)?\s+(?:(?P<b>[\w:<>, ]+?)\s+for\s+)?(?P<n>[A-Za-z_]\w*)[^{;]*\{"), ("Function", r"\bfn\s+(?P<n>[A-Za-z_]\w*)\s*(?:<[^(]*>)?\s*\(")],
    "cpp": [("Class", r"\b(?:class|struct)\s+(?P<n>[A-Za-z_]\w*)\s*(?:final\s*)?(?::\s*(?P<b>[\w:<>,\s]+?))?\s*\{"), ("Enum", r"\benum\s+(?:class\s+)?(?P<n>[A-Za-z_]\w*)[^{;]*\{"), ("Member", r"(?m)^[ \t]*(?!return\b|else\b|new\b|throw\b)(?:[\w:<>,*&~]+[\s*&]+)*(?:(?P<o>\w+)::)?(?P<n>~?[A-Za-z_]\w*|operator\s*[^\s\w(]+)\s*\([^;{}]*\)\s*(?:const\b|noexcept\b|override\b|final\b|\s)*(?::[^;{}]*)?\{")],
    "lua": [("Function", r"\b(?:local\s+)?function\s+(?P<n>[A-Za-z_][\w.:]*)\s*\("), ("Function", r"(?m)^[ \t]*(?:local\s+)?(?P<n>[A-Za-z_][\w.]*)\s*=\s*function\s*\(")],
}
_DEFINES = {k: [(label, re.compile(p)) for label, p in v] for k, v in _DEFINES.items()}
_HOLDERS = {"Class", "Interface", "Enum", "Struct", "Impl"}
#: Words before a parenthesis that call nothing.
_NO_CALL = frozenset("if for while switch catch return function sizeof typeof super new await else elseif match loop fn func class def do not and or in of with yield throw delete void case assert defined using synchronized try foreach until then".split())
_CALL = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*(?:\.|::|:|->))*[A-Za-z_$][\w$]*)\s*(?:<[\w\s,.?]*>)?\(")
_VARIABLE = {"js": re.compile(r"(?m)^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]*)?=(?!=)"), "go": re.compile(r"(?m)^(?:var|const)\s+([A-Za-z_]\w*)"), "rust": re.compile(r"(?m)^(?:pub\s+)?(?:const|static)\s+(?:mut\s+)?([A-Za-z_]\w*)"), "lua": re.compile(r"(?m)^local\s+([A-Za-z_]\w*)\s*=(?!\s*function)")}
_NOTE = re.compile(r"((?:^[ \t]*(?://|--|\*|/\*)[^\n]*\n)+)(?:^[ \t]*@[^\n]*\n)*\Z", re.M)
_JS_IMPORT = re.compile(r"""(?m)^\s*import\s+(?:type\s+)?(?P<what>[^'";]*?)\s*(?:\bfrom\s*)?['"](?P<a>[^'"\n]+)['"]|\bexport\s+(?:type\s+)?(?P<again>\*(?:\s+as\s+\w+)?|\{[^}]*\})\s*from\s*['"](?P<b>[^'"\n]+)['"]|(?:\b(?:const|let|var)\s+(?P<own>[\w$]+|\{[^}]*\})\s*=\s*)?\b(?:require|import)\s*\(\s*['"](?P<c>[^'"\n]+)['"]\s*\)""")


def module_of(project: str, path: str) -> str:
    """`project.folder.file` of a path without its extension; a first folder named like the project counts once; `index` is its folder."""
    parts = path.replace("\\", "/").strip("/").split("/")
    parts[-1] = re.sub(r"(?:\.d)?\.\w+$", "", parts[-1])
    parts = parts[1:] if parts[0] == project and len(parts) > 1 else parts
    return ".".join([project, *(parts[:-1] if parts[-1] == "index" and len(parts) > 1 else parts)])


def _named(what: str, target: str) -> list[tuple[str, str]]:
    """Local and full names of the clause of a JavaScript import."""
    out = []
    for inner in re.findall(r"\{([^}]*)\}", what):
        for item in filter(None, (x.strip() for x in inner.split(","))):
            name, _, local = re.sub(r"^type\s+", "", item).replace(":", " as ").partition(" as ")
            out.append(((local or name).strip(), f"{target}.{name.strip()}"))
    for item in filter(None, (x.strip() for x in re.sub(r"\{[^}]*\}", "", what).split(","))):
        out.append((item.removeprefix("*").strip().removeprefix("as").strip() or "*", target if item.startswith("*") else f"{target}.default"))
    return out


def imports_of(project: str, path: str, lang: str, code: str, plain: str) -> Iterator[tuple[str, str, int]]:
    """`local name, full name, offset` of a file's imports; those of the project's own files get its name in front."""
    folder = posixpath.dirname(path.replace("\\", "/"))
    if lang == "js":
        for m in _JS_IMPORT.finditer(code):
            if plain[m.start() : m.end()].strip(" \n") == "" or not re.search(r"\b(?:import|export|require)\b", plain[m.start() : m.end()]):
                continue
            spec = m["a"] or m["b"] or m["c"]
            target = module_of(project, posixpath.normpath(posixpath.join(folder, spec))) if spec.startswith(".") else spec
            for local, full in _named(m["what"] or m["again"] or "", target) or [(m["own"], target)] if not (m["own"] or "").startswith("{") else _named(m["own"], target):
                yield local or "*", full, m.start()
    elif lang == "java":
        for m in re.finditer(r"(?m)^\s*(?:import|using|use)\s+(?:static\s+|function\s+)?([\w.\\]+)(\.\*)?(?:\s+as\s+(\w+))?\s*;", plain):
            name = m[1].replace("\\", ".")
            yield "*" if m[2] else m[3] or name.rpartition(".")[2], name, m.start()
    elif lang == "go":
        for m in re.finditer(r'(?m)^import\s+(?:(\w+|\.)\s+)?"([^"]+)"|^import\s*\(([^)]*)\)', code):
            for alias, spec in [(m[1], m[2])] if m[2] else re.findall(r'(?m)^\s*(\w+|\.)?\s*"([^"]+)"', m[3]):
                yield "*" if alias == "." else alias or spec.rpartition("/")[2], spec.replace("/", "."), m.start()
    elif lang == "rust":
        for m in re.finditer(r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);", plain):
            for local, full in _use_tree(m[1].strip()):
                yield local, re.sub(r"^crate\b", project, full), m.start()
    elif lang == "cpp":
        for m in re.finditer(r'(?m)^[ \t]*#[ \t]*include[ \t]*(?:"([^"\n]+)"|<([^>\n]+)>)', code):
            yield "*", module_of(project, posixpath.normpath(posixpath.join(folder, m[1]))) if m[1] else m[2], m.start()
    elif lang == "lua":
        for m in re.finditer(r"""(?:local\s+(\w+)\s*=\s*)?\brequire\s*\(?\s*["']([^"'\n]+)["']""", code):
            yield m[1] or "*", m[2].replace("/", "."), m.start()


def _use_tree(text: str, base: str = "") -> Iterator[tuple[str, str]]:
    """Local and full names of a use declaration with nested braces."""
    head, brace, rest = text.partition("{")
    if brace:
        depth, start, inner = 0, 0, rest.rsplit("}", 1)[0]
        for i, c in enumerate(inner + ","):
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                if item := inner[start:i].strip():
                    yield from _use_tree(item, base + head.strip().replace("::", "."))
                start = i + 1
        return
    name, _, local = text.partition(" as ")
    full = (base + name.strip().replace("::", ".")).removesuffix(".self")
    yield ("*" if full.endswith(".*") else local.strip() or full.rpartition(".")[2]), full.removesuffix(".*")


def _extents(plain: str, lang: str) -> dict[int, int]:
    """Where the braces (in Lua the blocks) that open at a place close."""
    out, stack = {}, []
    if lang == "lua":
        for m in re.finditer(r"\b(?:function|do|then|repeat|end|until|elseif)\b", plain):
            if m[0] in ("end", "until", "elseif"):
                if stack:
                    out[stack.pop()] = m.end()
            else:
                stack.append(m.start())
        return out
    for m in re.finditer(r"[{}]", plain):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.end()
    return out


def read_file(project: str, path: str, code: str) -> list[dict]:
    lang = LANGUAGES.get(path.rpartition(".")[2].lower())
    if lang is None:
        return []
    code = code.removeprefix("﻿").replace("\r\n", "\n")
    plain = _LITERALS[lang].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)
    module, starts = module_of(project, path), [0, *(m.end() for m in re.finditer("\n", code))]
    line = lambda at: bisect_right(starts, at)
    ends = _extents(plain, lang)
    found: dict[int, tuple] = {}
    for label, pattern in _DEFINES[lang]:
        for m in pattern.finditer(plain):
            at, name = m.start("n"), m["n"]
            if name in _NO_CALL or at in found:
                continue
            groups = m.groupdict()
            if lang == "lua":
                brace = plain.find("function", m.start())
            else:
                brace = m.end() - 1 if plain[m.end() - 1] == "{" else next((x.start() for x in re.compile(r"[{;]").finditer(plain, m.end()) if x[0] == "{" or label != "Interface"), -1)
                if brace >= 0 and plain[brace] != "{":
                    brace = -1
            first = m.start() + len(m[0]) - len(m[0].lstrip())
            end = ends.get(brace, len(code)) if brace >= 0 else code.find("\n", m.end())
            found[at] = (first, end if end >= 0 else len(code), label, name, groups.get("b"), groups.get("o"))
    rows, scope = [], []
    add = lambda kind, **values: rows.append({"module": module, "kind": kind} | values)
    spans = []
    for _, (first, end, label, name, bases, owner) in sorted(found.items(), key=lambda x: (x[1][0], -x[1][1])):
        while scope and scope[-1][0] <= first:
            scope.pop()
        inside = bool(scope) and scope[-1][2] in _HOLDERS
        if label == "Member" and not inside and lang in ("js", "java"):
            continue  # a call with a block after it
        around = scope[-1][1] if scope else module
        if label == "Impl":
            scope.append((end, f"{module}.{name}", label))
            if bases:
                add("base", qn=f"{module}.{name}", target=re.sub(r"<.*", "", bases).replace("::", ".").strip(), n=0)
            continue
        own = name.replace(":", ".")
        qn = f"{around}.{owner}.{own}" if owner else f"{around}.{own}"
        kind = label if label not in ("Function", "Member") else "Method" if inside or owner else "Function"
        note = _NOTE.search(code, max(0, first - 4000), starts[line(first) - 1])
        add("def", qn=qn, label=kind, name=own.rpartition(".")[2], start_line=line(first), end_line=line(max(first, end - 1)), docstring=_plain_note(note[1]) if note else None, decorators=[], digest=hashlib.sha256(code[first:end].encode("utf-8", "replace")).hexdigest())
        for k, b in enumerate(filter(None, (re.sub(r"<.*?>|\b(?:public|private|protected|virtual|implements|extends)\b", "", x).strip() for x in re.split(r",|\bimplements\b", bases or "")))):
            add("base", qn=qn, target=b.replace("::", "."), n=k)
        scope.append((end, qn, label))
        spans.append((first, end, qn, label))
    if lang in _VARIABLE:
        taken = {f[3] for f in found.values()}
        for m in _VARIABLE[lang].finditer(plain):
            if m[1] not in taken:
                stop = code.find("\n", m.end())
                add("var", qn=f"{module}.{m[1]}", label="Variable", name=m[1], start_line=line(m.start()), end_line=line(m.start()), digest=hashlib.sha256(code[m.start() : stop if stop >= 0 else len(code)].encode("utf-8", "replace")).hexdigest())
    for local, full, at in imports_of(project, path, lang, code, plain):
        add("import", name=local, target=full, n=line(at))
    defined, open_, i = set(found), [], 0
    for m in _CALL.finditer(plain):
        name = re.sub(r"::|->|:", ".", m[1])
        last = m.start(1) + len(m[1]) - len(name.rpartition(".")[2])
        if last in defined or m.start(1) in defined or name in _NO_CALL:
            continue
        while i < len(spans) and spans[i][0] <= m.start():
            open_.append(spans[i])
            i += 1
        while open_ and open_[-1][1] <= m.start():
            open_.pop()
        holder = next((s[2] for s in reversed(open_) if s[3] in _HOLDERS), None)
        add("call", qn=open_[-1][2] if open_ else module, name=re.sub(r"^this\.", "self.", name), target=holder, n=line(m.start()), types={})
    return rows


def _plain_note(text: str) -> str:
    return "\n".join(re.sub(r"^\s*(?:/\*+|\*+/?|//+|--+)\s?|\s*\*+/\s*$", "", x).strip() for x in text.strip().split("\n")).strip()


def read(files: DataFrame, project: str = "project", path: str = "path", code: str = "code") -> DataFrame:
    """Rows of `python_code.SCHEMA` of all files of languages known here; null paths and codes give none."""
    own = files.where(F.col(code).isNotNull() & F.lower(F.substring_index(path, ".", -1)).isin(*LANGUAGES)).select(F.col(project).alias("project"), F.col(path).alias("path"), F.col(code).alias("code"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows = [x for p, f, c in zip(b["project"], b["path"], b["code"], strict=True) for x in read_file(p or "", f, c)]
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in cols})

    return own.mapInPandas(run, SCHEMA)
