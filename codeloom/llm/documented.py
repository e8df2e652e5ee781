"""Functions paired with their documentation.

Recursive patterns capture the comment right above a function, its decorators and signature (with balanced parentheses)
and its balanced body together; strings, character and pattern literals and comments are matched as wholes, so brackets
inside them count for nothing. A comment that a blank line parts from the function isn't its own. The documentation is
that of the docstring column, else the comment above, else the doc string that opens the body, the first that isn't
trivial.

Trivial: nothing is left after tool directives, licence notices, rulers, commented-out code and placeholders are
dropped, or fewer than three words besides tags, parameter names and the words of the function's own name.

Defined results: of several rows of a name the one with the latest indexed_at counts (on a tie the greatest
context_id); null names, null or blank snippets give no pair; a snippet whose body isn't balanced still has the comment
above it and its doc string; CJK characters count as a word each; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.keys import trimmed

#: Words that documentation must have at least.
LEAST_WORDS = 3

_PARTS = r"""(?(DEFINE)
  (?P<str>\"(?:[^\"\\\n]++|\\[\s\S])*+\"|'(?:[^'\\\n]++|\\[\s\S])*+'|`(?:[^`\\]++|\\[\s\S])*+`)
  (?P<pat>(?<=[(,=:\[!&|?{;]\s*)/(?![*/])(?:[^/\\\n\[]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/\w*+)
  (?P<note>//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z))
  (?P<round>\((?:[^()\"'`/#]++|(?&str)|(?&note)|/|\#|(?&round))*+\))
  (?P<block>\{(?:[^{}\"'`/]++|(?&str)|(?&note)|(?&pat)|/|(?&block))*+\})
  (?P<pystr>(?i:[rubf]{0,2})(?:\"\"\"(?:[^\"\\]++|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''|\"(?:[^\"\\\n]++|\\[\s\S])*+\"|'(?:[^'\\\n]++|\\[\s\S])*+'))
  (?P<pyround>[(\[{](?:[^()\[\]{}\"'\#rRuUbBfF]++|(?&pystr)|[rRuUbBfF]|\#[^\n]*+|(?&pyround))*+[)\]}])
)"""
#: Languages with braces: comment, annotations and signature, body.
BRACED = regex.compile(
    _PARTS + r"""
  \s*+ (?P<doc>(?:[^\S\n]*+(?&note)[^\S\n]*+(?:\n|$))*+)
  (?P<head>(?:[^\S\n]*+@[\w.]++(?&round)?+\s*+)*+ (?:[^{};\"'`/()\n]++|(?&round)|(?&note)|\n(?!\s*\n))*+)
  (?P<body>(?&block))?+ (?P<rest>[\s\S]*+)""",
    regex.VERBOSE,
)
#: Python: comment, decorators, signature; the body is what is indented below it.
PYTHON = regex.compile(
    _PARTS + r"""
  \s*+ (?P<doc>(?:[^\S\n]*+\#[^\n]*+(?:\n|$))*+)
  (?P<head>(?:[^\S\n]*+(?:@[\w.]++(?&pyround)?+[^\n]*+|\#[^\n]*+)\n\s*?)*+ [^\S\n]*+ (?:async\s+)?+(?:def|class)\s++\w++\s*+(?:\[[^\]\n]*+\])?+ (?&pyround)?+ (?:[^:\n\"'()\[\]]++|(?&pystr)|(?&pyround))*+:)
  (?P<body>(?:[^\S\n]*+(?:\#[^\n]*+)?\n)*+ [^\S\n]*+ (?P<docstr>(?i:[ru]?)(?:\"\"\"(?:[^\"\\]++|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''|\"(?:[^\"\\\n]++|\\[\s\S])*+\"|'(?:[^'\\\n]++|\\[\s\S])*+')(?=\s*(?:\#|;|\n|$)))?+ [\s\S]*+)""",
    regex.VERBOSE,
)

_DIRECTIVE = regex.compile(
    r"""(?ix)^\W*(?: noqa\b | type:\s*ignore | (?:pylint|flake8|mypy|pyright|ruff|isort|yapf|fmt|black|bandit|coverage|eslint|tslint|jshint|jslint|jscs|prettier|biome|stylelint|istanbul|c8|v8|webpack|nosec|nosonar|noinspection|checkstyle|spotbugs|pmd|clang-format|clang-tidy|nolint|golangci|lint|sonar)\b\s*[:\-(\s]\s*\S* | @ts-\w+ | ts-(?:ignore|nocheck|expect-error) | go:\w+ | \+build\b | pragma\b | region\b | endregion\b | @formatter | @suppress | @flow\b | nosec\b | nolint\b | nosonar\b | fmt:\s*(?:on|off) | vim?: | -\*- | \#?sourceMappingURL | cspell:\S* | eslint-\S+ | <reference\b | ^!/ )"""
)
_LICENCE = regex.compile(r"(?i)(?:\bcopyright\b\s*(?:\(c\)|©|\d{4})|©\s*\d{4}|\ball rights reserved\b|spdx-license|\blicen[cs]ed under\b|\b(?:mit|apache|bsd|gpl)[\w\s.-]{0,40} licen[cs]e\b|see the licen[cs]e file|without warrant(?:y|ies))")
_RULER = regex.compile(r"^[\W_]*$")
#: Statements, each told by a look that takes time in proportion to the line.
_ASSIGNS = regex.compile(r"[\w.$]++(?:\[[^\]]*+\])?+(?:\s*+,\s*+[\w.]++)*+\s*+(?:[-+*/%|&^]|<<|>>|:)?+=(?!=)\s*+\S")
_CONTROL = regex.compile(r"(?:if|elif|for|while|with|switch|catch)\b")
_BRANCH = regex.compile(r"[:{]\s*(?:(?:return|break|continue|pass|raise)\b|[\w.]+\()")
_DECLARES = regex.compile(r"(?:def|class|func|function|async|import|from|const|let|var|public|private|protected|static|package|#include)\s+[\w.$<>*{}\"' ,]++(?:(?<=[\s}])import\s|\(|=|;|:$|\{|(?<=[\"']))")
_CALL = regex.compile(r"[\w.$]++\((?:[^()]++|\([^()]*+\))*+\)\s*[;:]?$")
_LEAVES = regex.compile(r"(?:return|break|continue|throw|raise|yield|delete|goto|pass)\b[^.!?]*+(?<=;)$")
_BLOCK = regex.compile(r"(?:else|try|finally|do)\s*[:{]$|[)\]}]+[;,]?$")
_TWO = regex.compile(r"\);\s+\w")


def is_code(s: str) -> bool:
    """Whether a line of a comment is a statement rather than words."""
    if s[-1:] in (";", "{", "}") and ("=" in s or "(" in s):
        return True
    if _CONTROL.match(s) and not set("<>=()[]!").isdisjoint(s) and (s[-1] in ":{" or _BRANCH.search(s) or regex.match(r"(?:if|for|while)\s*\(", s)):
        return True
    return bool(_ASSIGNS.match(s) or _CALL.match(s) or _LEAVES.match(s) or _BLOCK.match(s) or _DECLARES.match(s) or _TWO.search(s))


_TODO = regex.compile(r"(?i)^\W*(?:todo|fixme|xxx|tbd|hack|wip)\b")
#: What tools and people put where documentation is missing, as whole lines.
_PLACEHOLDER = regex.compile(
    r"""(?ix)^\W*(?: none | null | nil | nan | undefined | n/?a | na | tba | docstring | doc(?:s|umentation)? | description | summary | comment | missing | unknown | empty | \w*\s*here
    | (?:no|missing|insert|add|write|your|undocumented|put)\s+(?:a\s+)?(?:doc\w*|description|comments?|summary|text)(?:\s+(?:yet|here|available|provided|given|found|needed))* | undocumented | not\s+(?:yet\s+)?documented(?:\s+yet)? | to\s+be\s+(?:documented|done|defined|written|determined|added)
    | auto-?\s*generated\s+(?:method|function|constructor|catch|class|code)?\s*(?:stub|block|body|docs?|docstring|comment)\b.* | (?:this\s+is\s+a\s+)?placeholder(?:\s+(?:text|doc\w*|description|comment))?(?:\W*(?:to\s+be\s+replaced|for\s+now|please|replace|until)\b.*)? | lorem\s+ipsum\b.* | (?:documentation|description|docs?)\s+(?:goes|will\s+go|to\s+follow|follows|coming|pending)\b.* | \{?@?inherit-?doc\}? )\W*$"""
)
_TAGS = regex.compile(r"""(?ix)\{@\w+\s*([^}]*)\} | ^\s*[@\\](?:param|arg|argument|prop|property)\s*(?:\{[^}]*\}\s*|\[[a-z, ]+\]\s*)?[\[\]\w.$*=]*\s*-? | [@\\][a-z]\w*(?:\s*\{[^}]*\})? | ^\s*:\w+(?:\s+[\w\s.\[\],|*]+?)?: | ^\s*(?:args|arguments|params?|parameters|returns?|raises|yields|throws|exceptions?|attributes|notes?|examples?|see\s+also|keyword\s+args)\s*:?\s*$ | </?[a-z][^<>]*>""")
_PARAM_LINE = regex.compile(r"^\s*[-*]?\s*`?\*{0,2}(\w+)`?\s*(?:\([^)]*\))?\s*:")
_WORD = regex.compile(r"\p{Han}|\p{Hiragana}|\p{Katakana}|[\p{L}\p{M}]+(?:['’][\p{L}]+)*")
_SPLIT = regex.compile(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?[\p{Ll}\p{Lo}\p{M}]+|\p{L}")
_SIGNS = regex.compile(r"^\s*(?://+[!/<]*|/\*+!?|\*+/|\*(?!\*)|#+[!:]?|;+)\s?|\s*\*+/\s*$")


def comment_text(raw: str) -> str:
    """A comment without its signs."""
    return "\n".join(_SIGNS.sub("", _SIGNS.sub("", x) if x.lstrip().startswith("/*") or x.rstrip().endswith("*/") else x).strip() for x in raw.strip().split("\n")).strip("\n")


def doc_string(raw: str) -> str:
    """The text of a Python doc string literal."""
    body = raw.lstrip("rRuU")
    q = 3 if body[:3] in ('"""', "'''") else 1
    return body[q:-q].strip()


def words_of(name: str) -> set[str]:
    """The words of a name in any case style, lower case, and the name as a whole."""
    return {w.lower() for w in _SPLIT.findall(name)} | {name.lower(), name.lower().replace("_", "")}


def kept_lines(text: str) -> list[str]:
    """The lines of documentation that document: no directive, licence, ruler, code or placeholder."""
    out = []
    for line in text.replace("\r", "").split("\n"):
        s = line.strip()
        if _RULER.match(s) or _DIRECTIVE.match(s) or _LICENCE.search(s) or _TODO.match(s) or _PLACEHOLDER.match(s) or is_code(s):
            continue
        out.append(s)
    return out


def is_trivial(text: str | None, name: str, parameters: list[str] | None = None) -> bool:
    if not text or not text.strip():
        return True
    known = {p.lower().lstrip("*&") for p in parameters or [] if p}
    own = words_of(name)
    n = 0
    for line in kept_lines(text):
        line = _TAGS.sub(r" \1 ", line)
        if (m := _PARAM_LINE.match(line)) and m[1].lower() in known:
            line = line[m.end() :]
        for w in _WORD.findall(line):
            w = w.lower()
            n += w not in known and w not in own
        # identifiers in snake case fall apart into words; as wholes they may be the name or a parameter
        for ident in regex.findall(r"\b[\p{L}\d]+(?:_[\p{L}\d]+)+\b", line):
            if ident.lower() in own or ident.lower() in known:
                n -= sum(w.lower() not in own and w.lower() not in known for w in _WORD.findall(ident))
    return n < LEAST_WORDS


def capture(snippet: str, path: str | None = None) -> tuple[str, str, str]:
    """Of a snippet: the comment above, the doc string (''), the code without them."""
    text = snippet.removeprefix("﻿").replace("\r\n", "\n")
    if not (path or "").endswith((".js", ".ts", ".java", ".go", ".mjs", ".jsx", ".tsx", ".c", ".h", ".cpp", ".cs", ".rs", ".kt", ".scala")):
        if m := PYTHON.match(text):
            inner = m["docstr"] or ""
            body = m["body"].replace(inner, "", 1) if inner else m["body"]
            return comment_text(m["doc"]), doc_string(inner) if inner else "", (m["head"] + body).strip("\n")
    m = BRACED.match(text)
    if not m:
        return "", "", text
    return comment_text(m["doc"]), "", ((m["head"] or "") + (m["body"] or "") + m["rest"]).strip("\n")


def pair(name: str, path: str | None, snippet: str, docstring: str | None, parameters: list[str] | None) -> tuple[str, str, str] | None:
    """`(description, where, code)` of a function, or None if its documentation is missing or trivial."""
    own = name.split("(")[0].rpartition(".")[2]
    above, inside, code = capture(snippet, path)
    for text, where in ((docstring, "docstring"), (above, "comment"), (inside, "doc string")):
        if not is_trivial(text, own, parameters):
            return "\n".join(kept_lines(text)).strip(), where, code
    return None


def documented(contexts: DataFrame, kinds: tuple[str, ...] = ("function", "method")) -> DataFrame:
    """`qualified_name, element_type, description, found_in, code` of the functions with documentation."""
    kind = F.lower(trimmed("element_type"))
    # the version is chosen by narrow columns; texts follow for the chosen rows alone
    version = F.struct("indexed_at", "context_id")
    chosen = contexts.where("qualified_name is not null").groupBy("qualified_name").agg(F.max(version).alias("v")).select(F.col("v.context_id").alias("context_id"))
    rows = contexts.where(kind.isin(*kinds) & F.col("code_snippet").rlike(r"\S")).select("context_id", "qualified_name", kind.alias("element_type"), "file_path", "code_snippet", "docstring", "parameters")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, n, k, p, s, d, a in zip(*(b[c] for c in ("context_id", "qualified_name", "element_type", "file_path", "code_snippet", "docstring", "parameters")), strict=True):
                if got := pair(n, p, s, d, None if a is None else list(a)):
                    out.append((i, n, k, *got))
            yield pd.DataFrame(out, columns=["context_id", "qualified_name", "element_type", "description", "found_in", "code"])

    found = rows.where("qualified_name is not null").mapInPandas(run, "context_id bigint, qualified_name string, element_type string, description string, found_in string, code string")
    return found.join(chosen, "context_id", "left_semi").drop("context_id")
