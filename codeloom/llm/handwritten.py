"""Files that nobody wrote by hand: generated, minified, third-party, bulk data.

Per file, layout statistics of the whole text (longest and mean line, shares of white space, word characters and
literals, density of numeric literals, the longest encoded run) are held against thresholds of its language. They find
minified code, bulk data and, by lines that repeat a few shapes throughout, generated code, the latter more easily in a
folder of generated code. Generated files are known besides by a name that tools give or by a declaration in the comment
that opens or closes the file (a mention in a doc string or in between is none), foreign ones by their folder or such a
declaration. Files with the code of a third-party
file, line ends and a leading byte-order mark aside, are found by joining 128-bit hashes of the code.

Defined results: null, empty and blank code is hand-written (nothing to tell it by); a null path or language is unknown,
so the file's text decides; repeated rows of a file_id count once, with the first kind that any of them has.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.lineage import cut

#: Folders of foreign code and of generated code, by convention of the package managers and tools.
FOREIGN_FOLDERS = frozenset("vendor vendors _vendor vendored third_party third-party thirdparty 3rdparty node_modules bower_components jspm_packages godeps site-packages dist-packages pods carthage".split())
GENERATED_FOLDERS = frozenset("generated __generated__ gen autogen generated-sources generated_sources".split())
#: Names that tools give to their files.
GENERATED_NAME = regex.compile(r"(?i)(_pb2(_grpc)?\.pyi?|[._]pb\.(js|ts|go|cc|h)|_pb\.d\.ts|\.pb\.\w+|\.g\.\w+|\.gen(erated)?\.\w+|_generated\.\w+|\.designer\.\w+|^zz_generated.*)$")
MINIFIED_NAME = regex.compile(r"(?i)[.-]min\.(m?js|css|ts)$")
#: Declarations, each at the start of a comment line.
GENERATED_MARK = regex.compile(
    r"""(?ix) ^\W*( @generated\b | (code|file)\s+(is\s+)?(auto-?\s?)?generated\b | (this\s+((file|code)\s+)?(is|was|has\s+been)\s+)?(an?\s+)?auto(matically)?[-\s]*generated(\s+(by|with|from|file|code)\b|\s*>)
    | this\s+(file|code)\s+(is|was|has\s+been)\s+(an?\s+)?((auto(matically)?[-\s]*)?(generated|created|produced)|(generated|created|produced)\s+automatically)\b | generated\s+(by|with|from)\b
    | (please\s+)?do\s+not\s+(edit|modify)\b(?=.*\b(generated|file|by\s+hand)\b) | <auto-?generated )"""
)
GENERATED_ANNOTATION = regex.compile(r"(?m)^\s*@(\w+\.)*Generated\(")
FOREIGN_MARK = regex.compile(
    r"""(?ix) ^\W*( upstream\s*:\s*\S | (vendored|copied|imported|taken|adapted)\s+(verbatim\s+)?from\s+(https?:|the\s+\S+\s+(project|library|package)) | (third|3rd)[-\s]party\s+(code|file|library)\b
    | ![^\n]*\bv?\d+\.\d+(\.\d+)?\b[^\n]*(\blicen[cs]e|\(c\)|©|copyright) | @license\b | this\s+(file|code)\s+is\s+part\s+of\s+(the\s+)?\S+\s+(library|package)\b )"""
)

_LITERALS = regex.compile(
    r"""(?P<long>\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z))|(?P<note>/\*[\s\S]*?(?:\*/|\Z)|(?<![:\w])//[^\n]*|(?<!\S)\#[^\n]*)|(?P<text>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<num>(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*\.?\d*(?:[eE][-+]?\d+)?)\w*)"""
)
#: What a line's shape leaves out.
_PLAIN = (string.ascii_letters + string.digits + "_ \t\r").encode()
_WORDS = regex.compile(r"\w+")
_RUN = regex.compile(r"[A-Za-z0-9+/=]{40,}|(?:\\x[0-9a-fA-F]{2}){12,}")


@dataclass(frozen=True)
class Limits:
    """Thresholds of a language. Minified: mean line, share of the text in long lines, white space at most."""

    mean_line: float = 200.0
    long_line: int = 250
    long_share: float = 0.6
    spaces: float = 0.12
    #: Bulk data: literals' share of the words, and their characters at least.
    literals: float = 0.9
    least: int = 600
    #: Generated without saying so: the share of lines of three shapes, of so many lines at least.
    repeated: float = 0.9
    repeated_lines: int = 25
    #: The same in a folder of generated code, which alone says nothing of a file.
    repeated_there: float = 0.75
    lines_there: int = 5


#: Languages whose lines run longer or shorter by habit; JSON holds nothing but literals, so only numbers make it data.
LIMITS = {"javascript": Limits(), "typescript": Limits(), "css": Limits(mean_line=250), "python": Limits(mean_line=300, spaces=0.08), "java": Limits(mean_line=300), "go": Limits(mean_line=300), "cpp": Limits(mean_line=300), "json": Limits(mean_line=1e9, long_share=2)}
#: The languages of file name extensions.
LANGUAGES = {"py": "python", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "json": "json", "h": "cpp", "hpp": "cpp", "cpp": "cpp", "cc": "cpp", "c": "cpp", "css": "css"}


def language_of(path: str | None, language: str | None) -> str:
    """The language of the path's extension, else the one stated (lower case), else ''."""
    ext = (path or "").rpartition("/")[2].rpartition(".")
    return LANGUAGES.get(ext[2].lower(), "") if ext[1] else (language or "").strip().lower()


def plain_code(code: str) -> str:
    """Code without a leading byte-order mark, lines ended by `\\n`."""
    return code.removeprefix("﻿").replace("\r\n", "\n")


@dataclass
class Layout:
    lines: int
    longest: int
    mean: float
    long_share: float
    spaces: float
    alnum: float
    literals: float
    literal_chars: int
    numbers: float
    encoded: int


def layout(code: str, limits: Limits) -> Layout:
    """Statistics of non-blank code."""
    sizes = [n for n in map(len, code.split("\n")) if n]
    total = len(code)
    solid = sum(map(len, code.split()))
    text, nums, long_texts, outside, last = 0, 0, 0, 0, 0
    for m in _LITERALS.finditer(code):
        outside += sum(map(len, _WORDS.findall(code, last, m.start())))
        last, size = m.end(), m.end() - m.start()
        kind = m.lastgroup
        if kind == "text":
            text += size
        elif kind == "num":
            nums += size
        elif kind == "long":
            body = m[0]
            # a long string of data has hardly a blank between its digits and codes, or none but line ends
            if size > 400 and (sum(map(len, body.split(" "))) > 0.97 * size or sum(map(str.isdigit, body)) > 0.3 * size):
                long_texts += size
    outside += sum(map(len, _WORDS.findall(code, last)))
    literal = text + nums + long_texts
    words = sum(map(len, _WORDS.findall(code)))
    return Layout(
        lines=len(sizes), longest=max(sizes, default=0), mean=sum(sizes) / max(1, len(sizes)), long_share=sum(n for n in sizes if n > limits.long_line) / total,
        spaces=1 - solid / total, alnum=words / total, literals=literal / max(1, literal + outside), literal_chars=literal, numbers=nums / max(1, solid), encoded=max(map(len, _RUN.findall(code)), default=0),
    )


def _table_like(code: str) -> bool:
    """Rows of separated values and nothing else."""
    rows = [r for r in code.split("\n") if r.strip()]
    if len(rows) < 20 or any(c in code for c in "(){}=") or code.lstrip()[:1] in "#/*\"'<":
        return False
    for sep in (",", "\t", ";", "|"):
        fields = [r.count(sep) for r in rows]
        most = max(set(fields), key=fields.count)
        if most and fields.count(most) >= 0.95 * len(rows) and not (most == 1 and sum(r.rstrip().endswith(sep) for r in rows) > len(rows) / 2):
            return True
    return False


def _lines(code: str) -> Iterator[str]:
    """The lines from the start, one at a time."""
    at = 0
    while (end := code.find("\n", at)) >= 0:
        yield code[at:end]
        at = end + 1
    yield code[at:]


def _lines_back(code: str) -> Iterator[str]:
    """The lines from the end, one at a time."""
    end = len(code)
    while (at := code.rfind("\n", 0, end)) >= 0:
        yield code[at + 1 : end]
        end = at
    yield code[:end]


def opening(code: str) -> list[str]:
    """The lines of the comments that open a file, before its first code; comment signs stay."""
    out, block = [], False
    for line in _lines(code.lstrip()):
        s = line.strip()
        if block:
            out.append(s)
            block = "*/" not in s
        elif s.startswith("/*"):
            out.append(s)
            block = "*/" not in s
            if not block and s.rpartition("*/")[2].strip():
                break
        elif s.startswith(("#", "//")) and not regex.match(r"#\s*(include|define|if|ifdef|ifndef|pragma|undef)\b", s):
            out.append(s)
        elif s:
            break
    return out


def closing(code: str) -> list[str]:
    """The comment lines that end a file, after its last code."""
    out = []
    for line in _lines_back(code.rstrip()):
        s = line.strip()
        if s and not s.startswith(("#", "//", "/*", "*")):
            break
        out.append(s)
    return out


def repetition(code: str) -> tuple[float, int]:
    """Which share of the lines have one of the three most common shapes, and how many lines have one.

    A line's shape is what is left without letters, digits and blanks.
    """
    shapes = Counter(x for x in code.encode("utf-8", "replace").translate(None, _PLAIN).split(b"\n") if len(x) > 1 and not x.startswith((b"//", b"#", b"*", b"/*")))
    n = sum(shapes.values())
    return sum(x for _, x in shapes.most_common(3)) / max(1, n), n


def kind_of(path: str | None, language: str | None, code: str | None) -> str | None:
    """`third-party`, `generated`, `minified`, `data`, or None for a file by itself (copies aside)."""
    if code is None or not (text := plain_code(code)).strip():
        return None
    *folders, name = (path or "").replace("\\", "/").split("/")
    folders = {f.lower() for f in folders}
    head = opening(text)
    marks = [*head, *closing(text)]
    if folders & FOREIGN_FOLDERS or any(FOREIGN_MARK.search(x) for x in head):
        return "third-party"
    if GENERATED_NAME.search(name) or any(GENERATED_MARK.search(x) for x in marks):
        return "generated"
    lang = language_of(path, language)
    if lang == "java" and GENERATED_ANNOTATION.search(text):
        return "generated"
    limits = LIMITS.get(lang, Limits())
    if MINIFIED_NAME.search(name):
        return "minified"
    s = layout(text, limits)
    if lang == "json":
        return "data" if s.literal_chars > 2000 and (s.numbers > 0.6 or s.encoded > 0.8 * len(text)) else None
    if s.literal_chars >= limits.least and s.literals >= limits.literals or s.encoded > 0.9 * len(text) or _table_like(text):
        return "data"
    if s.long_share >= limits.long_share and s.spaces <= limits.spaces and s.mean >= limits.mean_line and s.alnum > 0.3:
        return "minified"
    same, n = repetition(text)
    share, least = (limits.repeated_there, limits.lines_there) if folders & GENERATED_FOLDERS else (limits.repeated, limits.repeated_lines)
    return "generated" if same >= share and n >= least else None


def file_kinds(files: DataFrame) -> DataFrame:
    """`file_id, kind` of each file that isn't hand-written. files: `file_id, file_path, language, code`."""
    id_type = files.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, p, lang, c in zip(b["file_id"], b["file_path"], b["language"], b["code"], strict=True):
                kind = kind_of(p, lang, c)
                h = xxhash.xxh3_128_digest(plain_code(c).encode("utf-8", "surrogatepass")) if c and c.strip("﻿ \t\r\n") else None
                rows.append((i, kind, h))
            yield pd.DataFrame(rows, columns=["file_id", "kind", "h"])

    own = files.select("file_id", "file_path", "language", "code").mapInPandas(run, f"file_id {id_type}, kind string, h binary")
    own = cut(own)
    foreign = own.where("kind = 'third-party' and h is not null").select("h").distinct().withColumn("foreign", F.lit(True))
    copied = own.where("h is not null").join(foreign, "h", "left").select("file_id", F.when(F.col("foreign"), F.lit("third-party")).otherwise(F.col("kind")).alias("kind"))
    return copied.where("kind is not null").groupBy("file_id").agg(F.max("kind").alias("kind"))
