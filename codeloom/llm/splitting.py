"""Line ranges above a size limit, cut into overlapping pieces at natural boundaries.

The pieces of n lines are given by cut places 0 < c1 < c2 < ... < n. Piece k has the lines from c(k-1) less the overlap
to c(k), so a piece but the first adds `limit - overlap` lines at most. Dynamic programming over the places minimises
the sum of the cuts' penalties and of the squared distances of the pieces' sizes from an even split. A place is the more
natural the less it is indented, the fewer brackets are open at it, after a blank line and before a definition; it is
unnatural after a line that goes on or before one that closes something.

Defined results: of several rows of a name the one with the latest time counts (on a tie the greatest id); null names,
null, reversed or non-positive lines and files that don't exist or have null code give no pieces; end_line beyond the
file is the file's last line; lines end at `\\n` or `\\r\\n`, a final line end starts no line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a piece at most; lines that a piece repeats of the one before.
LIMIT, OVERLAP = 40, 4
#: Weight of the squared distance from an even size, as a share of the limit.
UNEVEN = 1.0

_STARTS = regex.compile(r"\s*(?:@\w|(?:export |default |public |private |protected |static |final |abstract |async )*(?:def|class|function|func|interface|type|struct|enum|impl|fn)\b|/\*\*|///?\s|#\s)")
_CLOSES = regex.compile(r"\s*(?:[)\]}]|else\b|elif\b|except\b|finally\b|catch\b|case\b.*:$)")
_GOES_ON = regex.compile(r"(?:[,(\[{\\:=+\-*/&|.<?]|=>|\b(?:return|and|or|not|in|is))\s*$")


#: Ranges of a file that are cut together, about.
TOGETHER = 1000


def penalties(lines: list[str]) -> np.ndarray:
    """Of each place between two lines (1 .. n - 1), how unnatural a cut there is."""
    n = len(lines)
    depth, indent, last = np.zeros(n + 1), np.zeros(n + 1), 0
    filled = [x for x in lines if x.strip()]
    base = min((len(x) - len(x.lstrip()) for x in filled), default=0)
    following = 0.0
    for i in range(n - 1, -1, -1):
        s = lines[i].lstrip()
        if s:
            following = (len(lines[i].expandtabs(4)) - len(s.expandtabs(4)) - base) / 2
        indent[i] = following
    for i, x in enumerate(lines):
        last += x.count("(") + x.count("[") - x.count(")") - x.count("]")
        depth[i + 1] = last = max(0, last)
    cost = np.empty(max(0, n - 1))
    for i in range(1, n):
        above, below = lines[i - 1], lines[i]
        c = 1.0 + min(8.0, max(0.0, indent[i])) + 3.0 * min(4.0, depth[i])
        if not above.strip():
            c -= 0.75
        elif not below.strip():
            c -= 0.5
        if _STARTS.match(below):
            c -= 0.5
        if _CLOSES.match(below):
            c += 3
        if _GOES_ON.search(above):
            c += 3
        if _STARTS.match(above) and above.strip():
            c += 2
        cost[i - 1] = max(0.0, c)
    return cost


def split_lines(lines: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The pieces of lines as (first, end), the end not included; one piece if they are few enough."""
    n = len(lines)
    if n <= limit:
        return [(0, n)] if n else []
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    step = limit - overlap
    pieces = 1 + -(-(n - limit) // step)
    even = (n + overlap * (pieces - 1)) / pieces
    cost = np.append(penalties(lines), 0.0)  # a piece that ends with the range isn't cut
    sizes = np.arange(1, step + 1) + overlap
    uneven = UNEVEN * ((sizes - even) / limit * 4) ** 2
    best, came = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    first = np.arange(1, limit + 1)
    # pieces must be longer than the overlap, or the next one would reach before them
    least = overlap + 1
    best[1 : limit + 1] = cost[:limit] + UNEVEN * ((first - even) / limit * 4) ** 2
    best[1:least] = np.inf
    for i in range(least + 1, n + 1):
        low = max(1, i - step)
        all_ = best[low:i] + uneven[i - low - 1 :: -1][: i - low] + cost[i - 1]
        k = int(np.argmin(all_))
        if all_[k] < best[i]:
            best[i], came[i] = all_[k], low + k
    out, end = [], n
    while end:
        start = int(came[end])
        out.append((max(0, start - overlap) if start else 0, end))
        end = start
    return out[::-1]


def code_lines(code: str) -> str:
    """SQL: the array of the lines of a column."""
    return f"case when {code} = '' then array() else split(regexp_replace({code}, '\\\\r?\\\\n\\\\z', ''), '\\\\r?\\\\n', -1) end"


def latest_tasks(tasks: DataFrame) -> DataFrame:
    """One row per qualified_name: `qualified_name, repo_name, file_path, start_line, end_line`."""
    version = F.struct(F.coalesce("created_at", F.lit(float("-inf"))).alias("at"), "task_id", "repo_name", "file_path", "start_line", "end_line")
    one = tasks.where("qualified_name is not null").groupBy("qualified_name").agg(F.max(version).alias("v"))
    return one.select("qualified_name", "v.repo_name", "v.file_path", "v.start_line", "v.end_line")


def oversized(tasks: DataFrame, files: DataFrame, limit: int = LIMIT) -> DataFrame:
    """`qualified_name, start_line, lines` of the tasks whose lines in their file exceed the limit.

    Ranges that can't exceed it are dropped first; then each needed file is chosen once by its narrow columns, so the
    code joins only the tasks that need it, and only their lines leave the JVM.
    """
    wide = latest_tasks(tasks).where(f"start_line >= 1 and end_line >= start_line and end_line - start_line + 1 > {limit}")
    chosen = files.groupBy("repo_name", "file_path").agg(F.max(F.struct(F.col("code").isNotNull().alias("has"), "last_modified", "file_id")).alias("v"))
    needed = wide.join(chosen, ["repo_name", "file_path"]).select("qualified_name", "start_line", "end_line", F.col("v.file_id").alias("file_id"))
    # the ranges of a file come together first, some at a time, so that its lines are parted once for all of them
    groups = needed.groupBy("file_id").agg(F.ceil(F.count("*") / F.lit(TOGETHER)).alias("groups"))
    ranges = needed.join(groups, "file_id").groupBy("file_id", F.pmod(F.xxhash64("qualified_name"), "groups").alias("group")).agg(F.collect_list(F.struct("qualified_name", "start_line", "end_line")).alias("ranges"))
    code = files.where("code is not null").select("file_id", "code").dropDuplicates(["file_id"])
    lines = ranges.join(code, "file_id").select("ranges", F.expr(code_lines("code")).alias("all"))
    each = lines.select("all", F.explode("ranges").alias("r")).where(f"least(r.end_line, size(all)) - r.start_line + 1 > {limit}")
    return each.select("r.qualified_name", "r.start_line", F.slice("all", F.col("r.start_line"), F.least("r.end_line", F.size("all")) - F.col("r.start_line") + 1).alias("lines"))


def pieces(ranges: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """`qualified_name, piece_no, start_line, end_line, code`: the pieces of `oversized` ranges, numbered from 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, at, lines in zip(b["qualified_name"], b["start_line"].tolist(), b["lines"], strict=True):
                lines = list(lines)
                for k, (first, end) in enumerate(split_lines(lines, limit, overlap)):
                    rows.append((name, k + 1, at + first, at + end - 1, "\n".join(lines[first:end])))
            yield pd.DataFrame(rows, columns=["qualified_name", "piece_no", "start_line", "end_line", "code"])

    return ranges.mapInPandas(run, "qualified_name string, piece_no int, start_line int, end_line int, code string")
