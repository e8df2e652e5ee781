"""File listings: what is scanned, languages, folders and files as graph rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Folders that scans leave out, and endings of such folders.
IGNORED = tuple(".git .hg .svn .idea .vscode __pycache__ node_modules bower_components .venv venv env .tox .mypy_cache .pytest_cache build dist target .gradle site-packages".split())
IGNORED_ENDS = (".egg-info", ".dist-info")
#: Extensions of the languages that have definitions.
LANGUAGES = {
    "python": "py", "javascript": "js jsx mjs cjs", "typescript": "ts tsx", "rust": "rs", "go": "go", "scala": "scala sc", "java": "java", "cpp": "cpp h hpp cc cxx hxx hh ixx cppm ccm", "csharp": "cs", "php": "php", "lua": "lua",
}
#: Files that make their folder a package.
INDICATORS = ("__init__.py", "index.js", "index.ts", "Cargo.toml", "package.json", "go.mod", "pom.xml")
#: Bytes of a file at most.
SIZE_CAP = 500_000


def extension(path: Column) -> Column:
    """The lower-case extension, '' without one."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9_]+)$", 1))


def language(path: Column) -> Column:
    """The language of a path's extension, null if it has none here."""
    pairs = [F.lit(x) for name, exts in LANGUAGES.items() for e in exts.split() for x in (e, name)]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def is_ignored(path: Column, folders: tuple[str, ...] = IGNORED, ends: tuple[str, ...] = IGNORED_ENDS) -> Column:
    """Whether a folder on the path is left out."""
    parts = F.split(path, "/")
    above = F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1))
    hit = F.arrays_overlap(above, F.array(*map(F.lit, folders)))
    if not ends:
        return hit
    return hit | F.exists(above, lambda p: reduce(lambda a, b: a | b, [p.endswith(e) for e in ends]))


def rule_pattern(rule: str) -> tuple[str, bool] | None:
    """A line of an ignore file as (regular expression on paths, whether it takes back), or None if it says nothing.

    A slash inside or in front binds it to the root; one at the end means folders only; `**` crosses folders, `*` and
    `?` don't. What lies in a matched folder is matched.
    """
    line = rule.rstrip("\n").strip()
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line.removeprefix("\\")
    folder, line = line.endswith("/"), line.rstrip("/")
    rooted = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            out, i = out + "[" + line[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return ("^" if rooted else "(?:^|/)") + out + ("/" if folder else "(?:/|$)"), back


def ignored_by(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that matches a path ignores it."""
    out = None
    for pattern, back in reversed([p for p in map(rule_pattern, rules) if p]):
        out = F.when(path.rlike(pattern), not back) if out is None else out.when(path.rlike(pattern), not back)
    return F.lit(False) if out is None else out.otherwise(False)


def folders(files: DataFrame, project: str, path: str) -> DataFrame:
    """`project, qn, name, path, is_package` of every folder above a file; a package holds a file that indicates one."""
    parts = F.split(F.col(path), "/")
    rows = files.select(F.col(project).alias("project"), parts.alias("parts")).where(F.size("parts") > 1)
    levels = rows.select("project", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"), "parts")
    direct = (F.col("k") == F.size("parts") - 1) & F.element_at("parts", -1).isin(*INDICATORS)
    one = levels.select("project", F.array_join(F.slice("parts", 1, F.col("k")), "/").alias("path"), direct.alias("package"))
    one = one.groupBy("project", "path").agg(F.max("package").alias("is_package"))
    return one.select("project", F.concat_ws(".", "project", F.replace("path", F.lit("/"), F.lit("."))).alias("qn"), F.substring_index("path", "/", -1).alias("name"), "path", "is_package")


def files_with_parents(files: DataFrame, project: str, path: str) -> DataFrame:
    """`project, qn, name, extension, path, parent`: files as nodes; the parent is a folder's name or the project."""
    p = F.col(path)
    stem = F.regexp_replace(p, r"\.[^./]*$", "")
    folder = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    dotted = lambda c: F.replace(c, F.lit("/"), F.lit("."))
    rows = files.select(F.col(project).alias("project"), F.concat_ws(".", F.col(project), dotted(stem)).alias("qn"), F.substring_index(p, "/", -1).alias("name"), extension(p).alias("extension"), p.alias("path"), F.when(folder == "", F.col(project)).otherwise(F.concat_ws(".", F.col(project), dotted(folder))).alias("parent"))
    return rows.distinct()


def listing(files: DataFrame, project: str, path: str, depth: int = 3, most: int = 20) -> DataFrame:
    """`project, parent, name, is_folder, position` of a folder tree's first levels: folders first, then names in any case; `most` per folder, and a row that counts the rest."""
    parts = F.split(F.col(path), "/")
    levels = files.select(F.col(project).alias("project"), parts.alias("parts")).distinct()
    levels = levels.select("project", "parts", F.explode(F.sequence(F.lit(1), F.least(F.lit(depth), F.size("parts")))).alias("k"))
    one = levels.select("project", F.array_join(F.slice("parts", 1, F.col("k") - 1), "/").alias("parent"), F.element_at("parts", F.col("k")).alias("name"), (F.col("k") < F.size("parts")).alias("is_folder")).distinct()
    w = Window.partitionBy("project", "parent").orderBy(F.col("is_folder").desc(), F.lower("name"), "name")
    ranked = one.withColumn("position", F.row_number().over(w))
    rest = ranked.where(F.col("position") > most).groupBy("project", "parent").agg(F.concat(F.count("*").cast("string"), F.lit(" more")).alias("name"))
    return ranked.where(F.col("position") <= most).unionByName(rest.withColumn("is_folder", F.lit(False)).withColumn("position", F.lit(most + 1)).select(*ranked.columns))
