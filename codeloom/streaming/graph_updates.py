"""A graph of Python files kept current: what changed files touch is read and resolved again, the rest is kept.

The state is a table of file rows (`python_code.SCHEMA` with `path`) and one of resolved calls. Of changed files the old
rows leave and the new ones enter. Calls are resolved again in the changed files, and elsewhere where they name a
definition that came or went; if imports or bases changed, names may lead elsewhere anywhere, so all calls are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.lineage import cut
from codeloom.operators.resolve import resolve_calls
from codeloom.sources import python_code


@dataclass(frozen=True)
class State:
    rows: DataFrame
    calls: DataFrame

    def calls_of(self, modules: DataFrame) -> DataFrame:
        """The resolved calls that leave modules (`module`)."""
        keys = _keys(self.rows.join(modules.select("module").distinct(), "module", "left_semi"))
        return self.calls.join(keys, ["caller", "name", "line"], "left_semi")


def _keys(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'call'").select(F.col("qn").alias("caller"), "name", F.col("n").alias("line"), "module").distinct()


def build(files: DataFrame) -> State:
    """The state of files (`project, path, code`)."""
    rows = cut(python_code.read(files))
    return State(rows, cut(resolve_calls(rows)))


def _modules(paths: DataFrame) -> DataFrame:
    """`module` of paths (`project, path`), as `python_code` names it."""
    path = F.trim(F.regexp_replace(F.translate("path", "\\", "/"), r"\.py$", ""), F.lit("/"))
    parts = F.split(path, "/")
    parts = F.when((parts[0] == F.col("project")) & (F.size(parts) > 1), F.slice(parts, 2, 10_000)).otherwise(parts)
    parts = F.when(F.element_at(parts, -1) == "__init__", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return paths.select(F.array_join(F.concat(F.array("project"), parts), ".").alias("module")).distinct()


def update(state: State, files: DataFrame, changed: DataFrame) -> State:
    """The state after a change: files are all files as they are now, changed the paths (`project, path`) added, modified or deleted."""
    paths = changed.select("project", "path").distinct()
    touched = cut(_modules(paths))
    fresh = cut(python_code.read(files.join(paths, ["project", "path"], "left_semi"), roots=python_code.roots_of(files)))
    old = state.rows.join(touched, "module", "left_semi")
    rows = cut(state.rows.join(touched, "module", "left_anti").unionByName(fresh))
    facts = lambda df, *kinds: df.where(F.col("kind").isin(*kinds)).select("module", "kind", "qn", "name", "target", F.when(F.col("kind") == "base", F.col("n")).alias("n"), "label").distinct()
    unlike = lambda *kinds: facts(old, *kinds).exceptAll(facts(fresh, *kinds)).unionByName(facts(fresh, *kinds).exceptAll(facts(old, *kinds)))
    every = not unlike("base", "import").isEmpty()
    calls = _keys(rows)
    if every:
        again = calls
    else:
        named = unlike("def").select(F.col("name").alias("last")).distinct()
        own = calls.join(touched, "module", "left_semi")
        by_name = calls.withColumn("last", F.substring_index("name", ".", -1)).join(named, "last", "left_semi").select(*calls.columns)
        again = own.unionByName(by_name).distinct()
    again = cut(again.select("caller", "name", "line").distinct())
    kept = state.calls.join(calls.select("caller", "name", "line").distinct(), ["caller", "name", "line"], "left_semi").join(again, ["caller", "name", "line"], "left_anti")
    return State(rows, cut(kept.unionByName(resolve_calls(rows, again))))


def rebuild_calls(state: State, modules: DataFrame) -> State:
    """The state with the calls of modules (`module`) resolved again from what it holds."""
    again = cut(_keys(state.rows.join(modules.select("module").distinct(), "module", "left_semi")).select("caller", "name", "line").distinct())
    return State(state.rows, cut(state.calls.join(again, ["caller", "name", "line"], "left_anti").unionByName(resolve_calls(state.rows, again))))
