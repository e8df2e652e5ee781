"""Finding nodes by name: strategies, predicates, the fuzzy cascade."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.graph import CODE_LABELS, Graph

#: Words that a query of several words doesn't search for.
STOP_WORDS = frozenset("the a an in on at for to of".split())
#: Nodes of an answer at most.
CAP = 50
#: The kinds of signs in a query.
_SIGNS = re.compile(r"(?P<anything>\.\*)|(?P<star>\*)|(?P<both>&)|(?P<either>\|)|(?P<round>[()])|(?P<special>[+?^$\[\]\\])|(?P<gap>\s+)|(?P<dot>\.)|(?P<name>[A-Za-z_][A-Za-z0-9_]*(?![^\s*&|()+?^$\[\]\\.]))|(?P<other>.)")


def _terms(signs: list[tuple[str, str]], at: str) -> list[str]:
    """What lies between the signs of a kind, without blank pieces."""
    out = [""]
    for kind, text in signs:
        if kind == at:
            out.append("")
        else:
            out[-1] += text
    return [t.strip() for t in out if t.strip()]


def strategy_of(query: str) -> tuple[str, str]:
    """How a query is meant (`and`, `pattern`, `regex`, `exact`), and its normal form.

    A query is a row of signs, and the kinds that occur in it decide: conjunction before alternatives of plain terms,
    these before a star that stands for any text, then several words (all wanted, but for stop words), then any other
    sign of regular expressions, then a full name of three dotted parts or more; all else is a part of a name.
    """
    signs = [(m.lastgroup, m[0]) for m in _SIGNS.finditer(query.strip())]
    kinds = {kind for kind, _ in signs}
    whole = "".join(text for _, text in signs)
    is_regex = bool(kinds & {"anything", "star", "either", "round", "special"})
    if signs and signs[0][0] != "anything":
        for how, joint, sign in (("and", "both", "&"), ("pattern", "either", "|")):
            if joint in kinds and (how == "and" or kinds.isdisjoint({"anything", "star", "round", "special"})) and len(terms := _terms(signs, joint)) > 1:
                return how, sign.join(terms)
    if "star" in kinds and kinds.isdisjoint({"anything", "special", "both", "either"}):
        return "regex", "".join(".*" if kind == "star" else text for kind, text in signs)
    words = [w for w in _terms(signs, "gap") if w.lower() not in STOP_WORDS]
    if "gap" in kinds and words:
        return "and", "&".join(words)
    if is_regex:
        return "regex", whole
    dots = sum(kind == "dot" for kind, _ in signs)
    return ("exact" if dots >= 2 and kinds <= {"name", "dot"} else "pattern"), whole


def matches(column: str, query: str, strategy: str, case: bool = False) -> Column:
    """Whether a name answers a query. Terms are literal text; a regular expression must match the whole name."""
    col = F.col(column) if case else F.lower(column)
    fold = (lambda t: t) if case else str.lower
    if strategy == "and":
        return reduce(lambda a, b: a & b, [col.contains(fold(t)) for t in query.split("&")])
    if strategy == "regex":
        # the flag instead of lower case, which would turn \D into \d
        return F.col(column).rlike(("" if case else "(?i)") + f"^(?:{query})$")
    return reduce(lambda a, b: a | b, [col.contains(fold(t)) for t in query.split("|")])


def has_decorator(text: str) -> Column:
    return F.exists("decorators", lambda d: F.lower(d).contains(text.lower()))


def completed(names: list[str], project: str) -> list[str]:
    """Names with the project in front."""
    low = project.lower()
    return [n if n.lower() == low or n.lower().startswith(low + ".") else f"{project}.{n}" for n in names]


def capped(rows: DataFrame, cap: int | None, *order: Column | str) -> DataFrame:
    """The first rows of a total order; all of them without a cap."""
    return rows if cap is None else rows.orderBy(*order).limit(cap)


def search_exact(graph: Graph, names: list[str], project: str | None = None, cap: int | None = CAP) -> DataFrame:
    """`qn, name, label, path` of nodes by full name; the path is that of the defining file where the node has none."""
    wanted = completed(names, project) if project else names
    found = graph.nodes.where(F.col("qn").isin(wanted)).select("qn", "name", "label", "path")
    files = graph.label("File").select(F.col("qn").alias("src"), F.col("path").alias("file_path"))
    defined = graph.rel("DEFINES").where(F.col("dst").isin(wanted)).join(files, "src").groupBy(F.col("dst").alias("qn")).agg(F.min("file_path").alias("file_path"))
    rows = found.join(defined, "qn", "left").select("qn", "name", "label", F.coalesce("path", "file_path").alias("path")).distinct()
    return capped(rows, cap, "qn")


def find_nodes(graph: Graph, query: str, project: str | None = None, labels: tuple[str, ...] | None = CODE_LABELS, case: bool = False, decorator: str | None = None, cap: int | None = CAP, strategy: str | None = None) -> DataFrame:
    """`qn, name, label, path` of the nodes that answer a query, by the strategy it suggests.

    A full name that isn't found is searched as a part of names instead.
    """
    how, normal = (strategy, query) if strategy else strategy_of(query)
    scope = F.lit(True)
    if project:
        scope = (F.col("project") == project) & F.col("qn").startswith(project + ".")
    if labels:
        scope = scope & F.col("label").isin(*labels)
    if decorator:
        scope = scope & has_decorator(decorator)
    if how != "exact":
        return capped(graph.nodes.where(scope & matches("name", normal, how, case)).select("qn", "name", "label", "path"), cap, "qn")
    wanted = completed([normal], project) if project else [normal]
    rank = F.when(F.col("qn").isin(wanted), 0).when(matches("name", normal, "pattern", case), 1)
    rows = graph.nodes.where(scope).withColumn("rank", rank).where("rank is not null")
    best = rows.agg(F.min("rank").alias("best"))
    rows = rows.join(F.broadcast(best), F.col("rank") == F.col("best"))  # one row
    return capped(rows.select("qn", "name", "label", "path"), cap, "qn")


def fuzzy_search(graph: Graph, requests: list[str], project: str, cap: int = 1) -> DataFrame:
    """`request, qn, name, label, quality`: the best nodes for each request.

    The steps, of which the first with an answer counts: the full name; the same in the project; names that end with
    the request's last two parts (or its only one); all parts (two at least) somewhere in the full name; the simple
    name, in any case; a simple name that contains it. One scan ranks each node for all requests (a caller's short list,
    so an array of literals); the least rank of a request is then an aggregate.
    """
    qn, low_qn, low_name = F.col("qn"), F.lower("qn"), F.lower("name")
    ranks = []
    for r in dict.fromkeys(requests):
        bare = re.sub(r"\.(py|js|ts|java|go)$", "", r)
        parts = bare.split(".")
        step = F.when(qn == bare, 1).when(qn == f"{project}.{bare}", 2).when(qn.endswith("." + ".".join(parts[-2:])), 3)
        if len(parts) >= 2:
            step = step.when(reduce(lambda a, b: a & b, [low_qn.contains(p.lower()) for p in parts if p] or [F.lit(False)]), 4)
        step = step.when(low_name == parts[-1].lower(), 5).when(low_name.contains(bare.lower()), 6)
        ranks.append(F.struct(F.lit(r).alias("request"), step.alias("step")))
    ranked = graph.label(*CODE_LABELS).select("qn", "name", "label", F.explode(F.filter(F.array(*ranks), lambda x: x["step"].isNotNull())).alias("r"))
    ranked = ranked.select("r.request", "r.step", "qn", "name", "label")
    if cap == 1:
        rows = ranked.groupBy("request").agg(F.min(F.struct("step", "qn", "name", "label")).alias("v")).select("request", "v.*")
    else:
        best = ranked.groupBy("request").agg(F.min("step").alias("best"))
        rows = ranked.join(best, "request").where("step = best")
        w = Window.partitionBy("request").orderBy("qn")
        rows = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)
    quality = F.when(F.col("step") <= 2, "exact").when(F.col("step") == 3, "suffix").when(F.col("step") == 4, "partial").otherwise("fuzzy")
    return rows.select("request", "qn", "name", "label", quality.alias("quality"))


def as_list(col: Column) -> Column:
    """A list that may have been stored as JSON or as one plain string."""
    return F.when(col.isNull() | (F.trim(col) == ""), F.expr("cast(array() as array<string>)")).otherwise(F.coalesce(F.when(col.startswith("["), F.from_json(col, "array<string>")), F.array(col)))


def compact(*columns: str) -> Column:
    """A row as JSON without its null fields."""
    return F.to_json(F.struct(*columns))
