"""One object for all questions on a graph: each method gives a DataFrame, and the tables are views for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import diff, files, graph, resolve, search, structure, text, traverse, vector
from codeloom.operators.graph import Graph
from codeloom.sources import exports, python_code


class CodeGraph:
    """A graph, with its source files (`project, path, code`) and embeddings (`qn, embedding`) if there are."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, embeddings: DataFrame | None = None) -> None:
        self.spark, self.graph, self.sources, self.embeddings = spark, Graph(nodes, edges), sources, embeddings

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> CodeGraph:
        """A graph stored by `write`."""
        g = graph.read_graph(spark, path)
        return cls(spark, g.nodes, g.edges)

    @classmethod
    def from_export(cls, spark: SparkSession, path: str) -> CodeGraph:
        g = exports.read_export(spark, path)
        return cls(spark, g.nodes, g.edges)

    @classmethod
    def from_python(cls, spark: SparkSession, sources: DataFrame) -> CodeGraph:
        """The graph of Python files (`project, path, code`): folders, files, definitions, containment, inheritance, overrides and calls."""
        rows = resolve.cut(python_code.read(sources))
        listed = sources.where(F.col("code").isNotNull())
        folders, own = files.folders(listed, "project", "path"), files.files_with_parents(listed, "project", "path")
        empty = lambda kind: F.lit(None).cast(kind)
        node = lambda df, label, **c: df.select(
            "project", label.alias("label"), "qn", "name", *(c.get(k, empty(t)).alias(k) for k, t in (("path", "string"), ("start_line", "int"), ("end_line", "int"), ("docstring", "string"), ("decorators", "array<string>"), ("is_package", "boolean")))
        )
        col, defined = F.col, rows.where("kind in ('def', 'var')").withColumn("project", F.substring_index("module", ".", 1))
        nodes = node(folders, F.lit("Folder"), path=col("path"), is_package=col("is_package")).unionByName(node(own.select("project", "qn", "name", "path"), F.lit("File"), path=col("path")))
        nodes = nodes.unionByName(node(listed.select("project", col("project").alias("qn"), col("project").alias("name")).distinct(), F.lit("Project")))
        nodes = nodes.unionByName(node(defined, col("label"), start_line=col("start_line"), end_line=col("end_line"), docstring=col("docstring"), decorators=col("decorators")))
        edge = lambda df, rel, a, b: df.select(a.alias("src"), rel.alias("rel"), b.alias("dst"), empty("string").alias("version"))
        up = F.regexp_replace("qn", r"\.[^.]*$", "")
        kind = F.when((col("label") == "Method"), "DEFINES_METHOD").when((col("label") == "Variable") & (up != col("module")), "DEFINES_VARIABLE").otherwise("DEFINES")
        edges = edge(folders, F.lit("CONTAINS_FOLDER"), up, col("qn")).unionByName(edge(own, F.lit("CONTAINS_FILE"), col("parent"), col("qn"))).unionByName(edge(defined, kind, up, col("qn")))
        edges = edges.unionByName(edge(resolve.inheritance(rows), F.lit("INHERITS"), col("src"), col("dst")).distinct()).unionByName(resolve.call_edges(resolve.resolve_calls(rows)))
        found = Graph(graph.upsert_nodes(nodes, "qn", col("label"), col("path")), edges)
        edges = found.edges.unionByName(edge(structure.overrides(found), F.lit("OVERRIDES"), col("src"), col("dst")))
        return cls(spark, found.nodes, graph.upsert_edges(edges, found.nodes), sources)

    def write(self, path: str) -> None:
        graph.write_graph(self.graph, path)

    def views(self, prefix: str = "") -> None:
        """Registers `nodes` and `edges` (and `sources`, `embeddings`) for SQL."""
        for name, df in (("nodes", self.graph.nodes), ("edges", self.graph.edges), ("sources", self.sources), ("embeddings", self.embeddings)):
            if df is not None:
                df.createOrReplaceTempView(prefix + name)

    def _keys(self, *qns: str) -> DataFrame:
        return self.spark.createDataFrame([(q,) for q in qns], "qn string")

    # search
    def find_nodes(self, query: str | list[str], **how: object) -> DataFrame:
        """Nodes for a query, or for any of several (50 at most, as given)."""
        queries = [query] if isinstance(query, str) else query
        if not 0 < len(queries) <= 50:
            raise ValueError("between 1 and 50 queries")
        found = search.find_nodes(self.graph, queries[0], **how)
        for q in queries[1:]:
            found = found.unionByName(search.find_nodes(self.graph, q, **how))
        return found.distinct()

    def fuzzy_search(self, requests: list[str], project: str, cap: int = 1) -> DataFrame:
        return search.fuzzy_search(self.graph, requests, project, cap)

    # traversal
    def find_calls(self, qn: str, outgoing: bool = True, depth: int = 1, cap: int | None = 100) -> DataFrame:
        """Functions that one calls, or that call it, within a depth of 5 at most."""
        rows = traverse.reachable(self.graph, self._keys(qn), "CALLS", depth=max(1, min(depth, 5)), reverse=not outgoing)
        return search.capped(rows.select("qn", "depth"), cap, "depth", "qn")

    def trace(self, start: str, end: str | None = None, depth: int = 5, *rels: str) -> DataFrame:
        """One shortest path to `end`, or all nodes with their distances; CALLS bring native bindings along."""
        kinds = rels or ("CALLS",)
        kinds = (*kinds, "BINDS_TO") if "CALLS" in kinds else kinds
        if end is None:
            return traverse.walks(self.graph, self._keys(start), *kinds, depth=min(depth, 10))
        return traverse.shortest_path(self.graph, self.spark.createDataFrame([(start, end)], "src string, dst string"), *kinds, depth=min(depth, 10))

    def cycles(self, start: str, depth: int = 4, *rels: str) -> DataFrame:
        return traverse.cycles(self.graph, self._keys(start), *(rels or ("CALLS",)), depth=depth)

    def dependency_tree(self, start: str, depth: int = 3, *rels: str) -> DataFrame:
        return traverse.dependency_tree(self.graph, self._keys(start), *(rels or ("CALLS", "BINDS_TO")), depth=depth)

    def relationships(self, qns: list[str], *rels: str) -> DataFrame:
        return graph.between(self.graph, self._keys(*qns), *(rels or ("CALLS", "INHERITS", "IMPORTS", "DEFINES", "DEFINES_METHOD", "OVERRIDES", "BINDS_TO")))

    # structure
    def children(self, qn: str, depth: int = 1) -> DataFrame:
        """What lies in a project, folder, file or class: `qn, label, depth`."""
        kinds = ("CONTAINS_FOLDER", "CONTAINS_FILE", "DEFINES", "DEFINES_METHOD", "DEFINES_VARIABLE")
        rows = traverse.reachable(self.graph, self._keys(qn), *kinds, depth=min(depth, 10))
        return graph.with_nodes(self.graph, rows.select(F.col("qn").alias("to"), "depth")).select(F.col("to").alias("qn"), "name", "label", "depth")

    def context(self, qn: str) -> DataFrame:
        return structure.code_context(self.graph, qn)

    def class_hierarchy(self) -> DataFrame:
        return structure.class_hierarchy(self.graph)

    def package_tree(self, least: int = 0) -> DataFrame:
        return structure.package_tree(self.graph, least)

    def module_calls(self) -> DataFrame:
        return structure.module_calls(self.graph)

    def key_functions(self, top: int | None = 20) -> DataFrame:
        return structure.key_functions(self.graph, top)

    def imports(self, text: str) -> DataFrame:
        return structure.imports_of(self.graph, text)

    def dependents(self, changed: list[str]) -> DataFrame:
        return diff.dependents(self.graph.rel("IMPORTS"), self._keys(*changed))

    def external_dependencies(self) -> DataFrame:
        return structure.external_dependencies(self.graph)

    def stats(self) -> DataFrame:
        return structure.project_stats(self.graph)

    # text and vectors
    def snippet(self, qn: str) -> DataFrame:
        """`qn, path, code`: the lines of a definition in its file."""
        if self.sources is None:
            raise ValueError("the graph has no source files")
        homes = self.graph.nodes.where("label = 'File'").select(F.col("qn").alias("file"), "path", "project")
        one = self.graph.nodes.where((F.col("qn") == qn) & F.col("start_line").isNotNull()).select("qn", "start_line", "end_line", "project")
        at = one.join(homes, "project").where(F.col("qn").startswith(F.concat("file", F.lit("."))))
        return at.join(self.sources, ["project", "path"]).select("qn", "path", text.snippet(F.col("code"), F.col("start_line"), F.col("end_line")).alias("code"))

    def grep(self, pattern: str, context: int = 1) -> DataFrame:
        if self.sources is None:
            raise ValueError("the graph has no source files")
        return text.grep(self.sources, "path", "code", pattern, context)

    def similar(self, query: list[float], k: int = 10, project: str | None = None) -> DataFrame:
        """The k definitions most similar to a vector, of a project only if one is named: the filter comes first."""
        if self.embeddings is None:
            raise ValueError("the graph has no embeddings")
        where = F.col("qn").startswith(project + ".") if project else None
        return vector.nearest(self.embeddings, "qn", "embedding", query, k, where)

    # changes
    def without(self, prefix: str) -> CodeGraph:
        g = graph.delete_prefix(self.graph, prefix)
        return CodeGraph(self.spark, g.nodes, g.edges, self.sources, self.embeddings)

    def without_project(self, project: str) -> CodeGraph:
        g = graph.delete_project(self.graph, project)
        return CodeGraph(self.spark, g.nodes, g.edges, self.sources, self.embeddings)
