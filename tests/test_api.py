import pytest

from codeloom.api import CodeGraph
from codeloom.plans.code_queries import _REPO


@pytest.fixture(scope="module")
def built(spark):
    return CodeGraph.from_python(spark, spark.createDataFrame([("p", *x) for x in _REPO], "project string, path string, code string"))


def test_graph_of_a_package(built, rows):
    assert ("p.app.core.Engine.start", "p.app.core.Base.start") in rows(built.graph.rel("OVERRIDES"), "src", "dst")
    assert rows(built.graph.rel("INHERITS"), "src", "dst") == [("p.app.core.Engine", "p.app.core.Base")]
    assert ("p.app", "CONTAINS_FILE", "p.app.core") in rows(built.graph.edges, "src", "rel", "dst")
    assert ("p.app.core.Base", "DEFINES_METHOD", "p.app.core.Base.check") in rows(built.graph.edges, "src", "rel", "dst")


def test_questions(built, rows):
    assert rows(built.find_nodes(["engine", "helper"]), "qn") == [("p.app.core.Engine",), ("p.app.tools.helper",)]
    assert rows(built.find_calls("p.app.tools.clean", outgoing=False), "qn") == [("p.app.core.Base.check",), ("p.app.tools.helper",)]
    assert rows(built.trace("p.main.run", "p.app.tools.clean"), "depth") == [(2,)]
    assert rows(built.children("p.app.core.Engine"), "qn") == [("p.app.core.Engine.start",)]
    assert rows(built.snippet("p.app.tools.helper"), "code") == [("def helper():\n    return clean(2)",)]
    assert rows(built.grep("lonely"), "path") == [("main.py",), ("other/far.py",)]
    assert rows(built.without("p.app").find_nodes("helper"), "qn") == []
    with pytest.raises(ValueError):
        built.similar([1.0])
    with pytest.raises(ValueError):
        built.find_nodes([])


def test_views(spark, built):
    built.views("t_")
    assert spark.sql("select count(*) from t_nodes where label = 'Class'").first()[0] == 2
