import pytest

from codeloom.operators.resolve import resolve_calls
from codeloom.sources import python_code
from codeloom.streaming.graph_updates import build, rebuild_calls, update

A = {
    "app/__init__.py": "from .core import Engine\n",
    "app/core.py": "from app.tools import clean\n\nclass Base:\n    limit = 3\n    def start(self):\n        self.check()\n    def check(self):\n        return clean(1)\n\nclass Engine(Base):\n    def stop(self):\n        self.start()\n        helper()\n",
    "app/tools.py": "LIMIT = 1\n\ndef clean(x):\n    return x\n\ndef helper():\n    return clean(LIMIT)\n",
    "main.py": "from app import Engine\n\ndef run(e: Engine):\n    e.stop()\n    lonely()\n",
    "far.py": "def lonely():\n    pass\n",
}
STEPS = {
    "values, bodies, and definitions that come and go": {"app/tools.py": A["app/tools.py"].replace("LIMIT = 1", "LIMIT = 2").replace("def helper", "def other"), "main.py": A["main.py"].replace("    lonely()\n", "    e.start()\n    lonely()\n"), "app/near.py": "def lonely():\n    pass\n\ndef helper():\n    pass\n", "far.py": None},
    "another base, another import, a file that no longer parses": {"app/core.py": A["app/core.py"].replace("class Engine(Base)", "class Engine"), "app/__init__.py": "from .tools import clean\n", "far.py": "def lonely(:\n"},
}


def frame(spark, files):
    return spark.createDataFrame([("p", k, v) for k, v in files.items() if v is not None], "project string, path string, code string")


def facts(rows, state):
    return rows(state.rows, "module", "kind", "qn", "label", "name", "target", "n", "start_line", "end_line", "digest"), rows(state.calls, "caller", "name", "line", "callee", "way")


@pytest.mark.parametrize("step", STEPS)
def test_update_gives_what_a_build_gives(spark, rows, step):
    after = A | STEPS[step]
    changed = spark.createDataFrame([("p", k) for k in STEPS[step]], "project string, path string")
    got = update(build(frame(spark, A)), frame(spark, after), changed)
    assert facts(rows, got) == facts(rows, build(frame(spark, after)))


def test_rebuild_calls_of_a_module(spark, rows):
    state = build(frame(spark, A))
    assert facts(rows, rebuild_calls(state, spark.createDataFrame([("p.app.core",)], "module string"))) == facts(rows, state)
    assert rows(state.calls_of(spark.createDataFrame([("p.main",)], "module string")), "name", "callee") == [("e.stop", "p.app.core.Engine.stop"), ("lonely", "p.far.lonely")]


def calls(spark, rows, files):
    return set(rows(resolve_calls(python_code.read(frame(spark, files))), "caller", "callee", "way"))


def test_attributes_of_self_and_the_order_of_bases(spark, rows):
    files = {
        "m.py": "class Zebra:\n    def go(self):\n        pass\n    def only(self):\n        pass\n\nclass Ant:\n    def go(self):\n        pass\n\nclass Both(Zebra, Ant):\n    def run(self):\n        self.go()\n\nclass Holder:\n    part: Ant\n    def __init__(self, other: Zebra):\n        self.box = Both()\n        self.other = other\n    def use(self):\n        self.box.run()\n        self.part.go()\n        self.other.only()\n"
    }
    got = calls(spark, rows, files)
    assert {("p.m.Both.run", "p.m.Zebra.go", "self"), ("p.m.Holder.use", "p.m.Both.run", "typed"), ("p.m.Holder.use", "p.m.Ant.go", "typed"), ("p.m.Holder.use", "p.m.Zebra.only", "typed")} <= got


def test_diamond_takes_the_base_declared_first(spark, rows):
    files = {"d.py": "class Top:\n    def f(self):\n        pass\n    def g(self):\n        pass\n\nclass Z(Top):\n    def g(self):\n        pass\n\nclass A(Top):\n    def g(self):\n        pass\n\nclass Low(Z, A):\n    def h(self):\n        self.f()\n        self.g()\n"}
    assert {("p.d.Low.h", "p.d.Top.f", "self"), ("p.d.Low.h", "p.d.Z.g", "self")} <= calls(spark, rows, files)
