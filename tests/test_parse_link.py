"""Parsing and linking over a small source tree of our own."""

import pytest

from knotwork.operators import link, parse

TREE = {
    "src/kiln/__init__.py": "from .oven import Oven\nfrom .tools import *\n",
    "src/kiln/oven.py": '''"""Ovens and their heat."""
from dataclasses import dataclass

from .parts.base import Heater, Base as Root
from kiln.parts import gauge


@dataclass
class Oven(Root):
    """Bakes things."""

    gauge: gauge.Gauge

    def __init__(self, heater: Heater | None = None):
        self.heater = heater
        self.dial = gauge.Gauge()

    def bake(self, minutes: int) -> "Tray":
        self.heater.warm_slowly()
        self.dial.read_degrees()
        self.describe_parts()
        super().cool_down()
        return Tray(minutes)

    @property
    def level(self):
        return 1

    @level.setter
    def level(self, value):
        print(value)


class Tray:
    def carry_away(self):
        return _secret_step()


def _secret_step():
    thing = Tray()
    thing.carry_away()
    unknown.mystery_motion()
''',
    "src/kiln/parts/__init__.py": "",
    "src/kiln/parts/base.py": "class Base:\n    def describe_parts(self):\n        return 1\n\n    def cool_down(self):\n        return 0\n\n\nclass Heater:\n    def warm_slowly(self):\n        pass\n",
    "src/kiln/parts/gauge.py": "class Gauge:\n    def read_degrees(self):\n        pass\n",
    "src/kiln/tools.py": "def mystery_motion():\n    pass\n\n\ndef helper_one():\n    helper_one()\n",
    "src/kiln/use.py": "from kiln import *\nimport kiln\n\n\ndef use_all():\n    Oven().bake(1)\n    kiln.Oven()\n    helper_one()\n",
    "src/kiln/broken.py": "def broken(:\n",
    "tests/test_oven.py": "from kiln import Oven\n\n\ndef test_bake():\n    oven = Oven()\n    oven.bake(3)\n",
    "docs/guide.md": "# Guide\n\nUse `Oven.bake` and `carry_away`, see `src/kiln/tools.py`, [code](../src/kiln/use.py).\n\n```\n# no heading\n```\n\n## Part\n\ntext\n\n## Part\n",
}


@pytest.fixture(scope="module")
def built(spark):
    files = spark.createDataFrame([("k", p, t) for p, t in TREE.items()] + [("k", "x.py", None)], "repo string, path string, content string")
    parsed = parse.parse_files(files)
    nodes, refs = parse.nodes_of(parsed), parse.refs_of(parsed)
    edges = link.link(nodes, refs)
    short = lambda k: k.split(":", 2)[2]
    return {r.key: r for r in nodes.collect()}, refs.collect(), {(short(r.source_key), r.relation, short(r.target_key)): r.confidence for r in edges.collect()}


def test_nodes(built):
    nodes, _, _ = built
    oven = nodes["class:src/kiln/oven.py:kiln.oven.Oven"]
    assert oven.signature == "@dataclass class Oven(Root)" and oven.docstring == "Bakes things." and oven.start_line == 8
    assert [n.parent_key for k, n in nodes.items() if k.startswith("method:src/kiln/oven.py:kiln.oven.Oven.level~")] == [oven.key]
    assert [k for k in nodes if "broken" in k] == ["module:src/kiln/broken.py:kiln.broken"]
    assert nodes["test:tests/test_oven.py:tests.test_oven.test_bake"].type == "test"
    sections = sorted(k for k in nodes if k.startswith("documentation"))
    assert [s.rsplit(":", 1)[1] for s in sections] == ["guide", "part", "part-2"]
    assert nodes["documentation:docs/guide.md:part"].parent_key == "documentation:docs/guide.md:guide"
    assert not nodes["function:src/kiln/oven.py:kiln.oven._secret_step"].is_public


def test_edges(built):
    _, _, edges = built
    assert edges[("kiln.oven.Oven", "inherits", "kiln.parts.base.Base")] == "high"
    for target in ("kiln.parts.base.Heater.warm_slowly", "kiln.parts.gauge.Gauge.read_degrees", "kiln.parts.base.Base.describe_parts", "kiln.parts.base.Base.cool_down", "kiln.oven.Tray"):
        assert edges[("kiln.oven.Oven.bake", "calls", target)] == "high", target
    assert edges[("kiln.oven._secret_step", "calls", "kiln.oven.Tray.carry_away")] == "high"
    assert edges[("kiln.oven._secret_step", "calls", "kiln.tools.mystery_motion")] == "low"
    assert edges[("kiln.oven.Tray.carry_away", "calls", "kiln.oven._secret_step")] == "high"
    assert ("kiln.use.use_all", "calls", "kiln.oven.Oven") in edges  # through a star import and a re-export
    assert edges[("kiln", "imports", "kiln.oven.Oven")] == "high" and ("tests.test_oven", "imports", "kiln.oven.Oven") in edges
    assert ("kiln.oven.Oven.bake", "references", "kiln.oven.Tray") in edges
    assert ("kiln.oven.Oven", "contains", "kiln.oven.Oven.bake") in edges
    assert ("kiln.oven.Oven.bake", "tested_by", "tests.test_oven.test_bake") in edges
    assert ("kiln.oven.Oven", "tested_by", "tests.test_oven.test_bake") in edges
    assert edges[("kiln.oven", "tested_by", "tests.test_oven")] == "low"
    assert ("kiln.oven.Oven.bake", "documented_by", "guide") in edges and ("kiln.oven.Tray.carry_away", "documented_by", "guide") in edges
    assert ("kiln.tools", "documented_by", "guide") in edges and ("kiln.use", "documented_by", "guide") in edges
    assert not [e for e in edges if e[0] == e[2]]


def test_empty(spark):
    files = spark.createDataFrame([], "repo string, path string, content string")
    parsed = parse.parse_files(files)
    assert link.link(parse.nodes_of(parsed), parse.refs_of(parsed)).count() == 0
