"""The engine from end to end over the tree of test_parse_link."""

import pytest

from knotwork.engine import Engine
from tests.test_parse_link import TREE


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for p, t in TREE.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    (root / "node_modules").mkdir()
    (root / "node_modules/x.py").write_text("a = 1\n")
    e = Engine(spark, tmp_path_factory.mktemp("index"))
    e.root = root
    e.report = e.index(root)
    return e


def test_index_and_again(engine):
    assert engine.report.files_seen == len(TREE) and engine.report.parsed == len(TREE) and engine.report.relinked
    again = engine.index(engine.root)
    assert (again.parsed, again.unchanged, again.relinked) == (0, len(TREE), False)
    assert engine.nodes.agg({"importance": "max"}).first()[0] == pytest.approx(1.0)


def test_brief_keeps_budget(engine):
    for budget in (300, 1500):
        text = engine.brief("how does the oven bake a tray", budget)
        assert len(text) / 3.3 <= budget and "RELEVANT SYMBOLS" in text
    assert "Oven" in engine.search("bake oven").first().short


def test_expand_map_stats(engine):
    text = engine.expand("Oven.bake", source=True)
    assert "CALLS" in text and "warm_slowly" in text and "def bake" in text
    assert engine.expand("src/kiln/oven.py:20").startswith("kiln.oven.Oven.bake")
    assert "No" in engine.expand("zzzz")
    assert "src/kiln/oven.py" in engine.map(800)
    assert {r.name for r in engine.stats().filter("part = 'languages'").collect()} == {"python", "markdown"}


def test_notes(engine):
    uid = engine.remember("bake needs a warm oven", topic="heat", symbols=["Oven.bake"])
    assert not engine.memories().filter(f"uid = '{uid}'").first().stale
    assert "bake needs a warm oven" in engine.brief("bake", 2000)
    p = engine.root / "src/kiln/oven.py"
    p.write_text(p.read_text().replace("return Tray(minutes)", "return Tray(minutes + 1)"))
    report = engine.index(engine.root)
    assert report.parsed == 1 and engine.memories().filter(f"uid = '{uid}'").first().stale
    engine.forget(uid)
    assert engine.memories().count() == 0
    with pytest.raises(KeyError):
        engine.forget("nobody")
