"""The dealt method decides where a plainer path could stand in for it."""

import pytest

from knotwork.llm import unparsable


@pytest.mark.parametrize(("extension", "text"), [("py", "x = 1\n"), ("json", "[1]"), ("toml", "a = 1\n")])
def test_what_the_grammars_refuse_is_flagged(monkeypatch, extension, text):
    assert unparsable.parses(extension, text)
    monkeypatch.setattr(unparsable, "dialects", lambda extension, text: set())
    assert not unparsable.parses(extension, text)


@pytest.mark.parametrize(("extension", "text"), [("py", "f() = 1\n"), ("toml", "a = 1\na = 2\n")])
def test_the_exact_check_still_refuses(extension, text):
    assert not unparsable.parses(extension, text)


def test_stretches_parse_as_the_whole():
    """What is parsed in remembered parts gets the verdict of one parse over all tokens."""
    from knotwork.llm import grammars as G
    from knotwork.llm.gll import accepts

    texts = {
        "json": ['{"a": [1, {"b": []}], "c": {}}', '{"a": [1, {"b": [}]}', '{"a" 1}', "[1, 2", "[]]", "3", '{"a": {"b": 1}, }', ""],
        "toml": ["a = 1\nb = [\n 1,\n 2\n]\n[t]\nc.d = {x = 1}\n", "a = [\n 1\nb = 2\n", "a = 1 b = 2\n", "[[t]]\n\n", "a = [1]]\n", "= 3\n", ""],
        "py": ["x = 1\nif x:\n    y = (2,\n  3); z = 4\nelse: pass\n", "x = = 1\n", "def f():\n    return 1 +\n", "match x:\n    case 1: pass\n", "match = 1\ntype = 2\n", "if x: y = 1; z\n", "else: pass\n", "x = [i for i in y if (a := i)]\nf(b=1, *c)\n", "@d\nclass A: x: int = 3\n", ""],
    }
    raw = {"json": G.json_tokens, "toml": G.toml_tokens, "py": G.python_tokens}
    for kind, some in texts.items():
        for text in [*some, *some]:
            try:
                want = accepts(G.LANGUAGES[kind][1], raw[kind](text))
            except G.Malformed:
                want = set()
            assert unparsable.dialects(kind, text) == want, (kind, text)
