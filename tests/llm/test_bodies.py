"""The bodies that the island grammars read, against the standard library's parser and by example."""

import ast

from knotwork.llm import docpairs

PY = '''import os
@register("x")
class A(Base):
    size = (1,
2)
    def m(self, a: dict[str, int] = {"k": (1, 2)}) -> int:
        """Reads twice."""
        x = f"""
def fake(): ...
"""
# less deep, but a comment
        if a:
            return [
a]

        def inner(b):  # note
            r\'\'\'Holds the lock.\'\'\'
            return b \\
+ 1
        return "def no():"

    @property
    @cached(size=")")
    async def n(self):
        "Counts."
    def bare(self):
        return 1
def one(): "Says it."; return {"a": 1}

def last():
\t"""Ends
\tthe file."""
\tpass
'''


def test_python_bodies_are_those_of_the_parser():
    lines = PY.split("\n")
    want = {}
    for f in ast.walk(ast.parse(PY)):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) and ast.get_docstring(f):
            rest = f.body[1:]
            want[f.name] = "\n".join(lines[rest[0].lineno - 1 : rest[-1].end_lineno]) if rest else ""
    want["one"] = 'return {"a": 1}'
    got = {name: (line, signature, body) for name, line, signature, _, body in docpairs.python_pairs(PY)}
    assert {k: v[2] for k, v in got.items()} == want and list(got) == ["m", "inner", "n", "one", "last"]
    assert got["m"][1] == 'def m(self, a: dict[str, int] = {"k": (1, 2)}) -> int'  # without the class's annotation
    assert got["n"][1] == '@property @cached(size=")") async def n(self)'


def test_python_bodies_cut_short():
    text = 'def a():\n    """Opens."""\n    x = (1,\n\n@keep\ndef b(\n    c):\n    """Closes."""\n    return ")'
    assert [(p[0], p[2], p[4]) for p in docpairs.python_pairs(text)] == [("a", "def a()", "    x = (1,"), ("b", "@keep def b( c)", '    return ")')]
    assert list(docpairs.python_pairs("")) == list(docpairs.python_pairs("\n\n")) == []


def test_javascript_bodies():
    text = "/** Opens. */\nfunction a(x) {\n  // don't }\n  if (/[}]'/.test(x)) { return `}${ {b: '}'} }` }\n}\n/** Adds. */\nconst b = (x, y) => x + [1,\n 2].length;\nclass K {\n  /** Counts. */\n  c() { return '}' }\n  /** Cut. */\n  d() { if (x) {"
    got = {p[0]: p[4] for p in docpairs.javascript_pairs(text)}
    assert got == {"a": text[text.index("{") : text.index("\n/** Adds")], "b": "x + [1,\n 2].length", "c": "{ return '}' }", "d": "{ if (x) {"}
    nested = "/** Nests. */\nfunction e() { return " + "`}${ {a: " * 3000 + "1" + "} }`" * 3000 + " }\nlet z"
    assert [p[4] for p in docpairs.javascript_pairs(nested)] == [nested[nested.index("{") : -6]]
