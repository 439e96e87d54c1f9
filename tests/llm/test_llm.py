"""The text, code and vector operators against brute force, round trips and their edge cases."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.llm import docpairs, leakage, mixing, neighbours, notwritten, truncation, unparsable
from knotwork.llm.grammars import LANGUAGES

# --- documentation pairs ---


@pytest.mark.parametrize(
    ("doc", "says"),
    [
        ("Scan the buffer.", False), ("Scans buffers", False), ("SCAN BUFFER", False), ("scan_buffer()", False), ("", False), (None, False), ("   ", False), ("TODO", False), ("TODO: describe", False), ("noqa: D103", False),
        ("type: ignore", False), ("See base class.", False), ("Inherited, see superclass.", False), ("_summary_\n\nArgs:\n    size (_type_): _description_", False), (":param size:\n:return:", False), ("[summary]", False),
        ("Function scan_buffer.", False), ("Auto-generated docstring of scan_buffer", False), ("pylint: disable=too-many-arguments", False), ("Siehe Basisklasse.", False),
        ("Scan the buffer, skipping empty lines.", True), ("TODO: tidy. Drops entries older than 5 days.", True), ("Sortiert die Einträge nach Alter.", True), ("Scan buffer.\n\n:param size: greatest number of bytes", True), ("読み込む", True),
    ],
)
def test_says_something(doc, says):
    assert docpairs.says_something(doc, *docpairs.read_signature("@cached(a, 'x)') def scan_buffer(self, size: dict[str, int] = {}) -> bool")) is says


def test_file_pairs(spark):
    py = 'import a\n\n@deco(x=")")\nasync def go(a, b={"k": (1, 2)}) -> int:  # note\n    # first\n    """Reads twice."""\n\ndef no(): return "def x(): pass"\n\nclass C:\n    def m(self):\n        r\'\'\'Holds the lock.\'\'\'\n'
    js = "/** Opens the gate. */\nexport async function open(a, {b} = {}) {}\n/** Lost. */\nlet x = 1;\nfunction no() {}\nclass K {\n  /**\n   * Counts gates.\n   */\n  count(n) { return 1 }\n}\n"
    rows = [(1, "a.py", py), (2, "b.js", js), (3, "c.py", None), (4, "d.py", ""), (5, "e.txt", py), (1, "a.py", py)]
    got = {(r.file_id, r.name, r.docstring) for r in docpairs.file_pairs(spark.createDataFrame(rows, "file_id long, path string, content string")).collect()}
    assert got == {(1, "go", "Reads twice."), (1, "m", "Holds the lock."), (2, "open", "Opens the gate."), (2, "count", "Counts gates.")}


def test_node_pairs_edges(spark):
    schema = "id long, type string, signature string, docstring string, extra string"
    rows = [(1, "function", "def f(…", "Keeps order."), (1, "function", "def f(…", "Keeps order."), (2, "class", "class A", "Keeps order."), (3, None, "def f()", "Keeps order."), (4, "method", None, "Keeps order."), (None, "method", "def f()", "Keeps order."), (5, "method", "def f()", "x" * 100_000)]
    got = sorted(r.id for r in docpairs.node_pairs(spark.createDataFrame([(*r, "e") for r in rows], schema)).collect())
    assert got == [1, 5]
    assert docpairs.node_pairs(spark.createDataFrame([], schema)).count() == 0


# --- parsing ---

VALID = {
    "py": ["", "x = 1\n", "match x:\n    case [1, *r] if r: pass\n    case {'a': b, **c}: pass\n", "f'{x!r:>{w}} {y=}'\n", "with (open(a) as b, c): pass\n", "type X[T] = int\n", "@a.b(c)[d]\nclass E(F, metaclass=G): x = 1; y = 2\n", "async def f():\n  return [x async for x in y if z]\n"],
    "json": ["{}", '{"a": [1, -2.5e3, "\\u00e9", null]}', " 1 "],
    "toml": ["", 'a = 1\nb.c = "x"\n[t."x y"]\n[[u.v]]\nd = 1979-05-27T07:32:00Z\n', "f = [[1,2],[3]]\ng = [[[1],[2]],[[3]]]\n", "a = [\n 1, # c\n 2\n]\n"],
    "js": ["", "a\nb", "if (x) /re/.test(y)", "x = a / b / c", "`a${b+`n${c}`}d`", "import a, {b as c} from 'x'\nexport default function () {}", "x = y => ({a: 1})", "class A extends B { #p = 1; static { f() } async *g() {} }", "for (const [a, b] of c) d: while (1) break d", "let {a, b: [c,,d] = [], ...r} = q"],
}
INVALID = {
    "py": ["print 'x'\n", "def f(:\n", "  a\n", "x = (1\n", "x = 'a\n", "<<<<<<< HEAD\n", "\x00"],
    "json": ["", "{", '{"a": 1,}', "{'a': 1}", "[1 2]", "NaN", '"\t"', "01"],
    "toml": ["a = ", "[a", "a = 01", "a b = 1", "a = 1\na = 2", "{}"],
    "js": ["a b", '{ "a": 1 }', "function (", "foo(", "}", "`abc", "/* abc", "# title", "from .a import b", "=======", "<html></html>"],
}


@pytest.mark.parametrize("language", VALID)
def test_grammars(language):
    for text in VALID[language]:
        assert unparsable.dialects(language, text), text
    for text in INVALID[language]:
        assert not unparsable.parses(language, text), text


def test_grammar_agrees_with_the_standard_library_on_damaged_texts():
    r = random.Random(7)
    agree = total = 0
    for language in ("py", "json", "toml"):
        for text in VALID[language]:
            for _ in range(25):
                at, n = r.randrange(len(text) + 1), r.randrange(1, 5)
                damaged = text[:at] + r.choice(["", text[at + n :], r.choice("()[]{}:,='\"\n x1") + text[at:]])
                exact = unparsable.exact(language, damaged)
                total += exact is not None
                agree += exact is not None and exact == bool(unparsable.dialects(language, damaged))
    assert agree / total > 0.97  # what is left are rules beyond the grammar


def test_unparsable(spark):
    rows = [(1, "r", "a.py", "python", "x = 1"), (2, "r", "b.PY", None, "x ="), (2, "r", "b.PY", None, "x ="), (3, "r", "c.md", "markdown", "# ("), (4, "r", "d.json", "json", ""), (5, "r", "e.js", "javascript", None), (6, "r", "f.js", "javascript", "a = [" + "1," * 20_000 + "1]"), (None, "r", "g.py", "python", "x =")]
    files = spark.createDataFrame(rows, "file_id long, repo string, path string, language string, content string")
    assert sorted(r.file_id for r in unparsable.unparsable(files).collect()) == [2, 4]
    rates = {(r.language, r.n_files, r.n_invalid) for r in unparsable.unparsable_rates(files).collect()}
    assert rates == {("python", 1, 0), ("unknown", 1, 1), ("markdown", 1, 0), ("json", 1, 1), ("javascript", 1, 0)}
    assert unparsable.unparsable(files.limit(0)).count() == 0 and "toml" in LANGUAGES


# --- vectors ---


def _clusters(n, dim, seed):
    g = np.random.default_rng(seed)
    centres = g.standard_normal((n // 5, dim))
    x = centres[g.integers(0, len(centres), n)] + 0.25 * g.standard_normal((n, dim))
    return x * g.uniform(0.2, 4, (n, 1))


def _brute(keys, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {key: {keys[j] for j in np.argsort(-s[i])[:k]} for i, key in enumerate(keys)}


EMB = "model string, node_key string, text_hash string, dim int, vector array<float>"


def test_similar_recall(spark):
    x = _clusters(1500, 24, 1).astype(np.float32)
    keys = [f"k{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([("m", k, "h", 24, v.tolist()) for k, v in zip(keys, x, strict=True)], EMB)
    got = {}
    for r in neighbours.similar(df, block=64).collect():
        got.setdefault(r.node_key, set()).add(r.other_key)
    want = _brute(keys, x.astype(np.float64), 5)
    assert all(len(got[k]) == 5 for k in keys)
    assert sum(len(got[k] & want[k]) for k in keys) / (5 * len(keys)) >= 0.9


def test_search_recall(spark):
    x = _clusters(1200, 16, 3).astype(np.float32)
    keys = [f"k{i:05d}" for i in range(len(x))]
    rows = [("m", k, "h", 16, v.tolist()) for k, v in zip(keys, x, strict=True)]
    df = spark.createDataFrame(rows[100:], EMB)
    asked = spark.createDataFrame([(k, m, v) for m, k, _, _, v in rows[:100]] + [("zero", "m", [0.0] * 16), ("other", "o", [1.0] * 16)], "query_id string, model string, vector array<float>")
    got = {}
    for r in neighbours.search(df, asked, block=64).collect():
        got.setdefault(r.query_id, set()).add(r.node_key)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {keys[i]: {keys[100 + j] for j in np.argsort(-(u[100:] @ u[i]))[:5]} for i in range(100)}
    assert got.keys() == want.keys() and sum(len(got[k] & want[k]) for k in want) / 500 >= 0.9
    assert neighbours.search(df, asked.limit(0)).count() == 0


def test_similar_cases(spark):
    bad = [("m", "n1", "h", 2, None), ("m", "n2", "h", 2, [0.0, 0.0]), ("m", "n3", "h", 2, [float("nan"), 1.0]), ("m", "n4", "h", 3, [1.0, 1.0]), (None, "n5", "h", 2, [1.0, 1.0]), ("m", None, "h", 2, [1.0, 1.0]), ("m", "n6", "h", 2, [None, 1.0]), ("m", "n7", "h", None, [1.0, 1.0])]
    copies = [("m", f"c{i:02d}", "h", 2, [1.0, 1.0]) for i in range(12)]
    rest = [("m", "d", "h", 2, [1.0, 0.9]), ("m", "d", "h", 2, [1.0, 0.9]), ("o", "e", "h", 2, [1.0, 0.9])]
    df = spark.createDataFrame(bad + copies + rest, EMB)
    got = {}
    for r in neighbours.similar(df).collect():
        got.setdefault(r.node_key, []).append((r.rank, r.other_key))
    assert sorted(got["c00"]) == [(i, f"c{i:02d}") for i in range(1, 6)]  # equal cosines by key
    assert [k for _, k in sorted(got["c11"])] == [f"c{i:02d}" for i in range(5)]
    assert [k for _, k in sorted(got["d"])] == [f"c{i:02d}" for i in range(5)] and "e" not in got and "n1" not in got
    pairs = {(r.node_key_a, r.node_key_b) for r in neighbours.mutual(df).collect()}
    assert ("c00", "c05") in pairs and ("c00", "c11") not in pairs and not any("d" in p for p in pairs)
    assert neighbours.mutual(df.limit(0)).count() == 0


def test_lists_are_full_and_lengths_apart(spark):
    x = _clusters(600, 12, 7).astype(np.float32)
    rows = [("m", f"k{i:04d}", "h", 12, v.tolist()) for i, v in enumerate(x)] + [("m", f"s{i}", "h", 3, [1.0, float(i), 0.5]) for i in range(4)]
    df = spark.createDataFrame(rows, EMB)
    n = {}
    for r in neighbours.similar(df, k=20, block=64).collect():
        n.setdefault(r.node_key, []).append(r.other_key)
    assert all(len(v) == (20 if k[0] == "k" else 3) and {o[0] for o in v} == {k[0]} for k, v in n.items()) and len(n) == 604


def test_many_copies(spark):
    """A third of all rows are copies of one vector, and as many are one vector at other lengths."""
    x = _clusters(300, 12, 8).astype(np.float32)
    rows = [("m", f"k{i:04d}", "h", 12, v.tolist()) for i, v in enumerate(x)] + [("m", f"c{i:04d}", "h", 12, x[0].tolist()) for i in range(300)] + [("m", f"l{i:04d}", "h", 12, (x[1] * (1 + i / 7)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, EMB)
    queries = df.select("node_key").filter("substr(node_key, 2) % 10 = 0")
    found = neighbours.recall(df, queries).first()
    assert found.n_queries == 90 and found.n_pairs == 450 and found.recall >= 0.9
    exact = {}
    for r in neighbours.against_all(df, queries.filter("node_key like 'k%'")).collect():
        exact.setdefault(r.node_key, []).append(r.cosine)
    u = np.array([r[4] for r in rows], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for k, cosines in exact.items():
        i = int(k[1:])
        assert np.allclose(sorted(cosines, reverse=True), np.sort(np.delete(u @ u[i], i))[::-1][:5])


# --- files not written by hand ---


def test_not_written(spark):
    r = random.Random(2)
    word = lambda: r.choice("alpha beta gamma delta omega sigma kappa lamda".split())
    hand = lambda: f"import {word()}\n\n\ndef {word()}_{word()}({word()}):\n    # keeps the {word()} in order\n    for {word()} in range({r.randrange(9)}):\n        print({word()})\n    return {word()}\n" * 3
    dump = lambda: f"{word()} = [\n" + "".join(f'  "{r.getrandbits(200):x}",\n' for _ in range(40)) + "]\n"
    made = lambda head=True: ("# Code generated by tool 1.2. DO NOT EDIT.\n" if head else "") + "".join(f"def {word()}_{i}(client, body=None):\n    return call(client, {i}, body)\n" for i in range(12))
    rows = [(i, f"r{i % 7}", f"src/{word()}{i}.py", hand()) for i in range(60)] + [(100 + i, f"r{i % 7}", f"src/{word()}{i}.py", dump()) for i in range(20)] + [(200 + i, f"r{i % 7}", f"src/{word()}{i}.py", made()) for i in range(20)]
    rows += [(300, "r1", "src/hidden.py", made(head=False)), (301, "r1", "third_party/quill/a.py", hand()), (302, "r2", "a/b.lock.json", '{"a": {"version": "1.2.3", "integrity": "sha1-92c24c01f4b39c1cfaf0eb59d15bc287f97483b3"}}')]
    rows += [(400, None, None, None), (401, "r", "x.py", ""), (402, "r1", "src/about.py", "# helpers for generated code; do not edit while it runs\n" + hand()), (None, "r", "y.py", dump())]
    files = spark.createDataFrame(rows, "file_id long, repo string, path string, content string")
    packages = spark.createDataFrame([("quill", "1", "MIT")], "package_name string, latest_version string, license_name string")
    got = {x.file_id for x in notwritten.not_written(files, packages).collect()}
    assert got == {*range(100, 120), *range(200, 220), 300, 301, 302}
    held = notwritten.validation(files, packages).first()
    assert held.n_labelled > 0 and held.recall >= 0.9
    assert notwritten.not_written(files.limit(0), packages.limit(0)).count() == 0
    assert {x.file_id for x in notwritten.not_written(files.filter("file_id < 60"), packages).collect()} == set()


# --- leaks ---


def test_words():
    assert leakage.words("A&amp;B caf&eacute; ﬁne so­ft hy-\n# phen well-known snake_case 3rd") == ["a", "b", "café", "fine", "soft", "hyphen", "well", "known", "snake", "case", "3rd"]


def test_leaks_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, "t", " ".join(r.choices(vocabulary, k=r.choice([5, 20, 40])))) for i in range(50)] + [(50, "t", None), (None, "t", "x")]
    docs = []
    for d in range(300):
        w = r.choices(vocabulary, k=r.randrange(0, 80))
        if d % 3 == 0:
            source = items[r.randrange(50)][2].split()
            n = r.randrange(8, 20)
            s = r.randrange(max(1, len(source) - n + 1))
            at = r.randrange(len(w) + 1)
            w[at:at] = source[s : s + n]
        docs.append((d, ", ".join(w).upper()))
    docs += [(300, None), (None, "x"), (301, ""), (302, " ".join(["w1"] * 50_000))]
    want = set()
    for d, text in docs[:300]:
        w = text.lower().replace(",", "").split()
        for i, _, t in items[:50]:
            grams = {tuple(t.split()[k : k + 12]) for k in range(len(t.split()) - 11)}
            if any(tuple(w[k : k + 12]) in grams for k in range(len(w) - 11)):
                want.add((i, d))
    items_df, docs_df = spark.createDataFrame(items, "item_id long, task string, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    for per_pass in (512, 7):
        assert {(x.item_id, x.doc_id) for x in leakage.leaks(items_df, docs_df, per_pass).collect()} == want
    assert leakage.leaks(items_df.limit(0), docs_df).count() == 0 and leakage.leaks(items_df, docs_df.limit(0)).count() == 0


# --- mixing ---


def test_mix(spark):
    r = random.Random(1)
    docs = [(i, r.choice("abc") if i % 10 else r.choice([None, "other"]), " ".join(["word"] * r.randrange(1, 60))) for i in range(900)] + [(900, "a", None), (901, "a", "")]
    documents = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.15, 3), ("none", 0.05, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(documents, targets)
    got = mixed.collect()
    most = {"a": 2, "b": 1, "c": 3}
    assert all(0 < x.copies <= most[x.source] for x in got) and len({x.doc_id for x in got}) == len(got)
    share = {x.source: x for x in mixing.shares(mixed, targets).collect()}
    for s, t in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert share[s].share_reached == pytest.approx(t / 0.95, abs=0.01)
    assert share["none"].n_tokens == 0
    fixed = mixing.shares(mixing.mix(documents, targets, total_tokens=10_000_000), targets)
    assert {x.source: x.n_copies for x in fixed.collect()}["b"] == sum(1 for d in docs if d[1] == "b" and d[2])
    weighted = mixing.mix(documents.withColumn("w", F.when(F.col("doc_id") < 450, 3.0).otherwise(1.0)), targets, total_tokens=3000, weight="w").collect()
    assert sum(x.copies for x in weighted if x.doc_id < 450) > 1.8 * sum(x.copies for x in weighted if x.doc_id >= 450)
    assert mixing.mix(documents.limit(0), targets).count() == 0
    # a source that can give nothing does not empty the mix
    barred = spark.createDataFrame([("a", 0.5, 2), ("b", 0.4, 2), ("c", 0.1, 0)], "source string, target_share double, max_repeats int")
    got = {x.source: x for x in mixing.shares(mixing.mix(documents, barred), barred).collect()}
    assert got["c"].n_tokens == 0 and got["a"].share_reached == pytest.approx(5 / 9, abs=0.01)
    for w in (None, "w"):
        heavy = documents.withColumn("w", F.col("doc_id") % 7 + 1.0)
        assert all(x.on_target and x.within_repeats for x in mixing.kept(mixing.mix(heavy, barred, weight=w), heavy, barred, 0.02).collect())


# --- truncation ---


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("All is well.", "whole"), ("It ends here", "doubtful"), ("One sentence. And then it sto", "cut"), ("One. Two…", "cut"), ("One. Two is done. [truncated]", "whole"), ("One. And the [message clipped]", "cut"),
        ("Text.\n\n- an entry", "doubtful"), ("Text.\n\n- an entry and", "cut"), ("Text.\n\n| a | b |", "whole"), ("Text.\n\n| a | b", "cut"), ("Text.\n\n```\ncode", "cut"), ("Text.\n\n```\ncode\n```", "whole"),
        ("Text.\n\nCheers", "whole"), ("Text.\n\nWill report back...", "whole"), ("Text.\n\nSee https://x.y/z", "whole"), ("Text. Call `foo", "cut"), ("Text says \ufffd", "cut"), ("Fine 👍", "whole"), ("¿Qué pasa?", "whole"), ("He said \"yes.\"", "whole"), ("Text. With 3 workers the", "cut"),
    ],
)
def test_endings(text, kind):
    assert truncation.ending(text)[0] == kind


def test_truncated(spark):
    sentence = "The careful worker folds every second ledger before the morning shift begins."
    r = random.Random(6)
    rows = []
    for i in range(400):
        text = f"Case {i + 100} opens. " + " ".join([sentence] * r.randrange(1, 9)) + f" Number {r.randrange(10**r.randrange(1, 9))} ends."
        rows.append((i, text[:200] if i % 4 == 0 else text, "a"))
    cut = {i for i, t, _ in rows if not t.endswith(".")}
    rows += [(1000, "Fold the second led", "b"), (1001, "Fold the second ledger", "b"), (1002, None, "b"), (1003, "  ", "b"), (None, "It sto", "b"), (1004, sentence * 2000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {x.doc_id for x in truncation.truncated(df).collect()} == cut | {1000}
    rate = {x.source: x for x in truncation.truncation_rates(df).collect()}
    assert rate["a"].n_cut == len(cut) and rate["a"].n_at_limits > 0.9 * len(cut) and "chars=200" in rate["a"].limits and rate[""].n_cut == 0
    assert truncation.truncated(df.limit(0)).count() == 0


def test_lengths():
    text = "é\"&<\n😀\u20ac"
    m = SimpleNamespace(**dict(zip(truncation.MEASURES, truncation.measured(text), strict=True)))
    assert (m.chars, m.utf8, m.utf16_units) == (len(text), len(text.encode()), len(text.encode("utf-16-le")) // 2)
    import html
    import json

    assert m.chars_entities == len(html.escape(text)) and m.chars_json == len(json.dumps(text, ensure_ascii=False)) - 2 and m.json_ascii == len(json.dumps(text)) - 2 and m.chars_crlf == len(text) + 1
    assert not math.isnan(m.utf8_crlf)
