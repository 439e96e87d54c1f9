"""Text functions, full-text search against SQLite, graph ranking and packing against plain Python."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from knotwork.functions import text as X
from knotwork.operators import graph, notes, pack, search
from knotwork.sources.snapshots import SnapshotStore, embeddings_due, upsert_embeddings


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_text(spark):
    assert one(spark, X.split_identifier(F.lit("HTTPServer.scale_upNow"))) == ["http", "server", "scale", "up", "now"]
    assert one(spark, X.identifier_tokens(F.lit("scaleUp"), F.lit(None).cast("string"), F.lit("a.scaleUp"))) == "scaleup scale up a.scaleup a"
    assert one(spark, X.query_terms(F.lit("How does the HTTPServer scale a queue?"))) == ["httpserver", "http", "server", "scale", "queue"]
    assert one(spark, X.first_sentence(F.lit("  One two.\nThree.\n\nFour"))) == "One two."
    assert one(spark, X.first_sentence(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, X.module_name_for(F.lit("src/a/__init__.py"))) == "a" and one(spark, X.module_name_for(F.lit("__init__.py"))) == "__root__"
    assert one(spark, X.slug(F.lit("Ä — !"))) == "section" and one(spark, X.estimate_tokens(F.lit("abcd"))) == 2
    assert one(spark, X.is_test_path(F.lit("a/test_x.py"))) and not one(spark, X.is_test_path(F.lit(None).cast("string")))
    assert one(spark, X.ignored(F.lit("a/dist/x.py"), ["dist/"])) and not one(spark, X.ignored(F.lit("a/dist"), ["dist/"])) and one(spark, X.ignored(F.lit("a/x_pb2.py"), ["*_pb2.py"]))


@pytest.mark.parametrize("stem", [False, True])
def test_bm25_is_sqlites(spark, stem):
    r = random.Random(3)
    vocabulary = ["cache", "caches", "cached", "flush", "flushing", "parser", "ledger", "token", "merge", "merging", "worker"]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randrange(3, 12))), " ".join(r.choices(vocabulary, k=r.randrange(0, 3)))) for i in range(40)]
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE t USING fts5(a, b, tokenize='{'porter ' if stem else ''}unicode61')")
    con.executemany("INSERT INTO t(rowid, a, b) VALUES (?, ?, ?)", docs)
    index = search.TextIndex(spark.createDataFrame(docs, "id long, a string, b string"), "id", {"a": 1.0, "b": 3.0}, stem)
    got = {x.doc: x.score for x in index.search(spark.createDataFrame([("q", "flushing ledger")], "query_id string, text string")).collect()}
    want = dict(con.execute("SELECT rowid, -bm25(t, 1.0, 3.0) FROM t WHERE t MATCH 'flushing OR ledger'").fetchall())
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert index.search(spark.createDataFrame([("q", "the of")], "query_id string, text string")).count() == 0


def test_pagerank(spark):
    r = random.Random(1)
    n = 30
    edges = [(r.randrange(n), r.randrange(n + 3), r.choice([*graph.FLOW, "contains", None])) for _ in range(90)]
    df = spark.createDataFrame([*edges, *edges[:9]], "source long, target long, relation string")
    got = {x.node: x.importance for x in graph.pagerank(spark.range(n).withColumnRenamed("id", "node"), df, 12).collect()}
    out: dict = {}
    for s, t, rel in set(edges):
        if s != t and s < n and t < n and rel in graph.FLOW:
            out.setdefault(s, []).append((t, graph.FLOW[rel]))
    rank = [1 / n] * n
    for _ in range(12):
        new = [0.15 / n + 0.85 * sum(rank[i] for i in range(n) if i not in out) / n] * n
        for s, ts in out.items():
            for t, w in ts:
                new[t] += 0.85 * rank[s] * w / sum(x for _, x in ts)
        rank = new
    assert all(abs(got[i] - rank[i] / max(rank)) < 1e-9 for i in range(n))
    assert graph.pagerank(spark.createDataFrame([], "node long"), df).count() == 0


def test_expansions(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls"), ("a", "e", "imports"), ("x", "a", "strange")], "source string, target string, relation string")
    importance = spark.createDataFrame([(k, 0.5) for k in "abcdex"], "node string, importance double")
    seeds = spark.createDataFrame([("q", "a", 1.0)], "query_id string, node string, score double")
    want = {"a": 1.0, "b": 1.0, "c": 0.5, "e": 0.4, "x": 0.3}
    assert {r.node: r.proximity for r in graph.expand_two_hops(seeds, edges, importance).collect()} == pytest.approx(want)
    best = {r.node: r for r in graph.expand_best_first(seeds, edges, importance).collect()}
    assert {k: r.proximity for k, r in best.items()} == pytest.approx(want) and (best["c"].how, best["c"].via) == ("calls →", "b")


def test_packing(spark):
    rows = spark.createDataFrame([("q", 1, 5), ("q", 2, 90), ("q", 3, 4), ("q", 4, 3), ("r", 1, 200)], "query_id string, rank int, cost int")
    assert sorted((r.query_id, r.rank) for r in pack.pack_prefix(rows, 100).collect()) == [("q", 1), ("q", 2), ("q", 3)]
    assert sorted((r.query_id, r.rank, r.used) for r in pack.pack_first_fit(rows, 12).collect()) == [("q", 1, 5), ("q", 3, 9), ("q", 4, 12)]


def test_notes(spark):
    log = spark.createDataFrame([(1, "a", False), (2, "b", None), (3, "a", False), (4, "b", True), (5, "b", False), (6, "c", True)], "pos long, uid string, deleted boolean")
    assert {(r.uid, r.pos, r.place) for r in notes.fold(log).collect()} == {("a", 3, 1), ("b", 5, 5)}


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, tmp_path / "s")
    e = "node_key string, text_hash string, model string, dim int, vector array<float>"
    store.commit({"x": spark.range(3)}, {"k": "v"})
    with pytest.raises(Exception):  # noqa: B017
        store.commit({"x": spark.range(5), "y": spark.range(1).select(F.raise_error(F.lit("no")))})
    assert store.read("x").count() == 3 and not store.has("y") and store.meta("k") == "v" and store.read("z", e).count() == 0
    old = spark.createDataFrame([("a", "1", "m", 1, [1.0]), ("b", "2", "m", 1, [1.0])], e)
    texts = spark.createDataFrame([("a", "new text")], "node_key string, text string")
    assert [r.node_key for r in embeddings_due(texts, old, "m").collect()] == ["a"]
    assert [r.node_key for r in upsert_embeddings(old, old.filter("node_key = 'a'"), texts).collect()] == ["a"]


def test_queries_against_sql(spark, data):
    """A few of the registered queries beside their SQL; compare.py runs them all."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("nodes", "edges", "memories", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    q, sql = queries(), oracle_sql()
    for name in ("p1_found", "p5_found", "p7_found", "labels", "label_groups", "note_log"):
        df = q[name](spark, data)
        cols = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql[name]})").fetchall()
        assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(str, want)), name
