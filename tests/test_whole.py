"""Cases in which a cut would lose rows: large groups, many rows, nodes below circles, long texts."""

import random

from pyspark.sql import functions as F

from knotwork.functions import text as X
from knotwork.operators import hierarchy, pack, summaries
from knotwork.plans import graph_queries


def first_fit(costs, limit):
    used, out = 0, []
    for rank, cost in costs:
        if used + cost <= limit:
            used += cost
            out.append((rank, used))
    return out


def test_first_fit_takes_what_comes_after_many_large_documents(spark, tmp_path):
    texts = ["x" * 6600] * 70 + ["y" * 330] * 12 + ["z"]
    spark.createDataFrame([(i, "r", t) for i, t in enumerate(texts)], "doc_id long, repo string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((x.used, x.doc_id) for x in graph_queries.pack_first_fit(spark, str(tmp_path)).collect())
    assert got == [(2000 + 100 * i, 69 + i if i else 0) for i in range(11)]


def test_first_fit_in_any_order(spark):
    r = random.Random(4)
    groups = {"a": [r.randrange(1, 400) for _ in range(900)], "b": [1, 300] * 200, "c": [1] * 500, "d": [301, 900], "e": [r.choice([1, 2, 299, 300]) for _ in range(300)]}
    rows = [(g, i, c) for g, costs in groups.items() for i, c in enumerate(costs)]
    r.shuffle(rows)
    got = {(x.query_id, x.rank, x.used) for x in pack.pack_first_fit(spark.createDataFrame(rows, "query_id string, rank int, cost int"), 300).collect()}
    assert got == {(g, *x) for g, costs in groups.items() for x in first_fit(enumerate(costs), 300)}


def test_map_ranks_every_module(spark):
    n = 1300
    nodes = [(f"m{i}", "module", f"m{i}", f"a/m{i:04}.py", 1, None, "Text." if i % 13 else None, True, (i * 7 % 50) / 10) for i in range(n)]
    schema = "key string, type string, name string, file_path string, start_line int, signature string, docstring string, is_public boolean, importance double"
    edges = spark.createDataFrame([], "source_key string, target_key string, relation string")
    got = pack.repo_map(spark.createDataFrame(nodes, schema).repartition(5), edges).collect()
    want = sorted((-x[8], x[3]) for x in nodes if x[6])
    assert [(x.rank, x.file_path) for x in sorted(got)] == [(k, path) for k, (_, path) in enumerate(want, 1)]


def test_numbered(spark):
    rows = spark.range(5000).selectExpr("id", "id % 3 AS k").repartition(7)
    got = pack.numbered(rows, "k", "id", name="n").collect()
    assert sorted((x.n, x.k, x.id) for x in got) == [(i, k, v) for i, (k, v) in enumerate(sorted((v % 3, v) for v in range(5000)), 1)]
    assert pack.numbered(rows.filter("id < 0"), "k", "id").count() == 0


def test_descendants_on_and_below_circles(spark):
    r = random.Random(6)
    # a circle of seven with trees, chains and branches below it, one of one, one of two, and ordinary trees
    parents = {i: (i + 1) % 7 for i in range(7)} | {7: 7, 8: 9, 9: 8, 10: None} | {i: r.choice([r.randrange(i), i - 1]) for i in range(11, 90)}
    want = {}
    for start in parents:
        at, steps, seen = parents[start], 1, {start}
        while at is not None and at not in seen:
            want[at, start] = steps
            seen.add(at)
            at, steps = parents[at], steps + 1
    df = spark.createDataFrame([(k, p, "x") for k, p in parents.items()], "id long, parent_id long, name string")
    got = hierarchy.descendants(df).collect()
    assert len(got) == len(want) and {(x.ancestor_id, x.id): x.distance for x in got} == want
    counts = {x.id: x.n_descendants for x in hierarchy.paths(df).collect()}
    assert counts == {k: sum(a == k for a, _ in want) for k in parents}


def test_docstrings_are_taken_whole(spark, tmp_path):
    long = "word " * 300 + "ledger"
    node = (1, "k", "class", "A", "m.A", "r", "m.py", 1, 9, "class A", long, True, "h", None, 0.5)
    schema = "id long, node_key string, type string, name string, qualname string, repo string, file_path string, start_line int, end_line int, signature string, docstring string, is_public boolean, content_hash string, parent_id long, importance double"
    other = (2, "o", "class", "B", "m.B", "r", "m.py", 10, 19, "class B", "Nothing", True, "h", None, 0.5)
    nodes = spark.createDataFrame([node, other], schema)
    nodes.write.parquet(f"{tmp_path}/nodes.parquet")
    for query in (graph_queries.bm25_nodes, graph_queries.bm25_nodes_stemmed):
        assert [(x.query_id, x.id) for x in query(spark, str(tmp_path)).collect()] == [("q2", 1)]
    indexed = summaries.index_documents(nodes.selectExpr("node_key AS key", "*", "'' AS summary").filter("id = 1"))
    assert indexed.first().docstring == long
    text = X.embedding_text(*(F.col(c) for c in ("type", "name", "qualname", "file_path", "signature", "docstring")))
    assert nodes.filter("id = 1").select(text.alias("t")).first().t.endswith("ledger")
