"""Hierarchies, orphan references and change feeds against brute force, with their edge cases."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from knotwork.functions.instants import instant_micros
from knotwork.operators import changes, hierarchy, orphans


def brute(parents: dict) -> dict:
    out = {}
    for start in parents:
        seen, at = [], start
        while True:
            if at in seen:
                out[start] = (min(seen[seen.index(at) :]), -1)
                break
            seen.append(at)
            if parents[at] is None or parents[at] not in parents:
                out[start] = (at, len(seen) - 1)
                break
            at = parents[at]
    return out


@pytest.mark.parametrize(("n", "group", "leaf", "seed"), [(60, 1000, 1000, 1), (400, 40, 60, 2), (300, 10, 30, 3)])
def test_hierarchy(spark, n, group, leaf, seed):
    r = random.Random(seed)
    # every shape: trees, long chains across all partitions, circles, parents that are not there
    parents = {i: r.choice([None, r.randrange(n), i - 1 if i else None, 10**9, i if r.random() < 0.1 else (i * 7 + 3) % n]) for i in range(n)}
    rows = [(k, p, "x") for k, p in parents.items()]
    df = spark.createDataFrame([*rows, *rows[:5], (None, 3, "x")], "id long, parent_id long, steps string").repartition(3)
    got = {x.id: (x.root_id, x.depth) for x in hierarchy.roots(df, group_rows=group, leaf_rows=leaf).collect()}
    assert got == brute(parents)


def test_one_long_chain_and_one_long_circle(spark):
    n = 500
    chain = {i: i - 1 if i else None for i in range(n)} | {n + i: n + (i * 37 + 37) % n if n % 37 else None for i in range(n)}
    df = spark.createDataFrame(list(chain.items()), "id long, parent_id long")
    got = {x.id: (x.root_id, x.depth) for x in hierarchy.roots(df, group_rows=20, leaf_rows=50).collect()}
    assert got == brute(chain)


def test_paths(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, None), (4, 4, "c"), (-5, 1, "neg")], "id long, parent_id long, name string")
    got = {r.id: r for r in hierarchy.paths(df).collect()}
    assert got[3].path == [1, 2, 3] and got[3].path_names == "a > b > ?" and got[1].n_descendants == 3 and got[-5].depth == 1
    assert got[4].path is None and got[4].depth == -1
    empty = spark.createDataFrame([], "id long, parent_id long, name string")
    assert hierarchy.paths(empty).count() == 0 and hierarchy.circles(empty).count() == 0


def test_instants(spark):
    texts = ["2024-05-01T08:22:49+00:00", "2024-05-01 08:22:49", "2024-05-01T10:22:49+02:00", "2024-05-01T08:22:49.000Z", "1714551769", "1714551769000", "2024-05-01T082249", "2024-13-01T00:00:00Z", "unknown", "", None, "2024-05-01T08:22", "2024-05-01T13:52:49+0530"]
    want = [1714551769] * 6 + [None] * 5 + [1714551720, 1714551769]
    got = [r.m for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", instant_micros(F.col("t")).alias("m")).orderBy("i").collect()]
    assert got == [None if w is None else w * 1_000_000 for w in want]


def _feed(spark, rows):
    return spark.createDataFrame(rows, "log_pos long, change_id string, uid string, created_at string, deleted boolean, topic string")


def test_changes(spark):
    rows = [
        (1, "a", "u", "2024-01-02T00:00:00Z", None, "late"), (2, "b", "u", "2024-01-01T00:00:00Z", False, "early"), (3, "a", "u", "2024-01-02T00:00:00Z", None, "late"),
        (4, "c", "v", "2024-01-01T00:00:00Z", None, "x"), (5, "d", "v", "2024-01-03T00:00:00Z", True, None), (6, "e", "w", "bad", None, "x"), (7, "f", "", "2024-01-01T00:00:00Z", None, "x"),
        (8, "g", None, "2024-01-01T00:00:00Z", None, "x"), (9, None, "z", "2024-01-01T00:00:00Z", None, "one"), (10, None, "z", "2024-01-01T00:00:00Z", None, "two"), (11, "h", "y", "2024-01-01T00:00:00Z", True, None),
    ]
    got = {(r.uid, r.log_pos, r.topic) for r in changes.latest_notes(_feed(spark, rows), ("topic",)).collect()}
    assert got == {("u", 1, "late"), ("z", 10, "two")}
    assert changes.latest_notes(_feed(spark, [])).count() == 0


def _replay(ops, base):
    """The rows alive after the operations in order, one by one."""
    state = {k: dict(v) for k, v in base.items()}
    for k, _, kind, a, b, sets_a, sets_b in sorted(ops, key=lambda o: o[1]):
        if kind == "put":
            state[k] = {"a": a, "b": b}
        elif kind == "remove":
            state.pop(k, None)
        elif k in state:
            state[k].update({c: v for c, v, s in (("a", a, sets_a), ("b", b, sets_b)) if s})
    return {(k, v["a"], v["b"]) for k, v in state.items()}


def test_patches_compose_in_any_grouping(spark):
    r = random.Random(5)
    ops = []
    for t in range(400):
        k = 0 if r.random() < 0.4 else r.randrange(9)
        kind = r.choice(["put", "update", "update", "update", "remove"] if r.random() < 0.7 else ["update"])
        ops.append((k, t, kind, r.choice([None, *range(9)]), r.randrange(9), r.random() < 0.5, r.random() < 0.5))
    shuffled = [*ops, *ops[:20], (None, 1, "put", 1, 1, True, True), (3, None, "put", 1, 1, True, True)]
    r.shuffle(shuffled)
    feed = spark.createDataFrame(shuffled, "k long, t long, kind string, a long, b long, sets_a boolean, sets_b boolean").repartition(5).withColumn("place", changes.place(F.col("t"), F.lit(3))).drop("t")
    old = {k: {"a": 1, "b": 2} for k in range(12)}
    base = spark.createDataFrame([(k, 1, 2, "x") for k in range(12)] + [(None, 1, 2, "x")], "k long, a long, b long, place string")
    for chunks, fan in ((1, 8), (7, 2), (64, 4)):
        got = [(x.k, x.a, x.b) for x in changes.apply_feed(feed, ["k"], ["a", "b"], base, chunks, fan).collect()]
        assert len(got) == len(set(got)) and set(got) == _replay(ops, old)
    assert {(x.k, x.a, x.b) for x in changes.apply_feed(feed, ["k"], ["a", "b"]).collect()} == _replay(ops, {})
    assert {(x.k, x.a, x.b) for x in changes.apply_feed(feed.filter("false"), ["k"], ["a", "b"], base).collect()} == _replay([], old)


def test_removed_rows_are_gone(spark):
    feed = spark.createDataFrame([("a", 1, "remove", None, None), ("c", 1, "update", 5, True), ("b", 2, "update", 7, True)], "k string, t long, kind string, v long, sets_v boolean").withColumn("place", changes.place(F.col("t"), F.lit(0)))
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    assert [(x.k, x.v) for x in changes.apply_feed(feed, ["k"], ["v"], base).collect()] == [("b", 7)]


REF = "key string, ref_table string, ref_row long, ref_field string, ref_value string, at long"


def _status(state):
    return {(r.ref_row, r.status) for r in state.orphans().collect()}


def test_orphans_batch_by_batch(spark):
    """Parents that come late, go and come back; the state after several batches is that of brute force."""
    refs = spark.createDataFrame([("k1", "t", 1, "f", "k1", 5), ("k2", "t", 2, "f", "k2", 5), ("k2", "t", 2, "f", "k2", 5), ("k3", "t", 3, "f", "k3", None)], REF)
    parent = lambda *rows: spark.createDataFrame(list(rows), "key string, since long")
    s = orphans.empty_state(refs).step(new_parents=parent(("k1", 1), ("k1", 9)), new_refs=refs)
    assert _status(s) == {(2, "pending"), (3, "pending")}
    s = s.step(new_parents=parent(("k2", 7), ("k3", 7)))
    assert _status(s) == {(2, "late")}
    s = s.step(removed=parent(("k1", 0), ("nobody", 0)))
    assert _status(s) == {(1, "pending"), (2, "late")}
    s = s.step(new_parents=parent(("k1", 3)), new_refs=refs.withColumn("ref_row", F.col("ref_row") + 10))
    assert _status(s) == {(2, "late"), (12, "late")}
    assert {(r.month, r.n_orphans) for r in s.snapshot().collect()} == {("1970-01", 2)}


def test_orphans_do_not_depend_on_the_batches(spark):
    """Any split of arrivals and references into batches between the removals gives the state of one batch."""
    r = random.Random(8)
    parents = [(f"k{r.randrange(12)}", r.randrange(20)) for _ in range(40)]
    refs = [(k := f"k{r.randrange(14)}", "t", i, "f", k, r.choice([None, *range(20)])) for i in range(60)]
    removed, back = ["k1", "k2", "k13"], [("k1", 15)]
    since = {}
    for k, t in parents:
        since[k] = min(t, since.get(k, t))
    since = {k: t for k, t in since.items() if k not in removed} | dict(back)
    want = {(i, "pending" if k not in since else "late") for k, _, i, _, _, at in refs if k not in since or (at is not None and at < since[k])}
    for n in (1, 2, 5):
        s = orphans.empty_state(spark.createDataFrame([], REF))
        cut = lambda rows: [rows[i::n] for i in range(n)]
        r.shuffle(parents)
        r.shuffle(refs)
        for some, asked in zip(cut(parents), cut(refs), strict=True):
            s = s.step(spark.createDataFrame(some, "key string, since long"), None, spark.createDataFrame(asked, REF))
        s = s.step(spark.createDataFrame(back, "key string, since long"), spark.createDataFrame([(k,) for k in removed], "key string"))
        assert _status(s) == want


def test_orphans_empty(spark):
    nodes = spark.createDataFrame([], "id long, node_key string, indexed_at timestamp_ntz")
    removed = spark.createDataFrame([], "node_id long, node_key string, removed_at timestamp_ntz")
    edges = spark.createDataFrame([], "edge_id long, source_id long, target_id long, linked_at timestamp_ntz")
    notes = spark.createDataFrame([(1, "bad", {"k": "h"}), (2, None, None)], "log_pos long, created_at string, anchors map<string,string>")
    state, history = orphans.replayed(nodes, removed, edges, notes, history=True)
    assert [(r.ref_table, r.ref_row, r.ref_value) for r in state.orphans().collect()] == [("memories", 1, "k")] and history.count() == 1
    state, history = orphans.replayed(nodes, removed, edges, notes.filter("false"), history=True)
    assert state.orphans().count() == 0 and history.count() == 0


def test_orphans_end_as_the_tables_stand(spark):
    """Whatever removals say, what is in nodes at the end is there."""
    day = lambda m: datetime.datetime(2024, m, 5)
    nodes = spark.createDataFrame([(1, "a", day(9)), (2, "b", day(2)), (3, "c", day(1))], "id long, node_key string, indexed_at timestamp_ntz")
    removed = spark.createDataFrame([(1, "a", day(6)), (2, "b", day(6)), (4, "d", None), (5, "e", day(3)), (None, None, day(3))], "node_id long, node_key string, removed_at timestamp_ntz")
    edges = spark.createDataFrame([(10 * i + m, i, None, day(m)) for i in (1, 2, 3, 4, 5) for m in (4, 8)], "edge_id long, source_id long, target_id long, linked_at timestamp_ntz")
    notes = spark.createDataFrame([], "log_pos long, created_at string, anchors map<string,string>")
    state, history = orphans.replayed(nodes, removed, edges, notes, history=True)
    assert _status(state) == {(14, "late"), (18, "late"), (44, "pending"), (48, "pending"), (54, "pending"), (58, "pending")}
    # at the end of June node 1 had just been taken out, and nobody knew that it would come back
    assert {(x.period, x.status): x.n_orphans for x in history.collect() if x.period in ("2024-04", "2024-07")} == {("2024-04", "pending"): 3, ("2024-07", "late"): 2, ("2024-07", "pending"): 4}
