"""Most similar vectors for every vector.

Method: NN-descent. A neighbour graph is started from random-projection forests (rows sorted by the side of random planes
they lie on, cut into blocks, every block compared with itself), then improved at every size by joining neighbours of
neighbours until few lists change; a round compares only pairs of which one is new around their pivot. The graph also
answers queries by greedy search. Comparisons run on vectors rounded to bytes; what is within their rounding error of a
list's k-th is put in exact order by the whole vectors at the end.

As NN-descent does, a round samples the pairs around a pivot that many lists name: its members meet in random groups of
LOCAL, other ones every round. against_all() is the exact way, for a stated set of queries in blocks.

Equal vectors are one class: the graph runs over classes, and a class's members come back at the end, so copies neither
crowd a list nor meet in one task. Lists of the members take equal cosines in the order of node_key.

Cases: unusable vectors (null, not dim long, all zero, NaN or infinite values) and rows without node_key or model take no
part; vectors of one model that differ in length are not compared; identical rows count once, of several rows of a node
the one with the smallest text_hash; a model with fewer nodes than k gives shorter lists; empty tables give empty results;
extra columns are ignored. Results are approximate; the tests and p4_recall measure recall against brute force.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import materialize

#: Neighbours kept while the graph is built, at least, and twice k; random orders; rows compared at once; share of changes to go on for.
KEEP, TREES, BLOCK, MOVING = 10, 8, 1024, 0.01
#: A graph that still moves after so many rounds is reported as not converged.
ROUNDS = 20
#: Members of a neighbourhood compared at once.
LOCAL = 64
#: No rounded cosine is farther than this from the exact one (vectors of ten numbers or more).
ROUNDING = 0.01
#: Queries that against_all compares with everything in one pass.
QUERIES = 4096

_LISTS = "id long, far array<float>, nbr array<long>"


def usable(embeddings: DataFrame) -> DataFrame:
    """model, node_key, vector: one usable vector per node."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 3e38)) & F.exists(v, lambda x: x != 0)
    some = embeddings.select("model", "node_key", "text_hash", "dim", "vector").filter(v.isNotNull() & F.col("node_key").isNotNull() & F.col("model").isNotNull() & (F.size(v) == F.col("dim")) & (F.size(v) > 0)).filter(fine)
    return some.groupBy("model", "node_key").agg(F.min(F.struct("text_hash", "vector"))["vector"].alias("vector"))


def _bytes(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of equal length as one matrix."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
        joined = b"".join(c.to_pylist())
        return np.frombuffer(joined, np.int8).reshape(len(c), -1)
    return np.asarray(c.flatten(), np.float64).reshape(len(c), -1)


def _by_length(model: list[str], column: pa.Array) -> Iterator[np.ndarray]:
    lengths = np.asarray(pa.compute.list_value_length(column)) if not pa.types.is_binary(column.type) else np.array([len(x) for x in column.to_pylist()])
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


def _keys(trees: int, bits: int):
    """Adds the rounded vector and, per tree, its place: the sides of `bits` random planes, then a random projection."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            model, vector = b.column("model").to_pylist(), b.column("vector")
            code, place, packed = np.zeros((len(model), trees), np.int64), np.zeros((len(model), trees)), np.empty(len(model), object)
            for at in _by_length(model, vector):
                x = _matrix(vector.take(pa.array(at)))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                planes = np.random.default_rng(17).standard_normal((x.shape[1], trees, bits + 1))
                side = np.einsum("nd,dtb->ntb", x, planes)
                code[at] = ((side[:, :, :bits] > 0) * (1 << np.arange(bits))[::-1]).sum(axis=2)
                place[at] = side[:, :, bits]
                packed[at] = [r.tobytes() for r in _bytes(x)]
            ids, k = np.asarray(b.column("id")), np.repeat(np.arange(len(model)), trees)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[k]), pa.array([model[i] for i in k], pa.string()), pa.array(packed[k], pa.binary()), pa.array(np.tile(np.arange(trees, dtype=np.int32), len(model))), pa.array(code.ravel()), pa.array(place.ravel())],
                names=["id", "model", "bytes", "tree", "code", "place"],
            )

    return work


def _lists(ids: np.ndarray, sims: np.ndarray, names: np.ndarray, keep: int) -> pa.RecordBatch:
    """The keep best columns of every row of sims, as list columns; sims below -1 are none."""
    k = min(keep, sims.shape[1])
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    far = -np.take_along_axis(sims, top, axis=1)
    good = far <= 1.5
    offsets = pa.array(np.concatenate([[0], np.cumsum(good.sum(axis=1))]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(far[good].astype(np.float32))), pa.ListArray.from_arrays(offsets, pa.array(names[top][good]))], names=["id", "far", "nbr"])


def _similar(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """Cosines of rounded vectors. The products of bytes add up exactly, so a pair has one value wherever it is met."""
    kind = np.float32 if a.shape[1] <= 1000 else np.float64
    x = a.astype(kind)
    y = x if b is None else b.astype(kind)
    norms = [np.sqrt((z.astype(np.float64) ** 2).sum(axis=1)) for z in (x, y)]
    return (x @ y.T).astype(np.float64) / (norms[0][:, None] * norms[1][None, :])


def _compare_blocks(keep: int, block: int):
    """Sorted rows in blocks of the same tree and model, each compared with itself."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None

        def flush(rows: list[tuple]):
            ids = np.array([r[0] for r in rows], np.int64)
            sims = _similar(np.frombuffer(b"".join(r[1] for r in rows), np.int8).reshape(len(rows), -1))
            np.fill_diagonal(sims, -2)
            return _lists(ids, sims, ids, keep)

        for b in batches:
            for i, v, t, m in zip(b.column("id").to_pylist(), b.column("bytes").to_pylist(), b.column("tree").to_pylist(), b.column("model").to_pylist(), strict=True):
                if (t, m) != group:
                    if len(held) > 1:
                        yield flush(held)
                    held, group = [], (t, m)
                held.append((i, v))
                if len(held) >= 2 * block:  # never leaves a short rest
                    yield flush(held[:block])
                    held = held[block:]
        if len(held) > 1:
            yield flush(held)

    return work


def _merge(lists: DataFrame, keep: int) -> DataFrame:
    """One list per id: the keep nearest of all its lists."""
    pairs = F.arrays_zip(F.col("far"), F.col("nbr"))
    both = lists.select("id", pairs.alias("z")).groupBy("id").agg(F.flatten(F.collect_list("z")).alias("z"))
    best = F.slice(F.array_sort(F.array_distinct("z")), 1, keep)
    return both.select("id", best.alias("z")).select("id", F.col("z.far").alias("far"), F.col("z.nbr").alias("nbr"))


def _join_local(keep: int):
    """Rows (pivot, id, bytes, worst, new) sorted by pivot: of those around the same pivot, each pair with a new one meets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        size = 0

        def pairs():
            """What was found so far, each id's nearest ones only, so that a hub's lists stay short before they are merged."""
            x = np.concatenate(out, axis=1)
            i, j, s = x[0], x[1], x[2].view(np.float64)
            order = np.lexsort((j, -s, i))
            i, j, s = i[order], j[order], s[order]
            other = np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            i, j, s = i[other], j[other], s[other]
            start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            place = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
            i, j, s = i[place < keep], j[place < keep], s[place < keep]
            start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            offsets = pa.array(np.append(start, len(i)), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(i[start]), pa.ListArray.from_arrays(offsets, pa.array((-s).astype(np.float32))), pa.ListArray.from_arrays(offsets, pa.array(j))], names=["id", "far", "nbr"])

        def meet(held: list, q: slice) -> None:
            nonlocal size
            ids, worst, new = np.array(held[1][q]), np.array(held[2][q]), np.array(held[4][q])
            if not new.any():
                return
            sims = _similar(np.frombuffer(b"".join(held[3][q]), np.int8).reshape(len(ids), -1))
            a, b = np.nonzero((sims > worst[:, None]) & (ids[:, None] != ids[None, :]) & (new[:, None] | new[None, :]))
            if len(a):
                out.append(np.stack([ids[a], ids[b], sims[a, b].astype(np.float64).view(np.int64)]))
                size += len(a)

        held: list = []
        for b in batches:
            pivot = np.asarray(b.column("pivot"))
            ids, worst, raw, new = np.asarray(b.column("id")), np.asarray(b.column("worst")), b.column("bytes").to_pylist(), b.column("new").to_pylist()
            cut = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]])) if len(pivot) else np.zeros(0, int)
            for s, e in zip(cut, np.append(cut[1:], len(pivot)), strict=True):
                if held and held[0] != pivot[s]:
                    for p in range(0, len(held[1]), LOCAL):
                        meet(held, slice(p, p + LOCAL))
                    held = []
                if not held:
                    held = [pivot[s], [], [], [], []]
                held[1] += ids[s:e].tolist()
                held[2] += worst[s:e].tolist()
                held[3] += raw[s:e]
                held[4] += new[s:e]
                while len(held[1]) >= 2 * LOCAL:
                    meet(held, slice(0, LOCAL))
                    held = [held[0], *(h[LOCAL:] for h in held[1:])]
            if size > 300_000:
                yield pairs()
                out, size = [], 0
        if held:
            for p in range(0, len(held[1]), LOCAL):
                meet(held, slice(p, p + LOCAL))
        if out:
            yield pairs()

    return work


def classes(embeddings: DataFrame) -> DataFrame:
    """id (of the class), model (and length: what may be compared), vector, node_key of every usable vector."""
    each = usable(embeddings).withColumn("model", _space("model", "vector"))
    return each.withColumn("id", F.xxhash64("model", "vector"))


def _space(model: str, vector: str) -> Column:
    return F.concat_ws("/", F.col(model), F.size(vector).cast("string"))


def first_members(each: DataFrame, most: int) -> DataFrame:
    """The first members of every class by node_key, with place. Spark cuts the groups before they meet."""
    return each.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("node_key"))).filter(F.col("place") <= most)


def _keyed(vectors: DataFrame, trees: int, bits: int) -> DataFrame:
    return materialize(vectors.select("id", "model", "vector").mapInArrow(_keys(trees, bits), "id long, model string, bytes binary, tree int, code long, place double"))


def _ordered(keyed: DataFrame, n: int, trees: int, block: int) -> DataFrame:
    parts = max(keyed.sparkSession.sparkContext.defaultParallelism, n * trees // (32 * block))
    return keyed.repartitionByRange(parts, "tree", "model", "code", "place").sortWithinPartitions("tree", "model", "code", "place")


def _bits(n: int, block: int) -> int:
    return int(max(0, min(40, np.ceil(np.log2(max(n, 1) / block)))))


def graph(reps: DataFrame, keep: int = KEEP, trees: int = TREES, block: int = BLOCK, rounds: int = ROUNDS, moving: float = MOVING) -> DataFrame:
    """id, far (negative cosines of rounded vectors), nbr: lists of about the keep nearest. reps: id, model, vector.

    Rounds go on until fewer than the share `moving` of all places in lists change; a warning tells if `rounds` were not
    enough."""
    n = reps.count()
    keyed = _keyed(reps, trees, _bits(n, block))
    ordered = _ordered(keyed, n, trees, block)
    near = materialize(_merge(ordered.mapInArrow(_compare_blocks(keep, block), _LISTS), keep).withColumn("old", F.array().cast("array<long>")))
    small = keyed.filter("tree = 0").select("id", "bytes")
    for turn in range(rounds):
        worst = near.select("id", F.when(F.size("far") >= keep, -F.element_at("far", -1)).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        links = near.select("id", F.explode(F.transform("nbr", lambda x: F.struct(x.alias("other"), (~F.array_contains("old", x)).alias("new")))).alias("z")).select("id", "z.*")
        around = links.select(F.col("id").alias("pivot"), F.col("other").alias("id"), "new").unionByName(links.select(F.col("other").alias("pivot"), "id", "new"))
        # a pivot around which nothing is new brings nobody together
        fresh = links.filter("new").select(F.explode(F.array("id", "other")).alias("pivot")).distinct()
        live = around.join(fresh, "pivot", "left_semi")
        seen = live.join(small.join(worst, "id"), "id").select("pivot", "id", "bytes", "worst", "new").hint("rebalance", "pivot").sortWithinPartitions("pivot", F.xxhash64("id", F.lit(turn)))
        better = _merge(near.select("id", "far", "nbr").unionByName(seen.mapInArrow(_join_local(keep), _LISTS)), keep)
        better = materialize(better.join(near.select("id", F.col("nbr").alias("old")), "id", "left").withColumn("old", F.coalesce("old", F.array().cast("array<long>"))))
        moved = better.agg(F.sum(F.size(F.array_except("nbr", "old"))).alias("m")).first().m or 0
        near = better
        if moved <= moving * keep * n:
            break
    else:
        warnings.warn(f"the neighbour graph still moved after {rounds} rounds: {moved} of {keep * n} places", stacklevel=2)
    return near.drop("old")


def _enter_blocks(keep: int, block: int):
    """Sorted rows in blocks of the same tree and model: the queries (asked) among them get the nearest others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None

        def flush(rows: list[tuple]):
            asked = np.array([r[2] for r in rows])
            if asked.any() and not asked.all():
                ids = np.array([r[0] for r in rows], np.int64)
                v = np.frombuffer(b"".join(r[1] for r in rows), np.int8).reshape(len(rows), -1)
                yield _lists(ids[asked], _similar(v[asked], v[~asked]), ids[~asked], keep)

        for b in batches:
            for i, v, t, m, a in zip(b.column("id").to_pylist(), b.column("bytes").to_pylist(), b.column("tree").to_pylist(), b.column("model").to_pylist(), b.column("asked").to_pylist(), strict=True):
                if (t, m) != group:
                    yield from flush(held)
                    held, group = [], (t, m)
                held.append((i, v, a))
                if len(held) >= 2 * block:
                    yield from flush(held[:block])
                    held = held[block:]
        yield from flush(held)

    return work


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = b.column("asked").to_pylist(), b.column("bytes").to_pylist()
        far = np.zeros(len(x), np.float32)
        lengths = np.array([len(v) if len(v) == len(w) else -1 for v, w in zip(x, y, strict=True)])
        for n in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == n)
            p, q = (np.frombuffer(b"".join(z[i] for i in at), np.int8).reshape(len(at), -1).astype(np.float64) for z in (x, y))
            far[at] = -(p * q).sum(axis=1) / (np.sqrt((p**2).sum(axis=1)) * np.sqrt((q**2).sum(axis=1)))
        yield pa.RecordBatch.from_arrays([b.column("query"), b.column("id"), pa.array(far)], names=["query", "id", "far"])


def search(embeddings: DataFrame, queries: DataFrame, k: int = 5, beam: int = 64, rounds: int = 8, trees: int = TREES, block: int = BLOCK) -> DataFrame:
    """query_id, node_key, cosine, rank: the k most similar nodes of the same model for every query vector.

    queries: query_id, model, vector. Greedy graph search: a query enters where the forests put it, then the best beam
    nodes it has met open their neighbours, round by round, until a round brings nothing better."""
    each = materialize(classes(embeddings))
    firsts = materialize(first_members(each, k))
    reps = firsts.filter("place = 1").select("id", "model", "vector")
    n, near = reps.count(), graph(reps, keep=max(KEEP, 2 * k), trees=trees, block=block)
    # a node is also reached from those whose list it is in: of these, the nearest ones join its own list
    links = near.select("id", F.explode(F.arrays_zip("far", "nbr")).alias("z")).select("id", "z.far", F.col("z.nbr").alias("other"))
    back = links.withColumn("n", F.row_number().over(Window.partitionBy("other").orderBy("far", "id"))).filter(F.col("n") <= 2 * max(KEEP, 2 * k)).select(F.col("other").alias("id"), F.col("id").alias("other"))
    links = materialize(links.select("id", "other").unionByName(back).distinct())
    asked = queries.filter("query_id is not null and model is not null and vector is not null").filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0)).dropDuplicates(["query_id"]).withColumn("id", F.xxhash64("query_id", F.lit("query")))
    asked = materialize(asked.select("query_id", "id", _space("model", "vector").alias("model"), "vector"))
    own, theirs = _keyed(asked, trees, _bits(n, block)), _keyed(reps, trees, _bits(n, block))
    both = own.withColumn("asked", F.lit(True)).unionByName(theirs.withColumn("asked", F.lit(False)))
    start = _merge(_ordered(both, n, trees, block).mapInArrow(_enter_blocks(beam, block), _LISTS), beam)
    small = theirs.filter("tree = 0").select("id", "bytes")
    wanted = own.filter("tree = 0").select(F.col("id").alias("query"), F.col("bytes").alias("asked"))
    best = materialize(start.select(F.col("id").alias("query"), F.explode(F.arrays_zip("nbr", "far")).alias("z")).select("query", F.col("z.nbr").alias("id"), "z.far", F.lit(False).alias("opened")))
    order = Window.partitionBy("query").orderBy("far", "id")
    for _ in range(rounds):
        seen = best.filter("not opened").join(links, "id").select("query", F.col("other").alias("id")).distinct()
        new = seen.join(best.select("query", "id"), ["query", "id"], "left_anti").join(small, "id").join(wanted, "query").mapInArrow(_score, "query long, id long, far float").withColumn("opened", F.lit(False))
        every = best.withColumn("opened", F.lit(True)).unionByName(new).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= beam).drop("n")
        best = materialize(every)
        if best.filter("not opened").isEmpty():
            break
    vectors = reps.select(F.col("id").alias("other"), F.col("vector").alias("other_vector"))
    exact = best.select(F.col("query").alias("id"), F.col("id").alias("other")).join(asked.select("id", "vector"), "id").join(vectors, "other").mapInArrow(_exact, "id long, other long, cosine double")
    members = firsts.select(F.col("id").alias("other"), "node_key")
    shown = exact.join(members, "other").join(asked.select("id", "query_id"), "id")
    ranked = shown.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "node_key")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "node_key", "cosine", "rank")


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c = b.column("vector"), b.column("other_vector")
        cosine = np.zeros(len(a))
        for at in _by_length([], a):
            x, y = _matrix(a.take(pa.array(at))), _matrix(c.take(pa.array(at)))
            cosine[at] = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("other"), pa.array(cosine)], names=["id", "other", "cosine"])


def similar(embeddings: DataFrame, k: int = 5, floor: float = -2.0, **how) -> DataFrame:
    """node_key, other_key, cosine, rank: the k most similar nodes of the same model for every usable vector.

    floor: leave out pairs below that cosine.
    """
    each = materialize(classes(embeddings))
    first = materialize(first_members(each, k + 1))
    reps = first.filter("place = 1").select("id", "model", "vector")
    near = graph(reps, **{"keep": max(KEEP, 2 * k), **how})
    # all that the rounding may have put behind the k-th
    close = F.filter(F.arrays_zip("far", "nbr"), lambda z: z["far"] <= F.element_at("far", F.least(F.size("far"), F.lit(k))) + 2 * ROUNDING)
    pairs = near.select("id", F.explode(close).alias("z")).filter(F.col("z.far") <= ROUNDING - floor).select("id", F.col("z.nbr").alias("other"))
    vectors = reps.select("id", "vector")
    # every pair once, whichever list it came from
    once = pairs.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct()
    exact = once.join(vectors, "id").join(vectors.select(F.col("id").alias("other"), F.col("vector").alias("other_vector")), "other").mapInArrow(_exact, "id long, other long, cosine double").filter(F.col("cosine") >= floor)
    exact = materialize(exact)
    both = exact.unionByName(exact.select(F.col("other").alias("id"), F.col("id").alias("other"), "cosine"))
    # members beyond the first k + 1 of a class are in nobody's list, and have only the first ones in their own
    crowd = first.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.col("id").alias("other"), F.lit(1.0).alias("cosine"))
    shown = both.unionByName(crowd).join(first.select(F.col("id").alias("other"), F.col("node_key").alias("other_key")), "other")
    asked = first.select("id", "node_key").join(shown.select("id", "other_key", "cosine"), "id")
    full = first.filter(F.col("place") == k + 1).select("id")
    late = each.join(full, "id", "left_semi").select("id", "model", "node_key").join(first.select("model", "node_key"), ["model", "node_key"], "left_anti")
    late = late.join(first.filter(F.col("place") <= k).select("id", F.col("node_key").alias("other_key")), "id").withColumn("cosine", F.lit(1.0)).select("id", "node_key", "other_key", "cosine")
    ranked = asked.unionByName(late).filter("node_key != other_key").withColumn("rank", F.row_number().over(Window.partitionBy("node_key").orderBy(F.desc("cosine"), "other_key")))
    return ranked.filter(F.col("rank") <= k).select("node_key", "other_key", "cosine", "rank")


def against_all(embeddings: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """node_key, other_key, cosine, rank: the exact k most similar others of the nodes in queries (node_key).

    The queries are compared with every vector, QUERIES of them in a pass over the table."""
    spark = embeddings.sparkSession
    each = materialize(usable(embeddings).withColumn("model", _space("model", "vector")))
    asked = materialize(each.join(queries.select("node_key").distinct(), "node_key", "left_semi"))
    passes = max(1, -(-asked.count() // QUERIES))
    found = None
    for turn in range(passes):
        # about QUERIES rows, whatever the table's size
        rows = asked.filter(F.pmod(F.xxhash64("node_key"), F.lit(passes)) == turn).collect()
        spaces = {m: ([r.node_key for r in rows if r.model == m], np.array([r.vector for r in rows if r.model == m], np.float64)) for m in {r.model for r in rows}}
        shared = spark.sparkContext.broadcast({m: (keys, v / np.linalg.norm(v, axis=1, keepdims=True)) for m, (keys, v) in spaces.items()})

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                models, names = np.array(b.column("model").to_pylist(), object), np.array(b.column("node_key").to_pylist(), object)
                for m, (keys, q) in shared.value.items():
                    at = np.flatnonzero(models == m)
                    if not len(at):
                        continue
                    x = _matrix(b.column("vector").take(pa.array(at)))
                    sims = q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                    sims[np.array(keys, object)[:, None] == names[at][None, :]] = -2
                    top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                    i = np.repeat(np.arange(len(keys)), top.shape[1])
                    rows = [(keys[a], names[at[c]], sims[a, c]) for a, c in zip(i, top.ravel(), strict=True) if sims[a, c] > -2]
                    yield pa.RecordBatch.from_pylist([dict(zip(("node_key", "other_key", "cosine"), r, strict=True)) for r in rows], pa.schema([("node_key", pa.string()), ("other_key", pa.string()), ("cosine", pa.float64())]))

        part = each.select("model", "node_key", "vector").mapInArrow(compare, "node_key string, other_key string, cosine double")
        found = part if found is None else found.unionByName(part)
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("node_key").orderBy(F.desc("cosine"), "other_key")))
    return best.filter(F.col("rank") <= k)


def recall(embeddings: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """n_queries, n_pairs, n_found, recall: how many of the exact k neighbours of the queries the lists hold. A neighbour
    counts as held if the list reaches its cosine: which of several equal ones it names does not matter."""
    lists = similar(embeddings, k).select("node_key", "rank", F.col("cosine").alias("have"))
    exact = materialize(against_all(embeddings, queries, k))
    met = exact.join(lists, ["node_key", "rank"], "left").agg(F.count_distinct("node_key").alias("n_queries"), F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("have") >= F.col("cosine") - 1e-6).alias("n_found"))
    return met.withColumn("recall", F.when(F.col("n_pairs") > 0, F.col("n_found") / F.col("n_pairs")))


def mutual(embeddings: DataFrame, k: int = 5, floor: float = 0.9, **how) -> DataFrame:
    """node_key_a < node_key_b: pairs of nodes in each other's lists of k whose cosine is at least floor."""
    lists = similar(embeddings, k, floor, **how).select(F.least("node_key", "other_key").alias("node_key_a"), F.greatest("node_key", "other_key").alias("node_key_b"))
    return lists.groupBy("node_key_a", "node_key_b").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("node_key_a", "node_key_b")
