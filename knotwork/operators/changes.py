"""Applying a change feed of inserts, updates and deletes.

Method: associative patch composition. An ordered operation is a function on a row: a put forgets what was before and sets
every column, a removal forgets all, an update sets some columns of a row that is there. A patch, the composition of any
run of operations, is written as the places in the order of the operations that survive in it: of the last put, of the
last removal, and per column of the last update. Composing two patches takes the later place of each, which is
associative, commutative and fit for partial aggregation. The feed is cut into range chunks by the order; every key's
patches are composed within its chunks, then within ever wider ranges of chunks (a tree of FAN-fold levels), so that no
task composes a hot key's operations alone. The last patches are applied to the base, and the values that survive are
fetched by the places of their operations.

Cases: operations without key or place are not applied; of several operations at one place of a key one counts, the one
of the greatest kind and values; a change id counts once, at its first position; a null change id is a change of its own;
ties in time go by the first position; updating or removing what is not there has no effect; a removed row may be put
again; an empty feed leaves the base as it is, an empty base is one without rows; base rows without key are dropped;
extra columns are ignored unless named as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.instants import instant_micros
from knotwork.session import materialize

PUT, UPDATE, REMOVE = "put", "update", "remove"
#: The feed's order is cut into this many ranges; a level of the tree composes FAN neighbouring ranges.
CHUNKS, FAN = 64, 8
#: Positions are below this; a place is an instant times this, and the position.
_POSITIONS = str(10**19)


def place(at: Column, position: Column) -> Column:
    """One number that orders by instant (a long), then by position (a long that is not negative)."""
    return (at.cast("decimal(18,0)") * F.lit(_POSITIONS).cast("decimal(20,0)")).cast("decimal(38,0)") + position.cast("decimal(19,0)")


def position_of(at: str) -> Column:
    return F.pmod(F.col(at), F.lit(_POSITIONS).cast("decimal(20,0)")).cast("long")


def first_arrivals(log: DataFrame, change_id: str, position: str) -> DataFrame:
    """The rows of the log that are the first of their change. Positions are unique."""
    # only numbers are aggregated; the rows come back by their position
    first = log.filter(F.col(change_id).isNotNull()).groupBy(change_id).agg(F.min(position).alias(position)).select(position)
    return log.filter(F.col(change_id).isNotNull()).join(first, position, "left_semi").unionByName(log.filter(F.col(change_id).isNull()))


def range_chunks(ops: DataFrame, by: str, chunks: int = CHUNKS) -> DataFrame:
    """ops with _chunk, the number of the range of `by` (a number) that a row lies in; ranges hold about equally many."""
    cuts = ops.agg(F.percentile_approx(F.col(by).cast("double"), [k / chunks for k in range(1, chunks)], 1000).alias("c")).first().c or []
    number = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c <= F.col(by).cast("double"))) if cuts else F.lit(0)
    return ops.withColumn("_chunk", number)


def compose(ops: DataFrame, key: list[str], columns: list[str], chunks: int = CHUNKS, fan: int = FAN) -> DataFrame:
    """One patch per key: the places _put, _gone and _set_<column> (null: no such operation).

    ops: key, place (see place()), kind (PUT, UPDATE, REMOVE), and per column sets_<column>, true where an update sets it.
    """
    last = {"_put": F.when(F.col("kind") == PUT, F.col("place")), "_gone": F.when(F.col("kind") == REMOVE, F.col("place"))}
    last |= {f"_set_{c}": F.when((F.col("kind") == UPDATE) & F.col(f"sets_{c}"), F.col("place")) for c in columns}
    some = ops.filter(F.col("place").isNotNull())
    for k in key:
        some = some.filter(F.col(k).isNotNull())
    parts = range_chunks(some, "place", chunks).groupBy(*key, "_chunk").agg(*[F.max(c).alias(n) for n, c in last.items()])
    width = fan
    while width < chunks:
        parts = parts.groupBy(*key, F.floor(F.col("_chunk") / fan).alias("_chunk")).agg(*[F.max(n).alias(n) for n in last])
        width *= fan
    return parts.groupBy(*key).agg(*[F.max(n).alias(n) for n in last])


def alive(patches: DataFrame, key: list[str], columns: list[str], base: DataFrame | None = None) -> DataFrame:
    """The keys alive after the patches and, per column, the place _at_<column> of the operation whose value it has (null:
    the base's value)."""
    none = F.lit(None).cast("decimal(38,0)")
    after = patches if base is None else patches.join(base.select(*key, F.lit(True).alias("_old")), key, "full")
    there = F.col("_put") > F.coalesce("_gone", F.col("_put") - 1)
    if base is not None:
        there = there | (F.col("_old") & F.col("_put").isNull() & F.col("_gone").isNull())
    at = [F.when(F.col(f"_set_{c}") > F.coalesce("_put", F.col(f"_set_{c}") - 1), F.col(f"_set_{c}")).otherwise(F.coalesce("_put", none)).alias(f"_at_{c}") for c in columns]
    return after.filter(F.coalesce(there, F.lit(False))).select(*key, F.col("_put"), *at)


def apply_feed(ops: DataFrame, key: list[str], columns: list[str], base: DataFrame | None = None, chunks: int = CHUNKS, fan: int = FAN) -> DataFrame:
    """key and columns of the rows alive after the operations (as for compose, with the columns' values) on the base."""
    # of several operations at one place one is taken, so that a place names one row of values
    ops = ops.select(*key, "place", "kind", *columns, *[F.coalesce(F.col(f"sets_{c}"), F.lit(False)).alias(f"sets_{c}") for c in columns])
    ops = ops.groupBy(*key, "place").agg(F.max(F.struct("kind", *columns, *[f"sets_{c}" for c in columns])).alias("o")).select(*key, "place", "o.*")
    if base is not None:
        base = base.select(*key, *columns)
        for k in key:
            base = base.filter(F.col(k).isNotNull())
        base = base.dropDuplicates(key)
    ops = materialize(ops)
    after = materialize(alive(compose(ops, key, columns, chunks, fan), key, columns, base))
    # a row's values come from few operations: at most one for each column
    wanted = after.select(*key, F.explode(F.array_distinct(F.array_compact(F.array(*[f"_at_{c}" for c in columns])))).alias("place"))
    values = ops.join(wanted, [*key, "place"]).groupBy(*key).agg(F.collect_list(F.struct("place", *columns)).alias("_ops"))
    out = after.join(values, key, "left")
    if base is not None:
        out = out.join(base.select(*key, *[F.col(c).alias(f"_base_{c}") for c in columns]), key, "left")

    def value(c: str) -> Column:
        from_op = F.filter("_ops", lambda o: o["place"] == F.col(f"_at_{c}"))[0][c]
        return F.when(F.col(f"_at_{c}").isNotNull(), from_op).otherwise(F.col(f"_base_{c}") if base is not None else None).alias(c)

    return out.select(*key, *[value(c) for c in columns])


def note_operations(memories: DataFrame) -> DataFrame:
    """uid, place, kind of the log's changes, each once: a removal, or a put of the whole note."""
    # only numbers and the key travel; the rows' other columns are fetched by position
    log = memories.select("uid", "change_id", "log_pos", instant_micros(F.col("created_at")).alias("at"), F.coalesce("deleted", F.lit(False)).alias("gone"))
    first = first_arrivals(log, "change_id", "log_pos").filter("uid is not null and uid != '' and at is not null")
    return first.select("uid", place(F.col("at"), F.col("log_pos")).alias("place"), F.when(F.col("gone"), F.lit(REMOVE)).otherwise(F.lit(PUT)).alias("kind"))


def latest_notes(memories: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """uid, log_pos (first position of the change that gave the last state) and the named columns of the notes alive."""
    patches = compose(note_operations(memories), ["uid"], [])
    kept = alive(patches, ["uid"], []).select("uid", position_of("_put").alias("log_pos"))
    if not columns:
        return kept
    return memories.select("log_pos", *columns).join(kept, "log_pos").select("uid", "log_pos", *columns)


def node_feed(nodes: DataFrame, removed: DataFrame, memories: DataFrame) -> DataFrame:
    """node_key, place, kind, content_hash, noted_hash, sets_noted_hash: what happened to nodes that were taken out or noted.

    A removal takes a node out, its row in nodes puts it back with its content hash when it was indexed, and a note's
    anchors update the hash under which the node was last noted."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    none = F.lit(None).cast("string")
    row = lambda at, position, kind, content, noted, sets: (place(at, position).alias("place"), F.lit(kind).alias("kind"), content.alias("content_hash"), noted.alias("noted_hash"), F.lit(False).alias("sets_content_hash"), F.lit(sets).alias("sets_noted_hash"))
    back = nodes.join(removed.select("node_key").distinct(), "node_key", "left_semi").select("node_key", *row(micros("indexed_at"), F.lit(2**62), PUT, F.col("content_hash"), none, False))
    gone = removed.select("node_key", *row(micros("removed_at"), F.lit(0), REMOVE, none, none, False))
    noted = memories.select("log_pos", instant_micros(F.col("created_at")).alias("at"), F.explode("anchors").alias("node_key", "hash")).select("node_key", *row(F.col("at"), F.col("log_pos") + 1, UPDATE, none, F.col("hash"), True))
    return back.unionByName(gone).unionByName(noted)


def current_nodes(nodes: DataFrame, removed: DataFrame, memories: DataFrame) -> DataFrame:
    """node_key, content_hash, noted_hash of the nodes that are there after the feed of node_feed.

    The base has every node that was never taken out as it is in nodes, and those that were, without their hashes."""
    was = removed.select("node_key").distinct()
    stay = nodes.filter("node_key is not null").groupBy("node_key").agg(F.min("content_hash").alias("content_hash")).join(was, "node_key", "left_anti")
    base = stay.unionByName(was.withColumn("content_hash", F.lit(None).cast("string"))).withColumn("noted_hash", F.lit(None).cast("string"))
    return apply_feed(node_feed(nodes, removed, memories), ["node_key"], ["content_hash", "noted_hash"], base)
