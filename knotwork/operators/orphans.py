"""References to records that do not exist.

Method: keyed pending-orphan state, kept up batch by batch. New references probe the parent index; those without a parent
wait as pending orphans under their key; an arriving parent resolves the ones that wait for it; a removed parent reopens
the references to it; counts are taken of the state after any batch. The state keeps apart what may still change with an
arrival (pending and late references, few) from the resolved references, which are only appended to and are looked at
again where a removal reopens some. A step is a handful of keyed joins over tables, so no key's references ever meet in
one task: Spark splits a hot key's side of the join, and the parent side has one row per key.

Cases: null references are none; a reference whose own time is unknown is late only if its parent is missing; several
rows of a parent count as the one that came first; equal times count as there in time; a removal of what is not there has
no effect; empty tables give empty results; extra columns are ignored; repeated reference rows stay one row per (table,
row, field, value).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.instants import instant_micros
from knotwork.session import broadcast_if_small, materialize

REF = ["ref_table", "ref_row", "ref_field", "ref_value"]
#: A record that was there before anything is known of it.
ALWAYS = -(2**63)


@dataclass
class OrphanState:
    """parents: key, since. open: REF columns, at, key, status ('pending', 'late'). settled: tables like open, without status.

    A late reference was an orphan when it was written and found its parent afterwards.
    """

    parents: DataFrame
    open: DataFrame
    settled: list[DataFrame]

    def step(self, new_parents: DataFrame | None = None, removed: DataFrame | None = None, new_refs: DataFrame | None = None) -> OrphanState:
        """The state after a batch: removals (key) first, then arrivals (key, since), then the new references (key, REF
        columns, at)."""
        parents, asked = self.parents, [self.open.drop("status")]
        if removed is not None:
            gone = broadcast_if_small(removed.select("key").filter("key is not null").distinct())
            parents = parents.join(gone, "key", "left_anti")
            # a copy of what was settled on a removed parent waits again; the copy left behind is never counted
            asked += [s.join(gone, "key", "left_semi") for s in self.settled]
        if new_parents is not None:
            parents = parents.unionByName(new_parents.select("key", "since").filter("key is not null")).groupBy("key").agg(F.min("since").alias("since"))
        if new_refs is not None:
            asked.append(new_refs.select(*REF, "at", "key"))
        parents = materialize(parents)
        found = materialize(reduce(DataFrame.unionByName, asked).join(parents, "key", "left").withColumn("status", judged("since")).drop("since"))
        return OrphanState(parents, found.filter("status != 'ok'"), [*self.settled, found.filter("status = 'ok'").drop("status")])

    def orphans(self) -> DataFrame:
        return self.open.select(*REF, "at", "status").distinct()

    def snapshot(self) -> DataFrame:
        """References per table, field, month of the reference and status."""
        month = F.date_format(F.timestamp_micros("at"), "yyyy-MM")
        return self.orphans().groupBy("ref_table", "ref_field", month.alias("month"), "status").agg(F.count(F.lit(1)).alias("n_orphans"))


def judged(since: str) -> Column:
    return F.when(F.col(since).isNull(), F.lit("pending")).when(F.col("at") < F.col(since), F.lit("late")).otherwise(F.lit("ok"))


def empty_state(refs: DataFrame) -> OrphanState:
    spark = refs.sparkSession
    none = spark.createDataFrame([], refs.select(*REF, "at", "key", F.lit("").alias("status")).schema)
    return OrphanState(spark.createDataFrame([], "key string, since long"), none, [])


def micros(stamp: str) -> Column:
    return F.unix_micros(F.col(stamp).cast("timestamp"))


def by_both_names(rows: DataFrame, id_col: str, time: Column) -> DataFrame:
    """key, since under both names that references use: the id as text, prefixed '#', and the node_key, '@'."""
    names = F.explode(F.array_compact(F.array(F.concat(F.lit("#"), F.col(id_col).cast("string")), F.concat(F.lit("@"), F.col("node_key"))))).alias("key")
    return rows.select(names, time.alias("since"))


def edge_refs(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("string").alias("v")) for c in ("source_id", "target_id")])).alias("x")
    return edges.select("edge_id", micros("linked_at").alias("at"), ends).filter("x.v is not null").select(F.concat(F.lit("#"), F.col("x.v")).alias("key"), F.lit("edges").alias("ref_table"), F.col("edge_id").alias("ref_row"), F.col("x.f").alias("ref_field"), F.col("x.v").alias("ref_value"), "at")


def anchor_refs(memories: DataFrame) -> DataFrame:
    key = F.explode(F.map_keys("anchors")).alias("v")
    return memories.select("log_pos", instant_micros(F.col("created_at")).alias("at"), key).filter("v is not null").select(F.concat(F.lit("@"), F.col("v")).alias("key"), F.lit("memories").alias("ref_table"), F.col("log_pos").alias("ref_row"), F.lit("anchors").alias("ref_field"), F.col("v").alias("ref_value"), "at")


def period_of(at: Column, months: int) -> Column:
    """The number of the period of so many months that an instant (microseconds) lies in; unknown instants come first."""
    t = F.timestamp_micros(at)
    return F.when(at.isNotNull() & (at != ALWAYS), F.floor((F.year(t) * 12 + F.month(t) - 1) / months)).otherwise(F.lit(0)).cast("int")


def replayed(nodes: DataFrame, removed: DataFrame, edges: DataFrame, memories: DataFrame, months: int = 3, history: bool = False) -> tuple[OrphanState, DataFrame | None]:
    """The state after all periods, and with history the snapshot of every period (period: its first month).

    Every period's removals, arrivals and references make one step. A node that was taken out was there until then."""
    spark = nodes.sparkSession
    removed = removed.filter("removed_at is not null")
    gone = materialize(by_both_names(removed, "node_id", micros("removed_at")).withColumn("period", period_of(F.col("since"), months)))
    # a node that is in the table has come back, whatever the times say: never before it was taken out
    back = broadcast_if_small(materialize(gone.groupBy("key").agg(F.max("period").alias("_gone"))))
    came = by_both_names(nodes, "id", micros("indexed_at")).withColumn("period", period_of(F.col("since"), months)).join(back, "key", "left").withColumn("period", F.greatest("period", "_gone")).drop("_gone")
    parents = materialize(came.unionByName(by_both_names(removed, "node_id", F.lit(ALWAYS)).withColumn("period", F.lit(0))))
    refs = edge_refs(edges).unionByName(anchor_refs(memories)).withColumn("period", period_of(F.col("at"), months))
    refs = materialize(refs)
    # one number per period
    periods = sorted({r.period for part in (parents, gone, refs) for r in part.select("period").distinct().collect()})
    state, snapshots = empty_state(refs), None
    for k, p in enumerate(periods):
        at = F.col("period") == p
        state = state.step(parents.filter(at), gone.filter(at) if k else None, refs.filter(at))
        if history:
            counts = materialize(state.orphans().groupBy("ref_table", "ref_field", "status").agg(F.count(F.lit(1)).alias("n_orphans")))
            label = f"{p * months // 12:04}-{p * months % 12 + 1:02}"
            counts = counts.select(F.lit(label).alias("period"), "ref_table", "ref_field", "status", "n_orphans")
            snapshots = counts if snapshots is None else snapshots.unionByName(counts)
    if history and snapshots is None:
        snapshots = spark.createDataFrame([], "period string, ref_table string, ref_field string, status string, n_orphans long")
    return state, snapshots
