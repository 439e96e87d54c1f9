"""Parent-child links to full hierarchies.

Method: weighted disjoint-set forests. Every partition (there are always several) joins its own links into a forest whose
members know the offset (number of steps) to the end of their chain, by compressing all its paths at once; chains that
leave the partition are boundary links. The boundary links are merged hierarchically: ever fewer, wider partitions
contract them until one bounded partition holds the rest, which yields the roots and the circles. The answers then flow back down. Paths are materialised by traversing the parent index
with doubling steps.

Cases: a null id is dropped; a null or unknown parent makes a root; several rows of one id count as one whose parent is
the smallest given; a node that is its own parent is a circle; an empty table gives an empty result; extra columns are
ignored. Nodes on a circle or below one get depth -1 and the smallest id on the circle as their root. A node below a
circle has the descendants of its subtree; a node on a circle has all others on the circle and below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.session import materialize

#: A merge step hands at most about this many boundary links to one task.
GROUP_ROWS = 250_000
#: Rows of one partition of the first step.
LEAF_ROWS = 200_000
#: The first step has at least so many partitions, however few the rows.
LEAVES = 4

_CHAIN = "id long, end long, steps long, least long, kind int"
#: kind of a chain's end: it goes on elsewhere, a root, a circle.
OPEN, ROOT, CIRCLE = 0, 1, 2
#: The parent of a root.
NONE = -(2**63)


def contract(ids: np.ndarray, nxt: np.ndarray, steps: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """The forest of one partition's weighted links id -> nxt (nxt NONE: the id is a root).

    Returns end, steps, least, kind of each id's chain. least is the smallest id over the links followed from the id, the
    end excluded. On a circle and below one, end is the circle's smallest id.
    """
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    place = np.clip(np.searchsorted(sorted_ids, nxt), 0, max(len(ids) - 1, 0))
    inside = (nxt != NONE) & (sorted_ids[place] == nxt) if len(ids) else np.zeros(0, bool)
    to = np.where(inside, order[place], np.arange(len(ids)))
    hop, low = np.where(inside, steps, 0), np.where(inside, least, np.iinfo(np.int64).max)
    # after this many doublings every chain stands at its end or runs in a circle
    jump, dist, small = to, hop, low
    for _ in range(max(1, int(len(ids)).bit_length())):
        if (inside[jump] == 0).all():
            break
        dist = dist + dist[jump]
        small = np.minimum(small, small[jump])
        jump = jump[jump]
    looped = inside[jump]
    kind = np.where(looped, CIRCLE, np.where(nxt[jump] == NONE, ROOT, OPEN)).astype(np.int32)
    leaves = ~looped & (nxt[jump] != NONE)  # the last member's own link leaves the partition
    end = np.where(leaves, nxt[jump], ids[jump])
    total = np.where(leaves, dist + steps[jump], dist)
    low = np.where(leaves, np.minimum(small, least[jump]), small)
    if looped.any():
        # jump lies on the circle now, whatever the start; the minimum along the circle needs a walk from there
        ring, seen = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        for start in np.unique(jump[looped]):
            if not seen[start]:
                walk, at = [start], to[start]
                while at != start:
                    walk.append(at)
                    at = to[at]
                ring[walk], seen[walk] = least[walk].min(), True
        end = np.where(looped, ring[jump], end)
    return end, total, low, kind


def _contract_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [b for b in batches if len(b)]
    if frames:
        x = pd.concat(frames, ignore_index=True)
        i = [x[c].to_numpy(np.int64) for c in ("id", "nxt", "steps", "least")]
        end, steps, least, kind = contract(*i)
        yield pd.DataFrame({"id": i[0], "end": end, "steps": steps, "least": least, "kind": kind})


def _as_links(open_chains: DataFrame) -> DataFrame:
    return open_chains.select("id", F.col("end").alias("nxt"), "steps", "least")


def resolve(links: DataFrame, group_rows: int = GROUP_ROWS, leaf_rows: int = LEAF_ROWS, leaves: int = LEAVES) -> DataFrame:
    """(id, end, steps, least, kind) with every chain followed to its root or circle.

    links: id, nxt (a known id, or NONE for a root), steps, least; ids distinct. leaves: at least so many partitions; 1 is
    for what is left of the boundary.
    """
    n = links.count()
    if leaves == 1 and n <= group_rows:
        return links.repartition(1).mapInPandas(_contract_batches, _CHAIN)
    parts = max(2, leaves, -(-n // leaf_rows))
    local = materialize(links.repartitionByRange(parts, "id").mapInPandas(_contract_batches, _CHAIN))
    going = local.filter(F.col("kind") == OPEN)
    # only ends of open chains are looked up again; their own links form the next, smaller level
    met = going.select(F.col("end").alias("id")).distinct()
    border = local.join(met, "id").select("id", F.when(F.col("kind") == OPEN, F.col("end")).otherwise(F.lit(NONE)).alias("nxt"), "steps", "least", "kind", "end")
    border = materialize(border)
    rest, done = _as_links(border.filter("kind = 0")), border.filter("kind > 0")
    m = border.count()
    if m > group_rows and m > 0.5 * n:
        solved = _resolve_halved(rest, done, group_rows, leaf_rows, m)
    else:
        ended = done.select("id", F.lit(NONE).alias("nxt"), F.lit(0).cast("long").alias("steps"), "id").toDF("id", "nxt", "steps", "least")
        top = resolve(rest.unionByName(ended), group_rows, leaf_rows, 1)
        solved = _finish(top, done)
    return _finish(local, solved)


def _finish(chains: DataFrame, solved: DataFrame) -> DataFrame:
    """Continue chains, open ones or such that end at a boundary id taken as a root, by what is solved for their ends."""
    s = solved.select(F.col("id").alias("end"), F.col("end").alias("end2"), F.col("steps").alias("steps2"), F.col("least").alias("least2"), F.col("kind").alias("kind2"))
    return chains.join(s, "end", "left").select(
        "id",
        F.coalesce(F.when(F.col("kind") != CIRCLE, F.col("end2")), F.col("end")).alias("end"),
        F.when((F.col("kind") != CIRCLE) & F.col("end2").isNotNull(), F.col("steps") + F.col("steps2")).otherwise(F.col("steps")).alias("steps"),
        F.col("least"),
        F.coalesce(F.when(F.col("kind") != CIRCLE, F.col("kind2")), F.col("kind")).cast("int").alias("kind"),
    )


def _resolve_halved(rest: DataFrame, done: DataFrame, group_rows: int, leaf_rows: int, salt: int) -> DataFrame:
    """Where partitions hardly contract (neighbours lie far apart), keep about half of the ids, chosen by hash so that
    every circle keeps one, let the others jump over each other until they stand on a kept one, and solve the half."""
    seed = F.xxhash64(F.col("id"), F.lit(salt))
    seed_nxt = F.xxhash64(F.col("nxt"), F.lit(salt))
    ended = done.select("id", "end", F.col("steps"), "kind")
    chosen = materialize(rest.withColumn("kept", seed <= seed_nxt))
    kept_ids = chosen.filter("kept").select(F.col("id").alias("nxt"), F.lit(True).alias("stands"))
    kept_ids = kept_ids.unionByName(done.select(F.col("id").alias("nxt"), F.lit(True).alias("stands")))
    hops = chosen.join(kept_ids, "nxt", "left").select("id", "nxt", "steps", "least", "kept", F.coalesce("stands", F.lit(False)).alias("stands"))
    while True:
        hops = materialize(hops)
        if hops.filter(~F.col("stands")).isEmpty():
            break
        via = hops.filter(~F.col("kept")).select(F.col("id").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("steps").alias("steps2"), F.col("least").alias("least2"), F.col("stands").alias("stands2"))
        on = hops.filter(~F.col("stands")).join(via, "nxt").select("id", F.col("nxt2").alias("nxt"), (F.col("steps") + F.col("steps2")).alias("steps"), F.least("least", "least2").alias("least"), "kept", F.col("stands2").alias("stands"))
        hops = hops.filter("stands").unionByName(on)
    stop = done.select("id", F.lit(NONE).alias("nxt"), F.lit(0).cast("long").alias("steps"), F.col("id").alias("least"))
    top = resolve(hops.filter("kept").select("id", "nxt", "steps", "least").unionByName(stop), group_rows, leaf_rows, 1)
    top = materialize(_finish(top, ended.select("id", "end", "steps", F.col("id").alias("least"), "kind")))
    others = hops.filter(~F.col("kept")).select("id", F.col("nxt").alias("end"), "steps", "least", F.lit(OPEN).alias("kind"))
    return top.unionByName(_finish(others, top))


def parent_links(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """One weighted link per distinct id: id, nxt (the parent where it exists, else -1), steps, least."""
    one = nodes.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent")).filter("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    known = one.select(F.col("id").alias("parent"), F.lit(1).alias("known"))
    # roots need no lookup; null parents would all meet in one task
    return (
        one.filter("parent is not null").join(known, "parent", "left").select("id", F.when(F.col("known").isNotNull(), F.col("parent")).otherwise(F.lit(NONE)).alias("nxt"))
        .unionByName(one.filter("parent is null").select("id", F.lit(NONE).alias("nxt")))
        .select("id", "nxt", F.lit(1).cast("long").alias("steps"), F.col("id").alias("least"))
    )


def roots(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", group_rows: int = GROUP_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """id, root_id, depth of every distinct id; depth -1 on and below a circle."""
    return _roots(resolve(materialize(parent_links(nodes, id_col, parent_col)), group_rows, leaf_rows))


def _roots(chains: DataFrame) -> DataFrame:
    return chains.select("id", F.col("end").alias("root_id"), F.when(F.col("kind") == CIRCLE, F.lit(-1)).otherwise(F.col("steps")).cast("long").alias("depth"))


def on_circles(found: DataFrame, links: DataFrame) -> DataFrame:
    """id, circle_id, nxt (its parent) of every node on a circle itself. found as from roots, links as from parent_links.

    The nodes reached by n steps from all nodes on and below circles are fewer with every doubling of n until only the
    circles are left, on which steps only permute."""
    lost = found.filter("depth < 0").select("id", F.col("root_id").alias("circle_id"))
    lost = materialize(lost.join(links.select("id", "nxt"), "id"))
    hops, left = materialize(lost.select("id", F.col("nxt").alias("to"))), lost.count()
    while True:
        reached = materialize(hops.select(F.col("to").alias("id")).distinct())
        n = reached.count()
        if n == left:
            return lost.join(reached, "id")
        left = n
        further = hops.select(F.col("id").alias("to"), F.col("to").alias("to2"))
        hops = materialize(hops.join(reached, "id", "left_semi").join(further, "to").select("id", F.col("to2").alias("to")))


def _closure(links: DataFrame) -> DataFrame:
    """ancestor_id, id, distance over links without circles, by doubling the parent index: each round joins the longest
    hops with all shorter ones, so a tree of depth d takes log2(d) joins and every pair is made once."""
    pairs, full = materialize(links.filter(F.col("nxt") != NONE).select("id", F.col("nxt").alias("ancestor_id"), F.lit(1).cast("long").alias("distance"))), 1
    while not pairs.filter(F.col("distance") == full).isEmpty():
        upper = pairs.select(F.col("id").alias("ancestor_id"), F.col("ancestor_id").alias("top"), F.col("distance").alias("more"))
        longer = pairs.filter(F.col("distance") == full).join(upper, "ancestor_id").select("id", F.col("top").alias("ancestor_id"), (F.col("distance") + F.col("more")).alias("distance"))
        pairs = materialize(pairs.unionByName(longer))
        full *= 2
    return pairs.select("ancestor_id", "id", "distance")


def _parts(nodes: DataFrame, id_col: str, parent_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """roots, on_circles, and the closure over all links but those of nodes on circles, whose subtrees have none."""
    links = materialize(parent_links(nodes, id_col, parent_col))
    found = materialize(_roots(resolve(links)))
    ring = materialize(on_circles(found, links))
    return found, ring, _closure(links.join(ring.select("id"), "id", "left_anti"))


def descendants(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """ancestor_id, id, distance for every proper descendant, each pair once with its fewest steps. Below circles these are
    the subtrees; of a node on a circle all others on it and below it descend, by way of the circle."""
    _, ring, tree = _parts(nodes, id_col, parent_col)
    # places on a circle are the steps to its smallest id
    cut = materialize(ring.select("id", F.when(F.col("id") == F.col("circle_id"), F.lit(NONE)).otherwise(F.col("nxt")).alias("nxt"), F.lit(1).cast("long").alias("steps"), F.col("id").alias("least")))
    place = materialize(resolve(cut).select("id", F.col("end").alias("circle_id"), F.col("steps").alias("place")))
    size = place.groupBy("circle_id").agg(F.count(F.lit(1)).alias("size"))
    other = place.select(F.col("id").alias("ancestor_id"), "circle_id", F.col("place").alias("goal"))
    around = place.join(size, "circle_id").join(other, "circle_id").filter("id != ancestor_id").select("ancestor_id", "id", F.expr("pmod(place - goal, size)").alias("distance"))
    # what hangs below a node of the circle comes by tree for that node itself, and so many steps later for the others
    hanging = around.select("ancestor_id", F.col("id").alias("entry"), F.col("distance").alias("more")).join(tree.withColumnRenamed("ancestor_id", "entry"), "entry")
    return tree.unionByName(around).unionByName(hanging.select("ancestor_id", "id", (F.col("distance") + F.col("more")).alias("distance")))


def paths(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", name_col: str = "name") -> DataFrame:
    """id, root_id, depth, path (ids from the root down), path_names (joined by ' > ', null names as '?'), n_descendants.
    On and below circles path and path_names are null; n_descendants counts what descendants gives, everywhere."""
    found, ring, closure = _parts(nodes, id_col, parent_col)
    names = nodes.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.coalesce(F.min(name_col), F.lit("?")).alias("label"))
    tree = found.filter("depth >= 0").select("id")
    steps = closure.join(tree, "id", "left_semi").unionByName(tree.select(F.col("id").alias("ancestor_id"), "id", F.lit(0).cast("long").alias("distance")))
    named = steps.join(names.select(F.col("id").alias("ancestor_id"), "label"), "ancestor_id")
    # a list is as long as the node is deep
    lines = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("k"), "ancestor_id", "label"))).alias("x"))
    below = closure.join(ring.select(F.col("id").alias("ancestor_id")), "ancestor_id", "left_anti").groupBy(F.col("ancestor_id").alias("id")).agg(F.count(F.lit(1)).alias("n_descendants"))
    others = found.filter("depth < 0").groupBy(F.col("root_id").alias("circle_id")).agg((F.count(F.lit(1)) - 1).alias("n_descendants"))
    below = below.unionByName(ring.join(others, "circle_id").select("id", "n_descendants"))
    return found.join(lines, "id", "left").join(below, "id", "left").select("id", "root_id", "depth", F.col("x.ancestor_id").alias("path"), F.array_join("x.label", " > ").alias("path_names"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"))


def circles(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """circle_id (its smallest id) and n_nodes on it or below it, for every circle of parents."""
    return roots(nodes, id_col, parent_col).filter("depth = -1").groupBy(F.col("root_id").alias("circle_id")).agg(F.count(F.lit(1)).alias("n_nodes"))
