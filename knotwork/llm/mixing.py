"""Mixing sources to target weights.

Method: Pareto order sampling. Every document of a source expects the same number of copies (or one in proportion to a
weight), at most max_repeats; its whole copies are certain, the fraction left is its inclusion probability p. Documents
are ranked by (u / (1 - u)) / (p / (1 - p)) with u drawn from a hash of seed and id, and taken in that order until the
source's tokens are filled, which makes a sample of fixed size in tokens. The cut is found through a histogram of the
ranks, so no source is ever sorted in one task: only the bin that holds the cut is ordered row by row.

Without a weight all documents of a source are as likely as each other, and the odds draw them evenly; with one the
inclusion probabilities differ.

Cases: null or unlisted sources and null texts stay out; a source that can give no tokens (no documents, only empty texts,
no repeats allowed) gets none, does not hold back the others, and its shortfall shows in the report; where max_repeats cannot fill a share, all its copies are taken; null shares or repeats count as 0; several
rows of a doc_id are several documents; an empty table gives an empty mix; extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import broadcast_if_small, materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: About as many documents share a bin of the rank histogram.
BIN_ROWS = 20_000


@lru_cache(4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def token_counts(documents: DataFrame, columns: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """columns and tokens, the number of the whole text's tokens."""

    # executors get the vocabulary with the job; it need not lie on every machine
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(SparkFiles.get(name))
        for b in batches:
            n = [len(e.ids) for e in t.encode_batch(b["text"].tolist(), add_special_tokens=False)] if len(b) else []
            yield b[columns].assign(tokens=pd.Series(n, index=b.index, dtype="int64"))

    some = documents.select(*columns, "text").filter("text is not null")
    kinds = dict(some.dtypes)
    return some.mapInPandas(count, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "tokens long"]))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, weight: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens, copies of every document in the mix.

    total_tokens: the size aimed at; where it is None, the largest one at which no source that has documents falls short.
    """
    goal = targets.filter("source is not null").groupBy("source").agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("most"))
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    listed = documents.select("doc_id", "source", "text", w.alias("w")).join(broadcast_if_small(goal.select("source")), "source", "left_semi")
    docs = materialize(token_counts(listed, ["doc_id", "source", "w"], tokenizer))

    # one row per source from here on: as many as the targets list
    sizes = {r.source: r for r in docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("w")).alias("mass"), F.count(F.lit(1)).alias("n")).collect()}
    goals = {r.source: r for r in goal.collect()}
    can = [goals[s].most * r.tokens / goals[s].share for s, r in sizes.items() if goals[s].share > 0 and goals[s].most * r.tokens > 0 and r.mass > 0]
    total = total_tokens if total_tokens is not None else min(can, default=0)
    want = {s: goals[s].share * total for s in sizes}
    rate = {s: want[s] / r.mass if r.mass else 0.0 for s, r in sizes.items()}
    for _ in range(50 if weight else 0):  # documents whose weight asks for more than max_repeats free tokens for the rest
        over = F.col("w") * _lookup(rate) >= _lookup({s: float(g.most) for s, g in goals.items()})
        sums = {r.source: r for r in docs.groupBy("source").agg(F.sum(F.when(over, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(~over, F.col("tokens") * F.col("w")).otherwise(0.0)).alias("mass")).collect()}
        new = {s: max(rate[s], (want[s] - goals[s].most * r.full) / r.mass) if r.mass > 0 else rate[s] for s, r in sums.items()}
        if all(new[s] <= rate[s] * (1 + 1e-9) for s in new):
            break
        rate = new
    expect = F.least(F.col("w") * _lookup(rate), _lookup({s: float(g.most) for s, g in goals.items()}))
    whole = F.floor(expect + 1e-9)
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    p = F.greatest(F.lit(0.0), expect - whole)
    ranked = docs.withColumn("whole", whole.cast("int")).withColumn("p", p)
    # q in (0, 1) orders like the odds ratio u / (1 - u) * (1 - p) / p
    odds = (u / (1 - u)) * (1 - F.col("p")) / F.col("p")
    ranked = ranked.withColumn("q", F.when(F.col("p") > 1e-9, odds / (1 + odds)))

    bins = int(min(1 << 20, max(256, sum(r.n for r in sizes.values()) // BIN_ROWS)))
    ranked = ranked.withColumn("bin", F.floor(F.col("q") * bins).cast("int"))
    sure = {r.source: r.t or 0 for r in ranked.groupBy("source").agg(F.sum(F.col("whole") * F.col("tokens")).alias("t")).collect()}
    rest = _lookup({s: float(want[s] - sure.get(s, 0)) for s in sizes})
    histogram = ranked.filter("q is not null").groupBy("source", "bin").agg(F.sum("tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = histogram.withColumn("before", before).withColumn("state", F.when(F.col("before") + F.col("t") <= rest, 1).when(F.col("before") < rest, 2).otherwise(0)).select("source", "bin", "before", "state")
    placed = ranked.join(levels, ["source", "bin"], "left")
    # a document at the cut comes in where that brings the tokens nearer to the target
    running = F.sum("tokens").over(Window.partitionBy("source", "bin").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.filter("state = 2").withColumn("upto", F.col("before") + running).withColumn("extra", (F.col("upto") - F.col("tokens") / 2 <= rest).cast("int")).drop("upto")
    clear = placed.filter("state is null or state != 2").withColumn("extra", F.coalesce((F.col("state") == 1).cast("int"), F.lit(0)))
    return clear.unionByName(edge).withColumn("copies", F.col("whole") + F.col("extra")).filter("copies > 0").select("doc_id", "source", "tokens", "copies")


def kept(mixed: DataFrame, documents: DataFrame, targets: DataFrame, near: float = 0.01) -> DataFrame:
    """source, has_documents, on_target, within_repeats per listed source: whether it reached its share of what the sources
    with documents can share, and whether no document is used too often."""
    per = shares(mixed, targets)
    there = documents.filter("length(text) > 0").select("source").distinct().withColumn("there", F.lit(True))
    per = per.join(there, "source", "left").withColumn("has_documents", F.coalesce("there", F.lit(False)) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    # one row for each target
    all_ = F.sum(F.when(F.col("has_documents"), F.col("target_share")).otherwise(0.0)).over(Window.partitionBy())
    goal = F.when(F.col("has_documents"), F.col("target_share") / all_).otherwise(0.0)
    most = mixed.groupBy("source").agg(F.max("copies").alias("copies"))
    return per.withColumn("goal", goal).join(most, "source", "left").select("source", "has_documents", (F.abs(F.col("share_reached") - F.col("goal")) <= near).alias("on_target"), (F.coalesce("copies", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"))


def _lookup(values: dict[str, float]):
    pairs = [F.lit(x) for s, v in values.items() for x in (s, float(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, documents, copies, tokens and the share of all tokens reached."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("copies").cast("long").alias("n_copies"), F.sum(F.col("copies") * F.col("tokens")).alias("n_tokens"))
    all_ = F.sum("n_tokens").over(Window.partitionBy())
    out = targets.filter("source is not null").select("source", "target_share", "max_repeats").join(got, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("source", "target_share", "max_repeats", zero("n_documents"), zero("n_copies"), zero("n_tokens"), F.coalesce(F.col("n_tokens") / all_, F.lit(0.0)).alias("share_reached"))
