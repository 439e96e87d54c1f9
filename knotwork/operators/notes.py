"""The append-only log of notes: folding, staleness, and what a note is about.

Cases: lines without uid are skipped; a note without text is malformed and skipped; a removal of what is not there has no
effect; a note written again after its removal takes its place at the end; null lists are empty; empty logs give nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "uid string, topic string, text string, files array<string>, symbols array<string>, created_at string, anchors map<string,string>, deleted boolean"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's lines in order (pos), malformed ones left out."""
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    return lines.select("pos", F.from_json("value", LOG, {"mode": "PERMISSIVE"}).alias("r")).select("pos", "r.*").filter("uid is not null and uid != ''")


def fold(log: DataFrame, position: str = "pos") -> DataFrame:
    """The notes alive, each in its last state, with place: the position since which it is there without a break.

    Everything is an aggregate with partial sums: the last removal and the last state per uid, then the first state
    behind the removal."""
    gone = F.coalesce("deleted", F.lit(False))
    p = F.col(position)
    marks = log.groupBy("uid").agg(F.max(F.when(gone, p)).alias("_cut"), F.max(p).alias("_last"))
    alive = marks.filter("_cut is null or _cut < _last")
    first = log.filter(~gone).join(alive, "uid").filter(F.col("_cut").isNull() | (p > F.col("_cut"))).groupBy("uid").agg(F.min(p).alias("place"), F.max("_last").alias(position))
    return log.join(first, ["uid", position])


def stale(notes: DataFrame, nodes: DataFrame) -> DataFrame:
    """uid, stale: whether a node that a note is anchored to is gone or has changed. nodes: key, content_hash."""
    at = notes.select("uid", F.explode("anchors").alias("key", "was"))
    seen = at.join(nodes.select("key", F.col("content_hash").alias("now")), "key", "left")
    bad = seen.groupBy("uid").agg(F.bool_or(F.col("now").isNull() | ~F.col("now").eqNullSafe(F.col("was"))).alias("stale"))
    return notes.select("uid").distinct().join(bad, "uid", "left").select("uid", F.coalesce("stale", F.lit(False)).alias("stale"))


def about(notes: DataFrame, nodes: DataFrame) -> DataFrame:
    """uid, key: the nodes a note is about.

    Listed symbols by qualified name, by its end, or by a name that one node alone has; of listed files the nodes whose
    name stands in the text, else the file itself. notes: uid, topic, content, files, symbols; nodes: key, type, name,
    qualname, file_path.
    """
    linkable = nodes.filter(F.col("type").isin("module", "class", "function", "method", "test"))
    parts = F.split("qualname", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.struct(F.when(i == 1, 0).otherwise(1).alias("tier"), F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("symbol")))
    bare = F.array(F.struct(F.lit(2).alias("tier"), F.col("name").alias("symbol")))
    named = linkable.select(F.explode(F.concat(ends, bare)).alias("x"), "key", F.length("qualname").alias("long")).select("x.*", "key", "long")
    # counted in parts where the nodes are, so that only a row a symbol moves
    each = named.groupBy("symbol", "tier").agg(F.count(F.lit(1)).alias("n"), F.min_by("key", F.struct("long", "key")).alias("key"))
    one = each.groupBy("symbol").agg(F.min(F.struct("tier", "n", "key")).alias("x")).select("symbol", "x.*").filter("tier < 2 or n = 1")
    by_symbol = notes.select("uid", F.explode("symbols").alias("symbol")).join(one, "symbol").select("uid", "key")
    text = F.concat_ws(" ", "content", "topic")
    words = notes.select("uid", F.explode("files").alias("file_path"), F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]{3,})"), 1).alias("words"))
    here = words.join(nodes.select("key", "type", "name", "file_path"), "file_path")
    file = F.col("type").isin("module", "file")
    met = here.select("uid", "file_path", "key", (~file & F.array_contains("words", F.col("name"))).alias("inside"), file.alias("file")).filter("inside or file")
    met = met.withColumn("any", F.max("inside").over(Window.partitionBy("uid", "file_path"))).filter("inside or not any").select("uid", "key")
    return by_symbol.unionByName(met).distinct()
