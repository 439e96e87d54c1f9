"""Answering questions over the graph: search, fuse, expand, score. A table of queries is answered in one plan.

Cases: a query that finds nothing has no rows; without vectors the mode is lexical; notes without targets are found by
their text alone; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators import graph, search
from knotwork.session import materialize

#: Notes that the text search brings, what a note's text and its place near the top count.
NOTE_HITS, NOTE_TEXT, NOTE_NEAR, NEAR_RANKS = 10, 0.8, 0.3, 12


@dataclass
class Answer:
    """ranked: query_id, key, score, relevance, rank, how, via; notes: query_id, uid, score; mode: lexical or hybrid."""

    ranked: DataFrame
    notes: DataFrame
    mode: str


def retrieve(queries: DataFrame, nodes: DataFrame, edges: DataFrame, index: search.TextIndex, notes: DataFrame | None = None, note_index: search.TextIndex | None = None, note_about: DataFrame | None = None, vectors: DataFrame | None = None, asked: DataFrame | None = None) -> Answer:
    """nodes: key, type, name, file_path, importance; edges: source_key, target_key, relation; notes: uid;
    note_about: uid, key; vectors: doc (a key), space, vector; asked: query_id, space, asked (the queries' vectors)."""
    queries = queries.select("query_id", "text").dropDuplicates(["query_id"])
    lists = [index.search(queries)]
    hybrid = vectors is not None and asked is not None
    if hybrid:
        lists.append(search.vector_search(vectors, asked))
    relevance = materialize(search.fuse(lists))
    kinds = nodes.select(F.col("key").alias("doc"), "type")
    code = materialize(relevance.join(kinds.filter("type != 'memory' or type is null"), "doc"))
    seeds = search.ranked(code.select("query_id", "doc", F.col("relevance").alias("score")), search.SEEDS).select("query_id", F.col("doc").alias("node"), "score")
    links = edges.select(F.col("source_key").alias("source"), F.col("target_key").alias("target"), "relation")
    importance = nodes.select(F.col("key").alias("node"), F.coalesce("importance", F.lit(0.0)).alias("importance"))
    near = graph.expand_best_first(materialize(seeds), links, importance)

    spark = queries.sparkSession
    scores = spark.createDataFrame([], "query_id string, uid string, score double")
    if notes is not None and note_index is not None:
        found = note_index.search(queries, NOTE_HITS).withColumn("top", F.max("score").over(Window.partitionBy("query_id")))
        scores = materialize(found.select("query_id", F.col("doc").alias("uid"), (NOTE_TEXT * F.col("score") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)).alias("score")))
    about = note_about if note_about is not None else spark.createDataFrame([], "uid string, key string")
    boost = scores.join(about, "uid").groupBy("query_id", F.col("key").alias("doc")).agg(F.max("score").alias("memory"), F.max_by("uid", F.struct("score", "uid")).alias("uid"))

    both = near.select("query_id", F.col("node").alias("doc"), "proximity", "how", "via").join(boost, ["query_id", "doc"], "full")
    placed = both.select("query_id", "doc", F.coalesce("proximity", 0.5 * F.col("memory")).alias("proximity"), F.when(F.col("proximity").isNull(), F.concat(F.lit("memory_about ← memory "), "uid")).otherwise(F.col("how")).alias("how"), "via", "memory")
    candidates = placed.join(code.select("query_id", "doc", "relevance"), ["query_id", "doc"], "left").join(nodes.select(F.col("key").alias("doc"), "type", "file_path", "importance"), "doc").filter("type is null or type != 'memory'")
    candidates = materialize(candidates)
    if hybrid:
        met = candidates.select("query_id", "doc").join(vectors, "doc").join(asked, ["query_id", "space"]).filter(F.size("vector") == F.size("asked"))
        similar = search.spread(met.select("query_id", "doc", search.cosine(F.col("vector"), F.col("asked")).alias("score"))).withColumnRenamed("score", "similarity")
        candidates = candidates.join(similar, ["query_id", "doc"], "left")
    else:
        candidates = candidates.withColumn("similarity", F.lit(None).cast("double"))
    best = search.hybrid_score(candidates).join(candidates.select("query_id", "doc", "how", "via"), ["query_id", "doc"])
    named = best.join(nodes.select(F.col("key").alias("via"), F.col("name").alias("via_name")), "via", "left")
    ranked = materialize(named.select("query_id", F.col("doc").alias("key"), "score", "relevance", "rank", F.concat_ws(" ", "how", F.coalesce("via_name", "via")).alias("via")))
    close = ranked.filter(F.col("rank") <= NEAR_RANKS).join(about, "key").select("query_id", "uid").distinct().join(scores.select("query_id", "uid"), ["query_id", "uid"], "left_anti").withColumn("score", F.lit(NOTE_NEAR))
    return Answer(ranked, scores.unionByName(close), "hybrid" if hybrid else "lexical")
