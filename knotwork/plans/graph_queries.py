"""The engine's own operators over the tables of a code knowledge graph, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from knotwork.functions import text as X
from knotwork.operators import graph, link, notes, pack, parse, retrieve, search, summaries
from knotwork.plans import graph_sql
from knotwork.session import folder, materialize, release, table
from knotwork.sources.repos import IGNORE, manifest_diff
from knotwork.streaming.logs import fold_stream, last_state, latest_states

#: The questions that the searches ask.
QUESTIONS = [("q1", "where is the snapshot cache flushed when the parser fails"), ("q2", "merge ledger tokens"), ("q3", "RankerJournal publish worker"), ("q4", "why does the scheduler retry a stale lease")]


def _nodes(spark, sf):
    """The nodes once each, under the engine's names."""
    n = table(spark, sf, "nodes").filter("id is not null and node_key is not null")
    return n.groupBy("id").agg(F.min(F.struct("node_key", "type", "name", "qualname", "repo", "file_path", "start_line", "end_line", "signature", "docstring", "is_public", "content_hash", "parent_id", "importance")).alias("r")).select("id", F.col("r.node_key").alias("key"), "r.*").drop("node_key")


def _edges(spark, sf):
    """source, target, relation, confidence once each between known nodes."""
    known = table(spark, sf, "nodes").filter("id is not null").select("id").distinct()
    e = graph.tidy_edges(table(spark, sf, "edges").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relation", "confidence"))
    return e.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")


def _questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id string, text string")


def file_manifest(spark, sf):
    c = F.col
    f = table(spark, sf, "files").filter("content is not null").dropDuplicates(["file_id"])
    return f.select("file_id", F.sha1(c("content").cast("binary")).alias("content_hash"), X.estimate_tokens(c("content")).alias("n_tokens"), X.language_for(c("path")).alias("language"), X.ignored(c("path"), IGNORE).alias("ignored"))


def manifest_changes(spark, sf):
    """The files as they were when nodes were made of them, against the files that are there."""
    n = table(spark, sf, "nodes").filter("type in ('module', 'file')").groupBy(F.concat_ws("/", "repo", "file_path").alias("path")).agg(F.min("content_hash").alias("content_hash"))
    f = table(spark, sf, "files").groupBy(F.concat_ws("/", "repo", "path").alias("path")).agg(F.min("content_hash").alias("content_hash"))
    return manifest_diff(n, f)


def path_flags(spark, sf):
    c = F.col("file_path")
    n = table(spark, sf, "nodes").select("file_path").filter("file_path is not null").distinct()
    return n.select("file_path", X.is_test_path(c).alias("is_test"), X.is_side_path(c).alias("is_side"), X.module_name_for(c).alias("module"))


def identifiers(spark, sf):
    c = F.col
    return _nodes(spark, sf).select("id", F.array_join(X.split_identifier(c("name")), " ").alias("parts"), X.identifier_tokens(c("name"), c("qualname")).alias("idents"), X.is_public(c("name")).alias("public_name"), X.slug(c("name")).alias("slug"))


def question_terms(spark, sf):
    return table(spark, sf, "eval_items").select("item_id", F.array_join(F.array_sort(X.query_terms(F.col("text"))), " ").alias("terms")).distinct()


def sentences(spark, sf):
    c = F.col("docstring")
    return _nodes(spark, sf).filter("length(docstring) > 0").select("id", X.first_sentence(c, 60).alias("first"), X.truncate(c, 40).alias("cut"), X.estimate_tokens(c).alias("n_tokens"))


def labels(spark, sf):
    c = F.col
    n = _nodes(spark, sf)
    return n.select("id", X.short_name(c("type"), c("name"), c("qualname"), c("file_path")).alias("short"), X.summary_label(c("type"), c("name"), c("qualname")).alias("label"), X.span(c("file_path"), c("start_line"), c("end_line")).alias("span"))


def embedding_texts(spark, sf):
    c = F.col
    n = _nodes(spark, sf).filter(X.should_embed(c("type"), c("name"), c("is_public"), c("docstring"), c("start_line"), c("end_line")))
    return n.select("id", F.sha1(X.embedding_text(c("type"), c("name"), c("qualname"), c("file_path"), c("signature"), c("docstring")).cast("binary")).alias("text_hash"))


def find_by_suffix(spark, sf):
    """Every method by the last two parts of its qualified name: how many nodes that finds, and the most important."""
    n = _nodes(spark, sf)
    p = F.split("qualname", r"\.")
    asked = n.filter("type = 'method'").filter(F.size(p) >= 2).select(F.array_join(F.slice(p, F.size(p) - 1, 2), ".").alias("suffix")).distinct()
    ends = n.filter(F.size(p) >= 2).select("id", "importance", F.array_join(F.slice(p, F.size(p) - 1, 2), ".").alias("suffix"))
    return asked.join(ends, "suffix").groupBy("suffix").agg(F.count(F.lit(1)).alias("n_nodes"), F.min_by("id", F.struct(-F.coalesce("importance", F.lit(0.0)), "id")).alias("best_id"))


def find_symbols(spark, sf):
    """The symbols that notes list, every class by the last two parts of its name, and the line at which every method begins."""
    n = _nodes(spark, sf)
    p = F.split("qualname", r"\.")
    asked = table(spark, sf, "memories").select(F.explode("symbols").alias("symbol"))
    asked = asked.unionByName(n.filter("type = 'class'").select(F.array_join(F.slice(p, F.greatest(F.size(p) - 1, F.lit(1)), 2), ".").alias("symbol")))
    asked = asked.unionByName(n.filter("type = 'method' and start_line is not null").select(F.concat("file_path", F.lit(":"), F.col("start_line").cast("string")).alias("symbol")))
    return link.find_symbols(asked, n).filter("place = 1").select("symbol", "key", "tier", "n")


def inherited_methods(spark, sf):
    """Every class's methods by name, its own before those of its bases in depth-first order."""
    n = _nodes(spark, sf)
    text = lambda c: F.col(c).cast("string")
    nodes = n.select("repo", text("id").alias("key"), "type", "name", "qualname", "file_path", "start_line", text("parent_id").alias("parent_key"))
    classes = n.filter("type = 'class'").select(text("id").alias("id"), F.coalesce("repo", F.lit("")).alias("repo"))
    up = _edges(spark, sf).filter("relation = 'inherits'").select(text("source").alias("class_key"), text("target").alias("base_key")).distinct()
    up = up.join(classes.select(F.col("id").alias("class_key"), "repo"), "class_key").join(classes.select(F.col("id").alias("base_key")), "base_key", "left_semi")
    bases = up.withColumn("place", F.row_number().over(Window.partitionBy("class_key").orderBy("base_key")))
    refs = spark.createDataFrame([], f"repo string, file_path string, {parse.REF}")
    return link.Names(nodes, refs).methods(bases).select(F.col("class_key").cast("long").alias("class_id"), "name", F.col("method_key").cast("long").alias("method_id"))


def edges_tidy(spark, sf):
    return _edges(spark, sf)


def adjacency(spark, sf):
    return graph.neighbours(_edges(spark, sf)).groupBy("node", "arrow", "relation").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == "low").alias("n_low"))


def label_groups(spark, sf):
    n = _nodes(spark, sf).select(F.col("id").alias("node"), "type", "qualname", F.coalesce("importance", F.lit(0.0)).alias("importance"))
    return graph.labelled_groups(_edges(spark, sf), n)


def contains_parents(spark, sf):
    n = _nodes(spark, sf).select("id", "parent_id")
    return n.join(n.select(F.col("id").alias("parent_id")), "parent_id").filter("id != parent_id").select(F.col("parent_id").alias("source"), F.col("id").alias("target"))


def unique_names(spark, sf):
    n = _nodes(spark, sf).select("repo", F.col("id").cast("string").alias("key"), "type", "name", "qualname", "file_path", "start_line", F.lit(None).cast("string").alias("parent_key"))
    refs = spark.createDataFrame([], f"repo string, file_path string, {parse.REF}")
    return link.Names(n, refs).unique.select("repo", "name", F.col("target_key").cast("long").alias("id"))


def pick_candidates(spark, sf):
    """Every bare method name asked from every file of its repo that calls something of that name's node."""
    n = _nodes(spark, sf)
    nodes = n.select("repo", F.col("id").cast("string").alias("key"), "type", "name", "qualname", "file_path", "start_line", F.lit(None).cast("string").alias("parent_key"))
    p = F.split("qualname", r"\.")
    refs = spark.createDataFrame([], f"repo string, file_path string, {parse.REF}")
    asked = n.filter("type = 'method'").filter(F.size(p) > 2).select(F.col("id"), F.coalesce("repo", F.lit("")).alias("repo"), "file_path", F.array_join(F.slice(p, F.size(p) - 1, 2), ".").alias("full"))
    return link.Names(nodes, refs).pick(asked).select("id", F.col("target_key").cast("long").alias("target_id"), "confidence")


def path_suffixes(spark, sf):
    """The last two parts of every path: the file they mean if only one does."""
    n = _nodes(spark, sf).filter("type in ('module', 'file')")
    modules = n.groupBy("repo", "file_path").agg(F.min("key").alias("module_key"))
    p = F.split("file_path", "/")
    asked = modules.filter(F.size(p) >= 2).select("repo", F.array_join(F.slice(p, F.size(p) - 1, 2), "/").alias("asked")).distinct()
    return link.resolve_paths(modules, asked).select("repo", "asked", "target_key")


def _linked(spark, sf):
    n = _nodes(spark, sf)
    parents = n.select(F.col("id").alias("parent_id"), F.col("key").alias("parent_key"))
    nodes = n.join(parents, "parent_id", "left").select("repo", "key", "type", "name", "file_path", "parent_key", "id")
    keys = n.select("id", "key", "repo")
    e = _edges(spark, sf).join(keys.select(F.col("id").alias("source"), F.col("key").alias("source_key"), "repo"), "source").join(keys.select(F.col("id").alias("target"), F.col("key").alias("target_key")), "target")
    return nodes, e.select("repo", "source_key", "target_key", "relation", "confidence")


def derived_tests(spark, sf):
    """tested_by derived from the calls within a repo."""
    nodes, edges = _linked(spark, sf)
    return link.tested_by(nodes, edges).select("repo", "source_key", "target_key")


def tests_by_name(spark, sf):
    nodes, edges = _linked(spark, sf)
    return link.tested_by_name(nodes, edges.filter("relation is null")).select("repo", "source_key", "target_key")


def counts(spark, sf):
    c = F.col
    n = _nodes(spark, sf).groupBy(F.lit("node").alias("part"), F.coalesce("type", F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    e = _edges(spark, sf).groupBy(F.lit("edge").alias("part"), F.coalesce("relation", F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    both = n.unionByName(e)
    return both.withColumn("percent", F.round(100.0 * c("n") / F.sum("n").over(Window.partitionBy("part")), 4))


def neighbour_names(spark, sf):
    c = F.col
    n = _nodes(spark, sf).select("id", X.summary_label(c("type"), c("name"), c("qualname")).alias("label"), F.coalesce("importance", F.lit(0.0)).alias("importance"))
    calls = _edges(spark, sf).filter("relation = 'calls'").select(c("source").alias("owner"), c("target").alias("id"))
    return graph.members_named(calls.join(n, "id").select("owner", "label", "importance", c("id").alias("tie")), 5)


def module_centrality(spark, sf):
    n = _nodes(spark, sf).select(F.col("id").alias("node"), "type", F.coalesce("importance", F.lit(0.0)).alias("importance"))
    return graph.centrality(n, _edges(spark, sf)).select("node", F.round("centrality", 9).alias("centrality"))


def pagerank(spark, sf):
    n = _nodes(spark, sf).select(F.col("id").alias("node"))
    return graph.pagerank(n, _edges(spark, sf)).select("node", F.round("importance", 7).alias("importance"))


def _seeds(spark, sf):
    """The three most important nodes of every repo, under the repo as query."""
    n = _nodes(spark, sf).filter("repo is not null")
    w = Window.partitionBy("repo").orderBy(F.desc(F.coalesce("importance", F.lit(0.0))), "id")
    return n.withColumn("n", F.row_number().over(w)).filter("n <= 3").select(F.col("repo").alias("query_id"), F.col("id").cast("string").alias("node"), (F.lit(1.0) / F.col("n")).alias("score"))


def _text_graph(spark, sf):
    c = F.col
    e = _edges(spark, sf).select(c("source").cast("string").alias("source"), c("target").cast("string").alias("target"), "relation")
    return e, _nodes(spark, sf).select(c("id").cast("string").alias("node"), F.coalesce("importance", F.lit(0.0)).alias("importance"))


def expand_two_hops(spark, sf):
    e, importance = _text_graph(spark, sf)
    return graph.expand_two_hops(_seeds(spark, sf), e, importance).select("query_id", F.col("node").cast("long").alias("node"), F.round("proximity", 9).alias("proximity"))


def expand_best_first(spark, sf):
    e, importance = _text_graph(spark, sf)
    return graph.expand_best_first(_seeds(spark, sf), e, importance).select("query_id", F.col("node").cast("long").alias("node"), F.round("proximity", 9).alias("proximity"), "how", F.col("via").cast("long").alias("via"))


def _documents(spark, sf):
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", "text").dropDuplicates(["doc_id"])


def bm25_documents(spark, sf):
    index = search.TextIndex(_documents(spark, sf), "doc_id", {"text": 1.0})
    return index.search(_questions(spark)).select("query_id", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def _fields(spark, sf):
    n = _nodes(spark, sf)
    return n.select("id", "name", X.identifier_tokens(F.col("name"), F.col("qualname")).alias("idents"), "file_path", F.lit("").alias("summary"), F.coalesce("docstring", F.lit("")).alias("docstring"))


def bm25_nodes(spark, sf):
    index = search.TextIndex(_fields(spark, sf), "id", search.NODE_FIELDS)
    return index.search(_questions(spark)).select("query_id", F.col("doc").alias("id"), F.round("score", 6).alias("score"))


def bm25_nodes_stemmed(spark, sf):
    index = search.TextIndex(_fields(spark, sf), "id", search.NODE_FIELDS, stem=True)
    return index.search(_questions(spark)).select("query_id", F.col("doc").alias("id"), F.round("score", 6).alias("score"))


def _vectors(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc"), F.lit("all").alias("space"), F.col("embedding").alias("vector"))
    return v, v.filter("doc % 50 = 0").select(F.col("doc").cast("string").alias("query_id"), "space", F.col("vector").alias("asked"))


def cosine_top(spark, sf):
    v, asked = _vectors(spark, sf)
    return search.vector_search(v, asked, 10).select(F.col("query_id").cast("long").alias("query_id"), F.col("doc").alias("vec_id"), F.round("score", 5).alias("score"))


def cosine_spread(spark, sf):
    v, asked = _vectors(spark, sf)
    return search.spread(search.vector_search(v, asked, 20)).select(F.col("query_id").cast("long").alias("query_id"), F.col("doc").alias("vec_id"), F.round("score", 4).alias("score"))


def fused_search(spark, sf):
    """Documents and their first lines searched apart and fused."""
    d = _documents(spark, sf)
    whole = search.TextIndex(d, "doc_id", {"text": 1.0})
    first = search.TextIndex(d.select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("text")), "doc_id", {"text": 1.0})
    q = _questions(spark)
    return search.fuse([whole.search(q), first.search(q)]).select("query_id", F.col("doc").alias("doc_id"), F.round("relevance", 6).alias("relevance"))


def hybrid_ranking(spark, sf):
    """The score over text relevance and importance of what BM25 finds among the nodes."""
    index = search.TextIndex(_fields(spark, sf), "id", search.NODE_FIELDS)
    rel = search.fuse([index.search(_questions(spark))])
    n = _nodes(spark, sf).select(F.col("id").alias("doc"), "type", "file_path", "importance")
    cand = rel.join(n, "doc").withColumn("similarity", F.lit(None).cast("double")).withColumn("proximity", F.col("relevance")).withColumn("memory", F.lit(0.0))
    return search.hybrid_score(cand).select("query_id", F.col("doc").alias("id"), F.round("score", 6).alias("score"))


def semantic_ranking(spark, sf):
    """Nodes whose id is divisible by 50 as questions: vectors and names found apart, fused, and scored with similarity."""
    c = F.col
    n = materialize(_nodes(spark, sf).select("id", "key", "type", "repo", "file_path", "importance"))
    e = table(spark, sf, "node_embeddings").filter("vector is not null and size(vector) = dim and not exists(vector, x -> isnan(x) or x is null) and exists(vector, x -> x != 0)")
    e = e.groupBy("node_key", "model").agg(F.min("vector").alias("vector")).join(n.select(c("key").alias("node_key"), "id"), "node_key")
    vectors = materialize(e.select(c("id").alias("doc"), c("model").alias("space"), "vector"))
    asked = vectors.filter("doc % 50 = 0").select(c("doc").cast("string").alias("query_id"), "space", c("vector").alias("asked"))
    near = materialize(search.vector_search(vectors, asked))
    # the same file's nodes by importance stand for what a text search brings
    mine = asked.select("query_id").join(n.select(c("id").cast("string").alias("query_id"), "repo", "file_path"), "query_id")
    beside = mine.join(n.select("repo", "file_path", c("id").alias("doc"), F.coalesce("importance", F.lit(0.0)).alias("score")), ["repo", "file_path"])
    found = search.fuse([near, search.ranked(beside, search.HITS)])
    facts = n.select(c("id").alias("doc"), "type", "file_path", "importance")
    cand = found.join(facts, "doc").join(search.spread(near).withColumnRenamed("score", "similarity"), ["query_id", "doc"], "left")
    cand = cand.withColumn("proximity", c("relevance")).withColumn("memory", F.lit(0.0))
    return search.hybrid_score(cand).select(c("query_id").cast("long").alias("query_id"), c("doc").alias("id"), F.round("score", 4).alias("score"))


def note_log(spark, sf):
    """The log of notes folded in the order of arrival."""
    log = table(spark, sf, "memories").filter("uid is not null and uid != ''").select(F.col("log_pos").alias("pos"), "uid", "topic", "deleted")
    return notes.fold(log).select("uid", "pos", "place", "topic")


def note_stale(spark, sf):
    log = table(spark, sf, "memories").filter("uid is not null and uid != ''").select(F.col("log_pos").alias("pos"), "uid", "anchors", "deleted")
    nodes = _nodes(spark, sf).groupBy("key").agg(F.max("content_hash").alias("content_hash"))
    return notes.stale(notes.fold(log), nodes)


def note_targets(spark, sf):
    log = table(spark, sf, "memories").filter("uid is not null and uid != ''").select(F.col("log_pos").alias("pos"), "uid", "topic", "content", "files", "symbols", "deleted")
    return notes.about(notes.fold(log), _nodes(spark, sf).select("key", "type", "name", "qualname", "file_path"))


def node_summaries(spark, sf):
    n = _nodes(spark, sf)
    keys = n.select("id", "key")
    e = _edges(spark, sf).join(keys.select(F.col("id").alias("source"), F.col("key").alias("source_key")), "source").join(keys.select(F.col("id").alias("target"), F.col("key").alias("target_key")), "target")
    return summaries.summaries(n, e)


def _costs(spark, sf):
    return table(spark, sf, "documents").filter("repo is not null and length(text) > 0").select("repo", "doc_id", X.estimate_tokens(F.col("text")).alias("cost")).dropDuplicates(["doc_id"])


def _largest():
    return Window.partitionBy("repo").orderBy(F.desc("cost"), "doc_id")


def pack_prefix(spark, sf):
    rank = F.row_number().over(_largest())
    few = _costs(spark, sf).withColumn("rank", rank).filter("rank <= 3000")  # a document costs a token at least
    return pack.pack_prefix(few, 3000, group="repo").select("repo", "doc_id", F.col("used").cast("long").alias("used"))


def pack_first_fit(spark, sf):
    can = pack.fitting(_costs(spark, sf), 3000, ["repo"], "cost", F.col("doc_id"))
    can = materialize(can.withColumn("rank", F.row_number().over(_largest())))
    return pack.pack_first_fit(can, 3000, group="repo").join(can, ["repo", "rank"]).select("repo", "doc_id", "used")


def repo_maps(spark, sf):
    n = _nodes(spark, sf)
    keys = n.select("id", "key")
    e = _edges(spark, sf).join(keys.select(F.col("id").alias("source"), F.col("key").alias("source_key")), "source").join(keys.select(F.col("id").alias("target"), F.col("key").alias("target_key")), "target")
    return pack.repo_map(n, e).select("rank", "file_path", "block", "cost")


def parsed_nodes(spark, sf):
    return parse.nodes_of(parse.parse_files(table(spark, sf, "files").select("repo", "path", "content")))


def parsed_references(spark, sf):
    return parse.refs_of(parse.parse_files(table(spark, sf, "files").select("repo", "path", "content")))


def linked_edges(spark, sf):
    parsed = materialize(parse.parse_files(table(spark, sf, "files").select("repo", "path", "content")))
    return link.link(parse.nodes_of(parsed), parse.refs_of(parsed))


def _placed(spark, sf):
    """The nodes, written down with place, the number of their key in the order of keys, which is short to move, and
    first: whether they are the first of their key."""
    n = _nodes(spark, sf).orderBy("key").withColumn("own", F.monotonically_increasing_id())
    n = n.withColumn("place", F.min("own").over(Window.partitionBy("key")))
    return materialize(n.withColumn("first", F.col("own") == F.col("place")).drop("own"))


def _answer(spark, sf, stem=True):
    at, tidy = _placed(spark, sf), graph.tidy_edges(table(spark, sf, "edges").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relation", "confidence"))
    places = at.select("id", "place")
    links = tidy.join(places.select(F.col("id").alias("source"), F.col("place").alias("source_key")), "source").join(places.select(F.col("id").alias("target"), F.col("place").alias("target_key")), "target")
    links = materialize(links.select("source_key", "target_key", "relation", "confidence"))
    log = table(spark, sf, "memories").filter("uid is not null and uid != ''").select(F.col("log_pos").alias("pos"), "uid", "topic", "content", "files", "symbols", "anchors", "deleted")
    kept = materialize(notes.fold(log).filter("content is not null"))
    about = materialize(notes.about(kept, at.select("key", "type", "name", "qualname", "file_path")))
    full = at.withColumn("file_path", F.concat_ws("/", "repo", "file_path"))
    said = materialize(summaries.summaries(full.drop("key").withColumnRenamed("place", "key"), links).withColumnRenamed("key", "place"))
    parents = at.select(F.col("id").alias("parent_id"), F.col("key").alias("parent_key"))
    n = materialize(full.join(parents, "parent_id", "left").join(said, "place").drop("place", "first"))
    release(said)
    names = at.filter("first").select("place", "key")
    e = links.withColumnRenamed("source_key", "place").join(names, "place").select(F.col("key").alias("source_key"), F.col("target_key").alias("place"), "relation", "confidence")
    e = materialize(e.join(names, "place").select("source_key", F.col("key").alias("target_key"), "relation", "confidence"))
    release(links)
    release(at)
    index = search.TextIndex(summaries.index_documents(n), "key", search.NODE_FIELDS, stem=stem)
    note_index = search.TextIndex(kept, "uid", search.NOTE_FIELDS, stem=stem)
    return n, e, kept, retrieve.retrieve(_questions(spark), n, e, index, kept, note_index, about)


def retrieval(spark, sf):
    """The questions answered over the whole graph: text, expansion, notes, score."""
    return _answer(spark, sf)[3].ranked


def retrieval_plain(spark, sf):
    """The same over words as they stand, without stems."""
    best = _answer(spark, sf, stem=False)[3].ranked
    return best.select("query_id", "key", F.round("score", 5).alias("score"), F.round("relevance", 5).alias("relevance"), "via")


def briefings(spark, sf):
    """The answers packed into 3000 tokens each."""
    n, e, kept, answer = _answer(spark, sf)
    stale = notes.stale(kept, n.select("key", "content_hash"))
    said = answer.notes.join(kept.join(stale, "uid"), "uid").select("query_id", "score", X.format_memory(F.col("uid"), F.col("topic"), F.col("content"), F.col("stale")).alias("note"))
    files = table(spark, sf, "files").filter("content is not null").groupBy(F.concat_ws("/", "repo", "path").alias("path")).agg(F.min("content").alias("content"))
    return pack.briefs(_questions(spark), answer.ranked, said, n, e, files, answer.mode, 3000)


def stream_note_log(spark, sf):
    """The last state of every note, folded from a stream of the log's files, one file a micro-batch."""
    base = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    log = table(spark, sf, "memories").select("log_pos", "uid", "topic", "deleted").filter("uid is not null and uid != ''")
    # the log as it would arrive: in several files, not in order
    log.repartition(4, F.xxhash64("log_pos")).write.parquet(f"{base}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/log")
    fold_stream(stream, latest_states("uid", "log_pos"), f"{base}/states", f"{base}/checkpoint").awaitTermination()
    state = last_state(spark, f"{base}/states")
    state = state if state is not None else spark.createDataFrame([], log.schema)
    return state.filter("not coalesce(deleted, false)").select("uid", "log_pos", "topic")


_ALL = (
    file_manifest, manifest_changes, path_flags, identifiers, question_terms, sentences, labels, embedding_texts, find_by_suffix, find_symbols, inherited_methods, edges_tidy, adjacency, label_groups, contains_parents, unique_names, pick_candidates, path_suffixes,
    derived_tests, tests_by_name, counts, neighbour_names, module_centrality, pagerank, expand_two_hops, expand_best_first, bm25_documents, bm25_nodes, bm25_nodes_stemmed, cosine_top, cosine_spread, fused_search, hybrid_ranking, semantic_ranking,
    note_log, stream_note_log, retrieval, retrieval_plain, briefings, note_stale, note_targets, node_summaries, pack_prefix, pack_first_fit, repo_maps, parsed_nodes, parsed_references, linked_edges,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = graph_sql.statements(QUESTIONS)
