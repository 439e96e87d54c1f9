"""Queries of the text, code and vector problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.llm import docpairs, leakage, mixing, neighbours, notwritten, truncation, unparsable
from knotwork.session import table


def p2_found(spark, sf):
    return docpairs.node_pairs(table(spark, sf, "nodes").select("id", "type", "signature", "docstring")).select("id").distinct()


def p2_file_pairs(spark, sf):
    return docpairs.file_pairs(table(spark, sf, "files").select("file_id", "path", "content"))


def _files(spark, sf):
    return table(spark, sf, "files").select("file_id", "repo", "path", "language", "content")


def p3_found(spark, sf):
    return unparsable.unparsable(_files(spark, sf))


def p3_rates(spark, sf):
    return unparsable.unparsable_rates(_files(spark, sf))


def p4_found(spark, sf):
    return neighbours.mutual(table(spark, sf, "node_embeddings"))


def p4_similar(spark, sf):
    return neighbours.similar(table(spark, sf, "node_embeddings")).withColumn("cosine", F.round("cosine", 6))


def p4_search(spark, sf):
    """The vectors of nodes whose id is divisible by 50 as queries against all; a node finds itself first."""
    e = table(spark, sf, "node_embeddings")
    some = table(spark, sf, "nodes").filter("id % 50 = 0").select("node_key").distinct()
    asked = neighbours.usable(e).join(some, "node_key", "left_semi").select(F.col("node_key").alias("query_id"), "model", "vector")
    return neighbours.search(e, asked).withColumn("cosine", F.round("cosine", 6))


def p4_recall(spark, sf):
    """Recall of the lists for the nodes whose id is divisible by 50, against brute force in blocks."""
    return neighbours.recall(table(spark, sf, "node_embeddings"), table(spark, sf, "nodes").filter("id % 50 = 0").select("node_key"))


def p6_found(spark, sf):
    return notwritten.not_written(_files(spark, sf), table(spark, sf, "packages"))


def p6_validation(spark, sf):
    return notwritten.validation(_files(spark, sf), table(spark, sf, "packages"))


def p8_found(spark, sf):
    return leakage.leaks(table(spark, sf, "eval_items").select("item_id", "text"), table(spark, sf, "documents").select("doc_id", "text"))


def p8_items(spark, sf):
    return leakage.leaked_items(table(spark, sf, "eval_items"), table(spark, sf, "documents").select("doc_id", "text"))


def p9_mix(spark, sf):
    return mixing.mix(table(spark, sf, "documents").select("doc_id", "source", "text"), table(spark, sf, "mix_targets"))


def p9_shares(spark, sf):
    targets = table(spark, sf, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, sf, "documents").select("doc_id", "source", "text"), targets), targets)


def _mix_parts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "text"), table(spark, sf, "mix_targets")


def p9_kept(spark, sf):
    """Whether the mix keeps its shares and repeats."""
    docs, targets = _mix_parts(spark, sf)
    return mixing.kept(mixing.mix(docs, targets), docs, targets)


def p9_weighted(spark, sf):
    """The same for a mix that prefers long texts: unequal probabilities within a source."""
    docs, targets = _mix_parts(spark, sf)
    return mixing.kept(mixing.mix(docs.withColumn("w", F.log1p(F.length("text"))), targets, weight="w"), docs, targets)


def p10_found(spark, sf):
    return truncation.truncated(table(spark, sf, "documents").select("doc_id", "source", "text"))


def p10_rates(spark, sf):
    return truncation.truncation_rates(table(spark, sf, "documents").select("doc_id", "source", "text"))


def p10_limits(spark, sf):
    return truncation.limits(truncation.inspected(table(spark, sf, "documents").select("doc_id", "source", "text")))


QUERIES = {f.__name__: f for f in (p2_found, p2_file_pairs, p3_found, p3_rates, p4_found, p4_similar, p4_search, p4_recall, p6_found, p6_validation, p8_found, p8_items, p9_mix, p9_shares, p9_kept, p9_weighted, p10_found, p10_rates, p10_limits)}

_USABLE = """WITH u AS (SELECT DISTINCT model, node_key, CAST(vector AS DOUBLE[]) AS v FROM node_embeddings WHERE vector IS NOT NULL AND node_key IS NOT NULL AND model IS NOT NULL AND len(vector) = dim AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x != 0)) > 0),
c AS (SELECT a.node_key AS a, b.node_key AS b, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS cosine FROM u a JOIN u b ON a.model = b.model AND a.node_key != b.node_key),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM c QUALIFY rank <= 5)
"""

_KEPT = """SELECT source, EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND length(d.text) > 0) AND coalesce(target_share, 0) > 0 AND coalesce(max_repeats, 0) > 0 AS has_documents, true AS on_target, true AS within_repeats FROM mix_targets t WHERE source IS NOT NULL"""

SQL = {
    "p9_kept": _KEPT,
    "p9_weighted": _KEPT,
    "p4_found": _USABLE + "SELECT x.a AS node_key_a, x.b AS node_key_b FROM t x JOIN t y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b AND x.cosine >= 0.9",
    "p4_search": _USABLE
    + """, s AS (SELECT a.node_key AS query_id, b.node_key, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS cosine FROM u a JOIN u b ON a.model = b.model WHERE a.node_key IN (SELECT node_key FROM nodes WHERE id % 50 = 0)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, node_key) AS INTEGER) AS rank FROM s QUALIFY rank <= 5) SELECT query_id, node_key, round(cosine, 6) AS cosine, rank FROM r""",
    "p4_similar": _USABLE + "SELECT a AS node_key, b AS other_key, round(cosine, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM t",
}
