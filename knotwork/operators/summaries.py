"""One-line summaries of nodes from their signatures, documentation and neighbours.

Cases: nodes without neighbours or documentation get what is left of their line; null names are left blank; ties between
equally important neighbours go by key; empty tables give nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions import text as X
from knotwork.operators.graph import members_named
from knotwork.session import materialize

#: How many neighbours each part of a summary names, and its greatest length.
PARTS = {"defines": 8, "methods": 8, "calls": 5, "callers": 4}
MOST = 300


def neighbour_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """key, defines, methods, calls, callers: the named neighbours of every node that has any."""
    c = F.col
    n = nodes.select("key", "type", "name", "is_public", X.summary_label(c("type"), c("name"), c("qualname")).alias("label"), F.coalesce("importance", F.lit(0.0)).alias("importance"))
    e = edges.filter("relation in ('contains', 'calls')").select("source_key", "target_key", "relation").distinct()
    shown = (c("relation") == "contains") & F.coalesce("is_public", F.lit(False))
    parts = F.array(
        F.when(shown & c("type").isin("class", "function"), "defines"),
        F.when(shown & c("type").isin("method", "function", "test") & ~c("name").startswith("__"), "methods"),
        F.when(c("relation") == "calls", "calls"),
    )
    down = e.join(n.withColumnRenamed("key", "target_key"), "target_key").select(c("source_key").alias("owner"), F.explode(F.array_compact(parts)).alias("part"), "label", "importance", c("target_key").alias("tie"))
    up = e.filter("relation = 'calls'").join(n.withColumnRenamed("key", "source_key"), "source_key").select(c("target_key").alias("owner"), F.lit("callers").alias("part"), "label", "importance", c("source_key").alias("tie"))
    named = members_named(down.unionByName(up), PARTS)
    return named.groupBy(c("owner").alias("key")).agg(*[F.max(F.when(c("part") == p, c("names"))).alias(p) for p in PARTS])


def summaries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """key, summary of every node. nodes: key, type, name, qualname, file_path, signature, docstring, is_public, importance.

    Keys may be numbers, if they are in the order of the names that they stand for."""
    names = materialize(neighbour_names(nodes, edges))
    d = nodes.select("key", "type", "name", "qualname", "file_path", "signature", "docstring").join(names, "key", "left")
    doc = F.when(F.length("docstring") > 0, X.first_sentence(F.col("docstring")))
    doc = F.when(F.length(doc) > 0, doc)
    line = lambda head, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(head), F.col(c), F.lit(".")))
    sig = F.coalesce(F.when(F.length("signature") > 0, F.col("signature")), F.col("name"))
    text = (
        F.when(F.col("type") == "memory", F.coalesce("docstring", F.lit("")))
        .when(F.col("type") == "module", F.concat_ws(" ", F.concat(F.lit("Module "), "qualname", F.lit(".")), doc, line("Defines: ", "defines")))
        .when(F.col("type") == "class", F.concat_ws(" ", F.concat(F.coalesce(F.when(F.length("signature") > 0, F.col("signature")), F.concat(F.lit("class "), "name")), F.lit(".")), doc, line("Methods: ", "methods"), line("Used by: ", "callers")))
        .when(F.col("type").isin("function", "method", "test"), F.concat_ws(" ", F.when(sig.endswith("."), sig).otherwise(F.concat(sig, F.lit("."))), doc, line("Calls: ", "calls"), line("Called by: ", "callers")))
        .when(F.col("type") == "documentation", F.concat_ws(" ", F.concat(F.lit("Docs '"), "name", F.lit("' ("), "file_path", F.lit(").")), F.when(F.length("docstring") > 0, X.first_sentence(F.col("docstring"), 240))))
        .otherwise(F.concat_ws(" ", "name", doc))
    )
    return d.select("key", X.truncate(text, MOST).alias("summary"))


def index_documents(nodes: DataFrame) -> DataFrame:
    """key, name, idents, file_path, summary, docstring: what the full-text index holds of every node but notes."""
    plain = nodes.filter(F.coalesce("type", F.lit("")) != "memory")
    return plain.select("key", "name", X.identifier_tokens(F.col("name"), F.col("qualname")).alias("idents"), "file_path", "summary", F.coalesce("docstring", F.lit("")).alias("docstring"))
