"""The engine: index a source tree or a table of files, then ask it.

    engine = Engine(spark, "/data/index")
    engine.index(root="/src/project")
    print(engine.brief("where is the cache flushed?"))
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.functions import text as X
from knotwork.operators import graph, link, notes, pack, parse, retrieve, search, summaries
from knotwork.session import materialize, ship
from knotwork.sources import repos
from knotwork.sources.snapshots import Folder, SnapshotStore, embeddings_due, upsert_embeddings

VERSION = "2"
#: The file of the note log.
LOG = "notes.jsonl"
_NODES = f"repo string, {parse.NODE}"
_REFS = f"repo string, {parse.REF.replace('src_key', 'file_path string, src_key')}"
_FILES = "path string, language string, content string, content_hash string, size_bytes long"
_EMBEDDINGS = "node_key string, text_hash string, model string, dim int, vector array<float>"


@dataclass
class Report:
    files_seen: int = 0
    parsed: int = 0
    unchanged: int = 0
    deleted: int = 0
    relinked: bool = False
    embedded: int = 0


class Engine:
    """One source tree's index. embedder: (model name, function from a string column to an array<float> column), optional."""

    def __init__(self, spark: SparkSession, index_dir: str | Path, embedder: tuple[str, Callable] | None = None):
        ship(spark)
        self.spark, self.embedder = spark, embedder
        self.store = SnapshotStore(spark, f"{index_dir}/tables")
        self.log = Folder(spark, str(index_dir))

    # --- writing ---

    def index(self, root: str | Path | None = None, files: DataFrame | None = None, embed: bool = True, force: bool = False) -> Report:
        """Bring the index up to date with a tree or a table (path, language, content, content_hash, size_bytes)."""
        present = materialize(files if files is not None else repos.scan_tree(self.spark, root))
        known = self.store.read("files", _FILES)
        force = force or self.store.meta("version") != VERSION
        diff = materialize(repos.manifest_diff(known, present))
        counts = {r.change: r["count"] for r in diff.groupBy("change").count().collect()}
        log_hash = self._log_hash()
        report = Report(present.count(), counts.get("new", 0) + counts.get("changed", 0), counts.get("same", 0), counts.get("removed", 0))
        due = present if force else present.join(diff.filter("change in ('new', 'changed')"), "path", "left_semi")
        report.parsed = report.files_seen if force else report.parsed
        report.unchanged = 0 if force else report.unchanged
        if force or report.parsed or report.deleted or not self.store.has("edges"):
            parsed = materialize(parse.parse_files(due.withColumn("repo", F.lit(""))))
            gone = diff.filter("change = 'removed'").select(F.col("path").alias("file_path"))
            touched = due.select(F.col("path").alias("file_path")).unionByName(gone)
            old_nodes, old_refs = self.store.read("parsed_nodes", _NODES), self.store.read("refs", _REFS)
            nodes = old_nodes.join(touched, "file_path", "left_anti").unionByName(parse.nodes_of(parsed))
            refs = old_refs.join(touched, "file_path", "left_anti").unionByName(parse.refs_of(parsed))
            nodes, refs = materialize(nodes), materialize(refs)
            edges = link.link(nodes, refs).drop("repo")
            self.store.commit({"files": present, "parsed_nodes": nodes, "refs": refs, "code_edges": edges}, {"version": VERSION, "linked": "0"})
        if report.parsed or report.deleted or self.store.meta("linked") != "1" or self.store.meta("log") != log_hash:
            self._relink(log_hash)
            report.relinked = True
        if embed and self.embedder:
            report.embedded = self._embed()
        return report

    def _relink(self, log_hash: str) -> None:
        code = self.store.read("parsed_nodes")
        log = notes.fold(notes.read_log(self.spark, self.log.at(LOG))) if self.log.read(LOG) is not None else self.spark.createDataFrame([], f"pos long, {notes.LOG}, place long")
        log = materialize(log.filter("text is not null"))
        kept = log.withColumn("content", F.col("text"))
        old = notes.stale(kept, code)
        kept = materialize(kept.join(old, "uid").select("uid", "topic", "content", "created_at", "files", "symbols", "place", "stale"))
        about = materialize(notes.about(kept.fillna({"topic": ""}), code))
        note_nodes = kept.select(F.lit("").alias("repo"), F.concat(F.lit("memory:"), "uid").alias("key"), F.lit("memory").alias("type"), F.coalesce("topic", F.substring("content", 1, 40)).alias("name"), F.concat(F.lit("memory."), "uid").alias("qualname"), F.col("content").alias("docstring"), F.lit(True).alias("is_public"))
        nodes = materialize(code.unionByName(note_nodes, allowMissingColumns=True))
        edges = self.store.read("code_edges")
        edges = materialize(edges.unionByName(about.select(F.concat(F.lit("memory:"), "uid").alias("source_key"), F.col("key").alias("target_key"), F.lit("memory_about").alias("relation"), F.lit(None).cast("string").alias("confidence"))))
        rank = graph.pagerank(nodes.select(F.col("key").alias("node")), edges.select(F.col("source_key").alias("source"), F.col("target_key").alias("target"), "relation"))
        nodes = materialize(nodes.join(rank.withColumnRenamed("node", "key"), "key"))
        nodes = nodes.join(summaries.summaries(nodes, edges), "key")
        self.store.commit({"nodes": nodes, "edges": edges, "notes": kept, "note_about": about}, {"linked": "1", "log": log_hash, "indexed_at": datetime.now(UTC).isoformat(timespec="seconds")})

    def _embed(self) -> int:
        model, encode = self.embedder
        c = F.col
        some = self.nodes.filter(X.should_embed(c("type"), c("name"), c("is_public"), c("docstring"), c("start_line"), c("end_line")))
        texts = some.select(c("key").alias("node_key"), X.embedding_text(c("type"), c("name"), c("qualname"), c("file_path"), c("signature"), c("docstring")).alias("text"))
        old = self.store.read("embeddings", _EMBEDDINGS)
        due = materialize(embeddings_due(texts, old, model))
        new = due.withColumn("vector", encode(c("text"))).select("node_key", "text_hash", F.lit(model).alias("model"), F.size("vector").alias("dim"), "vector")
        self.store.commit({"embeddings": upsert_embeddings(old, new, texts)})
        return due.count()

    def remember(self, text: str, topic: str | None = None, files: list[str] | None = None, symbols: list[str] | None = None) -> str:
        """Append a note, anchored to what it is about now, and link it. Returns its uid."""
        uid = uuid.uuid4().hex[:8]
        row = self.spark.createDataFrame([(uid, topic or "", text, files or [], symbols or [])], "uid string, topic string, content string, files array<string>, symbols array<string>")
        code = self.nodes.filter("type != 'memory'")
        anchors = {r.key: r.content_hash for r in notes.about(row, code).join(code.select("key", "content_hash"), "key").filter("content_hash is not null").collect()}
        self._append({"uid": uid, "topic": topic, "text": text, "files": files or [], "symbols": symbols or [], "created_at": datetime.now(UTC).isoformat(timespec="seconds"), "anchors": anchors})
        return uid

    def forget(self, uid: str) -> None:
        if self.memories().filter(F.col("uid") == uid).isEmpty():
            raise KeyError(uid)
        self._append({"uid": uid, "deleted": True})

    def _append(self, record: dict) -> None:
        line = json.dumps(record, ensure_ascii=False) + "\n"
        self.log.write(LOG, (self.log.read(LOG) or b"") + line.encode())
        self._relink(self._log_hash())

    def _log_hash(self) -> str:
        data = self.log.read(LOG)
        return hashlib.sha1(data).hexdigest() if data is not None else ""

    # --- reading ---

    @property
    def nodes(self) -> DataFrame:
        return self.store.read("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.store.read("edges")

    def memories(self) -> DataFrame:
        return self.store.read("notes").orderBy("place")

    def retrieve(self, queries: DataFrame) -> retrieve.Answer:
        nodes = self.nodes
        index = search.TextIndex(summaries.index_documents(nodes), "key", search.NODE_FIELDS, stem=True)
        kept = self.store.read("notes")
        note_index = search.TextIndex(kept, "uid", search.NOTE_FIELDS, stem=True)
        vectors = asked = None
        if self.embedder and self.store.has("embeddings"):
            model, encode = self.embedder
            vectors = self.store.read("embeddings").filter(F.col("model") == model).select(F.col("node_key").alias("doc"), F.col("model").alias("space"), "vector")
            asked = materialize(queries.select("query_id", F.lit(model).alias("space"), encode(F.col("text")).alias("asked")))
        return retrieve.retrieve(queries, nodes, self.edges, index, kept, note_index, self.store.read("note_about"), vectors, asked)

    def _query(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([("q", text)], "query_id string, text string")

    def search(self, text: str, limit: int = 10) -> DataFrame:
        """rank, short, type, location, score, summary, related of the best nodes that are no files."""
        c = F.col
        nodes = self.nodes.withColumn("short", X.short_name(c("type"), c("name"), c("qualname"), c("file_path")))
        found = self.retrieve(self._query(text)).ranked.join(nodes, "key").filter("type != 'file'").orderBy("rank").limit(limit)
        near = graph.neighbours(self.edges.select(c("source_key").alias("source"), c("target_key").alias("target"), "relation", "confidence"))
        near = near.filter("(arrow = '→' and relation not in ('contains', 'imports')) or (arrow = '←' and relation in ('calls', 'inherits'))")
        top = near.join(found.select(c("key").alias("node")), "node").join(nodes.filter("type != 'memory'").select(c("key").alias("other"), c("short").alias("s"), c("importance").alias("w")), "other")
        top = top.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("w"), "other", "relation"))).filter("n <= 5")
        related = top.groupBy(c("node").alias("key")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", F.concat_ws(" ", "arrow", F.replace("relation", F.lit("_"), F.lit(" ")), "s").alias("t"))))["t"], "; ").alias("related"))
        return found.join(related, "key", "left").select("rank", "short", "type", X.location(c("file_path"), c("start_line")).alias("location"), "score", "summary", "related").orderBy("rank")

    def brief_table(self, queries: DataFrame, budget: int = 5000) -> DataFrame:
        """query_id, brief, tokens for a table of queries (query_id, text)."""
        answer = self.retrieve(queries)
        c = F.col
        said = answer.notes.join(self.store.read("notes"), "uid").select("query_id", "score", X.format_memory(c("uid"), c("topic"), c("content"), c("stale"), " [may be outdated: linked code changed since this was written]").alias("note"))
        return pack.briefs(queries, answer.ranked, said, self.nodes, self.edges, self.store.read("files", _FILES), answer.mode, budget)

    def brief(self, text: str, budget: int = 5000) -> str:
        return self.brief_table(self._query(text), budget).first().brief

    def map(self, budget: int = 1500) -> str:
        """The most central modules with their members, as many as fit."""
        head = "REPOSITORY MAP (most central modules first)\n"
        blocks = pack.repo_map(self.nodes, self.edges).withColumn("query_id", F.lit("map"))
        kept = pack.pack_first_fit(blocks, budget - pack.tokens(head) - 20).join(blocks, ["query_id", "rank"]).orderBy("rank")
        body = head + "".join(r.block for r in kept.select("block").collect())
        return body + f"\n~{pack.tokens(body)} tokens / {budget}\n"

    def find(self, symbol: str) -> DataFrame:
        """The nodes a symbol may mean, the best first: `path:line`, qualified name, name, end of a qualified name."""
        found = link.find_symbols(self.spark.createDataFrame([(symbol,)], "symbol string"), self.nodes)
        return self.nodes.join(found.select("key", "place"), "key").orderBy("place").drop("place")

    def expand(self, symbol: str, source: bool = False) -> str:
        """A symbol's definition, its neighbours by label, its notes, and its source if asked for."""
        found = self.find(symbol).limit(9).collect()
        if not found:
            hits = [r for r in self.search(symbol, 6).collect()]
            return f"No symbol matching '{symbol}'.\n" if not hits else f"No exact match for '{symbol}'. Closest:\n" + "".join(f"  {r.short} ({r.type}) — {r.location}\n" for r in hits)
        node, c = found[0], F.col
        named = self.nodes.withColumn("node", c("key")).withColumn("short", X.short_name(c("type"), c("name"), c("qualname"), c("file_path"))).withColumn("at", X.location(c("file_path"), c("start_line")))
        edges = self.edges.select(c("source_key").alias("source"), c("target_key").alias("target"), "relation", "confidence")
        members = [r.target for r in edges.filter((c("source") == node.key) & (c("relation") == "contains")).select("target").collect()]
        around = edges.filter((c("source") == node.key) | (c("target") == node.key) | c("target").isin(members))
        rows = graph.labelled_groups(around, named.select("node", "type", "qualname", "importance")).filter(c("node") == node.key).join(named.select(c("node").alias("other"), "short", c("type").alias("kind"), "at", "docstring"), "other").collect()
        span = f"{node.file_path}:{node.start_line}" + (f"-{node.end_line}" if node.end_line != node.start_line else "")
        out = [f"{node.qualname} ({node.type})", f"DEFINED IN  {span}"] + ([f"SIGNATURE   {node.signature}"] if node.signature else []) + ([f"SUMMARY     {node.summary}"] if node.summary else [])
        order = ["CONTAINED IN", "CONTAINS", "INHERITS", "SUBCLASSES", "IMPORTS", "IMPORTED BY", "CALLS", "CALLED BY", "USED BY (via methods)", "REFERENCES", "REFERENCED BY", "TESTED BY", "DOCUMENTED BY", "MEMORIES"]
        for label in order:
            some = sorted((r for r in rows if r.label == label), key=lambda r: r.n)
            if some:
                out.append(f"\n{label}")
                out += [f"  ({r.other.split(':', 1)[1]}) {r.docstring}" if label == "MEMORIES" else f"  {r.mark}{r.short} ({r.kind}) — {r.at}" for r in some]
                out += [f"  … +{some[0].more} more"] if some[0].more else []
        if source:
            one = pack.with_source(self.nodes.filter(c("key") == node.key), self.nodes, self.store.read("files", _FILES))
            out += ["\nSOURCE", (one.select(pack.snippet(pack.EXPAND_SNIPPET).alias("s")).first().s or "").rstrip()]
        if found[1:]:
            out += ["\nOTHER MATCHES"] + [f"  {r.qualname} ({r.type}) — {r.file_path}:{r.start_line}" for r in found[1:9]]
        if any(r.mark for r in rows):
            out.append("\n(~ = low-confidence, name-based link)")
        return "\n".join(out) + "\n"

    def stats(self) -> DataFrame:
        """part, name, n: files, nodes by type, edges by relation, languages, embeddings, notes and stale ones."""
        count = lambda df, part, by: df.groupBy(F.coalesce(by, F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "name", "n")
        files = self.store.read("files", _FILES)
        parts = [count(self.nodes, "nodes", "type"), count(self.edges, "edges", "relation"), count(files, "languages", "language"), count(self.store.read("embeddings", _EMBEDDINGS), "embeddings", "model"), count(self.store.read("notes"), "notes", F.when(F.col("stale"), "stale").otherwise("fresh"))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
