"""Tables kept as parquet snapshots behind one pointer, in any folder that Hadoop's file systems reach.

A commit writes all its tables into a new folder and then moves the pointer in one step, so a reader sees the old state or
the new one. Tables that a commit does not name are carried over by reference.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """A folder of small files on a shared file system."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self._jvm, self._hadoop = jvm, jvm.org.apache.hadoop.fs
        self._root = self._hadoop.Path(str(root))
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._root.getFileSystem(conf)
        self._root = self._fs.makeQualified(self._root)
        self._context = self._hadoop.FileContext.getFileContext(self._root.toUri(), conf)
        self._fs.mkdirs(self._root)

    def at(self, name: str) -> str:
        return f"{self._root.toString()}/{name}"

    def read(self, name: str) -> bytes | None:
        path = self._hadoop.Path(self.at(name))
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        """Put a file in place in one step."""
        draft = self._hadoop.Path(self.at(f".{name}.{uuid.uuid4().hex}"))
        stream = self._fs.create(draft, True)
        try:
            stream.write(data)
        finally:
            stream.close()
        kind = getattr(self._hadoop, "Options$Rename")
        how = self._jvm.java.lang.reflect.Array.newInstance(kind.OVERWRITE.getClass(), 1)
        how[0] = kind.OVERWRITE
        self._context.rename(draft, self._hadoop.Path(self.at(name)), how)


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, str(root))

    @property
    def _current(self) -> dict:
        data = self.folder.read("CURRENT")
        return json.loads(data) if data else {"tables": {}, "meta": {}}

    def commit(self, tables: dict[str, DataFrame], meta: dict[str, str] | None = None) -> None:
        """Write the tables and values and make them current together; nothing changes where a write fails."""
        state = self._current
        name = uuid.uuid4().hex[:12]
        for t, df in tables.items():
            df.write.parquet(self.folder.at(f"{name}/{t}"))
            state["tables"][t] = f"{name}/{t}"
        state["meta"].update(meta or {})
        self.folder.write("CURRENT", json.dumps(state).encode())

    def has(self, table: str) -> bool:
        return table in self._current["tables"]

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        """A current table; an empty one of the schema where it was never written."""
        at = self._current["tables"].get(table)
        if at is None:
            if schema is None:
                raise FileNotFoundError(f"no table {table} in {self.folder.at('')}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(self.folder.at(at))

    def meta(self, key: str) -> str | None:
        return self._current["meta"].get(key)


def replace_by(old: DataFrame, new: DataFrame, keys: list[str], also_gone: DataFrame | None = None) -> DataFrame:
    """old without the rows whose keys are in new (or in also_gone), and new."""
    gone = new.select(*keys) if also_gone is None else new.select(*keys).unionByName(also_gone.select(*keys))
    return old.join(gone.distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_embeddings(old: DataFrame, new: DataFrame, keep: DataFrame) -> DataFrame:
    """Embeddings after new ones replaced those of the same node and nodes not to keep (node_key) were dropped."""
    return replace_by(old, new, ["node_key"]).join(keep.select("node_key").distinct(), "node_key", "left_semi")


def embeddings_due(texts: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """texts (node_key, text) whose SHA-1 the model has not embedded yet, shortest first within a partition."""
    hashed = texts.withColumn("text_hash", F.sha1(F.col("text").cast("binary")))
    have = embeddings.filter(F.col("model") == model).select("node_key", "text_hash")
    return hashed.join(have, ["node_key", "text_hash"], "left_anti").sortWithinPartitions(F.length("text"))
