"""Structured Streaming forms of the note log and the file manifest.

Each folds its micro-batches into a table through foreachBatch: batch n reads the state that batch n - 1 wrote and writes
its own, so a batch that is repeated after a failure gives the same state again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from knotwork.sources.snapshots import replace_by


def fold_stream(stream: DataFrame, step: Callable[[DataFrame | None, DataFrame], DataFrame], states: str, checkpoint: str) -> StreamingQuery:
    """Run step(state or None, batch) -> state over every micro-batch of all data that is there; the state after batch n is
    the parquet table states/n."""
    spark = stream.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        state = spark.read.parquet(f"{states}/{batch_id - 1}") if batch_id else None
        step(state, batch).write.mode("overwrite").parquet(f"{states}/{batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_state(spark: SparkSession, states: str) -> DataFrame | None:
    """The newest state of a stream; None where no batch has come."""
    path = spark._jvm.org.apache.hadoop.fs.Path(states)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(f.getPath().getName()) for f in fs.listStatus(path)] if fs.exists(path) else []
    return spark.read.parquet(f"{states}/{max(done)}") if done else None


def latest_states(key: str, position: str) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A step that keeps every key's row of the greatest position, removals included, so that late rows lose."""

    def step(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        every = batch if state is None else state.unionByName(batch)
        last = every.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*every.columns), position).alias("r"))
        return last.select("r.*")

    return step


def manifest_states(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """A step for manifests: the batch's files (path, content_hash) take the place of those of the same path."""
    one = batch.groupBy("path").agg(F.max("content_hash").alias("content_hash"))
    return one if state is None else replace_by(state, one, ["path"])
