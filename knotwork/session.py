"""Session helpers shared by all operators: tables, materialised steps, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when the optimizer's own size statistic is at most this many bytes.
BROADCAST_BYTES = 32 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster sets it; in local mode, else, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jsc = spark.sparkContext._jsc.sc()
        got = jsc.getCheckpointDir()
        if got.isDefined():
            return got.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/knotwork-{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Delete all that this application has written down. Results that were not read out by then are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back. Survives the loss of executors."""
    spark = spark or df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    with transient(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def transient(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of every action go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def release(df: DataFrame) -> None:
    """Delete a step that `materialize` wrote, once nothing that is still to run reads it."""
    spark = df.sparkSession
    own = folder(spark).removeprefix("file:").lstrip("/")
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if path.removeprefix("file:").lstrip("/").startswith(own):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def size_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; exact up to file overhead for a table just read from parquet."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast where the estimate is below the limit; beyond it the plain shuffle join runs."""
    return F.broadcast(df) if size_bytes(df) <= limit else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        out = f"{tempfile.mkdtemp(prefix='spark-')}/knotwork.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(out)
        _shipped.add(context.applicationId)
