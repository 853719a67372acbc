"""Shared folder, scratch tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast up to this many bytes (rows times a fixed row width); beyond it the plain join runs.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary one is set if driver and executors are
    one process (tests); on a cluster that would be another folder on each machine,
    so it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="symloom-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/symloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in replicated files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite").option("compression", "zstd" if not partition_by else "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(_schema_after(df, partition_by)).parquet(path)


def _schema_after(df: DataFrame, partition_by: tuple[str, ...]):
    from pyspark.sql.types import StructType

    own = [f for f in df.schema.fields if f.name not in partition_by]
    return StructType(own + [df.schema[c] for c in partition_by])


class Scratch:
    """Written tables of one operator, dropped as soon as the next step is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        with shuffles_removed(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(_schema_after(df, ())).parquet(path)
        self._paths[id(back)] = (path, back)
        return back

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path, _ = self._paths.pop(id(table))
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when the query ends and not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where ``rows * row_bytes`` was counted to stay within ``limit``."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def text_or_empty(text: str) -> "F.Column":
    return F.coalesce(F.col(text).cast("string"), F.lit(""))
