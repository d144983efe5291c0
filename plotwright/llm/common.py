"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that Python code works on at once; longer single texts are worked on alone.
SLICE_BYTES = 2 << 20


def session(df: DataFrame) -> SparkSession:
    """The session of ``df``, with Arrow batches bounded by bytes, so that long texts don't make large batches."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``).

    A written table cuts the lineage and survives the loss of executors. Where the setting is unset a temporary
    folder serves a local master, as in tests; on a cluster, whose machines don't share one, that is refused.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="plotwright-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.base = f"{base.rstrip('/')}/plotwright/{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.base}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, written and read back."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that no later plan reads."""
        if path := getattr(df, "_scratch_path", None):
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def extended(df: DataFrame, new: str) -> StructType:
    """The schema of ``df`` and the columns of the DDL string ``new``."""
    return StructType([*df.schema.fields, *StructType.fromDDL(new).fields])


#: Bytes that a side of a join may take to be sent to all tasks.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, row_bytes: int, also: Column | None = None) -> DataFrame:
    """``df``, a written table, marked for broadcast if its counted rows (and the bytes summed by ``also``) are within BROADCAST_BYTES; beyond that the join shuffles."""
    n = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(also if also is not None else F.lit(0)), F.lit(0)).alias("m")).first()
    return F.broadcast(df) if n.n * row_bytes + n.m <= BROADCAST_BYTES else df


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null as empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with at most SLICE_BYTES of text in ``column`` (or one row), and their texts."""
    for batch in batches:
        values, start, held = texts(batch.column(column)), 0, 0
        for i, x in enumerate(values):
            if i > start and held + len(x) > SLICE_BYTES:
                yield batch.slice(start, i - start), values[start:i]
                start, held = i, 0
            held += len(x)
        if start < len(values):
            yield batch.slice(start), values[start:]
    pa.default_memory_pool().release_unused()  # the process stays for other tasks
