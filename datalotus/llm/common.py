"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only a single-machine session (tests) may leave it unset; then a temporary
    folder is used. A cluster without the setting is an error, because a folder
    of one machine would be lost with that machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


class Tables:
    """The intermediate tables of one result. They live in the shared folder until
    `release`, which the result's owner may call once the result is written; what is
    left goes when the application ends. No other result's tables are touched."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def own(self, path: str) -> str:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
        self.paths.append(path)
        return path

    def write(self, df: DataFrame, label: str) -> DataFrame:
        return _written(df, self.own(new_path(self.spark, label)))

    def release(self) -> None:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        while self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str, tables: Tables | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, and a
    lost executor costs only the tasks that read it. `tables` owns the written table."""
    return (tables or Tables(df.sparkSession)).write(df, label)


def keep(df: DataFrame, label: str) -> DataFrame:
    """The same, without an owner: the table stays when the application ends."""
    return _written(df, new_path(df.sparkSession, label))


def column(name: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def row(docs: DataFrame) -> Column:
    """A row as one struct, so that columns made beside it can't clash with its own."""
    return F.struct(*[column(c) for c in docs.columns])


def slices(batch: pa.RecordBatch, texts: pa.Array, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `size` bytes."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)))
    start, done = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(start, stop - start)
        start, done = stop, ends[stop - 1]


def trim() -> None:
    """Give freed memory back to the system, as an idle worker would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The runs of non-space characters, as an array; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
