"""Shared pieces: scratch tables, byte-level word tables, Arrow helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts may be long; small batches bound the memory of a Python worker.
BATCH_ROWS = 1000


def tune(spark: SparkSession) -> SparkSession:
    """Small Arrow batches; and shuffle files go when the query that wrote them ends, as what is used again is a stored table."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A machine's own folder serves only where all tasks run in the driver's process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tonearm-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the tables of stored() that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_held: dict[str, Callable[[], None]] = {}


def holds(name: str, forget: Callable[[], None] = lambda: None) -> None:
    """Called in a Python worker by an operator that begins a partition: what other operators remember in the worker is forgotten."""
    others = [k for k in _held if k != name]
    for k in others:
        _held.pop(k)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    _held[name] = forget


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def texts(column: pa.Array) -> list[str]:
    """A string column as Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _word_table() -> bytes:
    keep = bytearray(b" " * 256)
    for i in range(256):
        if i >= 0x80 or 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A:
            keep[i] = i
        elif 0x41 <= i <= 0x5A:
            keep[i] = i + 32
    return bytes(keep)


#: Lower-cases A-Z and turns every byte outside [0-9a-z\x80-\xFF] into a space. Bytes from 0x80 on belong
#: to characters beyond ASCII, which are all word characters of [^\x00-\x2F\x3A-\x60\x7B-\x7F].
WORD_TABLE = _word_table()


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def clean_columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the wanted columns under fixed names; other columns, whatever they are called, cannot clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in named.items()))
