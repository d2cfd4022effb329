"""What the training-data operators share: table access, intermediate tables in the shared folder, Arrow batches of byte strings."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where intermediate tables go in tests, that is when the session names no spark.checkpoint.dir and runs in one process.
LOCAL_DIR = "/tmp/checkpoints/verdigris"


#: Setting of the bytes of a batch that goes to a worker, its value here, and Spark's own default. A session that sets ``KEEP_BATCH`` to true keeps its own.
BATCH_BYTES, BATCH, DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m", ("67108864b", "64m", "64MB", "67108864")
KEEP_BATCH = "verdigris.keepArrowBatches"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as Spark reads it; the path may be in a store that only Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share.

    It is the one that the session names. Only a session that names none, and whose executors
    are threads of the driver, gets ``LOCAL_DIR``; any other is an error, as its executors
    would not see one another's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{LOCAL_DIR}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    It cuts lineage and is computed once; a lost executor costs no earlier stage, because
    the files are not on it. The folder goes when the driver ends, or before that with ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/verdigris-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, folder = _files(spark, path)
    files.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.verdigris_path = path
    return out


def _files(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path as it takes it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables that ``materialize`` gave back; nothing may read them any more. Other tables are left alone."""
    for df in tables:
        if path := getattr(df, "verdigris_path", None):
            files, folder = _files(df.sparkSession, path)
            files.delete(folder, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one that begins so, which no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sized(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df``, marked for broadcast if a count says that it has at most ``most`` rows; a larger one is joined by shuffling."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with workers' batches of at most ``BATCH`` from now on, unless the session has a size of its own.

    A task holds a batch several times over, in the JVM and in the worker; the default size
    would take hundreds of megabytes of an executor for texts. The setting is read when a plan
    runs, so it cannot be put back here; it holds for the session, as the README says.
    """
    conf = df.sparkSession.conf
    if conf.get(KEEP_BATCH, "false") != "true" and conf.get(BATCH_BYTES, None) in (None, *DEFAULT_BATCH):
        conf.set(BATCH_BYTES, BATCH)
    return df


def hex_crc32(column) -> object:
    """crc32 of a column's text form, as the labels' fold is defined on it."""
    return F.crc32(column.cast("string").cast("binary"))


def binary_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string Arrow array without a copy; nulls are empty.

    Offsets start where the slice starts, so bytes before the first one do not belong to it.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


@cache
def lean_memory() -> None:
    """From now on this worker gives memory back: large arrays are mapped one by one and unmapped when they go.

    Else the C library raises by itself the size from which it maps, and what small objects pin stays.
    Where the C library has no such setting, nothing changes.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    setting = getattr(ctypes.CDLL(None), "mallopt", None)
    if setting is not None:
        for kind in (-1, -3):  # trim and map thresholds
            setting(kind, 1 << 18)


def blocks(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20, lean: bool = True) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of record batches with about ``most`` bytes in a text column (one row at least), with that column's bytes and offsets from 0. ``lean`` workers map large arrays anew each time."""
    if lean:
        lean_memory()
    for batch in batches:
        data, offsets = binary_offsets(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            own = offsets[at : end + 1]
            yield batch.slice(at, end - at), data[own[0] : own[-1]], own - own[0]
            at = end


def map_arrow(df: DataFrame, function: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` under a plain name, so that every operator states its result's schema."""
    return df.mapInArrow(function, schema)


def arrow_schema(spec: str) -> pa.Schema:
    """Arrow fields from a DDL string of simple types, for the batches that workers build."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(pa.field(name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array<") else kinds[kind]))
    return pa.schema(fields)
