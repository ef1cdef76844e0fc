"""Small helpers of the training-data operators: tables, shared storage, text buffers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step handles at once.
CHUNK_BYTES = 4 << 20

#: The word separators of the contracts, as a regular expression class.
SPACE = r"\x20\x09-\x0D"

#: Whether Spark deletes a finished query's shuffle files at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths that this process has staged, and those of the tables read from them.
_STAGED: set[str] = set()
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="logloom-shared-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.add(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors.

    The shuffle files of the write go as soon as it has ended, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that no later step reads."""
    for df in tables:
        remove(_PATHS.pop(df))


def remove(path: str) -> None:
    _STAGED.discard(path)
    where, place = fs.FileSystem.from_uri(path)
    where.delete_dir(place)


def remove_staged() -> None:
    """Deletes all that operators have staged in this process; for callers that have written their results."""
    _PATHS.clear()
    for path in list(_STAGED):
        if fs.FileSystem.from_uri(path)[0].get_file_info(fs.FileSystem.from_uri(path)[1]).type == fs.FileType.NotFound:
            _STAGED.discard(path)
        else:
            remove(path)


def packed(df: DataFrame, **columns: str | Column) -> DataFrame:
    """All columns of df in one struct `row`, beside the named ones, so that no names clash."""
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])
    return df.select(whole.alias("row"), *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def batches_of(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each slice holds about `limit` text bytes, or one row."""
    if batch.num_rows == 0:
        return
    offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))[1]
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets into them; null texts are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return raw, offs - offs[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
