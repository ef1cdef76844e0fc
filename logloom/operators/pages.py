"""Tables laid out in the order of a listing, so that a page far down reads the few files it lies in.

`lay_out` sorts a table by range into files and writes beside them an index: each file's rows, first and
last key. A page by offset finds its files by running counts, a page behind a key by its bounds; only
those files are read, where sorting before an offset would read all rows. The index has a row a file.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Order = list[tuple[str, bool]]  # column and whether it descends


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; in a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="logloom-pages-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ordering(order: Order) -> list[Column]:
    return [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in order]


def lay_out(table: DataFrame, path: str, order: Order, *, files: int) -> None:
    """Writes the table in the order to about `files` files, and their index."""
    spark = table.sparkSession
    keys = ordering(order)
    table.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/rows")
    key = F.struct(*[c for c, _ in order])
    written = spark.read.parquet(f"{path}/rows").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), key.alias("key"), F.col("_metadata.row_index").alias("place"))
    index = written.groupBy("file", "name").agg(F.count("*").alias("n"), F.min_by("key", "place").alias("first"), F.max_by("key", "place").alias("last"))
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/index")  # part names follow the ranges


def index_of(spark: SparkSession, path: str) -> list:
    return spark.read.parquet(f"{path}/index").orderBy("name").collect()


def _read(spark: SparkSession, path: str, files: list[str], order: Order) -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows")
    return (spark.read.schema(rows.schema).parquet(*files) if files else rows.limit(0)).orderBy(*ordering(order))


def page(spark: SparkSession, path: str, order: Order, *, number: int, size: int) -> DataFrame:
    """Page `number`, from 1, of `size` rows: what offset and limit give over the whole order."""
    first, before, files, skipped = (number - 1) * size, 0, [], 0
    for f in index_of(spark, path):
        if before + f["n"] > first and before < first + size:
            files.append(f["file"])
        elif before + f["n"] <= first:
            skipped += f["n"]
        before += f["n"]
    return _read(spark, path, files, order).offset(first - skipped).limit(size)


def page_behind(spark: SparkSession, path: str, order: Order, key: tuple, *, size: int) -> DataFrame:
    """The `size` rows that follow the row of `key`, however far down it is; keys without nulls."""
    left, files = size, []
    behind = lambda other: next((x > y) != down for x, y, (_, down) in zip(other, key, order, strict=True) if x != y) if tuple(other) != key else False
    for f in index_of(spark, path):
        if left > 0 and behind(f["last"]):
            files.append(f["file"])
            left -= f["n"] if behind(f["first"]) else 0  # of the file that the key lies in, some may come before
    after, same = F.lit(False), F.lit(True)
    for (c, down), value in zip(order, key, strict=True):
        after = after | same & (F.col(c) < F.lit(value) if down else F.col(c) > F.lit(value))
        same = same & (F.col(c) == F.lit(value))
    return _read(spark, path, files, order).filter(after).limit(size)
