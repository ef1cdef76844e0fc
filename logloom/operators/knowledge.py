"""Knowledge-base ingest: content-hash dedup, token estimates and Markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_hash(docs: DataFrame) -> DataFrame:
    """The first document of each (source, content hash)."""
    d = docs.select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return d.groupBy("source", "content_hash").agg(F.min("doc_id").alias("doc_id"))


def knowledge_stats(docs: DataFrame) -> DataFrame:
    """Documents and estimated tokens, (code points + 3) / 4, by source."""
    tokens = F.floor((F.length(F.coalesce("text", F.lit(""))) + 3) / 4)
    return docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum(tokens).alias("tokens"))


def rows_to_markdown(tables: DataFrame) -> DataFrame:
    """(id, markdown) of tables(id, rows array<array<string>>): the first row heads the table.

    Short rows are filled up, | is escaped and a line break becomes a blank. Tables of fewer
    than two rows, or without any cell, give null.
    """
    width = F.coalesce(F.array_max(F.transform("rows", F.size)), F.lit(0))
    escaped = lambda cell: F.replace(F.replace(F.coalesce(cell, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    full = lambda row: F.concat(F.transform(row, escaped), F.array_repeat(F.lit(""), F.col("width") - F.size(row)))
    line = lambda row: F.concat(F.lit("| "), F.array_join(full(row), " | "), F.lit(" |\n"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width")), F.lit("\n"))
    text = F.array_join(F.transform("rows", lambda row, i: F.when(i == 0, F.concat(line(row), rule)).otherwise(line(row))), "")
    return tables.withColumn("width", width).select("id", F.when((F.size("rows") > 1) & (F.col("width") > 0), text).alias("markdown"))
