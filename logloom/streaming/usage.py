"""Token usage of streamed answers, from their server-sent events; chunks framed to whole lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ["prompt_tokens", "completion_tokens", "total_tokens"]
SCHEMA = "usage struct<" + ", ".join(f"{f}: bigint" for f in FIELDS) + ">"


def framed(chunks: DataFrame) -> DataFrame:
    """chunks(stream_id, offset, data binary) as whole lines: a line belongs to the chunk that ends it.

    What no line break ends is a last row of its stream. Each chunk knows by a running count which
    line it continues; only the pieces of one line are gathered. Offsets are doubled, to make room
    for the last rows. Chunks without data, and rows without a stream_id, give nothing.
    """
    s, n = F.col("s"), F.col("n")
    rows = chunks.filter("stream_id IS NOT NULL AND data IS NOT NULL").select("stream_id", "offset", F.decode("data", "ISO-8859-1").alias("s"))  # a character a byte
    before = Window.partitionBy("stream_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n", F.coalesce(F.count_if(F.contains(s, F.lit("\n"))).over(before), F.lit(0)))
    ends = F.contains(s, F.lit("\n"))
    first = F.when(ends, F.substring_index(s, "\n", 1)).otherwise(s)
    rest = F.substring_index(s, "\n", -1)
    middle = F.when(ends, F.substring(s, F.length(first) + 1, F.length(s) - F.length(first) - F.length(rest)))
    piece = lambda line, at, text, more: F.struct(line.alias("line"), at.alias("offset"), text.alias("text"), more.alias("more"))
    none = F.lit(None).cast("string")
    pieces = F.array_compact(F.array(piece(n, F.col("offset"), first, middle), F.when(ends, piece(n + 1, F.col("offset"), rest, none))))
    lines = rows.select("stream_id", F.explode(pieces).alias("p")).groupBy("stream_id", "p.line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p.offset", "p.text"))), lambda p: p["text"]), "").alias("text"), F.max("p.more").alias("more"), F.max("p.offset").alias("offset")
    )
    text = F.make_valid_utf8(F.encode(F.concat("text", F.coalesce("more", F.lit(""))), "ISO-8859-1").cast("string"))
    whole = F.col("more").isNotNull()
    return lines.filter(whole | (F.col("text") != "")).select("stream_id", (2 * F.col("offset") + F.when(whole, 0).otherwise(1)).alias("offset"), text.alias("data"))


def usage_of_streams(chunks: DataFrame) -> DataFrame:
    """(stream_id, prompt_tokens, completion_tokens, total_tokens) of chunks(stream_id, offset, data).

    A chunk gives its first usage with a positive count, a stream its last chunk's; streams
    without any have zeros. Lines that are no data lines or no JSON are passed over. A chunk is
    whole lines, as framed() makes them. The aggregate keeps one usage a stream in each task before the shuffle, and
    holds as a streaming aggregate too.
    """
    body = lambda line: F.regexp_replace(F.trim(line), r"^(data:)+\s*", "")
    data = F.filter(F.split("data", "\r?\n"), lambda line: F.trim(line).startswith("data:"))
    found = F.transform(data, lambda line: F.from_json(body(line), SCHEMA)["usage"])
    given = F.filter(found, lambda u: F.greatest(*[F.coalesce(u[f], F.lit(0)) for f in FIELDS]) > 0)
    first = chunks.select("stream_id", "offset", F.get(given, 0).alias("u"))
    last = first.groupBy("stream_id").agg(F.max_by("u", F.when(F.col("u").isNotNull(), F.col("offset"))).alias("u"))
    return last.select("stream_id", *[F.coalesce(F.col("u")[f], F.lit(0)).alias(f) for f in FIELDS])
