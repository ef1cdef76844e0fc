"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source's words form, in every hash shard, a seeded stream that is cut into blocks of
nearly equal length. Highest quotients (weight / (2k + 1)) give each source an integer number
of blocks, and again each shard of the source its share; seeded ranks then choose the blocks,
each at most `MAX_REPEATS` times. All of it is DataFrame functions.

Defined cases: a null or blank text has size 0 and takes 0; a null source is the last source;
an empty table gives an empty result; repeated rows have their own places in the stream; ties
of quotients go by source and shard, ties in the stream by doc_id. The source table (one row
a source) is the only thing sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.shared import SPACE, packed, staged, table

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2
SEED = 20240
#: Documents to a shard, and the most shards, so that (source, shard) tables stay small.
SHARD_DOCS, MAX_SHARDS = 1024, 65_536
#: Blocks that the corpus is cut into where block lengths allow; and those lengths in words.
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 20_000, 16, 1024


def source_targets(sources: DataFrame) -> DataFrame:
    """Adds weight and target to (source, source_size): water filling under the caps."""
    every = Window.partitionBy()
    s = sources.withColumn("_m_rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_m_rank") - 1) % len(WEIGHTS) + 1))
    s = s.withColumn("_m_cap", F.lit(float(MAX_REPEATS)) * F.col("source_size")).withColumn("_m_ratio", F.col("_m_cap") / F.col("weight"))
    before = Window.orderBy("_m_ratio", "_m_rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_m_full", F.coalesce(F.sum("_m_cap").over(before), F.lit(0.0))).withColumn("_m_used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("_m_level", (TOTAL_SHARE * F.sum("source_size").over(every) - F.col("_m_full")) / (F.sum("weight").over(every) - F.col("_m_used")))
    s = s.withColumn("_m_level", F.min(F.when(F.col("_m_level") <= F.col("_m_ratio"), F.struct("_m_ratio", "_m_rank", "_m_level"))).over(every)["_m_level"])
    target = F.least(F.col("_m_cap"), F.coalesce(F.col("_m_level") * F.col("weight"), F.col("_m_cap")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def sainte_lague(df: DataFrame, group: list[str], key: list[str], weight: str, total: str, cap: str, out: str) -> DataFrame:
    """Integer seats by highest quotients within each group, none above its cap.

    Seat k of a key stands at x = (2k + 1) / weight, and the lowest x win. Up to x a key has
    least(cap, weight * x / 2) seats but for half a seat. The sum of that over n keys is concave,
    the least of n lines, so the level where it reaches a number of seats is the greatest over
    the lines. Levels for n / 2 seats fewer and more than the total enclose the last seat: those
    below the first win, and only those between them, some 2n in all, are ranked.
    """
    w = Window.partitionBy(*group)
    live = F.coalesce((F.col(weight) > 0) & (F.col(cap) > 0), F.lit(False))
    d = df.withColumn("_w", F.when(live, F.col(weight)).otherwise(0.0)).withColumn("_c", F.when(live, F.col(cap)).otherwise(0).cast("long"))
    d = d.withColumn("_live", live).withColumn("_n", F.sum(F.col("_live").cast("int")).over(w))
    late = w.orderBy(F.desc_nulls_last(F.when(F.col("_live"), F.col("_c") / F.col("_w"))), *key).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_open", F.sum("_w").over(late)).withColumn("_full", F.sum("_c").over(w) - F.sum("_c").over(late))

    def seats_at(more: F.Column) -> F.Column:
        level = F.max(F.when(F.col("_live"), 2 * (F.col(total) + more - F.col("_full")) / F.col("_open"))).over(w)
        return F.greatest(F.lit(0.0), F.least(F.col("_c").cast("double"), F.floor((F.col("_w") * level + 1) / 2).cast("double")))

    around = F.col("_n") / 2 + 2
    d = d.withColumn("_low", F.coalesce(seats_at(-around), F.lit(0)).cast("long")).withColumn("_high", F.coalesce(seats_at(around), F.lit(0)).cast("long"))
    d = d.withColumn("_rest", F.col(total) - F.sum("_low").over(w))
    seats = d.withColumn("_k", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1))))
    seats = seats.withColumn("_q", F.col(weight) / (2 * F.col("_k") + 1))
    best = F.row_number().over(w.orderBy(F.desc_nulls_last("_q"), *[F.asc_nulls_last(c) for c in key], "_k"))
    won = F.col("_k").isNotNull() & (best <= F.col("_rest"))
    seats = seats.withColumn("_won", won.cast("long"))
    return seats.groupBy(*df.columns).agg((F.first("_low") + F.sum("_won")).alias(out))


def placed_words(docs: DataFrame, *keep: str, seed: int = SEED) -> DataFrame:
    """A row for each document and block: its words _from to _to lie in block _j, which is given _copies times.

    A document without words has one row, with no block. Columns of `keep` settle ties in the stream.
    """
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")
    sizes = staged(docs.select(*keep, "doc_id", "source", words.alias("size")), "mix-sizes")
    n_docs, n_words = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = max(1, min(MAX_SHARDS, -(-n_docs // SHARD_DOCS)))
    block = max(LEAST_BLOCK, min(MOST_BLOCK, n_words // BLOCKS))
    sizes = sizes.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(shards)).cast("int"))
    parts = sizes.groupBy("source", "shard").agg(F.sum("size").alias("part_size"))
    parts = staged(parts.withColumn("blocks", F.when(F.col("part_size") > 0, F.greatest(F.lit(1), F.round(F.col("part_size") / block))).otherwise(0).cast("long")), "mix-parts")
    sources = source_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")))
    counts = parts.groupBy(F.col("source").alias("_m_source")).agg(F.sum("blocks").alias("_m_blocks"))
    sources = sources.join(counts, F.col("source").eqNullSafe(F.col("_m_source"))).drop("_m_source")
    sources = sources.withColumn("_m_want", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("_m_blocks")).otherwise(0.0))
    sources = sources.withColumn("_m_total", F.round(F.sum("_m_want").over(Window.partitionBy())).cast("long")).withColumn("_m_cap", MAX_REPEATS * F.col("_m_blocks"))
    sources = staged(sainte_lague(sources, [], ["source"], "_m_want", "_m_total", "_m_cap", "quota").select("source", "source_size", "target", "quota"), "mix-sources")
    named = sources.withColumnRenamed("source", "_m_source")
    parts = parts.join(named, F.col("source").eqNullSafe(F.col("_m_source"))).drop("_m_source")
    parts = parts.withColumn("_m_cap", MAX_REPEATS * F.col("blocks")).withColumn("_m_weight", F.col("blocks").cast("double"))
    parts = sainte_lague(parts, ["source"], ["shard"], "_m_weight", "quota", "_m_cap", "part_quota")
    parts = parts.select(F.col("source").alias("_p_source"), F.col("shard").alias("_p_shard"), "part_size", "blocks", "source_size", "target", "part_quota")
    rows = sizes.join(parts, F.col("source").eqNullSafe(F.col("_p_source")) & (F.col("shard") == F.col("_p_shard"))).drop("_p_source", "_p_shard")
    w = Window.partitionBy("source", "shard")
    rows = rows.withColumn("_end", F.sum("size").over(w.orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_at", F.col("_end") - F.col("size"))
    block_of = lambda word: F.expr(f"(({word} + 1) * blocks - 1) div part_size")
    rows = rows.withColumn("_j", F.explode_outer(F.when(F.col("size") > 0, F.sequence(block_of("_at"), block_of("_end - 1")))))
    edge = lambda j: F.expr(f"(({j}) * part_size) div blocks")
    rows = rows.withColumn("_from", F.when(F.col("_j").isNull(), 0).otherwise(F.greatest("_at", edge("_j")) - F.col("_at")))
    rows = rows.withColumn("_to", F.when(F.col("_j").isNull(), 0).otherwise(F.least("_end", edge("_j + 1")) - F.col("_at")))
    rank = F.dense_rank().over(w.orderBy(F.asc_nulls_last(F.when(F.col("_j").isNotNull(), F.xxhash64(F.lit(seed + 2), "source", "shard", "_j"))), "_j"))
    copies = F.expr("part_quota div blocks") + F.when(F.col("_rank") <= F.expr("part_quota % blocks"), 1).otherwise(0)
    return rows.withColumn("_rank", rank).withColumn("_copies", F.when(F.col("_to") > F.col("_from"), copies).otherwise(0))


def mix_sources(docs: DataFrame, *, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and the words taken of each document."""
    rows = placed_words(docs, seed=seed).withColumn("_taken", (F.col("_to") - F.col("_from")) * F.col("_copies"))
    taken = rows.groupBy("source", "shard", "doc_id", "_at", "_end", "size", "source_size", "target", F.when(F.col("size") == 0, F.monotonically_increasing_id()).alias("_zero"))
    return taken.agg(F.sum("_taken").alias("taken")).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, *, seed: int = SEED) -> DataFrame:
    """The mix itself: for each copy, a row for each unbroken range of the document's chosen words.

    A range holds the original text from its first word up to the next range's; white space
    goes with the word before it, and at the start of a text with the first word. A document of
    which nothing is taken goes. Rows are told apart by an internal key, written once, so null
    and shared doc_ids each have their own ranges.
    """
    rest = [c for c in docs.columns if c.lower() not in ("doc_id", "text", "source")]
    rows = packed(docs, doc_id="doc_id", text="text", source="source").withColumn("_x_row", F.monotonically_increasing_id())
    keyed = staged(rows.select("_x_row", "doc_id", "text", "source", F.struct(F.lit(0).alias("_x_none"), *[F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(rest)]).alias("_x_rest")), "mix-rows")
    rows = placed_words(keyed, "_x_row", seed=seed).filter("_copies > 0")
    rows = rows.select("_x_row", "size", "_from", "_to", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy"))
    w = Window.partitionBy("_x_row").orderBy("_copy", "_from")
    joined = (F.lag("_copy").over(w) == F.col("_copy")) & (F.lag("_to").over(w) == F.col("_from"))
    rows = rows.withColumn("_new", F.when(joined, 0).otherwise(1)).withColumn("_range", F.sum("_new").over(w))
    ranges = rows.groupBy("_x_row", "_range").agg(F.min("_from").alias("first"), F.max("_to").alias("end"), F.max("size").alias("size"))
    ranges = ranges.withColumn("whole", F.col("end") - F.col("first") == F.col("size"))
    ranges = ranges.groupBy("_x_row").agg(F.collect_list(F.struct("first", "end", "whole")).alias("_x_ranges"), F.min("whole").alias("_x_whole"))
    words = F.regexp_extract_all("text", F.lit(rf"(?:\A[{SPACE}]+)?[^{SPACE}]+[{SPACE}]*"), F.lit(0))
    # texts are cut into words below the explode, once a document
    rows = keyed.join(ranges, "_x_row").withColumn("_x_words", F.when(~F.col("_x_whole"), words)).withColumn("_x", F.explode("_x_ranges"))
    part = F.slice("_x_words", (F.col("_x.first") + 1).cast("int"), (F.col("_x.end") - F.col("_x.first")).cast("int"))
    given = {c.lower(): F.col(c) for c in ("doc_id", "source")} | {"text": F.when(F.col("_x.whole"), F.col("text")).otherwise(F.array_join(part, ""))}
    return rows.select(*[given.get(c.lower(), F.col(f"_x_rest.c{rest.index(c)}") if c in rest else None).alias(c) for c in docs.columns])


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
