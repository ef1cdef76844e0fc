"""URL rules: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A blocked Bloom filter (one 512-bit block and eight bits a key) holds three keys for each listed
url: its host, its host with the length of its path, its host with its path. A url's host
suffixes at label borders are asked first, then the listed lengths under those that may be
listed, then the prefixes of the lengths left, whose hashes are differences of running sums over
the path, so that no prefix is built. Hits meet the rules in an exact hash join, which compares
host and path and so removes false positives; the longest matching rule decides. Urls without a
hit are in no shuffle. Executors build parts of the filter, which are combined by bit_or block by
block; rules never go to the driver.

Defined cases: a null url or one without "://" has empty host and path and no rule; a rule
matches its host, all subdomains, and paths that start with its path; of several the longest
wins (host plus path, then the longer host), whatever its length; a null rule matches nothing; a
rule's host is read with A-Z lower-cased; of two verdicts of one rule the greater word counts (block
before allow); a url without a rule gets `DEFAULT`; repeated rows are judged each alone; an empty table gives no
rows, and an empty list no rules; extra columns are ignored.
The filter is broadcast, so its size is fixed: beyond `MAX_FILTER_BYTES` keys share its bits, and
more false positives meet the exact join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.shared import batches_of, mix64, staged, table, text_buffer

DEFAULT = "allow"
MAX_FILTER_BYTES = 64 << 20
BITS_PER_KEY = 16
#: Kinds of keys in the filter.
HOST, LENGTH, PATH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
BASE = np.uint64(0xF1357AEA2E62A9C5)
#: (host suffix, length) pairs that one vectorised step asks at once.
PAIRS = 1 << 18
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def split_url(url: str) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path."""
    there = F.coalesce(F.instr(F.col(url), "://") > 0, F.lit(False))
    rest = F.expr(f"substring({url}, instr({url}, '://') + 3)")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def joint(host: np.ndarray, kind: np.uint64, part: np.ndarray | int = 0) -> np.ndarray:
    """A filter key: a host's hash with what else it is asked for."""
    return mix64(mix64(host ^ kind) ^ np.asarray(part).astype(np.uint64))


def running_sums(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of bytes times powers of their place, which start again with each text."""
    lengths = np.diff(offsets)
    powers = np.multiply.accumulate(np.full(int(lengths.max(initial=0)) + 1, BASE))
    place = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    return np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[place], dtype=np.uint64))


def path_keys(hosts: np.ndarray, sums: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Keys of hosts with the first `lengths` bytes of the paths from `starts`."""
    return joint(hosts, PATH, mix64(sums[starts + lengths] - sums[starts]) ^ lengths.astype(np.uint64))


def rule_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the three keys of each rule."""
    for b in (x for whole in batches for x in batches_of(whole, "_rule_path")):
        data, offsets = text_buffer(b.column("_rule_path"))
        hosts, lengths = b.column("_host_hash").to_numpy().view(np.uint64), np.diff(offsets)
        keys = [joint(hosts, HOST), joint(hosts, LENGTH, lengths), path_keys(hosts, running_sums(data, offsets), offsets[:-1], lengths)]
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(k.view(np.int64)) for k in keys)], names=[*b.schema.names, "_k_host", "_k_length", "_k_path"])


class BlockedBloom:
    """Keys set eight bits within one block of eight 64-bit words."""

    def __init__(self, blocks: int):
        self.words = np.zeros((blocks, 8), np.uint64)

    def _place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = (h >> np.uint64(32)) % np.uint64(len(self.words))
        bits = mix64(h)[:, None] >> (np.arange(8, dtype=np.uint64) * np.uint64(6)) & np.uint64(63)
        return block.astype(np.int64), np.uint64(1) << bits

    def add(self, h: np.ndarray) -> None:
        block, bits = self._place(h)
        np.bitwise_or.at(self.words, (block[:, None], np.arange(8)), bits)

    def might_hold(self, h: np.ndarray) -> np.ndarray:
        block, bits = self._place(h)
        return ((self.words[block] & bits) == bits).all(axis=1)


def bloom_of(keys: DataFrame) -> BlockedBloom:
    """The filter of keys(h), their 64-bit hashes: partial filters by task, combined block by block."""
    blocks = max(1, min(-(-keys.count() * BITS_PER_KEY // 512), MAX_FILTER_BYTES // 64))
    names = [f"w{k}" for k in range(8)]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = BlockedBloom(blocks)
        for b in batches:
            part.add(b.column("h").to_numpy().view(np.uint64))
        some = np.flatnonzero(part.words.any(axis=1))
        for at in np.array_split(some, -(-len(some) // 65_536)) if len(some) else []:
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(part.words[at, k].view(np.int64)) for k in range(8))], names=["block", *names])

    rows = keys.mapInArrow(parts, "block long, " + ", ".join(f"{n} long" for n in names))
    table = rows.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in names]).toArrow()  # at most MAX_FILTER_BYTES of words
    bloom = BlockedBloom(blocks)
    if table.num_rows:
        bloom.words[table.column("block").to_numpy()] = np.stack([table.column(n).to_numpy().view(np.uint64) for n in names], axis=1)
    return bloom


def possible_rules(b: pa.RecordBatch, bloom: BlockedBloom, listed: np.ndarray) -> pa.Array:
    """For each row the path keys of rules that may fit; `listed` are the lengths of rule paths in bytes."""
    data, offsets = text_buffer(b.column("_path"))
    sums, held = running_sums(data, offsets), b.column("_hashes")
    row = np.repeat(np.arange(b.num_rows), np.diff(held.offsets.to_numpy()))
    hosts = held.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    some = bloom.might_hold(joint(hosts, HOST))
    row, hosts = row[some], hosts[some]
    fits = np.searchsorted(listed, np.diff(offsets)[row], side="right")
    ends = np.cumsum(fits)
    rows, keys, first = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while first < len(row):
        before = ends[first] - fits[first]
        last = max(first + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        pair = np.repeat(np.arange(first, last), fits[first:last])
        length = listed[np.arange(len(pair)) - (ends - fits)[pair] + before]
        may = bloom.might_hold(joint(hosts[pair], LENGTH, length))
        pair, length = pair[may], length[may]
        key = path_keys(hosts[pair], sums, offsets[row[pair]], length)
        may = bloom.might_hold(key)
        rows.append(row[pair[may]])
        keys.append(key[may])
        first = last
    counts = np.bincount(np.concatenate(rows), minlength=b.num_rows)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_column: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """Judges each row's url by rules(rule, verdict): id, host, path, rule, verdict."""
    spark = pages.sparkSession
    host_of = F.translate(F.regexp_extract("rule", r"^[^/]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    listed = rules.filter(F.col("rule").isNotNull()).select("rule", F.col("verdict").alias("_rule_verdict"), host_of.alias("_rule_host"), F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1).alias("_rule_path"))
    shape = listed.agg(F.collect_set(F.octet_length("_rule_path")), F.max(F.size(F.split("_rule_host", "[.]")))).first()  # lengths, not paths
    lengths, labels = np.array(sorted(shape[0]), np.int64), shape[1] or 0
    listed = listed.withColumn("_host_hash", F.xxhash64("_rule_host"))
    listed = listed.mapInArrow(rule_keys, "rule string, _rule_verdict string, _rule_host string, _rule_path string, _host_hash long, _k_host long, _k_length long, _k_path long")
    held = spark.sparkContext.broadcast(bloom_of(listed.select(F.explode(F.array("_k_host", "_k_length", "_k_path")).alias("h")).distinct()))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in batches_of(whole, "_path")):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_id", "_host", "_path")), possible_rules(b, held.value, lengths)], names=["_id", "_host", "_path", "_keys"])

    host, path = split_url("_url")
    rows = pages.select(F.col(id_column).alias("_id"), F.col("url").alias("_url")).select("_id", host.alias("_host"), path.alias("_path"))
    kind = dict(rows.dtypes)["_id"]
    parts = F.split("_host", "[.]")
    starts = F.sequence(F.greatest(F.lit(1), F.size(parts) - labels + 1), F.size(parts))  # no rule has more labels
    suffixes = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    rows = rows.withColumn("_hashes", suffixes if labels else F.array().cast("array<long>"))
    rows = rows.mapInArrow(hits, f"_id {kind}, _host string, _path string, _keys array<long>").withColumn("_row", F.monotonically_increasing_id())
    rows = staged(rows, "url-hits")
    given = [F.col("_id").alias(id_column), F.col("_host").alias("host"), F.col("_path").alias("path")]
    rest = rows.filter(F.size("_keys") == 0).select(*given, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    some = rows.filter(F.size("_keys") > 0).withColumn("_key", F.explode("_keys")).drop("_keys")
    same_host = (F.col("_host") == F.col("_rule_host")) | F.endswith("_host", F.concat(F.lit("."), "_rule_host"))
    judged = some.join(listed, (F.col("_key") == F.col("_k_path")) & same_host & F.startswith("_path", F.col("_rule_path")), "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), F.length("_rule_host").alias("host"), "rule", F.col("_rule_verdict").alias("v"))))
    judged = judged.groupBy("_row", "_id", "_host", "_path").agg(best.alias("b"))
    return judged.select(*given, F.col("b.rule").alias("rule"), F.coalesce("b.v", F.lit(default)).alias("verdict")).unionByName(rest)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


OP1_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(rhost, rpath, rule, verdict) AS (VALUES
  ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'),
  ('www.example.com', '/en/', 'www.example.com/en/', 'allow'), ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')),
m AS (
  SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
