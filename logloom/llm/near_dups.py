"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidates.

1. One pass over the texts gives each document its set size, a 128-bit hash of its whole
   shingle set, and BANDS band keys from a one-permutation sketch with optimal densification.
2. Equal sets collapse to their smallest doc_id, so groups of exact copies cost one row.
3. Each bucket names its smallest member as centre and links it to the others: a star has one
   edge a member, never all pairs. Edges are confirmed on full sets.
4. Members that their star left outside its main component are compared, in blocks, with the
   members they are not yet connected to. This is the exact way for what stars miss; blocks
   meet in one task two at a time and only confirmed links leave it.
5. Components by alternating large-star and small-star rounds over a checkpointed link table.

Two sets with a similarity of 0.8 share no bucket with probability (1 - 0.8^ROWS)^BANDS, 1e-7.

Defined cases: null or blank text has an empty set, n_shingles 0 and is its own component; a
text of fewer words than a shingle has one shingle, all its words; rows that share a doc_id
are one node, linked by any of their sets; a row without a doc_id
is linked with nothing and kept, but `drop_near_duplicates` judges each row, null doc_ids too;
very long texts are whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.shared import batches_of, mix64, packed, staged, table, text_buffer, unstage

ROWS, BANDS = 5, 40
BINS = ROWS * BANDS
THRESHOLD = 80  # per cent
#: Words of a shingle, by op8's contract.
WIDTH = 2
#: A centre meets at most about so many members in one task.
STAR_MEMBERS = 512
#: Members of an open family, and copies of one text, meet what they have in common in so many tasks.
SALTS = 8
#: Shingle bytes of a block in step 4.
BLOCK_BYTES = 1 << 20
SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"
SETS = "doc_id long, shingles binary"

_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_PRIME, _INVERSE = np.uint64(0x100000001B3), np.uint64(pow(0x100000001B3, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the batch (A-Z lower-cased), and each text's first word."""
    data, offsets = text_buffer(column)
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = _GAP[data]
    edge = np.zeros(len(data) + 2, np.int8)
    edge[1:-1] = ~gap[:-1]
    inside = edge[1:] - edge[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    word = ~gap[:-1]
    starts = np.flatnonzero(word & (cut[:-1] | (inside[:-1] == 1)))
    ends = np.flatnonzero(word & (cut[1:] | (inside[1:] == -1))) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data]] * powers(_PRIME, len(data)), out=total[1:])
        value = (total[ends] - total[starts]) * powers(_INVERSE, len(data) + 1)[starts]
        value = mix64(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return value, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of `width` words; a shorter text is one shingle."""
    words, first = word_hashes(column)
    runs = [words]  # hashes of 1, 2, ... width words from each word on
    with np.errstate(over="ignore"):
        for k in range(1, width):
            runs.append(mix64(runs[-1][:-1] * np.uint64(0x9FB21C651E98DF25) + words[k:]))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > width:
            s = np.sort(runs[-1][a : b - width + 1])
            yield s[np.append(True, s[1:] != s[:-1])]
        else:
            yield runs[b - a - 1][a : a + 1] if b > a else words[a:b]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """BINS minima of each non-empty set; an empty bin takes another's by its own fixed sequence."""
    edges = np.array([k * (1 << 64) // BINS for k in range(BINS + 1)][:BINS], np.uint64)
    out, full = np.zeros((len(sets), BINS), np.uint64), np.zeros((len(sets), BINS), bool)
    for k, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        full[k] = at < np.append(at[1:], len(s))
        out[k, full[k]] = s[at[full[k]]]
    base, (row, bin_) = out.copy(), np.nonzero(~full)
    turn = 0
    while len(row):
        turn += 1
        other = (mix64(bin_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)) % np.uint64(BINS)).astype(np.int64)
        got = full[row, other]
        out[row[got], bin_[got]] = base[row[got], other[got]]
        row, bin_ = row[~got], bin_[~got]
    return out


def sketch_rows(batches: Iterator[pa.RecordBatch], width: int = WIDTH) -> Iterator[pa.RecordBatch]:
    index = np.arange(BANDS, dtype=np.uint64)
    for b in (x for whole in batches for x in batches_of(whole, "text")):
        sets = list(shingle_sets(b.column("text"), width))
        some = [k for k, s in enumerate(sets) if len(s)]
        h, bands = np.zeros((len(sets), 2), np.uint64), [None] * len(sets)
        with np.errstate(over="ignore"):
            for k in some:
                h[k] = np.add.reduce(mix64(sets[k])), np.add.reduce(mix64(sets[k] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
            if some:
                values = sketches([sets[k] for k in some]).reshape(len(some), BANDS, ROWS)
                key = np.broadcast_to(index, values.shape[:2]).copy()
                for r in range(ROWS):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
                for k, row in zip(some, key.view(np.int64), strict=True):
                    bands[k] = row
        h = h.view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "h1", "h2", "bands"],
        )


def set_rows(batches: Iterator[pa.RecordBatch], width: int = WIDTH) -> Iterator[pa.RecordBatch]:
    for b in (x for whole in batches for x in batches_of(whole, "text")):
        sets = [s.tobytes() for s in shingle_sets(b.column("text"), width)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two sorted sets."""
    if 100 * min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    shared = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    return 100 * shared >= THRESHOLD * (len(a) + len(b) - shared)


def star_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (centre, salt, kind): the centre's sets come before its members' sets."""
    star, own = None, []
    for b in batches:
        out = []
        for centre, salt, kind, member, shingles in zip(*(b.column(c).to_pylist() for c in ("centre", "salt", "kind", "member", "shingles")), strict=True):
            s = np.frombuffer(shingles, np.uint64)
            if (centre, salt) != star:
                star, own = (centre, salt), []
            if kind == 0:
                own.append(s)
            elif any(alike(o, s) for o in own):
                out.append((centre, member))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])


def block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the members of two blocks that are in different components; gives the components to join."""
    for b in batches:
        out = set()
        for left, right in zip(b.column("left").to_pylist(), b.column("right").to_pylist(), strict=True):
            others = [(x["member"], x["component"], np.frombuffer(x["shingles"], np.uint64)) for x in right]
            sizes = np.array([len(s) for _, _, s in others])
            comps = np.array([c for _, c, _ in others])
            every, starts = np.concatenate([s for _, _, s in others]), np.append(0, np.cumsum(sizes)[:-1])
            for x in left:
                s = np.frombuffer(x["shingles"], np.uint64)
                at = np.minimum(np.searchsorted(s, every), len(s) - 1)
                shared = np.add.reduceat((s[at] == every).astype(np.int64), starts)
                for k in np.flatnonzero((100 * shared >= THRESHOLD * (len(s) + sizes - shared)) & (comps != x["component"])):
                    out.add((x["component"], others[k][1]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])


def is_settled(edges: DataFrame) -> bool:
    """Whether each node u of edges(u, v) has one smaller neighbour v, which has none itself: one job."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.agg(F.count_if(F.col("up") + F.when(F.col("up") > 0, F.col("down")).otherwise(0) > 1)).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in links(a, b) that are not their component's smallest.

    A round moves the larger neighbours of each node to its least neighbour (large star), then
    each node's smaller neighbours to their least (small star). A round is one written table
    and one small job, which looks whether only stars are left.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while not is_settled(edges):
        low = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        moved = edges.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        low = moved.groupBy("u").agg(F.min("v").alias("m"))
        small = moved.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, edges = edges, staged(small.filter("u <> v").distinct(), "links")
        unstage(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    sketch = staged(texts.mapInArrow(partial(sketch_rows, width=width), SKETCH), "sketch")
    key = ["h1", "h2", "n_shingles"]
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    reps = staged(sketch.filter(linkable).groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "set-reps")
    bands = reps.select(F.col("rep").alias("doc_id"), "n_shingles", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("_last")).filter("centre < _last").drop("_last")
    stars = staged(bands.join(buckets, "band").filter("doc_id <> centre").select("centre", F.col("doc_id").alias("member"), "n_shingles").distinct(), "stars")
    needed = stars.select(F.col("member").alias("doc_id")).union(stars.select("centre")).distinct()
    # the ids grow with the corpus, so they are never broadcast
    sets = texts.join(needed.hint("merge"), "doc_id", "left_semi").mapInArrow(partial(set_rows, width=width), SETS)
    sets = staged(sets.filter(F.length("shingles") > 0).distinct(), "sets")
    # only sets of sizes that can be alike meet, and a star of many members is dealt to as many tasks as it needs
    own = reps.groupBy(F.col("rep").alias("centre")).agg(F.min("n_shingles").alias("small"), F.max("n_shingles").alias("large"))
    fits = (100 * F.col("n_shingles") >= THRESHOLD * F.col("small")) & (100 * F.col("large") >= THRESHOLD * F.col("n_shingles"))
    pairs = stars.join(own, "centre").filter(fits).select("centre", "member").distinct()
    wide = pairs.groupBy("centre").agg(F.ceil(F.count("*") / STAR_MEMBERS).alias("parts")).filter("parts > 1")
    dealt = pairs.join(wide, "centre", "left").select("centre", "member", F.pmod(F.xxhash64("member"), F.coalesce("parts", F.lit(1))).alias("salt"))
    asked = dealt.select("centre", "salt", F.lit(1).alias("kind"), "member").unionByName(dealt.select("centre", "salt", F.lit(0).alias("kind"), F.col("centre").alias("member")).distinct())
    rows = asked.join(sets, F.col("member") == F.col("doc_id")).select("centre", "salt", "kind", "member", "shingles")
    rows = rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "kind")
    comp = components(rows.mapInArrow(star_links, "a long, b long"))
    again = missed_links(stars, sets, comp)
    if again is not None:
        merged = components(again).select(F.col("node").alias("component"), F.col("component").alias("over"))
        comp = comp.join(merged, "component", "left").select("node", F.coalesce("over", "component").alias("component")).unionByName(merged.select(F.col("component").alias("node"), F.col("over").alias("component")))
    unstage(stars, sets)
    named = reps.drop("bands").join(comp, F.col("rep") == F.col("node"), "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    out = sketch.filter(linkable).select("doc_id", *key).join(named, key).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(sketch.filter(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def missed_links(stars: DataFrame, sets: DataFrame, comp: DataFrame) -> DataFrame | None:
    """Links between components (a, b) that no star confirmed; None where no members are left apart.

    A centre has been compared with all its members, so only families whose members, without
    their centre, lie in several components are opened.
    """
    family = stars.join(comp, F.col("member") == F.col("node"), "left").select("centre", "member", "n_shingles", F.coalesce("component", "member").alias("component"))
    parts = family.groupBy("centre", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    open_ = parts.groupBy("centre").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"), F.ceil(8 * F.sum("size") / BLOCK_BYTES).alias("blocks"))
    open_ = open_.filter("parts > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    family = family.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int")).join(open_, ["centre", "salt"]).drop("salt")
    family = staged(family.withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks"))), "open-families")
    if not family.count():
        return None
    item = F.struct("member", "component", "shingles")
    # dealt by block, so that a large family is spread over tasks; a left block goes to each right one
    dealt = family.join(sets.withColumnRenamed("doc_id", "member"), "member")
    right = staged(dealt.groupBy("centre", "block", "blocks", "main").agg(F.collect_list(item).alias("right")), "blocks")
    apart = F.filter("right", lambda x: x["component"] != F.col("main")).alias("left")
    alone = right.filter("blocks = 1").select(apart, "right")
    left = right.filter("blocks > 1").select("centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), apart).filter(F.size("left") > 0)
    pairs = left.join(right.drop("blocks", "main"), ["centre", "block"]).select("left", "right")
    found = alone.mapInArrow(block_links, "a long, b long").unionByName(pairs.mapInArrow(block_links, "a long, b long"))
    found = staged(found.distinct(), "missed-links")
    unstage(family, right)
    return found


def drop_near_duplicates(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """One row of each group, with all its columns: that of the smallest doc_id, null being the last.

    A row's key is a hash of its doc_id and text, so rows that share a doc_id are members of a
    group each, and equal rows are copies of one member. Null and blank texts are no copies of
    each other and stay; an empty table gives no rows; columns may have any names.
    """
    rows = packed(docs, doc_id="doc_id", key=F.xxhash64("doc_id", "text", F.col("doc_id").isNull(), F.col("text").isNull()), text="text")
    groups = near_duplicates(rows.select(F.col("key").alias("doc_id"), "text"), width=width).select(F.col("doc_id").alias("key"), "component_id").distinct()
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    kept = rows.select("key", rank.alias("rank")).join(groups, "key").groupBy("component_id").agg(F.min("rank")["key"].alias("key"))
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row")))
    return rows.join(kept.select("key"), "key", "left_semi").withColumn("copy", first).filter("copy = 1").select("row.*")


def op8_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Exact pairs by joining shingles, then all that each document reaches.
OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) > 1 THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) ELSE words END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.y FROM r JOIN b ON r.seen = b.x)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(seen) AS component_id, doc_id = min(seen) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
