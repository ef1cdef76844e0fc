"""Exact removal of repeated 100-byte strings with sharded suffix arrays.

A byte goes if it lies in a MATCH-byte string that also starts earlier in the corpus (smaller
doc_id, or the same document further left), judged on the input.

1. Each window of MATCH bytes has a landmark: the least hash of its GRAM-byte strings. Equal
   windows have equal landmarks, and neighbouring windows mostly share one, so a document is
   a short list of stretches (landmark, first window, last window).
2. Exact copies of a document are set aside by their hash; the first stands for all.
3. Landmarks that only one stretch has cannot repeat. The others' stretches, with their bytes,
   are dealt by landmark, so all equal windows meet in one shard.
4. A shard sorts its blocks of text: Larsson-Sadakane prefix doubling in numpy refines only
   groups that are still tied, Kasai's rule (a suffix loses one byte of common prefix to its
   left neighbour at most) gives common prefixes, and runs of MATCH or more are repeats; the
   first keeps its bytes. A landmark with more text than a block is merged over its blocks by
   binary search among the sorted windows of earlier blocks.
5. A landmark with more than HOT places is dealt to several shards by its stretches' bytes.
   Each removes its own repeats and gives its distinct windows with their first places. Binary
   search among splitters, drawn from all shards' windows, deals them to ranges, in which a
   window's places lie side by side; all but the least go too.
6. Spans go back to their documents, merge, and are cut out.

Defined cases: null text is empty; matches never cross documents; a document under MATCH bytes
is kept; a null doc_id counts as the largest; equal rows (one doc_id, one text) are one document,
so neither is a copy of the other; rows that share a doc_id alone are documents of their own, in
the order of a hash of their texts; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.near_dups import _BYTE, _INVERSE, _PRIME, SALTS, powers
from logloom.llm.shared import batches_of, mix64, packed, staged, table, text_buffer, unstage

MATCH = 100
GRAM = 20
#: Bytes of a suffix array; three such indices fit in one 64-bit sort key.
BLOCK = 3 << 19
HOT = 16_384  # of one landmark's windows a shard holds about 40 for each place: 65 MB
#: The place of a null doc_id.
LAST = (1 << 63) - 1
#: Contexts of one landmark that a shard knows by heart.
REMEMBERED = 4096
#: Kinds of spans: bytes that go; a start whose window goes; a shard's first place of a window.
GONE, START, FIRST = 0, 1, 2
SPANS = "doc_id long, version long, first long, end long, kind int, window binary"
STRETCHES = "doc_id long, version long, n_bytes long, h1 long, h2 long, mark array<long>, lo array<int>, hi array<int>, places array<int>"


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each string of `size` bytes."""
    if len(data) < size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_PRIME, len(data)), out=total[1:])
        return mix64((total[size:] - total[:-size]) * powers(_INVERSE, len(data) - size + 1))


def landmarks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least gram hash of each window, by doubling, and whether the window starts with it."""
    m, width, want = rolling(data, GRAM), 1, MATCH - GRAM + 1
    grams = m
    while 2 * width <= want:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = want - width
    m = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
    return m, grams[: len(m)] == m


def stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in (x for whole in batches for x in batches_of(whole, "text")):
        data, offsets = text_buffer(b.column("text"))
        least, leaves = landmarks(data) if len(data) >= MATCH else (np.empty(0, np.uint64), np.empty(0, bool))
        inside = np.zeros(len(least) + 1, np.int32)
        first, end = offsets[:-1], np.maximum(offsets[1:] - MATCH + 1, offsets[:-1])  # windows of each document
        has = end > first
        np.add.at(inside, first[has], 1)
        np.add.at(inside, end[has], -1)
        inside = np.cumsum(inside[:-1]) > 0
        new = inside.copy()
        new[1:] &= least[1:] != least[:-1]
        new[first[has]] = True
        starts = np.flatnonzero(new)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        cut = np.searchsorted(starts, offsets).astype(np.int32)
        lo = (starts - offsets[doc]).astype(np.int32)
        hi = np.append(lo[1:], 0).astype(np.int32) - 1
        last = cut[1:][np.diff(cut) > 0] - 1
        hi[last] = (end - first - 1)[has]
        left = np.append(0, np.cumsum(leaves))  # a stretch of periodic text has its landmark at several places
        places = (1 + left[starts + hi - lo] - left[starts]).astype(np.int32)
        raw = data.tobytes()
        hashes = [xxhash.xxh3_128_intdigest(raw[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        half = lambda s: np.array([x >> s & (1 << 64) - 1 for x in hashes], np.uint64).view(np.int64)
        lists = lambda v: pa.ListArray.from_arrays(pa.array(cut), pa.array(v))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("version"), pa.array(np.diff(offsets)), pa.array(half(0)), pa.array(half(64)), lists(least[starts].view(np.int64)), lists(lo), lists(hi), lists(places)],
            names=["doc_id", "version", "n_bytes", "h1", "h2", "mark", "lo", "hi", "places"],
        )


CONTEXTS = "mark long, doc_id long, version long, lo int, context binary, parts long"


def context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes under each listed stretch."""
    for b in (x for whole in batches for x in batches_of(whole, "text")):
        data, offsets = text_buffer(b.column("text"))
        raw, rows = data.tobytes(), []
        for doc, version, at, some in zip(b.column("doc_id").to_pylist(), b.column("version").to_pylist(), offsets[:-1].tolist(), b.column("stretches").to_pylist(), strict=True):
            rows += [(s["mark"], doc, version, s["lo"], raw[at + s["lo"] : at + s["hi"] + MATCH], s["parts"]) for s in some]
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in CONTEXTS.split(", ")])


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first `depth` bytes or more; the end sorts before any byte."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data.astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)  # seven bytes of nine bits
    for k in range(7):
        key = key << np.uint64(9) | padded[k : k + n]
    sa = np.argsort(key, kind="stable").astype(np.int64)
    ordered = key[sa]
    head = np.append(True, ordered[1:] != ordered[:-1])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    bits, h = np.uint64(max(1, (n + 1).bit_length())), 7
    low = np.uint64((1 << int(bits)) - 1)
    while h < depth:
        tied = ~(head & np.append(head[1:], True))  # slots whose group has several members
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        at = sa[slots]
        second = rank[np.minimum(at + h, n)] + 1
        if 3 * int(bits) <= 64:
            key = (rank[at].astype(np.uint64) << bits | second.astype(np.uint64)) << bits | at.astype(np.uint64)
            key.sort()
            sa[slots] = (key & low).astype(np.int64)
            pair = key >> bits
            split = np.append(True, pair[1:] != pair[:-1])
        else:  # one very long text
            order = np.lexsort((second, rank[at]))
            sa[slots], one, two = at[order], rank[at][order], second[order]
            split = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
        head[slots] = split
        rank[sa[slots]] = slots[np.maximum.accumulate(np.where(split, np.arange(len(slots)), 0))]
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Kasai: common prefix of each suffix with the one before it in sa, in sa's order.

    Where the preceding suffix's predecessor is one to the left and shares its first byte, the
    value is one less than the left neighbour's; only the other positions are compared, eight
    bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    fresh = np.append(True, before[1:] != before[:-1] + 1) | (before < 0)
    fresh[1:] |= (before[:-1] < 0) | (data[:-1] != data[before[:-1]])
    words = np.zeros(n + 8, np.uint64)
    for k in range(8):
        words[:n] |= np.append(data[k:], np.zeros(min(k, n), np.uint8))[:n].astype(np.uint64) << np.uint64(8 * k)
    at = np.flatnonzero(fresh & (before >= 0))
    other, length = before[at], np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        p, q = at[live] + length[live], other[live] + length[live]
        room = np.minimum(n - p, n - q)
        diff = words[np.minimum(p, n)] ^ words[np.minimum(q, n)]
        lowest = diff & (~diff + np.uint64(1))
        same = np.where(diff == 0, 8, (np.log2(np.maximum(lowest, 1).astype(np.float64)) // 8).astype(np.int64))
        length[live] += np.minimum(same, np.maximum(room, 0))
        live = live[(same == 8) & (room > 8)]
    plcp = np.zeros(n, np.int64)
    plcp[at] = length
    origin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    plcp = np.maximum(plcp[origin] - (np.arange(n) - origin), 0)
    return plcp[sa]


class Shard:
    """Contexts sorted by (landmark, document, start), taken block by block.

    A part of a landmark (`split`) also gives its distinct windows with their first places, in
    `firsts`. Of windows that several parts in a block have, the least place by document counts.
    """

    def __init__(self, block: int = BLOCK, split: bool = False):
        self.block, self.split = block, split
        self.mark, self.first, self.seen = None, set(), np.empty(0, f"S{MATCH}")
        self.docs: list = []
        self.los: list[int] = []
        self.contexts: list[bytes] = []
        self.size, self.tail = 0, 0
        self.out: list[tuple] = []
        self.firsts: list[tuple] = []

    def add(self, mark: int, doc, lo: int, context: bytes) -> None:
        if mark != self.mark:
            if self.size > self.block // 2 or len(self.seen):  # seen blocks are forgotten with their landmark
                self.flush()
            self.mark, self.first, self.seen, self.tail = mark, set(), np.empty(0, f"S{MATCH}"), len(self.docs)
        elif self.docs and (doc, lo) == (self.docs[-1], self.los[-1]):
            return  # an equal row
        if context in self.first:
            self.out.append((doc, lo, lo + len(context)))
            return
        if len(self.first) < REMEMBERED:  # what is forgotten meets in the suffix array
            self.first.add(context)
        self.docs.append(doc)
        self.los.append(lo)
        self.contexts.append(context)
        self.size += len(context)
        if self.size > self.block:
            self.flush(open_group=True)

    def flush(self, open_group: bool = False) -> None:
        if not self.docs:
            return
        lengths = np.array(list(map(len, self.contexts)), np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        raw = b"".join(self.contexts)
        data = np.frombuffer(raw, np.uint8)
        valid = np.ones(len(data), bool)
        tails = ends[:, None] - np.arange(1, MATCH)
        valid[tails.ravel()] = False
        sa = suffix_array(data, MATCH)
        run = np.flatnonzero(np.append(True, common_prefixes(data, sa)[1:] < MATCH))
        place = np.where(valid[sa], sa, len(data))
        if self.split:  # a block holds contexts of several parts, so the first place is not the leftmost
            order = np.empty(len(lengths), np.int64)
            order[sorted(range(len(lengths)), key=lambda c: (self.docs[c], self.los[c]))] = np.arange(len(lengths))
            inside = np.minimum(np.searchsorted(ends, place, side="right"), len(lengths) - 1)
            least = np.minimum.reduceat(np.where(place < len(data), order[inside] << 32 | place, LAST), run)
            least = np.where(least < LAST, least & (1 << 32) - 1, len(data))
        else:
            least = np.minimum.reduceat(place, run)  # first place of each distinct window, in their order
        first = np.repeat(least, np.diff(np.append(run, len(sa))))
        again, known = np.zeros(len(data), bool), np.zeros(len(data) + 1, bool)
        again[sa[valid[sa] & (place != first)]] = True
        if open_group or len(self.seen):  # the last landmark's windows meet those of its other blocks
            at = int(starts[self.tail]) if self.tail < len(starts) else len(data)
            last = least[(least >= at) & (least < len(data))]
            own = np.array([raw[p : p + MATCH] for p in last.tolist()], f"S{MATCH}")
            if len(self.seen) and len(own):
                k = np.minimum(np.searchsorted(self.seen, own), len(self.seen) - 1)
                old = self.seen[k] == own
                known[last[old]] = True
                again[sa[valid[sa] & known[first]]] = True
                own = own[~old]
            self.seen = np.sort(np.concatenate([self.seen, own]), kind="stable")
        if self.split:
            for p in least[(least < len(data)) & ~known[least]].tolist():
                c = int(np.searchsorted(ends, p, side="right"))
                self.firsts.append((self.docs[c], self.los[c] + p - int(starts[c]), raw[p : p + MATCH]))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
        for i, j in edge.reshape(-1, 2).tolist():
            for c in range(int(np.searchsorted(ends, i, side="right")), int(np.searchsorted(starts, j, side="left"))):
                a, z = max(i, int(starts[c])), min(j, int(ends[c]) - MATCH + 1)
                if a < z:
                    self.out.append((self.docs[c], self.los[c] + a - int(starts[c]), self.los[c] + z - int(starts[c]) + MATCH - 1))
        self.docs, self.los, self.contexts, self.size, self.tail = [], [], [], 0, 0

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def rows(self) -> list[tuple]:
        """What was found since, as rows of SPANS."""
        firsts, self.firsts = self.firsts, []
        return [(*doc, a, z, GONE, None) for doc, a, z in self.take()] + [(*doc, a, a + 1, FIRST, w) for doc, a, w in firsts]


def spans_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SPANS.split(", ")])


def repeat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that go, and of split landmarks each shard's first windows."""
    whole, part = Shard(), Shard(split=True)

    def taken() -> Iterator[pa.RecordBatch]:
        if rows := whole.rows() + part.rows():
            yield spans_batch(rows)

    for b in batches:
        for mark, doc, version, lo, context, parts, salt in zip(*(b.column(c).to_pylist() for c in ("mark", "doc_id", "version", "lo", "context", "parts", "salt")), strict=True):
            if parts > 1:
                part.add((mark, salt), (doc, version), lo, context)
            else:
                whole.add(mark, (doc, version), lo, context)
        yield from taken()
    whole.flush()
    part.flush()
    yield from taken()


def later_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of each window but its first, of rows sorted by window and place, as starts that go."""
    last = None
    for b in batches:
        if b.num_rows:
            windows = text_buffer(b.column("window"))[0].view(f"S{MATCH}")
            old = np.append(False, windows[1:] == windows[:-1])
            old[0] = windows[0] == last
            last = windows[-1]
            if old.any():
                b = b.filter(pa.array(old))
                kind = pa.array(np.full(b.num_rows, START, np.int32))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "version", "first", "end")), kind], names=["doc_id", "version", "first", "end", "kind"])


def version() -> Column:
    """Tells rows apart that share a doc_id."""
    return F.xxhash64("text")


def repeated_spans(docs: DataFrame, *, hot: int = HOT) -> DataFrame:
    """(doc_id, version, first, end, kind) spans that `keep_mask` reads; they may overlap."""
    place = ["doc_id", "version"]
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), version().alias("version"), "text")
    found = staged(texts.mapInArrow(stretch_rows, STRETCHES), "stretches")
    long = found.filter(F.col("n_bytes") >= MATCH)
    key = ["h1", "h2", "n_bytes"]
    first = long.groupBy(*key).agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).filter("_first < _last")
    # a group of copies may hold a third of all rows, so its rows meet its first in SALTS tasks
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = long.select(*place, *key, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).join(first, [*key, "salt"]).filter("doc_id > _first")
    copies = staged(copies.select(*place, F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("end"), F.lit(GONE).alias("kind")).distinct(), "copies")
    unique = long.join(copies.select(*place), place, "left_anti")
    marks = unique.select(F.explode(F.arrays_zip("mark", "places")).alias("s")).select("s.*").groupBy("mark").agg(F.sum("places").alias("n"))
    marks = staged(marks.filter("n > 1").select("mark", F.ceil(F.col("n") / hot).alias("parts")), "marks")
    each = unique.select(*place, F.explode(F.arrays_zip("mark", "lo", "hi")).alias("s")).select(*place, "s.*")
    by_doc = staged(each.join(marks, "mark").groupBy(*place).agg(F.collect_list(F.struct("mark", "lo", "hi", "parts")).alias("stretches")), "repeated-stretches")
    unstage(found, marks)
    contexts = texts.join(by_doc, place).mapInArrow(context_rows, CONTEXTS)
    dealt = contexts.withColumn("salt", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("context"), F.col("parts"))).otherwise(0))
    dealt = dealt.repartition("mark", "salt").sortWithinPartitions("mark", "salt", "doc_id", "version", "lo")
    spans = staged(dealt.mapInArrow(repeat_rows, SPANS), "spans")
    unstage(by_doc)
    windows = spans.filter(F.col("window").isNotNull()).repartitionByRange("window").sortWithinPartitions("window", *place, "first")
    later = windows.mapInArrow(later_rows, SPANS.removesuffix(", window binary"))
    return spans.filter(F.col("window").isNull()).drop("window").unionByName(later).unionByName(copies)


def keep_mask(n: int, spans: list[dict]) -> tuple[np.ndarray, int]:
    """True for bytes that stay, and the number of removed runs."""
    change = np.zeros(n + 1, np.int64)
    for s in spans:
        change[min(s["first"], n)] += 1
        change[min(s["end"] + (MATCH - 1 if s["kind"] == START else 0), n)] -= 1
    gone = np.cumsum(change[:n]) > 0
    return ~gone, int(np.count_nonzero(gone & ~np.append(False, gone[:-1])))


def with_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with the spans of their rows in `_spans`."""
    by_doc = spans.groupBy(F.col("doc_id").alias("_s_id"), F.col("version").alias("_s_version")).agg(F.collect_list(F.struct("first", "end", "kind")).alias("_spans"))
    same = (F.coalesce(F.col(key).cast("long"), F.lit(LAST)) == F.col("_s_id")) & (version() == F.col("_s_version"))
    return docs.join(by_doc, same, "left").drop("_s_id", "_s_version")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their repeated bytes cut out; a code point that lost a byte goes whole.

    Each row is a document, in the order of doc_id with nulls last, by a key in that order
    written once; of equal rows all but one are emptied. Null and empty texts stay as they are,
    an empty table gives no rows, and other columns, of any names, are kept.
    """
    columns = docs.columns
    ordered = packed(docs, doc_id="doc_id", text="text").sort(F.asc_nulls_last("doc_id"), F.xxhash64("text"))
    rest = [c for c in columns if c.lower() != "text"]
    other = F.struct(*[F.col("row").getField(c).alias(c) for c in rest]) if rest else F.lit(0)
    keyed = staged(ordered.select(F.monotonically_increasing_id().alias("key"), "text", other.alias("other")), "repeat-rows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in batches_of(whole, "text")):
            data, offsets = text_buffer(b.column("text"))
            old, new = b.column("text").to_pylist(), []
            for text, i, j, spans in zip(old, offsets[:-1].tolist(), offsets[1:].tolist(), b.column("_spans").to_pylist(), strict=True):
                new.append(data[i:j][keep_mask(j - i, spans)[0]].tobytes().decode("utf-8", "ignore") if spans else text)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), b.column("other")], names=["text", "other"])

    spans = repeated_spans(keyed.select(F.col("key").alias("doc_id"), "text"))
    kept = with_spans(keyed, spans, "key").select("text", "_spans", "other")
    kept = kept.mapInArrow(cut, T.StructType([T.StructField("text", T.StringType()), keyed.schema["other"]]))
    return kept.select(*[F.col("text").alias(c) if c.lower() == "text" else F.col("other").getField(c).alias(c) for c in columns])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x for whole in batches for x in batches_of(whole, "text")):
        data, offsets = text_buffer(b.column("text"))
        rows = []
        for i, j, spans in zip(offsets[:-1].tolist(), offsets[1:].tolist(), b.column("_spans").to_pylist(), strict=True):
            keep, runs = keep_mask(j - i, spans or [])
            rows.append((j - i, j - i - int(keep.sum()), runs, hashlib.sha256(data[i:j][keep].tobytes()).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return with_spans(docs, repeated_spans(docs)).mapInArrow(digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: Every 100-byte string by its place, as hexadecimal text; bytes under a string that starts earlier elsewhere go.
OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
b AS (SELECT doc_id, n, b, substr(h, CAST(512 * b + 1 AS INT), 710) AS part FROM (SELECT *, unnest(range((n + 255) // 256)) AS b FROM d WHERE n >= 100)),
p AS (SELECT doc_id, part, 256 * b AS start, unnest(range(least(256, n - 99 - 256 * b))) AS i FROM b),
w AS (SELECT doc_id, start + i AS pos, row_number() OVER (PARTITION BY md5(substr(part, CAST(2 * i + 1 AS INT), 200)) ORDER BY doc_id, start + i) AS k FROM p),
g AS (SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM w WHERE k > 1),
s AS (SELECT doc_id, pos, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM g),
r AS (SELECT doc_id, span, min(pos) AS a, max(pos) + 100 AS z FROM s GROUP BY 1, 2),
c AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS kept_from, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS last FROM r),
o AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans, string_agg(substr(h, CAST(2 * kept_from + 1 AS INT), CAST(2 * (a - kept_from) AS INT)), '' ORDER BY a)
  || substr(any_value(h), CAST(2 * max(z) + 1 AS INT)) AS kept FROM c JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""
