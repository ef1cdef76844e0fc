"""Best-fit packing of tokenized documents into sequences.

Documents are tokenized word by word (white space never joins two tokens of this vocabulary,
so a word's ids do not depend on its neighbours; a cache of words makes it quick) and cut into
pieces. A text that holds one of the vocabulary's added tokens, which the tokenizer matches
before all rules, goes through the tokenizer whole. Pieces are dealt by hash to shards and sorted by length, longest first; each shard
packs best-fit decreasing: a segment tree over the remaining capacities finds the tightest
open sequence in O(log capacity) a piece. Full pieces fill a sequence alone. A shard keeps
only its open sequences in memory, never its pieces.

Defined cases: null or blank text has the end id alone; repeated doc_ids are packed each;
ties of length go by doc_id, piece and checksum, so reruns agree for the same number of
partitions; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.shared import batches_of, table, text_buffer

CAPACITY = 4096
END_ID = 1
#: Words whose ids a task remembers; then it starts afresh.
CACHE_WORDS = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A full stop or comma between a letter and white space is a token of its own.
MARK = re.compile(rb"(?<=[a-z])([.,])(?=[ \n])")


class WordTokenizer:
    """ids of texts as little-endian 32-bit bytes; the vocabulary's rules lower-case and drop white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.whole = Tokenizer.from_file(path)  # matches its added tokens
        added = self.whole.get_added_tokens_decoder().values()
        self.added = re.compile(b"|".join(re.escape(t.content.encode()) for t in added) or rb"(?!)")
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        """Adds the ids of words: of plain letters by the model itself, of others by all rules."""
        known, tokenize = self.known, self.model.tokenize
        rest = []
        for w in words:
            if w.isalpha():  # of bytes: ASCII letters only
                known[w] = array("I", [t.id for t in tokenize(w.decode())]).tobytes()
            else:
                rest.append(w)
        for at in range(0, len(rest), 8192):
            some = rest[at : at + 8192]
            e = self.tokenizer.encode([x.decode() for x in some], is_pretokenized=True, add_special_tokens=False)
            raw, cuts = array("I", e.ids).tobytes(), np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(some) + 1)) * 4
            known.update((w, raw[i:j]) for w, (i, j) in zip(some, pairwise(cuts.tolist()), strict=True))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        special = {k: self.whole.encode(t.decode(), add_special_tokens=False).ids for k, t in enumerate(texts) if self.added.search(t)}
        words = [[] if k in special else MARK.sub(rb" \1", t.lower()).split() for k, t in enumerate(texts)]
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = set().union(*words)
        gc.disable()  # the cache holds no cycles, and looking for them costs more than filling it
        self.learn(new)
        gc.enable()
        return [array("I", special[k]).tobytes() if k in special else b"".join(map(self.known.__getitem__, w)) for k, w in enumerate(words)]


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, which serves many tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def pieces_of(path: str, with_ids: bool, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = word_tokenizer(path), np.array([END_ID], "<u4").tobytes()
        step, names = 4 * capacity, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for b in (x for whole in batches for x in batches_of(whole, "text")):
            data, offsets = text_buffer(b.column("text"))
            data, offsets = data.tobytes(), offsets.tolist()
            rows = []
            for doc, whole in zip(b.column("doc_id").to_pylist(), ids_of([data[i:j] for i, j in pairwise(offsets)]), strict=True):
                whole += end
                for piece, at in enumerate(range(0, len(whole), step)):
                    part = whole[at : at + step]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part)[: 5 + with_ids])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    return run


class Capacities:
    """Open sequences by remaining capacity under a segment tree; finds the least that is enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, sequence: int, used: int) -> None:
        self.open[room].append((sequence, used))
        at = self.leaves + room
        while at and not self.some[at]:
            self.some[at] = 1
            at >>= 1

    def tightest(self, need: int) -> tuple[int, int, int] | None:
        at = self.leaves + need
        if not self.some[at]:
            while at > 1 and (at & 1 or not self.some[at + 1]):  # up to where something lies to the right
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.some[2 * at] else 2 * at + 1
        room = at - self.leaves
        sequence, used = self.open[room].pop()
        if not self.open[room]:
            self.some[at] = 0
            at >>= 1
            while at and not (self.some[2 * at] or self.some[2 * at + 1]):
                self.some[at] = 0
                at >>= 1
        return room, sequence, used


def best_fit(lengths: list[int], places: Capacities, capacity: int, next_id: int) -> tuple[list[int], list[int], int]:
    """Sequences and offsets of pieces that come longest first."""
    sequences, offsets = [], []
    for n in lengths:
        found = places.tightest(n) if n < capacity else None
        if found is None:
            room, sequence, used = capacity, next_id, 0
            next_id += 1
        else:
            room, sequence, used = found
        sequences.append(sequence)
        offsets.append(used)
        if room > n:
            places.put(room - n, sequence, used + n)
    return sequences, offsets, next_id


def packer(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id, places = TaskContext.get().partitionId() << 40, Capacities(capacity)
        for b in batches:
            sequences, offsets, next_id = best_fit(b.column("length").to_pylist(), places, capacity, next_id)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], names=[*b.schema.names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    schema = PIECES + ", ids binary" * with_ids
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces_of(tokenizer or default_tokenizer(), with_ids, capacity), schema)
    dealt = pieces.repartition("doc_id", "piece").sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(packer(capacity), schema + ", sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
