"""Which of many fixed patterns a text may contain, found in one pass over Arrow batches.

Each pattern has one of its four-byte pieces, and that a bit; a text gets the bits of all pieces
that hash like its own. Other pieces may hash alike and windows lie across rows, so a bit says that
a pattern may be there and no bit that it is not. Whoever asks looks for the pattern itself then.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE, BITS = 4, 63
#: Letters by how common they are; a pattern's piece is the one with the rarest.
_COMMON = "qjxzkvw_/-.:=1bpgyfmcul dhrsnioate"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_FACTOR, _SHIFT = np.uint32(0x9E3779B1), np.uint32(15)
#: Bytes that are looked at in one go.
STEP = 1 << 17


def _slots(data: np.ndarray) -> np.ndarray:
    pieces = np.ndarray((len(data) - SIZE + 1,), "<u4", data, strides=(1,))
    return (pieces * _FACTOR) >> _SHIFT


def piece(pattern: bytes) -> bytes:
    return min((pattern[k : k + SIZE] for k in range(len(pattern) - SIZE + 1)), key=lambda g: sum(2.0 ** _COMMON.find(chr(c)) for c in g))


@lru_cache(maxsize=8)
def table_of(patterns: tuple[str, ...]) -> np.ndarray:
    """The bits for each hash of a piece; made in each Python worker."""
    table = np.zeros(1 << (32 - int(_SHIFT)), np.int64)
    for k, p in enumerate(patterns):
        table[_slots(np.frombuffer(piece(p.encode()), np.uint8).copy())] |= 1 << k % BITS
    return table


def bits_of(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    texts = texts.cast(pa.large_binary())
    _, ends, data = texts.buffers()
    if data is None or not len(texts):
        return out
    ends, data = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1], np.frombuffer(data, np.uint8)
    for start in range(int(ends[0]), int(ends[-1]), STEP):
        some = _LOWER[data[start : min(start + STEP + SIZE - 1, int(ends[-1]))]]
        if len(some) < SIZE:
            continue
        bits = table[_slots(some)]
        first = int(np.searchsorted(ends, start, "right")) - 1
        last = int(np.searchsorted(ends, start + len(bits), "left"))
        at = np.clip(ends[first:last] - start, 0, len(bits) - 1)
        out[first:last] |= np.bitwise_or.reduceat(bits, at)
    return out


def may_contain(text: Column, patterns: list[str]) -> Column:
    """Bits of the patterns that a text may contain, ASCII letters in either case; `is_set` reads them."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(bits_of(texts, table_of(known)))

    known = tuple(patterns)
    return F.arrow_udf(run, "long")(text)


def is_set(bits: Column, patterns: list[str], pattern: str) -> Column:
    return F.getbit(bits, F.lit(patterns.index(pattern) % BITS)) == 1
