"""Token counts of whole texts, by batch encoding of their pieces.

1. A batch's texts are cut at safe boundaries, so that a very long text becomes many pieces. Under
   byte-level rules no token crosses from a character that is not white space to white space, and
   what follows such a place is matched the same way whatever stands before it. So a piece's tokens
   are those it has within its text, and a text's count is the sum over its pieces.
2. Each distinct piece is encoded once by the library; pieces not met before form batches of about
   BATCH_BYTES, and only lengths are kept.
3. Files whose rules allow no such cut (a normalizer, a prefix space, another pre-tokenizer,
   SentencePiece models) have their texts encoded whole, in batches of the same size.

Memory is bounded by a chunk of text, one batch's encodings and the table of known pieces; the one
thing that grows beyond is a text without any safe boundary, which is encoded alone.

Defined cases: a null text is empty and has no tokens; a null doc_id stays null; equal rows each
have a row; strings of special tokens inside texts count as the library takes them by default (one
token); an empty table gives no rows; all other columns are ignored by the query and kept in `row`
by `count_tokens`, so names cannot clash.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.shared import batches_of, table, text_buffer

LIMIT = 1024
#: Bytes that one call of the library encodes.
BATCH_BYTES = 1 << 19
#: Known pieces that a Python worker keeps, and the longest of them.
KNOWN, KNOWN_BYTES = 1 << 19, 64

_CLOSES = np.zeros(256, bool)  # white space at which a piece begins: tab, line breaks, blank
_CLOSES[[9, 10, 13, 32]] = True
_PRINTS = np.zeros(256, bool)  # ASCII that is neither white space nor a control character
_PRINTS[0x21:0x7F] = True
_LEADS = np.zeros(256, bool)  # first bytes of characters none of which is white space
_LEADS[[*range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def splits_safely(rules: dict) -> bool:
    """Whether a tokenizers file keeps to the byte-level rules under which step 1 holds."""
    pre = rules.get("pre_tokenizer") or {}
    plain = all(
        not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and not any(c.isspace() for c in t["content"])
        for t in rules.get("added_tokens") or []
    )
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return bool(byte_level and plain and not rules.get("normalizer") and (rules.get("model") or {}).get("type") == "BPE")


def boundaries(data: np.ndarray) -> np.ndarray:
    """Places where white space follows a character that is surely none, as a mask over the bytes."""
    cut = np.zeros(len(data), bool)
    if len(data) < 2:
        return cut
    solid = _PRINTS[data]
    tail = (data & 0xC0) == 0x80
    for width in (2, 3, 4):  # the last byte of a character of so many bytes
        if len(data) >= width:
            lead = _LEADS[data[: len(data) - width + 1]].copy()
            for k in range(1, width):
                lead &= tail[k : len(data) - width + 1 + k]
            solid[width - 1 :] |= lead
    cut[1:] = _CLOSES[data[1:]] & solid[:-1]
    return cut


def byte_batches(pieces: list[bytes], limit: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    """The pieces in batches of about `limit` bytes; a longer piece is a batch of its own."""
    some, size = [], 0
    for p in pieces:
        if some and size + len(p) > limit:
            yield some
            some, size = [], 0
        some.append(p)
        size += len(p)
    if some:
        yield some


class Counter:
    """Counts tokens of UTF-8 pieces with one tokenizer file."""

    def __init__(self, path: str):
        self.known: dict[bytes, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.safe = False
            self.lengths: Callable[[list[bytes]], list[int]] = lambda some: list(map(len, model.encode([p.decode() for p in some], num_threads=1)))
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            with open(path, encoding="utf-8") as f:
                self.safe = splits_safely(json.load(f))
            self.lengths = lambda some: list(map(len, tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)))

    def encoded(self, pieces: list[bytes]) -> list[int]:
        return [n for some in byte_batches(pieces) for n in self.lengths(some)]

    def of_chunk(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a buffer."""
        raw, counts = data.tobytes(), np.zeros(len(offsets) - 1, np.int64)
        full = np.flatnonzero(np.diff(offsets))  # texts with any byte
        if not len(full):
            return counts
        if not self.safe:
            counts[full] = self.encoded([raw[offsets[k] : offsets[k + 1]] for k in full.tolist()])
            return counts
        cut = boundaries(data)
        cut[offsets[full]] = True
        starts = np.flatnonzero(cut)
        at = starts.tolist()
        pieces = [raw[i:j] for i, j in zip(at, [*at[1:], len(raw)], strict=True)]
        found = list(map(self.known.get, pieces))
        new = list(dict.fromkeys(p for p, n in zip(pieces, found, strict=True) if n is None))
        if new:
            fresh = dict(zip(new, self.encoded(new), strict=True))
            found = [fresh[p] if n is None else n for p, n in zip(pieces, found, strict=True)]
            if len(self.known) + len(fresh) > KNOWN:
                self.known.clear()
            self.known.update((p, n) for p, n in fresh.items() if len(p) <= KNOWN_BYTES)
        counts[full] = np.add.reduceat(np.array(found, np.int64), np.searchsorted(starts, offsets[full]))
        return counts


@cache
def counter(path: str) -> Counter:
    """One for each Python worker, which serves many tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Counter(path)


def counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in (x for whole in batches for x in batches_of(whole, "text")):
            data, offsets = text_buffer(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(np.diff(offsets)), pa.array(count.of_chunk(data, offsets))], names=["row", "n_bytes", "n_tokens"]
            )

    return run


def count_tokens(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """n_bytes and n_tokens of each row's text, beside the other columns in the struct `row`."""
    rest = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() != "text"]
    picked = docs.select((F.struct(*rest) if rest else F.lit(0)).alias("row"), "text")
    schema = T.StructType([picked.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return picked.mapInArrow(counted(tokenizer or default_tokenizer()), schema)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return counts.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
