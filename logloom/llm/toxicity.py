"""Toxicity: noisy-channel deobfuscation, then a word classifier on the restored text.

1. A character trigram model is counted over every whole text.
2. Vectorised scans find what could be disguised: letters beside leet characters, letters
   three times in a row, single letters spaced out, words that match a known one but for
   doubled letters.
3. Each such stretch becomes a lattice (leet readings, dropped marks, shortened repetitions,
   word borders) and a Viterbi pass under the character model restores the likeliest words.
4. A logistic model on the words of labelled documents, plain and restored, gives the score.
   It is fitted on at most TRAIN_ROWS labelled rows outside the held-out fold, in hash order.

Labels, lang, source and doc_id are never inputs of a score. Defined cases: null or empty
text has no words and gets the model's base rate; without training rows every score is 0;
repeated rows are scored each; of conflicting labels of one doc_id toxic counts; an empty table
gives no rows; texts are whole, however long; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.shared import batches_of, table, text_buffer

TRAIN_ROWS = 20_000
#: Most words with a weight; and a word's least toxic training documents and ratio of rates.
VOCABULARY, LEAST_DOCS, LEAST_RATIO = 256, 5, 4.0
RIDGE = 0.02
CUT = 0.7

#: Readings of characters that stand for letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "abcdefghijklmnopqrstuvwxyz"}
LEET_COST, ANY_COST, DROP_COST, BORDER_COST = 0.3, 2.5, 2.0, 3.0
#: A known word's cost: about one in e^9 words.
WORD_COST = 9.0
#: Most word beginnings with a weight, and their lengths in bytes.
BEGINNINGS, BEGINNING_BYTES = 32, (5, 6, 7, 8)
#: Costs of reading n equal letters as one or as two.
REPEATS = {1: ((1, 0.0),), 2: ((2, 0.0), (1, 1.5)), 3: ((1, 0.3), (2, 0.8))}
SYMBOLS = 28  # border, a-z, any other letter
REMEMBERED = 200_000

_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27
_PLAIN = bytes(b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32 for b in range(256))
_LETTER = _SYMBOL > 0
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LEET]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[[*range(48, 58), ord("@")]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[ord(c) for c in " .-_*"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def trigram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trigram, n) counts of a partition; texts are set apart by borders."""
    total = np.zeros(SYMBOLS**3, np.int64)
    for b in (x for whole in batches for x in batches_of(whole, "text")):
        data, offsets = text_buffer(b.column("text"))
        s = np.zeros(len(data) + 2 * len(offsets), np.int32)
        s[np.arange(len(data)) + 2 * np.repeat(np.arange(1, len(offsets)), np.diff(offsets))] = _SYMBOL[data]
        total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    some = np.flatnonzero(total)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["trigram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """log p(c | a, b), interpolated with lower orders."""
    counts = docs.select("text").mapInArrow(trigram_rows, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect()  # at most SYMBOLS ** 3
    n = np.zeros(SYMBOLS**3)
    for trigram, k in counts:
        n[trigram] = k
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    share = lambda x: x / np.maximum(x.sum(axis=-1, keepdims=True), 1)
    return np.log(0.8 * share(n) + 0.15 * share(n.sum(axis=0))[None] + 0.04 * share(n.sum(axis=(0, 1)))[None, None] + 0.01 / SYMBOLS)


class Restorer:
    """Viterbi over the character lattice of a disguised stretch."""

    def __init__(self, model: np.ndarray, words: set[bytes] = frozenset()):
        self.cost = (-model).tolist()
        self.words = {w.decode() for w in words if w.isalpha()}
        self.starts = {w[:k] for w in self.words for k in range(len(w) + 1)}
        self.known: dict[tuple[str, bool], list[bytes]] = {}

    def __call__(self, seen: str, spaced: bool = False) -> list[bytes]:
        if (seen, spaced) not in self.known:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[seen, spaced] = self.decode(seen, spaced)
        return self.known[seen, spaced]

    @staticmethod
    def lattice(seen: str) -> Iterator[list[tuple[tuple[int, ...], float]]]:
        """For each run of equal characters: the symbols it may stand for, with costs."""
        at = 0
        while at < len(seen):
            c, end = seen[at], at + 1
            while end < len(seen) and seen[end] == c:
                end += 1
            n, at = end - at, end
            if "a" <= c <= "z" or c in LEET:
                letters, cost = (c, 0.0) if c not in LEET else (LEET[c], ANY_COST if c == "*" else LEET_COST)
                options = [((ord(x) - 96,) * k, cost * k + extra) for x in letters for k, extra in REPEATS[min(n, 3)]]
                yield options + [((), DROP_COST * min(n, 3))] * (c in LEET)
            elif c.isalpha():
                yield [((27,) * min(n, 2), 0.0)]
            else:
                yield [((), 0.5), ((0,), 0.5)]

    def decode(self, seen: str, spaced: bool) -> list[bytes]:
        cost = self.cost
        states: dict[tuple[int, int], tuple[float, tuple[int, ...]]] = {(0, 0): (0.0, ())}
        for options in [*self.lattice(seen), [((0,), 0.0)]]:
            if spaced:
                options = options + [((0, *o), c + BORDER_COST) for o, c in options if o and o[0]]
            after: dict[tuple[int, int], tuple[float, tuple[int, ...]]] = {}
            for (a, b), (so_far, path) in states.items():
                for symbols, extra in options:
                    x, y, total = a, b, so_far + extra
                    for s in symbols:
                        total += cost[x][y][s]
                        x, y = y, s
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, path + symbols)
            states = after
        least, path = min(states.values())
        said = "".join(chr(96 + s) if 0 < s < 27 else "\0" if s else " " for s in path).split()
        word = self.known_word(seen, least) if not spaced else None
        if spaced:
            said += {w for k in range(len(seen)) if (w := self.known_word(seen[k:], math.inf, whole=False))}
        return [w.encode() for w in ([word] if word else said)]

    def known_word(self, seen: str, least: float, whole: bool = True) -> str | None:
        """The likeliest known word along the lattice, if the model's own best reading costs more.

        Known words have one cost each, as whole words; a spaced stretch may hold them anywhere.
        """
        states, found = {"": 0.0}, (least, None)
        if not self.words:
            return None
        for options in self.lattice(seen):
            after: dict[str, float] = {}
            for start, so_far in states.items():
                for symbols, extra in options:
                    grown = start + "".join(chr(96 + s) for s in symbols if s)
                    if grown in self.starts and so_far + extra < after.get(grown, math.inf):
                        after[grown] = so_far + extra
            states = after
            if not states:
                break
            if not whole:
                found = min([found, *((c + WORD_COST, w) for w, c in states.items() if w in self.words)], key=lambda x: x[0])
        if whole:
            found = min([found, *((c + WORD_COST, w) for w, c in states.items() if w in self.words)], key=lambda x: x[0])
        return found[1]


def disguised(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, bool]]:
    """(document, stretch, spaced) for each stretch that could hide a word."""
    if len(data) < 3:
        return []
    low = _LOWER[data]
    letter, leet, space = _LETTER[low], _LEET[low], _SPACE[low]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    near = np.zeros(len(data), bool)
    near[:-1] |= leet[:-1] & letter[1:] & ~border[1:-1]
    near[:-1] |= letter[:-1] & _DIGIT[low[1:]] & ~border[1:-1]
    near[:-2] |= (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & letter[:-2] & (low[:-2] < 128)
    out = []
    gaps = np.flatnonzero(space | border[:-1])
    text = low.tobytes()

    def document(at: int) -> int:
        return int(np.searchsorted(offsets, at, side="right")) - 1

    where = np.flatnonzero(near)
    if len(where):
        k = np.unique(np.searchsorted(gaps, where, side="right"))
        for first, last in zip(np.where(k > 0, gaps[np.maximum(k - 1, 0)], 0).tolist(), np.append(gaps, len(data))[k].tolist(), strict=True):
            seen = text[first:last].decode("utf-8", "ignore").strip(" \t\n\r\x0b\x0c.,;:!?\"'()")
            if seen:
                out.append((document(first), seen, False))
    single = np.zeros(len(data), bool)
    alone = letter | leet & ~_BETWEEN[low]
    left, right = np.ones(len(data), bool), np.ones(len(data), bool)
    left[1:] = ~alone[:-1] | border[1:-1]
    right[:-1] = ~alone[1:] | border[1:-1]
    single = alone & left & right & (low < 128)
    links = np.zeros(len(data), bool)
    links[:-2] = single[:-2] & single[2:] & _BETWEEN[low[1:-1]] & ~border[1:-2] & ~border[2:-1]
    at = np.flatnonzero(links)
    if len(at):
        for first, last in runs_by_two(at):
            if last - first >= 2:  # three letters or more
                out.append((document(first), text[first : last + 3 : 2].decode("ascii", "ignore"), True))
    return out


def runs_by_two(at: np.ndarray) -> Iterator[tuple[int, int]]:
    for parity in (0, 1):
        own = at[at % 2 == parity]
        breaks = np.flatnonzero(np.diff(own) != 2)
        if len(own):
            yield from zip(own[np.append(0, breaks + 1)].tolist(), own[np.append(breaks, len(own) - 1)].tolist(), strict=True)


def collapse(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of an equal letter shortened to one, and the new offsets."""
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != data[:-1]) | (data[1:] == 32) | (data[1:] >= 128)
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    return data[keep], np.append(0, np.cumsum(keep))[offsets]


def single_letters(word: bytes) -> bytes:
    return bytes(c for k, c in enumerate(word) if k == 0 or c != word[k - 1] or c >= 128)


def with_beginnings(words: list[bytes]) -> set[bytes]:
    return {*words, *(b" " + w[:k] for w in words for k in BEGINNING_BYTES if len(w) > k)}


def words_of(column: pa.Array, restore: Restorer, lexicon: set[bytes] | None) -> list[set[bytes]]:
    """The words of each text, plain and restored; only those of the lexicon if there is one."""
    data, offsets = text_buffer(column)
    plain = data.tobytes().translate(_PLAIN)
    cuts = offsets.tolist()
    texts = [plain[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    words = [set(t.split()) for t in texts]
    found = words if lexicon is None else [w & lexicon for w in words]
    for start in (w for w in lexicon or () if w[0] == 32):
        for k, t in enumerate(texts):
            if start in t or t.startswith(start[1:]):
                found[k].add(start)
    for doc, seen, spaced in disguised(data, offsets):
        new = restore(seen, spaced)
        found[doc].update(new if lexicon is None else lexicon & with_beginnings(new))
    if lexicon:
        short = {single_letters(w) for w in lexicon if w[0] != 32}
        data, at = collapse(np.frombuffer(plain, np.uint8), offsets)
        text, at = data.tobytes(), at.tolist()
        for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if hit := short.intersection(text[i:j].split()):
                for w in words[k]:
                    if w not in lexicon and single_letters(w) in hit:
                        found[k].update(lexicon & with_beginnings(restore(w.decode("utf-8", "ignore"))))
    return found


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_words(docs: DataFrame, labels: DataFrame, model: np.ndarray) -> dict[bytes, float]:
    """Weights of words; b"" is the intercept."""
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").alias("_l_id"), F.col("toxic").cast("int").alias("_toxic"))
    rows = rows.groupBy("_l_id").agg(F.max("_toxic").alias("_toxic")).orderBy(F.xxhash64(F.lit(9), "_l_id"), "_l_id").limit(TRAIN_ROWS)
    train = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("_l_id")).select("text", "_toxic")  # bounded by TRAIN_ROWS

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, n = Restorer(model), (Counter(), Counter())
        for b in (x for whole in batches for x in batches_of(whole, "text")):
            for y, words in zip(b.column("_toxic").to_pylist(), words_of(b.column("text"), restore, None), strict=True):
                n[y > 0].update(words)
                n[y > 0].update({b" " + w[:k] for w in words for k in BEGINNING_BYTES if len(w) > k})
                n[y > 0][b""] += 1
        names = [*(n[0].keys() | n[1].keys())]
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([n[0][w] for w in names], pa.int64()), pa.array([n[1][w] for w in names], pa.int64())], names=["word", "clean", "toxic"])

    by_word = train.mapInArrow(counts, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    size = by_word.filter(F.length("word") == 0).first()
    if size is None or not size["toxic"] or not size["clean"]:
        return {}
    rate = lambda c, k: (F.col(c) + 0.5) / (size[c] + k)
    ratio = rate("toxic", 1.0) / rate("clean", 1.0)
    # words that tell the classes apart: large ratio, and far beyond chance for their frequency
    p = F.lit(size["toxic"] / (size["toxic"] + size["clean"]))
    z = (F.col("toxic") - (F.col("toxic") + F.col("clean")) * p) / F.sqrt((F.col("toxic") + F.col("clean")) * p * (1 - p))
    telling = by_word.filter((F.length("word") > 2) & (F.col("toxic") >= LEAST_DOCS) & (ratio >= LEAST_RATIO) & (z >= 6)).withColumn("z", z)
    begins = F.substring("word", 1, 1) == F.lit(b" ")
    chosen = telling.filter(~begins).orderBy(F.desc("z"), "word").limit(VOCABULARY).union(telling.filter(begins).orderBy(F.desc("z"), "word").limit(BEGINNINGS))
    words = [bytes(r["word"]) for r in chosen.select("word").collect()]
    index = {w: k for k, w in enumerate(words)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = set(index)
        restore = Restorer(model, lexicon)
        for b in (x for whole in batches for x in batches_of(whole, "text")):
            found = [sorted(index[w] for w in ws) for ws in words_of(b.column("text"), restore, lexicon)]
            yield pa.RecordBatch.from_arrays([b.column("_toxic"), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "found"])

    rows = train.mapInArrow(features, "toxic int, found array<int>").groupBy("toxic", "found").count().collect()  # bounded by TRAIN_ROWS
    x, y, n = np.zeros((len(rows), len(words) + 1)), np.array([r["toxic"] > 0 for r in rows], float), np.array([r["count"] for r in rows], float)
    x[:, -1] = 1
    for k, r in enumerate(rows):
        x[k, r["found"]] = 1
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), RIDGE)
    penalty[-1] = 1e-6
    for _ in range(50):  # Newton's method
        mu = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * mu * (1 - mu))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (n * (mu - y)) + penalty * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return {word: float(v) for word, v in zip([*words, b""], w, strict=True)}


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    model = character_model(docs)
    weights = fit_words(docs, labels, model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = set(weights) - {b""}
        restore = Restorer(model, lexicon)
        for b in (x for whole in batches for x in batches_of(whole, "text")):
            found = words_of(b.column("text"), restore, lexicon)
            out = [1 / (1 + math.exp(-max(-30.0, min(30.0, weights[b""] + sum(weights[w] for w in sorted(ws)))))) if weights else 0.0 for ws in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scores, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
