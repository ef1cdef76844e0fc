"""Fill-in-the-middle transformation of whole texts, and the way back.

A text is cut into units, `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+` from left to right.
One numpy kernel cuts all rows of a batch on its Arrow UTF-8 buffer: a table of byte classes tells
white space, a mask over adjacent bytes marks where units end, its running sum less the sum before
a document counts units within it, and a binary search in the running sum finds all rows' cuts at
once. The parts and the sentinels are then gathered into one output buffer. Cuts lie behind ASCII
white space or in front of it, so no character is split.

The draw depends on the seed and doc_id alone: h1 to h4 are the first four groups of 8 hexadecimal
digits of sha256("<seed>:<doc_id>"). The prefix ends after the smaller of h1 % (n + 1) and
h2 % (n + 1) units, the middle after the larger. A text is left plain if it is empty, holds a
sentinel, or h3 % 100 >= rate; else it is spm if h4 % 100 < spm, else psm.

Defined cases: a null text is empty and plain; a null doc_id draws as the empty string; rows that
share a doc_id have the same draw; equal rows each give a row; a text of white space alone is one
unit; an empty table gives no rows. `fill_in_middle` keeps all columns but the text in the struct
`row`, so names cannot clash. A text is never cut short; a single one may have 2 GB at most, as any
Arrow string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.shared import batches_of, table, text_buffer

SEED, RATE, SPM = 42, 50, 80
#: Sentinels before prefix, suffix and middle; they differ in their second byte alone.
SENTINELS = b"<P><S><M>"
PLAIN, PSM, SPM_FORM = 0, 1, 2
FORMS = pa.array(["plain", "psm", "spm"])
FORM_NAMES = {name: k for k, name in enumerate(FORMS.to_pylist())}

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(b"PSM")] = True


def sentinels(data: np.ndarray) -> np.ndarray:
    """Places where a sentinel stands."""
    if len(data) < 3:
        return np.empty(0, np.int64)
    return np.flatnonzero((data[:-2] == ord("<")) & _LETTER[data[1:-1]] & (data[2:] == ord(">")))


def unit_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running number of unit ends at each byte, that before each document, and each document's units."""
    space = _SPACE[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~space[:-1] & space[1:]
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True  # white space at the end is a unit of its own
    running = np.cumsum(ends)
    total = np.append(0, running)
    return running, total[offsets[:-1]], total[offsets[1:]] - total[offsets[:-1]]


def holding(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents a sentinel lies in; one over the border of two lies in neither."""
    doc = np.searchsorted(offsets, places, side="right") - 1
    out = np.zeros(len(offsets) - 1, bool)
    out[doc[places + 3 <= offsets[doc + 1]]] = True
    return out


def gathered(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments source[start : start + length] of each row behind one another, and the rows' offsets."""
    sizes = lengths.ravel()
    ends = np.cumsum(sizes)
    index = np.arange(int(ends[-1]) if len(ends) else 0)
    index += np.repeat(starts.ravel() - (ends - sizes), sizes)
    return source[index], np.append(0, np.cumsum(lengths.sum(axis=1)))


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())


def characters(data: np.ndarray) -> np.ndarray:
    """Code points before each byte, and before the end."""
    return np.append(0, np.cumsum((data & 0xC0) != 0x80))


class Cut:
    """The forms and parts of all documents of a buffer; draws are four unsigned integers a row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, rate: int, spm: int):
        self.data, self.offsets = data, offsets
        running, before, self.units = unit_counts(data, offsets)
        h = draws.astype(np.int64)
        one, two = h[:, 0] % (self.units + 1), h[:, 1] % (self.units + 1)
        first, end = offsets[:-1], offsets[1:]

        def behind(units: np.ndarray) -> np.ndarray:
            return np.where(units > 0, np.searchsorted(running, before + units) + 1, first)

        self.one, self.two = behind(np.minimum(one, two)), behind(np.maximum(one, two))
        plain = (first == end) | holding(sentinels(data), offsets) | (h[:, 2] % 100 >= rate)
        self.form = np.where(plain, PLAIN, np.where(h[:, 3] % 100 < spm, SPM_FORM, PSM))

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        first, end, base = self.offsets[:-1], self.offsets[1:], len(self.data)
        p, s, m = (np.full(len(first), base + 3 * k) for k in range(3))  # where the sentinels lie in the source
        three = np.where(self.form == PLAIN, 0, 3)
        none, size = np.zeros(len(first), np.int64), end - first
        prefix, middle, suffix = (first, self.one - first), (self.one, self.two - self.one), (self.two, end - self.two)
        spm, plain = self.form == SPM_FORM, self.form == PLAIN
        pick = lambda a, b, k: np.where(plain, none, np.where(spm, a[k], b[k]))
        starts = np.stack([np.where(spm, s, p), np.where(plain, first, pick(suffix, prefix, 0)), np.where(spm, p, s), pick(prefix, suffix, 0), m, middle[0]], axis=1)
        sizes = np.stack([three, np.where(plain, size, pick(suffix, prefix, 1)), three, pick(prefix, suffix, 1), three, np.where(plain, none, middle[1])], axis=1)
        return gathered(np.append(self.data, np.frombuffer(SENTINELS, np.uint8)), starts, sizes)


def transformed(rate: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in batches_of(whole, "text")):
            data, offsets = text_buffer(b.column("text"))
            drawn = np.frombuffer(b"".join(b.column("drawn").to_pylist()), ">u4").reshape(-1, 4)
            cut = Cut(data, offsets, drawn, rate, spm)
            before, plain = characters(data), cut.form == PLAIN
            chars = lambda i, j: pa.array(before[j] - before[i], pa.int64(), mask=plain)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(cut.units, pa.int64()), FORMS.take(pa.array(cut.form)), chars(offsets[:-1], cut.one), chars(cut.one, cut.two), strings(*cut.outputs())],
                names=["row", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def fill_in_middle(docs: DataFrame, *, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """A row a document: `row` (its columns but the text), n, form, prefix_chars, middle_chars, output."""
    other = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() != "text"])  # doc_id at least
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = docs.select(other.alias("row"), "text", F.unhex(F.substring(F.sha2(named, 256), 1, 32)).alias("drawn"))
    kinds = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}
    schema = T.StructType([drawn.schema["row"], *(T.StructField(name, kind) for name, kind in kinds.items())])
    return drawn.mapInArrow(transformed(rate, spm), schema)


def rebuilt(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts behind outputs: parts put back in their order, sentinels left out."""
    first, end, plain = offsets[:-1], offsets[1:], form == PLAIN
    places = sentinels(data)
    doc = np.searchsorted(offsets, places, side="right") - 1
    places = places[(places + 3 <= offsets[doc + 1]) & ~plain[doc]]
    at = np.zeros((len(form), 3), np.int64)
    if len(places) != 3 * int(np.count_nonzero(~plain)):
        raise ValueError("an output that is not plain must hold exactly three sentinels")
    at[~plain] = places.reshape(-1, 3)
    psm = form == PSM
    one, two, three = ((at[:, 0] + 3, at[:, 1]), (at[:, 1] + 3, at[:, 2]), (at[:, 2] + 3, end))
    part = lambda a, b, k: np.where(psm, a[k], b[k])
    starts = np.stack([np.where(plain, first, part(one, two, 0)), three[0], part(two, one, 0)], axis=1)
    ends = np.stack([np.where(plain, end, part(one, two, 1)), three[1], part(two, one, 1)], axis=1)
    sizes = ends - starts
    sizes[plain, 1:] = 0
    return gathered(data, starts, sizes)


def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x for whole in batches for x in batches_of(whole, "output")):
        data, offsets = text_buffer(b.column("output"))
        form = np.array([FORM_NAMES[f] for f in b.column("form").to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, strings(*rebuilt(data, offsets, form))], names=[*b.schema.names, "restored"])


def restore(outputs: DataFrame) -> DataFrame:
    """The rows of fill_in_middle with the text rebuilt from output and form alone in `restored`."""
    return outputs.mapInArrow(restored, T.StructType([*outputs.schema.fields, T.StructField("restored", T.StringType())]))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = restore(fill_in_middle(docs))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS g FROM d),
c AS (SELECT *, len(w) AS n, least(g[1] % (len(w) + 1), g[2] % (len(w) + 1)) AS a, greatest(g[1] % (len(w) + 1), g[2] % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 50 THEN 'plain'
    WHEN g[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
