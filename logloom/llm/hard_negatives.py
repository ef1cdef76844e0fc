"""Hard negatives for contrastive training, by blocked dense products.

Anchors are cut by hash into groups of at most GROUP_BYTES of vectors. A group is broadcast (its
size is what bounds the broadcast) and two passes read all rows:

1. Each task multiplies anchor blocks with candidate blocks (float64, exact while scores stay below
   2^53) and keeps every anchor's best rows of its own label. These lists merge: the best of all
   tasks' lists are the positives.
2. A positive's score p admits rows of other labels with low * p <= 100 * score <= high * p. The
   same products keep the best rows within each distinct window of an anchor; lists merge again.

No task holds more than a block of products and k rows for each anchor of a group (times its
windows); no row of the candidates is shuffled, only the lists are. Ties go to the smaller vec_id.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no
part; nor do rows with a null vec_id, which nothing could name; vec_id names a row, so a repeated
vec_id is kept once (its least label, then vector, by order); shorter vectors, empty ones too, count
as padded with zeros; an anchor without another row of its label has no rows, as has a positive
without a negative in its window (always so below a score of 0); fewer than k give fewer rows; an
empty table gives none; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.shared import staged, table

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
SCALE, ANCHOR_EVERY, NOISE_EVERY, LABELS = 256, 100, 7, 10
#: Bytes of anchor vectors that are broadcast at once.
GROUP_BYTES = 64 << 20
#: Anchors and candidates of one product.
ANCHOR_BLOCK, CANDIDATE_BLOCK = 512, 4096
NONE = float("-inf")
LAST = np.iinfo(np.int64).max


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False))


def dense(vectors: pa.Array, width: int) -> np.ndarray:
    """The list column as a matrix, zeros behind the shorter rows."""
    sizes = np.asarray(vectors.value_lengths())
    flat = np.asarray(vectors.flatten(), np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Best:
    """The k best (score, id) of each of n rows: higher scores first, ties by smaller id. Mergeable."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((n, k), NONE), np.full((n, k), LAST)

    def push(self, at: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of the rows `at`, a column each; NONE where one does not count."""
        kept, names, k = self.scores[at], self.ids[at], self.k
        hit = (scores >= kept[:, -1:]) & (scores > NONE)
        crowded = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * k)
        if len(crowded):  # raise the floor to the block's own k-th score; its ties all stay
            some = scores[crowded]
            hit[crowded] &= some >= np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k, None]
        row, column = np.nonzero(hit)
        touched = np.unique(row)
        if not len(touched):
            return
        rows = np.concatenate([row, np.repeat(touched, k)])
        values = np.concatenate([scores[row, column], kept[touched].ravel()])
        owners = np.concatenate([ids[column], names[touched].ravel()])
        order = np.lexsort((owners, -values, rows))
        rows, values, owners = rows[order], values[order], owners[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        first = place < k
        kept[rows[first], place[first]], names[rows[first], place[first]] = values[first], owners[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, score) of all that was kept."""
        row, place = np.nonzero(self.scores > NONE)
        return row, self.ids[row, place], self.scores[row, place].astype(np.int64)


class Anchors:
    """A group of anchors, with the windows of scores that each admits (none in the first pass)."""

    def __init__(self, rows: pa.Table, width: int):
        rows = rows.combine_chunks()
        self.ids, self.labels = (np.asarray(rows.column(c)) for c in ("vec_id", "label"))
        self.vectors = dense(rows.column("v").combine_chunks(), width) if len(rows) else np.zeros((0, width))
        self.width, self.windows = width, np.empty((len(rows), 0), np.int64)

    def admit(self, positives: pa.Table, slots: int) -> None:
        """Each anchor's distinct positive scores, a slot each."""
        order = np.argsort(self.ids)
        self.ids, self.labels, self.vectors = self.ids[order], self.labels[order], self.vectors[order]
        self.windows = np.full((len(order), slots), -1)  # a negative score admits nothing
        pairs = np.unique(np.stack([np.asarray(positives.column(c)) for c in ("anchor_id", "positive_score")], axis=1), axis=0)
        row = np.searchsorted(self.ids, pairs[:, 0])
        self.windows[row, np.arange(len(row)) - np.searchsorted(row, row)] = pairs[:, 1]

    def products(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, scores, whether labels agree, candidates' ids) of each pair of blocks."""
        for whole in batches:
            for first in range(0, whole.num_rows, CANDIDATE_BLOCK):
                b = whole.slice(first, CANDIDATE_BLOCK)
                ids, labels, c = np.asarray(b.column("vec_id")), np.asarray(b.column("label")), dense(b.column("v"), self.width).T
                for at in (slice(k, k + ANCHOR_BLOCK) for k in range(0, len(self.ids), ANCHOR_BLOCK)):
                    yield at, self.vectors[at] @ c, self.labels[at, None] == labels, ids


def positive_rows(anchors, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = anchors.value
        best = Best(len(a.ids), k)
        for at, scores, same, ids in a.products(batches):
            best.push(at, np.where(same & (a.ids[at, None] != ids), scores, NONE), ids)
        row, ids, scores = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(a.ids[row]), pa.array(ids), pa.array(scores)], names=["anchor_id", "positive_id", "positive_score"])

    return run


def negative_rows(anchors, k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = anchors.value
        floor, roof = -(-low * a.windows // 100), high * a.windows // 100
        floor[a.windows < 0], roof[a.windows < 0] = 1, 0
        slots = [Best(len(a.ids), k) for _ in range(a.windows.shape[1])]
        for at, scores, same, ids in a.products(batches):
            scores[same] = NONE
            for slot, best in enumerate(slots):
                inside = (scores >= floor[at, slot, None]) & (scores <= roof[at, slot, None])
                if inside.any():
                    best.push(at, np.where(inside, scores, NONE), ids)
        for slot, best in enumerate(slots):
            row, ids, scores = best.rows()
            columns = [a.ids[row], a.windows[row, slot], ids, scores]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "positive_score", "negative_id", "negative_score"])

    return run


def hard_negatives(
    rows: DataFrame, anchors: Column, *, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` has vec_id and label (long) and v (array<double> of integers), each vec_id once;
    `anchors` says which rows are anchors. `rows` is read several times, so give a written table.
    """
    spark = rows.sparkSession
    asked = rows.filter(anchors)
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(width or 0, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    groups = min(n, -(-n * (8 * width + 16) * 5 // (4 * group_bytes)))  # a quarter spare, as a hash deals unevenly
    parts = []
    for group in range(groups):
        members = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == group) if groups > 1 else asked
        block = Anchors(members.select("vec_id", "label", "v").toArrow(), width)
        known = spark.sparkContext.broadcast(block)
        best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        found = rows.select("vec_id", "label", "v").mapInArrow(positive_rows(known, positives), "anchor_id long, positive_id long, positive_score long")
        chosen = staged(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= positives).drop("rank"), "positives")
        known.unpersist()
        block.admit(chosen.select("anchor_id", "positive_score").toArrow(), positives)
        known = spark.sparkContext.broadcast(block)
        best = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
        near = rows.select("vec_id", "label", "v").mapInArrow(
            negative_rows(known, negatives, low, high), "anchor_id long, positive_score long, negative_id long, negative_score long"
        )
        near = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
        part = chosen.join(near, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        if groups == 1:
            return part
        parts.append(staged(part, "hard-negatives"))
        known.unpersist()
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def labelled_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label after the noise, and the integer components, of the rows that take part."""
    e = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    label = F.col("label").cast("long")
    noisy = F.when(F.col("vec_id") % NOISE_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    v = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("double"))
    e = e.select(F.col("vec_id").cast("long").alias("vec_id"), noisy.alias("label"), v.alias("v"))
    return e.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.label", "s.v")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(labelled_vectors(table(spark, sf_dir, "embeddings")), "labelled-vectors")
    return hard_negatives(rows, F.col("vec_id") % ANCHOR_EVERY == 0)


OP12_SQL = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % {NOISE_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
  list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a, e c WHERE a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE k <= {POSITIVES} AND NOT s.same AND 100 * s.score BETWEEN {LOW} * p.score AND {HIGH} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
