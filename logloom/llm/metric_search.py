"""Exact top-k inner products by M-trees searched best first.

Rows are dealt to the nearest of at most MAX_PIVOTS pivots, a sample by hash, and each cell is cut
by hash into parts of about PAGE_ROWS rows. A part becomes one M-tree: leaf pages of vectors
around a routing object, inner pages above them, each entry with its covering radius and its
distance to the parent's routing object. With metric d, q.x <= q.c + |q| d(c, x), so a page (or a
cell) within radius r of c holds no score above q.c + |q| r. Since
q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 and d(q, x) >= |d(q, parent) - d(parent, c)| - r, stored
parent distances discard entries before their own distance is computed. Queries first search the
cell that promises most; the k-th score found is a floor, and only cells whose bound reaches it
get the query. The table of cells is all that is broadcast. Scores are exact: components are
integers, sums below 2^53.

Defined cases: a vector that is null, empty or holds a null or non-finite component takes no
part, as query or as candidate; shorter vectors count as padded with zeros; ties go to the
smaller vec_id; vec_id names the row, so a repeated vec_id is kept once (its first vector by
order); fewer than k candidates give fewer rows; an empty table gives none; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.shared import staged, table

K = 5
SCALE = 256
QUERY_EVERY = 50
PAGE_ROWS, LEAF_ROWS, FANOUT = 4096, 256, 16
#: Cells at most; with 1,000 components their table has 32 MB.
MAX_PIVOTS = 4096
BLOCK_QUERIES = 512
#: Rounding that bounds may carry; scores are integers, so half of one is safe.
SLACK = 0.5


def valid(c: Column) -> Column:
    ok = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & F.coalesce(ok, F.lit(False))


def matrix(vectors: pa.Array | list, width: int | None = None) -> np.ndarray:
    vectors = vectors.to_pylist() if isinstance(vectors, pa.Array) else vectors
    width = max(map(len, vectors)) if width is None else width
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v[:width]  # what is beyond meets zeros
    return out


class Cells:
    """Pivots with the covering radius and the largest squared norm of their cells."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.norms2 = pivots, (pivots * pivots).sum(axis=1)
        self.radii, self.largest = np.full(len(pivots), -1.0), np.zeros(len(pivots))  # -1: an empty cell

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ self.pivots.T) + self.norms2, 0))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No score of a cell's rows is above its bound."""
        norm2 = (q * q).sum(axis=1)[:, None]
        outside = np.maximum(self.distances(q) - self.radii - SLACK, 0)
        bound = np.minimum(q @ self.pivots.T + np.sqrt(norm2) * (self.radii + SLACK), (norm2 + self.largest - outside * outside) / 2) + SLACK
        return np.where(self.radii < 0, -np.inf, bound)


class Node:
    """A page: routing objects (or rows) of its entries, covering radii, largest norms and distances to its parent."""

    __slots__ = ("centres", "radii", "norms2", "to_parent", "children", "vectors", "ids")


def distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(axis=-1))


def build(x: np.ndarray, ids: np.ndarray, norms2: np.ndarray, rows: np.ndarray, parent: np.ndarray) -> Node:
    node = Node()
    node.vectors = node.ids = node.children = node.centres = node.radii = None
    if len(rows) <= LEAF_ROWS:
        node.vectors, node.ids, node.norms2, node.to_parent = x[rows], ids[rows], norms2[rows], distance(x[rows], parent)
        return node
    # farthest-first routing objects part the space; each row goes to the nearest
    picks, nearest, owner = [], distance(x[rows], parent), np.zeros(len(rows), np.int64)
    for k in range(FANOUT):
        p = int(np.argmax(nearest))
        if k and nearest[p] <= 0:
            break
        picks.append(p)
        d = distance(x[rows], x[rows[p]])
        owner[d < (np.inf if k == 0 else nearest)] = k
        nearest = d if k == 0 else np.minimum(nearest, d)
    parts = [rows[owner == k] for k in range(len(picks))]
    if len(parts) == 1:  # equal vectors
        parts = np.array_split(rows, -(-len(rows) // LEAF_ROWS))
        picks = [int(np.flatnonzero(rows == p[0])[0]) for p in parts]
    node.centres = x[rows[picks]]
    node.radii = np.array([distance(x[p], c).max() for p, c in zip(parts, node.centres, strict=True)])
    node.norms2 = np.array([norms2[p].max() for p in parts])
    node.to_parent = distance(node.centres, parent)
    node.children = [build(x, ids, norms2, p, c) for p, c in zip(parts, node.centres, strict=True)]
    return node


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each q to each c; exact, as all are integers below 2^53."""
    return np.maximum((q * q).sum(axis=1)[:, None] - 2 * (q @ c.T) + (c * c).sum(axis=1), 0)


class Search:
    """Best-first search for a block of queries at once.

    The page with the best bound of any query comes first, with the queries that still need it;
    each query leaves a page when its k-th score passes the page's bound for it.
    """

    def __init__(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
        self.q, self.own, self.k = q, own, k
        self.norm2 = (q * q).sum(axis=1)
        self.norm = np.sqrt(self.norm2)
        self.scores, self.ids = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        self.least = floor.astype(np.float64)

    def run(self, root: Node, centre: np.ndarray) -> None:
        heap, turn = [(-np.inf, 0, root, np.arange(len(self.q)), np.full(len(self.q), np.inf), distance(self.q, centre))], 0
        while heap:
            _, _, node, rows, bounds, to_q = heapq.heappop(heap)
            needed = bounds >= self.least[rows]
            rows, to_q = rows[needed], to_q[needed]
            if not len(rows):
                continue
            # from stored distances alone: d(q, x) >= |d(q, parent) - d(parent, entry)| - radius
            gap = np.abs(to_q[:, None] - node.to_parent)
            if node.vectors is None:
                gap = np.maximum(gap - node.radii, 0)
            open_ = (self.norm2[rows, None] + node.norms2 - gap * gap) / 2 + SLACK >= self.least[rows, None]
            if node.vectors is not None:
                self.leaf(node, rows, np.flatnonzero(open_.any(axis=0)))
                continue
            some = np.flatnonzero(open_.any(axis=0))
            centres = node.centres[some]
            d = np.sqrt(squared(self.q[rows], centres))
            outside = np.maximum(d - node.radii[some], 0)
            bounds = np.minimum(self.q[rows] @ centres.T + self.norm[rows, None] * node.radii[some], (self.norm2[rows, None] + node.norms2[some] - outside * outside) / 2) + SLACK
            go = open_[:, some] & (bounds >= self.least[rows, None])
            for c in np.flatnonzero(go.any(axis=0)).tolist():
                turn += 1
                mine = go[:, c]
                heapq.heappush(heap, (-float(bounds[mine, c].max()), turn, node.children[some[c]], rows[mine], bounds[mine, c], d[mine, c]))

    def leaf(self, node: Node, rows: np.ndarray, some: np.ndarray) -> None:
        if not len(some):
            return
        ids = node.ids[some]  # in order, so a stable sort puts ties right
        scores = self.q[rows] @ node.vectors[some].T
        scores[self.own[rows, None] == ids] = -np.inf
        better = np.flatnonzero(scores.max(axis=1) >= self.least[rows])
        if not len(better):
            return
        rows, scores = rows[better], scores[better]
        best = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        scores = np.concatenate([self.scores[rows], np.take_along_axis(scores, best, axis=1)], axis=1)
        ids = np.concatenate([self.ids[rows], ids[best]], axis=1)
        order = np.lexsort((ids, -scores), axis=-1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)
        self.least[rows] = np.maximum(self.least[rows], self.scores[rows, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, vec_id and score of all results."""
        row, place = np.nonzero(self.scores > -np.inf)
        return row, self.ids[row, place], self.scores[row, place]


def page_bytes(node: Node) -> Iterator[bytes]:
    """A tree as plain numbers: kind, entries and width of each page, its arrays, then its children."""
    leaf = node.vectors is not None
    rows = node.vectors if leaf else node.centres
    yield np.array([leaf, *rows.shape], np.int64).tobytes()
    for a in (rows, node.ids if leaf else node.radii, node.norms2, node.to_parent):
        yield np.ascontiguousarray(a).tobytes()
    for child in node.children or ():
        yield from page_bytes(child)


def page_of(raw: bytes, at: int) -> tuple[Node, int]:
    """The tree that starts at a byte, and where it ends."""
    leaf, n, width = np.frombuffer(raw, np.int64, 3, at).tolist()
    at += 24

    def taken(count: int, kind: type = np.float64) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += 8 * count
        return out

    node = Node()
    node.vectors = node.ids = node.children = node.centres = node.radii = None
    rows = taken(n * width).reshape(n, width)
    if leaf:
        node.vectors, node.ids = rows, taken(n, np.int64)
    else:
        node.centres, node.radii = rows, taken(n)
    node.norms2, node.to_parent = taken(n), taken(n)
    if not leaf:
        node.children = []
        for _ in range(n):
            child, at = page_of(raw, at)
            node.children.append(child)
    return node, at


def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One tree, behind its centre, for each (cell, part, rows) row."""
    for b in batches:
        for cell, part, rows in zip(b.column("cell").to_pylist(), b.column("part").to_pylist(), b.column("rows").to_pylist(), strict=True):
            rows.sort(key=lambda r: r["vec_id"])
            x, ids = matrix([r["v"] for r in rows]), np.array([r["vec_id"] for r in rows], np.int64)
            centre = x.mean(axis=0)
            root = build(x, ids, (x * x).sum(axis=1), np.arange(len(x)), centre)
            raw = b"".join([np.array([len(centre)], np.int64).tobytes(), centre.tobytes(), *page_bytes(root)])
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([part], pa.int32()), pa.array([raw], pa.binary())], names=["cell", "part", "tree"])


def searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, block in zip(b.column("tree"), b.column("queries"), strict=True):
                raw = raw.as_py()
                width = int(np.frombuffer(raw, np.int64, 1)[0])
                centre, root = np.frombuffer(raw, np.float64, width, 8), page_of(raw, 8 + 8 * width)[0]
                asked = block.as_py()
                own = np.array([r["vec_id"] for r in asked], np.int64)
                search = Search(matrix([r["v"] for r in asked], width), own, np.array([r["floor"] for r in asked]), k)
                search.run(root, centre)
                row, ids, scores = search.found()
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(ids), pa.array(scores.astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = K, page_rows: int = PAGE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for vectors(vec_id, v) and queries(vec_id, v)."""
    spark = vectors.sparkSession
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = vectors.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").select("v").limit(min(MAX_PIVOTS, -(-n // page_rows))).collect()
    cells = Cells(np.unique(matrix([r["v"] for r in sample], width), axis=0))
    near = spark.sparkContext.broadcast(cells)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                x = matrix(b.column("v"), width)
                d = near.value.distances(x)
                cell = d.argmin(axis=1)
                off = np.sqrt(((x - near.value.pivots[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cell, pa.int32()), pa.array(off), pa.array((x * x).sum(axis=1))], names=["vec_id", "v", "cell", "off", "norm2"])

    dealt = staged(vectors.select("vec_id", "v").mapInArrow(assigned, "vec_id long, v array<double>, cell int, off double, norm2 double"), "cells")
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("radius"), F.max("norm2").alias("norm2")).collect()  # one row a cell
    for r in sizes:
        cells.radii[r["cell"]], cells.largest[r["cell"]] = r["radius"], r["norm2"]
    known = spark.sparkContext.broadcast(cells)
    parts = spark.createDataFrame([(r["cell"], -(-r["n"] // page_rows)) for r in sizes], "cell int, parts int")
    rows = dealt.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    index = rows.groupBy("cell", "part").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
    index = staged(index.mapInArrow(trees, "cell int, part int, tree binary"), "m-trees")
    blocks = max(1, -(-n // (QUERY_EVERY * BLOCK_QUERIES)))

    def routed(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    b = whole.slice(at, 512)
                    bounds = known.value.bounds(matrix(b.column("v"), width))
                    home = bounds.argmax(axis=1)
                    floor = b.column("floor").to_numpy()
                    if first:
                        row, cell = np.arange(len(home)), home
                    else:
                        bounds[np.arange(len(home)), home] = -np.inf  # searched before
                        row, cell = np.nonzero((bounds >= floor[:, None]) & (bounds > -np.inf))
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([b.column("vec_id").take(take), b.column("v").take(take), pa.array(floor[row]), pa.array(cell, pa.int32())], names=["vec_id", "v", "floor", "cell"])

        return run

    def found(asked: DataFrame, first: bool) -> DataFrame:
        """Results of each query in its cells: blocks of queries meet the trees of their cell, part by part.

        A tree is shuffled to its task once, and all blocks of its cell come to it there.
        """
        asked = asked.select("vec_id", "v", "floor").mapInArrow(routed(first), "vec_id long, v array<double>, floor double, cell int")
        block = F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(blocks)).alias("block")
        asked = asked.groupBy("cell", block).agg(F.collect_list(F.struct("vec_id", "v", "floor")).alias("queries"))
        asked = asked.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return asked.join(index, ["cell", "part"]).select("tree", "queries").mapInArrow(searcher(k), "query_id long, vec_id long, score long")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    home = staged(found(queries.withColumn("floor", F.lit(float("-inf"))), True).withColumn("rank", rank).filter(F.col("rank") <= k), "home-results")
    floors = home.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    rest = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    every = home.drop("rank").unionByName(found(rest, False))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    e = e.select("vec_id", F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("double")).alias("v"))
    e = staged(e.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    return top_k(e, e.filter(F.col("vec_id") % QUERY_EVERY == 0))


OP5_SQL = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q, e c WHERE q.vec_id % {QUERY_EVERY} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
