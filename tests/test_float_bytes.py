"""Vectors as stored bytes and back, against numpy."""

import numpy as np
from pyspark.sql import functions as F

from logloom.functions.float_bytes import bytes_to_floats, floats_to_bytes
from logloom.operators import lookups


def test_any_bits(spark):
    """Floats of random bits, the borders of each binade, subnormals, zeros of both signs, infinities, NaN."""
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 1 << 32, 20_000, np.uint64).astype(np.uint32)
    binades = np.arange(0, 256, dtype=np.uint32) << np.uint32(23)
    bits = np.concatenate([bits, binades, binades + 1, binades[1:] - 1, binades | np.uint32(1 << 31), np.arange(50, dtype=np.uint32)])
    floats = bits.view("<f4")
    floats = floats[~np.isnan(floats)]
    table = spark.createDataFrame([(k, [float(x) for x in part]) for k, part in enumerate(np.array_split(floats, 200))], "id int, v array<float>")
    rows = table.select("id", floats_to_bytes(F.col("v")).alias("raw")).withColumn("back", floats_to_bytes(bytes_to_floats(F.col("raw")))).orderBy("id").collect()
    assert b"".join(bytes(r.raw) for r in rows) == floats.tobytes()
    assert all(r.raw == r.back for r in rows)


def test_doubles_and_defined_cases(spark):
    doubles = [0.1, -1e-50, 1e39, 3.4028235677973366e38, -0.0, 1 / 3, 1e-45]
    table = spark.createDataFrame([(1, doubles), (2, None), (3, []), (4, [None, float("nan")])], "id int, v array<double>")
    got = {r.id: r for r in table.select("id", floats_to_bytes(F.col("v")).alias("raw")).withColumn("v", bytes_to_floats(F.col("raw"))).collect()}
    with np.errstate(over="ignore"):
        assert bytes(got[1].raw) == np.array(doubles).astype("<f4").tobytes()
    assert (got[2].raw, got[2].v) == (None, None) and (bytes(got[3].raw), got[3].v) == (b"", [])
    assert bytes(got[4].raw) == np.array([np.nan, np.nan], "<f4").tobytes() and all(np.isnan(got[4].v))
    broken = spark.sql("SELECT X'0000803F' AS a, X'00803F' AS b").select(bytes_to_floats(F.col("a")).alias("a"), bytes_to_floats(F.col("b")).alias("b")).first()
    assert (broken.a, broken.b) == ([1.0], None)


def test_embeddings_of_chunks(spark):
    """New ones go over old ones; several of one chunk, unknown chunks and null vectors are defined."""
    chunks = spark.createDataFrame([(1, b"\0\0\0\0", 1, "a"), (2, None, None, "b"), (3, b"\0\0\0\0", 1, "c"), (4, None, None, "d")], "chunk_id int, embedding binary, embedding_dim int, content string")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (2, [3.0]), (3, None), (9, [5.0])], "chunk_id int, vector array<float>")
    got = lookups.embedded_chunks(chunks, vectors).orderBy("chunk_id").collect()
    pack = lambda *x: np.array(x, "<f4").tobytes()
    assert [(r.chunk_id, r.embedding and bytes(r.embedding), r.embedding_dim, r.content) for r in got] == [
        (1, pack(1, 2), 2, "a"),
        (2, pack(3), 1, "b"),
        (3, pack(0), 1, "c"),
        (4, None, None, "d"),
    ]
