"""Fill-in-middle, hard negatives and token counts against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import fill_in_middle as fim
from logloom.llm import hard_negatives as hard
from logloom.llm import token_counts as tc

public_tokenizers = pytest.importorskip("public_tokenizers")

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
ODD = ["", " ", "\n\t ", "a", " a", "a ", "é", "é ü ß", "　 x", "x<P>y", "<S>", "a <M", "<P", ">b", "a\x1fb \x0b\x0c c", "word " * 9000, "日本 語\r\n" * 40, "😀 <P😀> x", "<<<P", "S> <S"]


def by_hand(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    assert "".join(units) == text
    n = len(units)
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:one]), "".join(units[one:two]), "".join(units[two:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text, text)
    if h[3] % 100 < spm:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text)
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text)


def random_texts(n, seed):
    rng = random.Random(seed)
    pieces = [*" \n\t<>PSM,.'\"0123abcXYZ", "<P>", "é", "ß", "語", " ", "　", " ", "\x85", "\x1f", "😀", "don't", " word", "<|endoftext|>", "<|endof"]
    return ["".join(rng.choices(pieces, k=rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"rate": 100}, {"rate": 100, "spm": 0, "seed": 7}])
def test_fill_in_middle(spark, options):
    texts = ODD + random_texts(400, 3)
    rows = [(k % 300 - 5, t, "x", k) for k, t in enumerate(texts)] + [(None, "a b c d e", None, 1), (None, None, None, 2), (3, "twice a b", "x", 0), (3, "twice a b", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")  # names that clash
    out = fim.restore(fim.fill_in_middle(docs, **options))
    got = [(r.row.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(repr(by_hand(d, t, **options)) for d, t, *_ in rows)
    kept = sorted((repr((r.row.form, r.row.n)) for r in out.collect()))
    assert kept == sorted(repr((f, n)) for _, _, f, n in rows)


def test_fill_in_middle_nothing(spark):
    assert fim.restore(fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    with pytest.raises(ValueError, match="three sentinels"):
        fim.rebuilt(np.frombuffer(b"<P>a<S>b", np.uint8), np.array([0, 8]), np.array([fim.PSM]))


def plain_negatives(rows, positives=5, negatives=10, low=30, high=90):
    """All pairs in plain Python; rows are (vec_id, label, v)."""
    out, width = [], max((len(v) for *_, v in rows), default=0)
    rows = [(i, label, [*v, *[0] * (width - len(v))]) for i, label, v in rows]
    for a, label, v in rows:
        if a % 100 == 0:
            scored = sorted((-sum(map(lambda x, y: x * y, v, w)), i, other == label) for i, other, w in rows if i != a)
            for p, i, _ in [s for s in scored if s[2]][:positives]:
                near = [s for s in scored if not s[2] and low * -p <= 100 * -s[0] <= high * -p][:negatives]
                out += [(a, i, k + 1, j, -p, -s) for k, (s, j, _) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("group_bytes", [1 << 20, 150])
def test_hard_negatives(spark, group_bytes):
    rng = np.random.default_rng(11)
    vectors = rng.integers(-3, 9, (420, 4))
    vectors[100:160] = vectors[100]  # ties
    vectors[200] = 0  # an anchor whose scores are all 0
    rows = [(10 * k if k < 60 else 5000 + k, int(rng.integers(0, 3)), v[: 2 if k % 17 == 0 else 4].tolist()) for k, v in enumerate(vectors)]
    rows += [(9000, 99, [1, 2, 3, 4]), (9100, 1, [])]  # a label of its own, an empty vector
    table = spark.createDataFrame([(i, label, [float(x) for x in v]) for i, label, v in rows], "vec_id long, label long, v array<double>").repartition(5).cache()
    got = hard.hard_negatives(table, F.col("vec_id") % 100 == 0, group_bytes=group_bytes)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)
    few = hard.hard_negatives(table, F.col("vec_id") % 100 == 0, positives=1, negatives=2, low=0, high=100)
    assert sorted(map(tuple, few.collect())) == plain_negatives(rows, 1, 2, 0, 100)


def test_hard_negatives_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [0.5, 0.25]), (1, 1, [0.5, 0.3]), (2, 2, [0.3, 0.1]), (7, 1, [0.2, 0.2]),  # 0 and 7 become label 2
        (3, None, [1.0, 1.0]), (4, 1, None), (5, 1, [1.0, None]), (6, 1, [nan, 1.0]), (8, 1, [inf, 1.0]), (None, 1, [1.0, 1.0]),
        (2, 2, [0.3, 0.1]), (9, 2, [0.31, 0.1]), (9, 2, [0.9, 0.9]), (14, 9, [0.2, 0.1]),
    ]
    e = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("extra", F.lit(1))
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [(0, 2, [128, 64]), (1, 1, [128, math.floor(256 * np.float32(0.3))]), (2, 2, [76, 25]), (7, 2, [51, 51]), (9, 2, [79, 25]), (14, 0, [51, 25])]
    got = hard.op12_hard_negatives(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == plain_negatives(whole) != []
    spark.createDataFrame([], e.schema).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert hard.op12_hard_negatives(spark, f"{tmp_path}/none").count() == 0


def test_best_merges():
    """A list of many blocks is that of all at once, with equal scores in any order of ids."""
    rng = np.random.default_rng(2)
    scores, ids = rng.integers(0, 6, (7, 900)).astype(float), rng.permutation(900)
    scores[:, rng.random(900) < 0.2] = hard.NONE
    scores[3] = 4.0
    best = hard.Best(7, 10)
    for at in range(0, 900, 70):
        best.push(slice(0, 7), scores[:, at : at + 70], ids[at : at + 70])
    for row in range(7):
        want = sorted((-s, i) for s, i in zip(scores[row], ids, strict=True) if s > hard.NONE)[:10]
        assert list(zip(-best.scores[row], best.ids[row], strict=True)) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = public_tokenizers.path(name)
    texts = [t.replace("word ", "word,  then\n") for t in ODD] + ["x" * 30_000, "a1" * 5000, "<|endoftext|> <|endoftext|>a  <|endoftext|>", "it's 's  're\n\n\n x"] + random_texts(300, 5)
    rows = [(k - 3, t, 5) for k, t in enumerate(texts)] + [(None, "null id", 1), (1, None, 2), (9, "twice", 3), (9, "twice", 3)]
    got = tc.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), tokenizer=path).collect()
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False))
    want = [(d, n, len((t or "").encode()), count(t or "")) for d, t, n in rows]
    assert sorted(map(repr, ((r.row.doc_id, r.row.n_tokens, r.n_bytes, r.n_tokens) for r in got))) == sorted(map(repr, want))


def test_token_counts_nothing(spark):
    assert tc.count_tokens(spark.createDataFrame([], "text string")).count() == 0


def test_pieces():
    """Byte-level files are cut, others are not; a long text is many pieces; batches keep to their bytes."""
    assert tc.counter(public_tokenizers.path("byte_bpe_50k.json")).safe
    assert not tc.counter(public_tokenizers.path("word_bpe_49k.json")).safe
    data = np.frombuffer("né a  b　 c 語 d  e".encode() * 1000, np.uint8)
    assert np.count_nonzero(tc.boundaries(data)) == 4000  # behind \u00e9, a, c and \u8a9e; none next to white space beyond ASCII
    batches = list(tc.byte_batches([b"x" * n for n in (5, 6, 50, 1, 1, 9)], 10))
    assert [len(b) for b in batches] == [1, 1, 1, 2, 1] and sum(map(len, batches)) == 6


def test_one_chunk_is_many():
    """Texts of one buffer count alone: no piece crosses their borders."""
    count = tc.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    data, offsets = tc.text_buffer(pa.array(["ab", "", None, "c d", " ", "e"]))
    assert count.of_chunk(data, offsets).tolist() == [len(count.encoded([t])) and count.encoded([t])[0] if t else 0 for t in (b"ab", b"", b"", b"c d", b" ", b"e")]
