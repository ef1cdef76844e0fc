"""The operators against brute force on small tables with nulls, ties, copies and empties."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from logloom.llm import chat_format, metric_search, near_dups, packing, quality_rules, source_mixing, substring_dedup, toxicity, url_filter, warc
from logloom.llm.shared import shared_path

DOCS = "doc_id long, text string, lang string, source string, extra int"
LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, LONG, "en", "a", 1),
    (2, LONG, "en", "a", 2),
    (3, LONG.replace("word7 ", "other "), "en", None, 3),
    (4, None, "en", "b", 4),
    (5, "", None, "b", 5),
    (6, "one", "de", "b", 6),
    (7, "the same the same the same " * 30, "de", "c", 7),
    (8, "é ü ß " * 50, "fr", "c", 8),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_substrings(docs):
    seen, want = set(), {}
    for doc, text, *_ in ROWS:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        want[doc] = int(gone.sum())
    for hot in (substring_dedup.HOT, 1):  # the gathered and the spread way
        got = substring_dedup.with_spans(docs, substring_dedup.repeated_spans(docs, hot=hot)).toPandas()
        for doc, text, spans in zip(got.doc_id, got.text, got._spans, strict=True):
            n = len((text or "").encode())
            spans = [] if spans is None else [r.asDict() for r in spans]
            assert n - int(substring_dedup.keep_mask(n, spans)[0].sum()) == want[doc]


def test_shard_blocks():
    """A landmark over three blocks, the last one short, and another landmark after it."""
    rng = np.random.default_rng(5)
    text = lambda n: rng.integers(97, 123, n, np.uint8).tobytes()
    passages, seen, want, got = [text(120) for _ in range(4)], set(), {}, {}
    shard = substring_dedup.Shard(block=2048)
    rows = [(1, doc, text(30) + passages[doc % 4] + text(30)) for doc in range(25)] + [(2, 25, text(150))]
    for mark, doc, context in rows:
        shard.add(mark, doc, 0, context)
        gone = np.zeros(len(context), bool)
        for k in range(len(context) - 99):
            gone[k : k + 100] |= context[k : k + 100] in seen
            seen.add(context[k : k + 100])
        want[doc] = int(gone.sum())
    shard.flush()
    for doc, first, end in shard.take():
        got.setdefault(doc, np.zeros(180, bool))[first:end] = True
    assert {doc: int(got[doc].sum()) if doc in got else 0 for doc in want} == want


def test_suffix_array():
    data = np.frombuffer(b"abracadabra" * 20, np.uint8)
    raw = data.tobytes()
    sa = substring_dedup.suffix_array(data, len(raw) + 1)
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_common_prefixes():
    rng = np.random.default_rng(7)
    for raw in [b"XabYabz", b"a", *(rng.integers(97, 97 + k, n, np.uint8).tobytes() for k in (1, 2, 3, 8) for n in range(1, 120))]:
        data = np.frombuffer(raw, np.uint8)
        sa = substring_dedup.suffix_array(data, len(raw) + 1)
        want = [0] + [next((k for k in range(len(raw)) if a + k == len(raw) or b + k == len(raw) or raw[a + k] != raw[b + k])) for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True)]
        assert substring_dedup.common_prefixes(data, sa).tolist() == want


def test_near_duplicates(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(docs).collect()}
    assert got[2] == (59, 1) and got[3] == (59, 1)
    assert got[4] == (0, 4) and got[5] == (0, 5) and got[6] == (1, 6)


def test_shingle_width(spark):
    words = [f"word{i}" for i in range(60)]
    column = pa.array([" ".join(words), " ".join([*words[:20], "x", *words[21:40], "y", *words[41:]]), "one", "a b c d", "a b c d", "a b c", "a b c d e", "", None])
    sets = list(near_dups.shingle_sets(column, 5))
    assert [len(s) for s in sets] == [56, 56, 1, 1, 1, 1, 1, 0, 0] and sets[3] == sets[4] and sets[3] != sets[5] and sets[3] != sets[6]
    assert len(np.intersect1d(*sets[:2])) == 46 and not near_dups.alike(*sets[:2])
    assert near_dups.alike(*list(near_dups.shingle_sets(column))[:2])
    assert corpus_pipeline.SHINGLE == 5


def test_packing(docs):
    got = packing.pack_documents(docs, capacity=64).toPandas()
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 64 and len(used) <= 1.1 * -(-got.length.sum() // 64) + 1
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    empty = got[got.doc_id == 4].iloc[0]
    assert empty.length == 1 and empty.ids_crc32 == zlib.crc32(b"\1\0\0\0")


def test_added_tokens():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole, words = Tokenizer.from_file(path), packing.WordTokenizer(path)
    texts = ["one<|endoftext|>Two, three.", "<|startoftext|>", "x<|startoftext|><|endoftext|>y z", "A\n <|endoftext|> b.\nc", "<|ENDOFTEXT|> no", "<|endoftext |> no", "plain Words, é. ok", ""]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in words([t.encode() for t in texts])] == want
    assert 49407 in want[0] and want[1] == [49406]


def test_mixing(docs):
    got = source_mixing.mix_sources(docs).toPandas()
    assert len(got) == len(ROWS) and (got.taken <= 2 * got["size"]).all()
    assert abs(got.groupby("source", dropna=False).target.first().sum() - 1.5 * got["size"].sum()) < 1e-6


def test_mixed_texts(spark):
    """The chosen word ranges come out as they stand in the text, also for null and shared doc_ids."""
    gaps = [" ", "\n", "\t ", "\n\n"]
    text = lambda name, n: " \n" * (n % 2) + "".join(f"{name}w{k}{gaps[k % 4]}" for k in range(n))
    rows = [(k if k < 7 else None if k < 9 else 1, text(f"d{k}", n), "ab"[k % 2]) for k, n in enumerate([50, 333, 1, 17, 90, 8, 64, 40, 75, 61, 200])]
    docs = spark.createDataFrame([*rows, (11, None, "a"), (12, " \n", "b")], "doc_id long, text string, source string").repartition(1).sortWithinPartitions("text").cache()
    want = Counter()
    for r in source_mixing.placed_words(docs, "text").collect():
        want.update({(r.text.split()[k], r.doc_id): r._copies for k in range(r._from, r._to) if r._copies})
    got = source_mixing.mixed_documents(docs).collect()
    assert Counter((x, r.doc_id) for r in got for x in r.text.split()) == want
    assert {n for n in want.values()} == {1, 2} and len(want) < 939
    starts = []
    for r in got:
        first, last = r.text.split()[0], r.text.split()[-1]
        whole = next(t for _, t, _ in rows if first in t.split())
        a, z = whole.split().index(first), whole.split().index(last) + 1
        cut = lambda k, whole=whole: 0 if k == 0 else len(whole) if k == len(whole.split()) else whole.index(whole.split()[k] + gaps[k % 4])
        assert r.text == whole[cut(a) : cut(z)]
        starts.append(a)
    assert max(starts) > 0


def test_quality(docs):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert got[7].n_repeat_words == 180 and got[7].base_failed and not got[4].kept and got[1].kept


def test_stages_null_and_shared_ids(spark):
    """Stages judge rows: a null doc_id stays, and rows that share a doc_id have their own verdicts."""
    good = [" ".join(f"{c}word{i}" for i in range(60)) for c in "abc"]
    bad = "the same the same the same " * 30
    rows = [(None, good[0], "en", "a", 1), (1, good[1], "en", "a", 2), (1, bad, "en", "a", 3), (1, good[1], "en", "a", 4), (1, good[2], "en", "a", 5), (None, good[2], "en", "a", 6)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(r.extra for r in quality_rules.filter_quality(docs).collect()) == [1, 2, 4, 5, 6]
    got = near_dups.drop_near_duplicates(docs).collect()
    assert sorted(r.text for r in got) == sorted([*good, bad]) and {r.extra for r in got} in ({1, 2, 3, 5}, {1, 4, 3, 5})
    got = {r.extra: r.text for r in substring_dedup.remove_repeats(docs.filter("text not like 'the %'")).collect()}
    assert got[1] == good[0] and got[5] == good[2] and got[6] == "" and sorted([got[2], got[4]]) == ["", good[1]]


def test_repeated_rows_lose_nothing(spark):
    """Equal rows are one document for op3; rows that share a doc_id alone are documents of their own."""
    texts = [" ".join(f"{c}word{i}" for i in range(60)) for c in "abc"]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[1]), (2, texts[2]), (None, texts[1]), (3, "x" + texts[0]), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (substring_dedup.HOT, 1):
        got = substring_dedup.with_spans(docs, substring_dedup.repeated_spans(docs, hot=hot)).collect()
        left = {(r.doc_id, r.text): int(substring_dedup.keep_mask(len(r.text or ""), r._spans or [])[0].sum()) for r in got}
        assert left == {(1, texts[0]): len(texts[0]), (2, texts[1]): len(texts[1]), (2, texts[2]): len(texts[2]), (None, texts[1]): 0, (3, "x" + texts[0]): 1, (4, None): 0}


CLASHING = ["_spans", "_s_id", "_n_row", "_q_key1", "_x_row", "row", "key", "copy", "kept", "rank", "other", "stretches", "n words", "_copies", "shard"]


def test_clashing_names(spark):
    """Stages keep other columns, whatever their names."""
    docs = spark.createDataFrame([(k, " ".join(f"{c}word{i}" for i in range(60)), "en", "a", *range(len(CLASHING))) for k, c in enumerate("aab")], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in CLASHING))
    for stage in (quality_rules.filter_quality, near_dups.drop_near_duplicates, substring_dedup.remove_repeats, source_mixing.mixed_documents):
        got = stage(docs)
        assert got.columns == docs.columns
        assert all(tuple(r)[4:] == tuple(range(len(CLASHING))) for r in got.collect())


def test_top_k(spark):
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(700, 6)) * 20)
    x[100:400] = x[100]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    got = metric_search.top_k(rows, rows.filter("vec_id % 50 = 0")).toPandas()
    for q, part in got.groupby("query_id"):
        order = sorted((i for i in range(700) if i != q), key=lambda i: (-(x[i] @ x[q]), i))[:5]
        assert part.sort_values("rank").vec_id.tolist() == order


def test_top_k_cells(spark):
    """Many cells: clustered and scattered vectors, ties, ragged and equal ones, against brute force."""
    rng = np.random.default_rng(4)
    near = np.repeat(rng.normal(size=(8, 5)) * 300, 60, axis=0) + rng.normal(size=(480, 5)) * 3
    x = np.floor(np.concatenate([near, rng.normal(size=(200, 5)) * 100, np.tile([[3.0, 1, 4, 1, 5]], (120, 1)), np.zeros((3, 5))]))
    x[:, 4] = np.where(np.arange(len(x)) % 3 == 0, 0, x[:, 4])
    rows = spark.createDataFrame([(i, v[: 4 if i % 3 == 0 else 5].tolist(), i) for i, v in enumerate(x)], "vec_id long, v array<double>, cell int").select("vec_id", "v")
    got = metric_search.top_k(rows, rows.filter("vec_id % 7 = 0"), page_rows=40).toPandas()
    assert got["query_id"].nunique() == -(-len(x) // 7)
    for q, part in got.groupby("query_id"):
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-(x[i] @ x[q]), i))[:5]
        part = part.sort_values("rank")
        assert part.vec_id.tolist() == order and part.score.tolist() == [int(x[i] @ x[q]) for i in order]
    assert metric_search.top_k(rows.limit(0), rows.limit(0)).count() == 0
    two = rows.filter("vec_id < 2")
    assert sorted(tuple(r)[:3] for r in metric_search.top_k(two, two).collect()) == [(0, 1, 1), (1, 1, 0)]


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a <|end|>\n <\\|turn|> b"), (1, 1, "assistant", None), (2, 0, None, ""), (1, 2, "assistant", "é\n<|turn|>user\n")]
    got = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert chat_format.parse(got[1].formatted) == [("user", turns[0][3]), ("assistant", ""), ("assistant", turns[3][3])]
    assert got[1].loss_length[0] == 0 and len(got[2].loss_start) == 0


def test_warc_round_trip(spark):
    page = "<p>" + "x" * 1500
    rows = [(1, "http://a/", page), (2, None, page), (3, "http://b/", None), (4, "http://c/", "short"), (5, "http://c/", "short")]
    path = shared_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r.page_id: r for r in warc.read_warc(spark, path, payload=True).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[2].payload.decode() == page
    assert got[4].record_type == got[5].record_type == "response" and got[3].payload_bytes == 0
    assert warc.read_warc(spark, path).filter("record_type = 'revisit'").count() == 1


def test_warc_modes(spark):
    """An append adds records, an overwrite replaces them, and an empty table writes none."""
    path, page = shared_path(spark, "warc-test"), lambda k: spark.createDataFrame([(k, "http://a/", "x")] * (k > 0), "page_id long, url string, html string")
    ids = lambda: sorted(r.page_id for r in warc.read_warc(spark, path).collect())
    for k, mode, want in ((0, "append", []), (1, "append", [1]), (2, "append", [1, 2]), (3, "overwrite", [3])):
        warc.write_warc(page(k), path, mode=mode)
        assert ids() == want


class Counted:
    """A file in memory that counts the bytes read of it."""

    def __init__(self, data):
        self.data, self.n = data, 0

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        self.n += n
        return self.data[at : at + n]


def test_warc_ranged_reads():
    """A pushed filter reads little of an archive, and a truncated record is an error."""
    rng = np.random.default_rng(2)
    records = [warc.record(k, f"http://h/{k}", "response", "d", rng.integers(0, 256, 50_000, np.uint8).tobytes(), None) for k in range(50)]
    data = b"".join(map(warc.member, records))
    file = Counted(data)
    got = list(warc.own_records(warc.Ranges(file, 4096), 0, len(data), lambda h: h["WARC-X-Page-ID"] == "7", True))
    assert len(got) == 1 and len(got[0][1]) == 50_000 and file.n < len(data) // 5
    for cut, how in ((data[:100], warc.own_records), (data[:100], None), (b"".join(records)[:-30_000], None)):
        ranges = warc.Ranges(Counted(cut), 4096)
        with pytest.raises((ValueError, zlib.error)):
            list(how(ranges, 0, len(cut), lambda h: True, True) if how else warc.other_records(ranges, lambda h: True, True))


def test_foreign_warc(spark, tmp_path):
    """Archives of other writers: plain, a member a record, and one member for all; and splits of our own."""
    import gzip

    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    blocks = [(b"warcinfo", b"application/warc-fields", b"software: x\r\n"), (b"response", b"application/http; msgtype=response", http + b"<p>" * 40_000), (b"resource", b"text/html", b"<b>"), (b"revisit", b"application/http", http)]
    records = [b"WARC/1.0\r\nWARC-Type: " + t + b"\r\nWARC-Target-URI: http://x/\r\nWARC-Refers-To: <urn:uuid:1>\r\nContent-Type: " + c + b"\r\nContent-Length: " + str(len(b)).encode() + b"\r\n\r\n" + b + b"\r\n\r\n" for t, c, b in blocks]
    for name, data in (("a.warc", b"".join(records)), ("b.warc.gz", b"".join(map(gzip.compress, records))), ("c.warc.gz", gzip.compress(b"".join(records)))):
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_bytes(data)
        path = f"file://{tmp_path}/{name}"
        got = {r.record_type: r for r in warc.read_warc(spark, path, payload=True).collect()}
        assert len(got) == 4 and bytes(got["response"].payload) == b"<p>" * 40_000 and bytes(got["resource"].payload) == b"<b>" and got["revisit"].payload is None
        assert got["response"].payload_bytes == 120_000 and got["response"].page_id is None and got["response"].refers_to is None
        assert warc.read_warc(spark, f"{path}/{name}").filter("record_type = 'response'").count() == 1


def test_warc_splits(spark, monkeypatch):
    path = shared_path(spark, "warc-test")
    monkeypatch.setattr(warc, "SPLIT_BYTES", 1)  # the writer runs in other processes; edges are those of its own setting
    pages = spark.createDataFrame([(k, None, "p" * 2000 if k % 2 else f"{k}" * 1500) for k in range(1, 40)] + [(None, None, "p" * 2000)], "page_id long, url string, html string")
    warc.write_warc(pages, path)
    got = warc.read_warc(spark, path, payload=True).collect()
    assert sorted(r.page_id or 0 for r in got) == list(range(40))
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {39} and sum(r.record_type == "revisit" for r in got) == 20


def test_urls(spark):
    urls = [(1, "http://WWW.Example.com/en/x?q"), (2, "https://m.example.com/en/"), (3, None), (4, "no scheme"), (5, "http://a.net/fr/1#x"), (5, "http://a.org")]
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect() if r.page_id < 5)
    assert got == [(1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "m.example.com", "/en/", "example.com/en/", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow")]


def test_long_rule(spark):
    path = "/en/" + "x" * 3000
    rules = spark.createDataFrame([("example.com/en/", "allow"), (f"example.com{path}", "block"), (None, "block")], "rule string, verdict string")
    urls = spark.createDataFrame([(1, f"http://example.com{path}/y"), (2, "http://example.com/en/x")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(urls, rules).collect()}
    assert got == {1: "block", 2: "allow"}


def test_urls_brute_force(spark, monkeypatch):
    """Many rules and urls, with a filter of full size and with one so small that nearly all keys pass it."""
    rng = np.random.default_rng(11)
    pick = lambda xs: xs[rng.integers(len(xs))]
    hosts = [".".join(pick("abc") for _ in range(rng.integers(1, 5))) for _ in range(40)] + ["a..b", "x.", ""]
    paths = ["", "/", *("/" + "/".join(pick(["en", "fr", "x" * 40]) for _ in range(rng.integers(1, 4))) for _ in range(40))]
    rules = sorted({pick(hosts) + pick([p for p in paths if p]) for _ in range(150)})
    verdicts = {r: pick(["allow", "block"]) for r in rules}
    urls = [f"http://{pick(hosts).upper()}{pick(paths)}{pick(['', '?q', '#f'])}" for _ in range(400)] + [None, "x"]
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls)], "page_id long, url string, rule int")
    table = spark.createDataFrame([(r, v) for r, v in verdicts.items()], "rule string, verdict string")
    for size in (url_filter.MAX_FILTER_BYTES, 64):
        monkeypatch.setattr(url_filter, "MAX_FILTER_BYTES", size)
        got = {r.page_id: r for r in url_filter.filter_urls(pages, table, default="none").collect()}
        assert len(got) == len(urls)
        for k, r in got.items():
            fits = [x for x in rules if (r.host == (h := x.partition("/")[0]) or r.host.endswith("." + h)) and r.path.startswith(x[len(h) :])]
            best = max(fits, key=lambda x: (len(x), len(x.partition("/")[0])), default=None) if urls[k] and "://" in urls[k] else None
            assert (len(r.rule or ""), r.verdict) == (len(best or ""), verdicts.get(r.rule, "none")) and (best is None) == (r.rule is None)
    assert url_filter.filter_urls(pages.limit(0), table).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, table.limit(0)).collect()} == {"allow"}


def test_toxicity_restores(spark):
    text = ["the man is an idiot here" if i % 5 == 0 else "the man is kind here" for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(text)] + [(100, "an 1d10t and an i d i o t"), (101, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(150)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    assert got[100] > 0.7 and got[101] < 0.5


def test_empty_tables(none, spark):
    assert near_dups.near_duplicates(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0
    assert source_mixing.mix_sources(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert substring_dedup.repeated_spans(none).count() == 0
