"""Substring removal at any split of landmarks, links of shared doc_ids, page ids of any sign."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import metric_search, near_dups, source_mixing, substring_dedup, toxicity, url_filter, warc


def mixed_texts(n, seed):
    """Periodic texts, fills of one template, copies, and windows that cross two passages."""
    rng = random.Random(seed)
    letters = lambda k: "".join(rng.choices("abcdé ", k=k))
    passages, out = [letters(130) for _ in range(6)], []
    for _ in range(n):
        kind = rng.randrange(6)
        if kind == 0:
            out.append(letters(rng.randrange(1, 4)) * rng.randrange(40, 300))
        elif kind == 1:
            out.append("a" * rng.randrange(90, 400))
        elif kind == 2 and out:
            out.append(rng.choice(out))
        elif kind == 3:
            out.append(letters(rng.randrange(150)))
        else:
            out.append(letters(40).join(rng.choices(passages, k=rng.randrange(1, 4))))
    return out


def removed(texts):
    seen, out = set(), {}
    for doc, text in enumerate(texts):
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        out[doc] = gone.tobytes()
    return out


@pytest.mark.parametrize("hot", [1, 50, substring_dedup.HOT])
def test_split_landmarks(spark, hot):
    texts = mixed_texts(300, 13)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = substring_dedup.with_spans(docs, substring_dedup.repeated_spans(docs, hot=hot)).collect()
    mask = lambda r: ~substring_dedup.keep_mask(len(r.text.encode()), [s.asDict() for s in r._spans or []])[0]
    assert {r.doc_id: mask(r).tobytes() for r in got} == removed(texts)


def test_first_holder_keeps_its_text(spark):
    """Six periodic texts whose only landmark has more places than one shard takes."""
    texts = {k: "a" * (9000 + k) for k in range(1, 7)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = substring_dedup.with_spans(docs, substring_dedup.repeated_spans(docs)).collect()
    lost = {r.doc_id: int((~substring_dedup.keep_mask(len(r.text), [s.asDict() for s in r._spans])[0]).sum()) for r in got}
    want = removed(["", *texts.values()])
    assert lost == {k: sum(want[k]) for k in texts} and lost[1] == 9000


def test_shared_ids(spark):
    one, two = ([f"{name}{k}" for k in range(120)] for name in "xy")
    near = lambda words: " ".join([*words, "more"])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one)), (3, near(two)), (4, "apart"), (1, " ".join(one))]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)} and len(got) == 6


def test_page_ids():
    ids = [0, 7, -5, (1 << 63) - 1, -(1 << 63)]
    assert [warc.page_of(warc.urn(i)) for i in ids] == ids
    assert [warc.page_of(x) for x in (None, "", "<urn:page:>", "x", "9" * 19, "1" * 40, "1-2", "--3")] == [None] * 8


def test_negative_pages(spark, tmp_path):
    same = "x" * 1200
    rows = [(-5, "u1", same), (-7, "u2", same), (3, "u3", "small"), ((1 << 63) - 1, "u4", None), (-(1 << 63), "u5", "y" * 1000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.op7_warc(spark, str(tmp_path)).collect()}
    small = (5, "response", None)
    assert got == {-5: (1200, "response", None), -7: (1200, "revisit", -5), 3: small, (1 << 63) - 1: (0, "response", None), -(1 << 63): (1000, "response", None)}


def test_pages_survive():
    """A tree comes back from its bytes as it was."""
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (1500, 7)).astype(float)
    root = metric_search.build(x, np.arange(1500), (x * x).sum(axis=1), np.arange(1500), x.mean(axis=0))
    raw = b"".join(metric_search.page_bytes(root))
    again, end = metric_search.page_of(raw, 0)
    assert end == len(raw) and b"".join(metric_search.page_bytes(again)) == raw
    pages, left = 0, [again]
    while left:
        node = left.pop()
        pages += 1
        left += node.children or []
    assert pages > 6


def test_vectors_without_part(spark, tmp_path):
    """Null, non-finite, empty and repeated vectors; fewer candidates than asked for."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (50, [0.5, 0.5]), (50, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (100, [inf, 1.0]), (4, [1.0, None]), (150, []), (None, [9.0, 9.0]), (5, [2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, metric_search.op5_exact_top_k(spark, str(tmp_path)).collect()))
    q = 256 * 256
    assert got == sorted([(0, 1, 1, 3 * q), (0, 2, 5, 2 * q), (0, 3, 50, q * 3 // 2), (50, 1, 0, q * 3 // 2), (50, 2, 1, q), (50, 3, 5, q)])


def test_viterbi_against_enumeration():
    """The decoded reading is the cheapest of all paths through the lattice."""
    rng = np.random.default_rng(6)
    restore = toxicity.Restorer(np.log(rng.dirichlet(np.ones(toxicity.SYMBOLS), (toxicity.SYMBOLS, toxicity.SYMBOLS))))
    for spaced in (False, True):
        for seen in ("k1ll", "a$$h", "4@b", "h.3.y", "éa0", "t*t", "zzz", "s-1-k"):
            stages = [*restore.lattice(seen), [((0,), 0.0)]]
            if spaced:
                stages = [o + [((0, *s), c + toxicity.BORDER_COST) for s, c in o if s and s[0]] for o in stages]
            found = []
            for choice in itertools.product(*stages):
                symbols = [s for some, _ in choice for s in some]
                total, x, y = sum(c for _, c in choice), 0, 0
                for s in symbols:
                    total += restore.cost[x][y][s]
                    x, y = y, s
                found.append((total, symbols))
            best = min(found)[1]
            words = "".join(chr(96 + s) if 0 < s < 27 else "\0" if s else " " for s in best).split()
            assert restore.decode(seen, spaced) == [w.encode() for w in words]


def test_seats_against_quotients(spark):
    """Apportionment is that of highest quotients, seat by seat, under caps and with ties."""
    rng = random.Random(12)
    rows, want = [], {}
    for group in range(40):
        keys = [(f"s{k}", float(rng.choice([0, 1, 1, 2, 5, 9.5, 40])), rng.randrange(6)) for k in range(rng.randrange(1, 9))]
        total = rng.randrange(0, 20)
        rows += [(group, k, w, total, cap) for k, w, cap in keys]
        seats = dict.fromkeys((k for k, *_ in keys), 0)
        for _ in range(total):
            open_ = [(-w / (2 * seats[k] + 1), k) for k, w, cap in keys if w > 0 and seats[k] < cap]
            if open_:
                seats[min(open_)[1]] += 1
        want |= {(group, k): n for k, n in seats.items()}
    table = spark.createDataFrame(rows, "g int, key string, w double, total long, cap long")
    got = source_mixing.sainte_lague(table, ["g"], ["key"], "w", "total", "cap", "seats").collect()
    assert {(r.g, r.key): r.seats for r in got} == want


def test_seats_of_very_many_keys(spark):
    """Seats far from the rounded shares: 200,000 keys whose shares all round one way, and keys that caps hold back."""
    n = 200_000
    rows = spark.range(n).select(F.lit(0).alias("g"), "id", F.lit(1.0).alias("w"), F.lit(n * 14 // 10).cast("long").alias("total"), F.lit(2).cast("long").alias("cap"))
    got = source_mixing.sainte_lague(rows, ["g"], ["id"], "w", "total", "cap", "seats")
    assert {(r.seats, r["count"], r.first, r.last) for r in got.groupBy("seats").agg(F.count("*").alias("count"), F.min("id").alias("first"), F.max("id").alias("last")).collect()} == {
        (2, n * 4 // 10, 0, n * 4 // 10 - 1),
        (1, n * 6 // 10, n * 4 // 10, n - 1),
    }
    rng = random.Random(4)
    keys = [(k, rng.choice([1e-9, 0.3, 1.0, 7.0, 1e6]) * rng.random(), rng.choice([0, 1, 3, 50, 4000])) for k in range(400)]
    for total in (0, 1, 399, 20_000, sum(c for _, _, c in keys) - 1, 10**7):
        seats = sorted((-w / (2 * j + 1), k, j) for k, w, c in keys for j in range(c))[:total]
        want = Counter(k for _, k, _ in seats)
        table = spark.createDataFrame([(0, k, w, total, c) for k, w, c in keys], "g int, id long, w double, total long, cap long")
        got = source_mixing.sainte_lague(table, ["g"], ["id"], "w", "total", "cap", "seats").collect()
        assert {r.id: r.seats for r in got} == {k: want[k] for k, _, _ in keys}


def test_urls_against_very_many_lengths(spark, monkeypatch):
    """2,000 path lengths, nested rules, UTF-8, upper-case hosts, two verdicts: as brute force has it, in blocks of any size."""
    rng = random.Random(8)
    hosts = ["a.b", "b", "x.a.b", "é.c", "c", "B.D", "d", "", "a..b"]
    paths = ["/" + "".join(rng.choices("aé/", k=rng.randrange(0, 6))) for _ in range(60)] + ["", *("/" + "z" * n for n in range(2000))]
    rules = [(rng.choice(hosts) + p, rng.choice(["allow", "block", "grey"])) for p in paths for _ in range(2)] + [(None, "block")]
    urls = [(k, rng.choice(["http://", "//", ""]) + rng.choice(["", "w.", "A."]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "/q", "?a", "#b"])) for k in range(500)] + [(500, None)]
    lower = lambda h: "".join(c.lower() if "A" <= c <= "Z" else c for c in h)
    parted = [(lower(r.split("/")[0]), r[len(r.split("/")[0]) :], r, v) for r, v in rules if r is not None]
    want = {}
    for k, url in urls:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        stop = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = lower(rest[:stop]), rest[stop:].split("?")[0].split("#")[0]
        fit = [(len(r), len(h), r, v) for h, p, r, v in parted if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[k] = (host, path, *(max(fit)[2:] if fit else (None, "none")))
    table, pages = spark.createDataFrame(rules, "rule string, verdict string"), spark.createDataFrame(urls, "page_id long, url string")
    for pairs, size in ((1 << 18, url_filter.MAX_FILTER_BYTES), (100, 64)):
        monkeypatch.setattr(url_filter, "PAIRS", pairs)
        monkeypatch.setattr(url_filter, "MAX_FILTER_BYTES", size)
        got = url_filter.filter_urls(pages, table, default="none").collect()
        assert len(got) == len(urls) and {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want


def test_wide_stars(spark, monkeypatch):
    """Stars dealt to several tasks, members of any size and centres with several sets: the components of all true links."""
    rng = random.Random(5)
    base = [[f"{name}{k}" for k in range(60)] for name in "xyz"]
    rows = []
    for k in range(160):
        words = list(rng.choice(base))
        if k % 3:
            words[rng.randrange(60)] = f"new{k}"
        if k % 4 == 0:
            words += [f"tail{k}-{j}" for j in range(rng.choice([3, 8, 14, 16, 40]))]
        rows.append((k // 2 if k < 20 else k, " ".join(words)))
    sets = [(doc, {" ".join(p) for p in itertools.pairwise(text.split())}) for doc, text in rows]
    least = {doc: doc for doc, _ in rows}
    changed = True
    while changed:
        changed = False
        for (a, x), (b, y) in itertools.combinations(sets, 2):
            low = min(least[a], least[b])
            if (least[a], least[b]) != (low, low) and 100 * len(x & y) >= 80 * len(x | y):
                least[a] = least[b] = low
                changed = True
    for members in (near_dups.STAR_MEMBERS, 3):
        monkeypatch.setattr(near_dups, "STAR_MEMBERS", members)
        got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == least
