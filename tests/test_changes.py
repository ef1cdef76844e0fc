"""Change feeds, settings in force and the live dashboard against plain walks in order."""

import random
import time

import pytest
from pyspark.sql import functions as F

from logloom.operators import feeds, logs, lookups, security, tables
from logloom.plans import catalog
from logloom.sources import gateway
from logloom.streaming.dashboard import Board, live_usage

SF = "/root/testdata/sf0.001"


def walked(base, feed):
    """The table after the feed, change by change; rows are key: (created, a, b)."""
    rows = {k: (feeds.FIRST, a, b) for k, a, b in base if k is not None}
    for k, seq, op, a, b in sorted({f for f in feed if f[0] is not None and f[1] is not None}, key=lambda f: f[1]):
        if op == "delete":
            rows.pop(k, None)
        elif op == "insert" and k not in rows:
            rows[k] = (seq, a, b)
        elif op == "update" and k in rows:
            made, x, y = rows[k]
            rows[k] = (made, x if a is None else a, y if b is None else b)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_folded(spark, seed):
    rng = random.Random(seed)
    base = [(k, f"n{k}", rng.choice([None, k])) for k in range(0, 40, 2)] + [(None, "nameless", 1)]
    feed = [(rng.randrange(40), n, rng.choice(["insert", "update", "update", "update", "delete", "other"]), rng.choice([None, f"a{n}"]), rng.choice([None, n])) for n in range(-50, 600)]
    feed += feed[:200] + [(None, 1000, "insert", "x", 1), (3, None, "insert", "x", 1)]
    b = spark.createDataFrame(base, "k long, a string, b long")
    got = feeds.folded(b, spark.createDataFrame(feed, "k long, seq int, op string, a string, b long").repartition(5), "k").collect()
    want = walked(base, feed)
    assert {r.k: (r.created_seq, r.a, r.b) for r in got} == want | {None: (feeds.FIRST, "nameless", 1)} and len(got) == len(want) + 1
    partial = feeds.folded(b, spark.createDataFrame([(2, 1, "update", 77), (4, 1, "delete", None)], "k long, seq long, op string, b long"), "k")
    assert {r.k: (r.a, r.b) for r in partial.filter("k < 6").collect()} == {0: ("n0", base[0][2]), 2: ("n2", 77)}
    assert feeds.folded(b.filter("false"), spark.createDataFrame([], "k long, seq long, op string"), "k").count() == 0


def test_cascade(spark):
    rows = spark.createDataFrame([(1, 7, -5), (2, 7, 20), (3, 8, -5), (4, None, 1)], "k long, p long, created_seq long")
    parents = spark.createDataFrame([(7, 10, "delete"), (7, 11, "insert"), (8, 12, "update"), (None, 13, "delete")], "pk long, seq long, op string")
    assert {r.k for r in feeds.without_parents_deleted(rows, "p", parents, "pk").collect()} == {2, 3, 4}


@pytest.mark.parametrize("by", [None, "tenant"])
def test_in_force(spark, by):
    rng = random.Random(5)
    at = lambda: f"2024-0{rng.randrange(1, 4)}-{rng.randrange(1, 29):02d}T{rng.randrange(24):02d}"
    defaults = {"mode": "audit", "enabled": "true"}
    versions = [(at(), rng.choice(["mode", "enabled", "unknown"]), str(rng.randrange(9)), rng.randrange(3)) for _ in range(120)] + [(None, "mode", "x", 1), ("2024-01-05T00", "mode", None, 1)]
    events = [(n, rng.choice([at(), at(), at(), None, versions[n % 100][0]]), rng.randrange(3)) for n in range(300)]
    frame = spark.createDataFrame(events, "id long, created_at string, tenant long").repartition(4)
    got = feeds.in_force(frame, spark.createDataFrame(versions, "since string, name string, value string, tenant long"), defaults, by=by).collect()
    want = {}
    for n, when, tenant in events:
        value = dict(defaults)
        if when is not None:
            own = [v for v in versions if v[0] is not None and v[0] <= when and v[2] is not None and (by is None or v[3] == tenant)]
            value |= {name: v for _, name, v, _ in sorted(own) if name in defaults}
        want[n] = (when, tenant, value)
    assert {r.id: (r.created_at, r.tenant, r.setting.asDict()) for r in got} == want and len(got) == len(events)
    none = feeds.in_force(frame, spark.createDataFrame([], "since string, name string, value string, tenant long"), defaults, by=by)
    assert {tuple(r.setting) for r in none.collect()} == {("audit", "true")} and none.count() == 300


def test_defaults_leave_unicode_off(spark):
    rows = spark.createDataFrame([(1, "a​b curl http://x cat .env"), (2, None)], "id long, text string")
    fired = lambda **changed: {f.rule_id for r in security.under_settings(security.with_findings(rows.withColumn("setting", F.struct(*[F.lit(v).alias(k) for k, v in (security.DEFAULTS | changed).items()])))).collect() for f in r.found}
    every = fired(scan_unicode="true")
    assert "unicode.zero_width" in every and fired() == every - {"unicode.zero_width"}
    assert fired(scan_network="false") == fired() - {r for r in every if r.startswith("network.")}
    assert fired(scan_tools="false") == fired() - {r for r in every if r.startswith("tool.") or r == "file.sensitive_path"}
    assert fired(enabled="false") == fired(scan_request="false") == set()


def test_live_dashboard(spark, tmp_path):
    """Logs in any order, in three batches and a restart, come to the figures of the batch queries."""
    every = gateway.request_logs(spark, SF)
    board, batches = Board(str(tmp_path / "board")), []

    def sink(days, batch_id):
        batches.append((spark.createDataFrame(days.collect(), days.schema), batch_id))
        board.write(days, batch_id)

    for k in range(3):
        every.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        given = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = live_usage(given, late="400 days").writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    for days, batch_id in batches:  # replayed
        board.write(days, batch_id)
    assert sorted(map(tuple, board.usage(spark, as_of=catalog.AS_OF, days=7).collect())) == sorted(map(tuple, logs.daily_usage(every, as_of=catalog.AS_OF, days=7).collect()))
    assert tuple(board.totals(spark, today=catalog.AS_OF).first()) == tuple(logs.dashboard(every, today=catalog.AS_OF).first())


def test_late_rows(spark, tmp_path):
    """What is further behind than the watermark allows is passed over; what is not, is counted."""
    board, rows = Board(str(tmp_path / "board")), "created_at string, total_tokens long, duration_ms long"
    for part in ([("2024-01-10T00:00:00Z", 1, 1)], [("2024-01-09T00:00:00Z", 2, 2), (None, 9, 9), ("no time", 9, 9)], [("2024-01-01T00:00:00Z", 4, 4)]):
        spark.createDataFrame(part, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.1)
        given = spark.readStream.schema(rows).parquet(str(tmp_path / "in"))
        query = live_usage(given).writeStream.foreachBatch(board.write).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert sorted(map(tuple, board.days(spark).collect())) == [("2024-01-09", 1, 2, 2), ("2024-01-10", 1, 1, 1)]


def test_rules_made(spark):
    rows = [("blacklist", "tool", "rm", None, None, "d"), ("blacklist", "tool", "rm", None, None, "d"), ("whitelist", "path", "", "low", "block", None), ("grey", "path", "x", None, None, None), (None, "path", "x", None, None, None), ("blacklist", None, "x", None, None, None), ("grey", "else", None, None, None, None)]
    inputs = spark.createDataFrame(rows, "rule_type string, category string, pattern string, severity string, action string, description string")
    made = tables.created_rules(inputs, now="t", seed="s").collect()
    assert {tuple(r)[1:] for r in made} == {("blacklist", "tool", "rm", "medium", "warn", 1, "d", "t"), ("whitelist", "path", "", "low", "block", 1, None, "t")} and len(made) == 2
    errors = sorted(r.error for r in tables.judged_rules(inputs).collect() if r.error)
    assert errors == sorted([tables.BAD_TYPE % "grey", tables.BAD_TYPE % "", tables.BAD_CATEGORY % "", tables.BAD_CATEGORY % "else"])
    defaults = tables.default_rules(spark)
    assert defaults.count() == 23 and {r.enabled for r in defaults.collect()} == {1}


def test_documents_go(spark):
    docs = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, None)], "doc_id long, kb_id long")
    parts = spark.createDataFrame([(1, 0), (1, 1), (3, 0), (9, 0)], "doc_id long, chunk_index long")
    left = tables.delete_documents(docs, parts, docs.filter("doc_id in (2, 3)"))
    assert {r.doc_id for r in left[0].collect()} == {1, 4} and {r.doc_id for r in left[1].collect()} == {1, 9}
    bases = spark.createDataFrame([(7, 99), (8, 99)], "kb_id long, doc_count long")
    assert {tuple(r) for r in tables.counted_bases(bases, *left).select("kb_id", "doc_count", "chunk_count").collect()} == {(7, 1, 2), (8, 0, 0)}


def test_channels_made(spark):
    rows = [("a", None, None, None, None, None, None), ("b", "openai", "u", ["m"], {"x": "y"}, 5, 2)]
    inputs = spark.createDataFrame(rows, "name string, type string, base_url string, models array<string>, mapping map<string,string>, priority int, weight int")
    got = {r.name: r for r in lookups.created_channels(inputs, now="t", seed="s").collect()}
    assert tuple(got["a"])[2:] == ("custom", "", "[]", "{}", 1, 0, 1, "t", "t") and tuple(got["b"])[2:] == ("openai", "u", '["m"]', '{"x":"y"}', 1, 5, 2, "t", "t")
    assert len({r.id for r in got.values()}) == 2 and [tuple(r.models) for r in lookups.typed_channels(lookups.created_channels(inputs, now="t", seed="s")).orderBy("name").collect()] == [(), ("m",)]
