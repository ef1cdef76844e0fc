"""Registered gateway queries against their SQL in DuckDB."""

import duckdb
import pytest

from logloom.operators import json_fields, knowledge, lookups, security, tables
from logloom.plans import catalog
from logloom.sources import gateway
from logloom.streaming.usage import usage_of_streams

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("events", "documents", "customer", "embeddings", "conversations", "pages", "part", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    found = catalog.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    got = found.select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
    assert len(got) or name == "log_search"


def test_every_rule_fires(spark):
    texts = spark.createDataFrame(list(enumerate(gateway.SNIPPETS)), "id long, text string")
    fired = {r.rule_id for r in security.findings(texts).select("rule_id").distinct().collect()}
    assert fired == {r for r, *_ in security.rules(*[texts["text"]] * 2)}
    assert catalog.WHEN.keys() == fired
    nothing = spark.createDataFrame([(1, None), (2, "")], "id long, text string")
    assert {(r.level, r.score) for r in security.scores(nothing).collect()} == {("clean", 0)}


def test_split_text_covers_every_line(spark):
    rows = catalog.QUERIES["split_text"](spark, SF).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == {k for k, v in docs.items() if v}
    for r in rows:
        assert r.content in docs[r.doc_id] and len(r.content) <= 4 * 512
    assert gateway.channels(spark).count() == 5


def test_split_markdown_keeps_every_line(spark):
    docs = {r.doc_id: (r.text or "").split("\n") for r in gateway.headed_documents(spark, SF).collect()}
    seen = {k: set() for k in docs}
    for r in catalog.QUERIES["split_markdown"](spark, SF).collect():
        seen[r.doc_id].update(range(r.line_start, r.line_end + 1))
        assert r.token_count == (len(r.content) + 3) // 4
    assert all(i in seen[k] or not line.strip() for k, lines in docs.items() for i, line in enumerate(lines))


def test_rows_to_markdown(spark):
    data = [(1, [["a", "b|c"], ["d\ne"]]), (2, [["a"]]), (3, None), (4, [[], []]), (5, [["h"], [None]])]
    got = {r.id: r.markdown for r in knowledge.rows_to_markdown(spark.createDataFrame(data, "id long, rows array<array<string>>")).collect()}
    assert got == {1: "| a | b\\|c |\n| --- | --- |\n| d e |  |\n", 2: None, 3: None, 4: None, 5: "| h |\n| --- |\n|  |\n"}


def test_usage_of_streams(spark):
    one = 'data: {"usage":{"prompt_tokens":3,"completion_tokens":4,"total_tokens":7}}'
    data = [(1, 0, one), (1, 1, 'data: {"usage":{"total_tokens":0}}'), (2, 0, one.replace("7", "8")), (2, 5, f"event: x\r\n\r\n{one}\r\n"), (3, 0, None), (4, 0, "data: [DONE]\ndata:\n{}")]
    got = {tuple(r) for r in usage_of_streams(spark.createDataFrame(data, "stream_id long, offset long, data string")).collect()}
    assert got == {(1, 3, 4, 7), (2, 3, 4, 7), (3, 0, 0, 0), (4, 0, 0, 0)}


def test_evidence(spark):
    data = [(0, "sk-ant-api03-abcdefghijklmnopqrstux123"), (1, "short"), (2, "a\nb"), (3, None)]
    masked = spark.createDataFrame(data, "id int, text string").select("id", security.mask_evidence(security.F.col("text")).alias("e")).collect()
    assert [r.e for r in sorted(masked)] == ["sk-ant-a****x123", "short", "a b", None]


def test_table_changes(spark):
    rows = lambda data: spark.createDataFrame(data, "id long, a string, b long")
    listed = lambda df: sorted(map(tuple, df.collect()))
    base = rows([(1, "x", 1), (2, "y", 2)])
    assert listed(tables.overlay(base, rows([(2, None, 9), (3, "z", 3)]), "id")) == [(1, "x", 1), (2, "y", 9)]
    assert listed(tables.insert_ignore(base, rows([(2, "no", 0), (3, "z", 3), (3, "z", 3)]), "id")) == [(1, "x", 1), (2, "y", 2), (3, "z", 3)]
    with pytest.raises(ValueError, match="no such columns"):
        tables.overlay(base, base.withColumnRenamed("a", "c"), "id")
    kbs, gone = spark.createDataFrame([(1,), (2,)], "kb_id long"), spark.createDataFrame([(1,)], "kb_id long")
    docs = spark.createDataFrame([(10, 1), (20, 2)], "doc_id long, kb_id long")
    chunks = spark.createDataFrame([(10, 0), (20, 0), (20, 1)], "doc_id long, chunk_index long")
    left = tables.delete_knowledge_bases(kbs, docs, chunks, gone)
    assert [df.count() for df in left] == [1, 1, 2]


def test_rule_tables_and_bodies(spark):
    assert security.like("tool.shell.command", "SH_LL%c") and not security.like("tool.shell.command", "sh.ll")
    bodies = spark.createDataFrame([(1, '{"k": "sk-ant-1234", "b": ["AKIA", 1.5, null]}'), (2, "{bad"), (3, None), (4, '{"b": 1}')], "id long, body string")
    got = {r.id: (r.body, r.changed) for r in json_fields.redact_bodies(bodies).collect()}
    assert got == {1: ('{"b":["****",1.5,null],"k":"sk-a****1234"}', True), 2: ("{bad", False), 3: (None, False), 4: ('{"b": 1}', False)}
    assert sorted(r.id for r in json_fields.parse_errors(bodies).collect()) == [2, 3]


def test_redact_inside(spark):
    cases = {
        "a sk-abcdefghijklmnopqrstuvwx, b": "a sk-a****uvwx, b",
        "sk-short BEARER abcdefg": "sk-short BEARER ab****fg",
        "bearer abcdef\nbearer é12345": "bearer ****\nbearer é1****45",
        "x -----BEGIN CERTIFICATE-----\nabc\n-----end certificate----- y": "x -----BEGIN CERTIFICATE-----\n[REDACTED PRIVATE KEY BLOCK]\n y",
        "-----BEGIN PRIVATE KEY----- open": "-----BEGIN PRIVATE KEY----- open",
    }
    rows = spark.createDataFrame([*[(k, None) for k in cases], ("value", "Password"), ("abc", "token")], "text string, name string")
    got = {r.text: r.out for r in rows.select("text", security.redact_inside(security.F.col("text"), security.F.col("name")).alias("out")).collect()}
    assert got == cases | {"value": "****", "abc": "abc"}


def test_numbers_follow(spark):
    rows = spark.createDataFrame([("b", "2024-01-01T00:00"), ("a", "2024-01-01T00:00"), ("c", "2023-01-01T00:00")], "id string, created_at string")
    assert {r.id: r.seq for r in lookups.appended_logs(spark.createDataFrame([(7,)], "seq long"), rows).collect()} == {"c": 8, "a": 9, "b": 10}
    assert lookups.numbered(rows.filter("false")).count() == 0
    undated = rows.unionByName(spark.createDataFrame([("n", None), ("m", None), ("e", "")], rows.schema))
    assert {r.id: r.seq for r in lookups.numbered(undated).collect()} == {"m": 1, "n": 2, "e": 3, "c": 4, "a": 5, "b": 6}
