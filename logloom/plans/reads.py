"""Queries that read channels, knowledge bases, uploads and logs as a client asks for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import chunks, csv_tables, dispatch, feeds, lookups, pages, security, tables
from logloom.plans import splitting
from logloom.sources import gateway

channels = lambda s, d: lookups.typed_channels(gateway.nation_channels(s, d))
LISTING = [("created_at", True), ("id", False)]


def deep_page(s, d):
    """Page 40 of 20 logs, newest first, from a table laid out in that order in the shared folder."""
    path = pages.shared_path(s, "log-pages")
    pages.lay_out(gateway.request_logs(s, d).select("id", "created_at", "model"), path, LISTING, files=64)
    return pages.page(s, path, LISTING, number=40, size=20)


def csv_cells(s, d):
    rows = csv_tables.csv_tables(gateway.csv_uploads(s, d)).select("doc_id", F.posexplode("rows").alias("record", "cells"))
    return rows.select("doc_id", "record", F.posexplode("cells").alias("field", "value"))


def rule_inputs(s, d):
    """The many rules, of which some have a kind or type that is not known."""
    r = gateway.many_rules(s, d)
    kind = F.when(F.length("pattern") % 5 == 0, "other").otherwise(F.col("category"))
    return r.withColumns({"category": kind, "rule_type": F.when(F.length("pattern") % 7 == 0, "grey").otherwise(F.col("rule_type")), "description": F.lit(None).cast("string")}).drop("enabled")


def without_ninths(s, d):
    docs = gateway.knowledge_documents(s, d)
    left = tables.delete_documents(docs, chunks.split_text(docs), docs.filter("doc_id % 9 = 0"))
    bases = s.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("long").alias("kb_id"), F.col("r_name").alias("name"))
    return tables.counted_bases(bases, *left).select("kb_id", "name", "doc_count", "chunk_count")


def rule_changes(s, d):
    """Built-in rules after every event's change to one: switches and severities."""
    defaults, i = tables.default_rules(s), F.col("event_id")
    names = sorted(r for r, *_ in security.built_in())
    pick = lambda of, k: F.element_at(F.array(*map(F.lit, of)), (k % len(of) + 1).cast("int"))
    e = s.read.parquet(f"{d}/events.parquet")
    feed = e.select(pick(names, i).alias("rule_id"), i.alias("seq"), F.lit("update").alias("op"), F.when(i % 3 == 0, (i % 2).cast("int")).alias("enabled"), F.when(i % 5 == 0, pick(("low", "high", "info"), i)).alias("severity"))
    return feeds.folded(defaults, feed, "rule_id").select("rule_id", "severity", "enabled")


QUERIES = {
    "rule_errors": lambda s, d: tables.judged_rules(rule_inputs(s, d)).filter("error IS NOT NULL").select("rule_type", "category", "pattern", "error"),
    "rules_created": lambda s, d: tables.created_rules(rule_inputs(s, d), now="2024-02-01T00:00:00.000Z", seed="r").drop("id", "description"),
    "kb_counts_after_delete": without_ninths,
    "builtin_rule_changes": rule_changes,
    "kb_conversation": lambda s, d: s.read.parquet(f"{d}/conversations.parquet").filter("conv_id % 5 = 1").orderBy("conv_id", "turn").select("conv_id", "turn", "role", "text"),
    "kb_sources": lambda s, d: lookups.newest(s.read.parquet(f"{d}/pages.parquet").filter("page_id % 3 = 0").select(F.col("page_id").alias("source_id"), F.col("url").alias("source_url"), F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 31 + 1).cast("string"), 2, "0")).alias("created_at")), "created_at", "source_id", 40),
    "channels_all": lambda s, d: lookups.in_order(channels(s, d), F.desc("priority"), F.desc("created_at")).select("place", "channel_id"),
    "channels_enabled": lambda s, d: lookups.enabled_channels(channels(s, d)).select("place", "channel_id"),
    "channel_adaptors": lambda s, d: lookups.with_adaptor(channels(s, d)).select("channel_id", "adaptor", "base_url"),
    "channel_by_id": lambda s, d: channels(s, d).filter("channel_id = 4").select("channel_id", "status", "priority", "created_at"),
    "models_shown": lambda s, d: lookups.models_shown(channels(s, d)),
    "list_models": lambda s, d: dispatch.list_models(channels(s, d)),
    "channels_created": lambda s, d: lookups.created_channels(channels(s, d), now="2024-02-01T00:00:00Z", seed="s").drop("id"),
    "log_views": lambda s, d: lookups.log_views(gateway.request_logs(s, d).withColumn("message", F.when(F.col("status_code") >= 400, F.col("model")))).select("id", "is_stream", "is_retry", "error_message"),
    "log_page_deep": deep_page,
    "kb_documents": lambda s, d: lookups.newest(gateway.knowledge_documents(s, d).filter("kb_id = 1"), "created_at", "doc_id", 50).select("doc_id", "created_at"),
    "kb_document": lambda s, d: gateway.knowledge_documents(s, d).filter("doc_id = 17").select("doc_id", "kb_id", "created_at", "text"),
    "kb_chunks": lambda s, d: chunks.split_text(gateway.knowledge_documents(s, d).filter("kb_id = 2")).orderBy("chunk_index", "doc_id").select("doc_id", "chunk_index", "content"),
    "kb_document_totals": lambda s, d: lookups.document_totals(gateway.knowledge_documents(s, d), chunks.split_text(gateway.knowledge_documents(s, d))),
    "csv_cells": csv_cells,
    "csv_errors": lambda s, d: csv_tables.csv_tables(gateway.csv_uploads(s, d)).filter("error IS NOT NULL").select("doc_id", "error"),
}

CHANNELS = """c AS (SELECT CAST(n_nationkey AS BIGINT) AS channel_id, n_name AS name, CASE n_nationkey % 6 WHEN 0 THEN ['a', 'b'] WHEN 2 THEN ['b', 'C', 'd', 'e', 'f'] WHEN 4 THEN ['g'] ELSE [] END AS models,
  CASE n_nationkey % 4 WHEN 0 THEN ['b'] WHEN 3 THEN ['z', 'a'] ELSE [] END AS keys, CASE n_nationkey % 4 WHEN 0 THEN '{"b":"x"}' WHEN 3 THEN '{"z":"y","a":"w"}' ELSE '{}' END AS mapping,
  CAST(n_nationkey % 4 <> 0 AS INT) AS status, n_regionkey * 10 AS priority, n_nationkey % 3 AS weight, '2024-01-' || lpad(CAST(31 - n_nationkey AS VARCHAR), 2, '0') AS created_at,
  list_extract(['openai', 'claude', 'gemini', 'deepseek', 'custom', 'other', NULL], CAST(n_nationkey % 7 + 1 AS INT)) AS type, CASE n_nationkey % 3 WHEN 1 THEN 'http://x//' WHEN 0 THEN '' END AS base_url FROM nation)"""
ADDRESS = "coalesce(nullif(base_url, ''), CASE type WHEN 'openai' THEN 'https://api.openai.com/v1' WHEN 'claude' THEN 'https://api.anthropic.com' WHEN 'gemini' THEN 'https://generativelanguage.googleapis.com' WHEN 'deepseek' THEN 'https://api.deepseek.com/v1' ELSE '' END)"
BASES = "k AS (SELECT doc_id, doc_id % 3 AS kb_id, '2024-01-' || lpad(CAST(doc_id % 31 + 1 AS VARCHAR), 2, '0') AS created_at, text FROM documents)"
LINES = "l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE doc_id % 17 <> 3)"

RULES = """r0 AS (SELECT doc_id AS i, CASE WHEN doc_id % 5 = 0 THEN 'whitelist' ELSE 'blacklist' END AS rule_type, left(text, 41) AS pattern FROM documents WHERE length(text) >= 41
  UNION ALL SELECT c_custkey, 'blacklist', c_name FROM customer UNION ALL SELECT p_partkey, 'blacklist', p_name FROM part),
r AS (SELECT CASE WHEN length(pattern) % 7 = 0 THEN 'grey' ELSE rule_type END AS rule_type, CASE WHEN length(pattern) % 5 = 0 THEN 'other' ELSE list_extract(['domain', 'tool', 'path', 'keyword'], CAST(i % 4 + 1 AS INT)) END AS category,
  pattern, list_extract(['critical', 'high', 'low', 'info', 'odd', NULL], CAST(i % 6 + 1 AS INT)) AS severity, CASE i % 3 WHEN 1 THEN 'block' WHEN 2 THEN 'warn' END AS action FROM r0)"""

SQL = {
    "rule_errors": f"""WITH {RULES} SELECT rule_type, category, pattern, CASE WHEN category = 'other' THEN '非法的 category: other，可选值: domain, tool, path, keyword' ELSE '非法的 rule_type: grey' END AS error
  FROM r WHERE category = 'other' OR rule_type = 'grey'""",
    "rules_created": f"""WITH {RULES}, g AS (SELECT DISTINCT * FROM r WHERE category <> 'other' AND rule_type <> 'grey') SELECT rule_type, category, pattern, coalesce(severity, 'medium') AS severity,
  coalesce(action, 'warn') AS action, 1 AS enabled, '2024-02-01T00:00:00.000Z' AS created_at FROM g""",
    "kb_counts_after_delete": f"""WITH RECURSIVE s AS (SELECT doc_id AS id, text FROM documents WHERE doc_id % 9 <> 0), {splitting.cut('x', 's', 512, 64)}
SELECT CAST(r_regionkey AS BIGINT) AS kb_id, r_name AS name, (SELECT count(*) FROM s WHERE id % 3 = r_regionkey) AS doc_count, (SELECT count(*) FROM x WHERE id % 3 = r_regionkey) AS chunk_count FROM region""",
    "kb_conversation": "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 5 = 1",
    "kb_sources": "SELECT page_id AS source_id, url AS source_url, '2024-01-' || lpad(CAST(page_id % 31 + 1 AS VARCHAR), 2, '0') AS created_at FROM pages WHERE page_id % 3 = 0 ORDER BY created_at DESC, source_id LIMIT 40",
    "channels_all": f"WITH {CHANNELS} SELECT CAST(row_number() OVER (ORDER BY priority DESC, created_at DESC) AS INT) AS place, channel_id FROM c",
    "channels_enabled": f"WITH {CHANNELS} SELECT CAST(row_number() OVER (ORDER BY priority DESC, weight DESC, channel_id) AS INT) AS place, channel_id FROM c WHERE status = 1",
    "channel_adaptors": f"WITH {CHANNELS} SELECT channel_id, CASE WHEN type IN ('openai', 'claude', 'gemini', 'deepseek') THEN type ELSE 'custom' END AS adaptor, {ADDRESS} AS base_url FROM c",
    "channel_by_id": f"WITH {CHANNELS} SELECT channel_id, status, priority, created_at FROM c WHERE channel_id = 4",
    "models_shown": f"WITH {CHANNELS} SELECT channel_id, coalesce(array_to_string(models[1:3], ','), '') AS shown, CAST(greatest(len(models) - 3, 0) AS INT) AS more FROM c",
    "list_models": f"WITH {CHANNELS}, n AS (SELECT channel_id, priority, weight, unnest(list_concat(models, keys)) AS model FROM c WHERE status = 1) SELECT DISTINCT model, first_value(channel_id) OVER (PARTITION BY model ORDER BY priority DESC, weight DESC, channel_id) AS owner FROM n",
    "channels_created": f"""WITH {CHANNELS} SELECT name, coalesce(type, 'custom') AS type, coalesce(base_url, '') AS base_url, CAST(to_json(models) AS VARCHAR) AS models, mapping, 1 AS status, priority, weight,
  '2024-02-01T00:00:00Z' AS created_at, '2024-02-01T00:00:00Z' AS updated_at FROM c""",
    "log_views": "SELECT CAST(event_id AS VARCHAR) AS id, event_id % 2 = 1 AS is_stream, event_id % 7 = 0 AS is_retry, CASE WHEN event_type IN ('error', 'signup') THEN event_type END AS error_message FROM events",
    "log_page_deep": "SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created_at, event_type AS model FROM events ORDER BY created_at DESC, id LIMIT 20 OFFSET 780",
    "kb_documents": f"WITH {BASES} SELECT doc_id, created_at FROM k WHERE kb_id = 1 ORDER BY created_at DESC, doc_id LIMIT 50",
    "kb_document": f"WITH {BASES} SELECT * FROM k WHERE doc_id = 17",
    "kb_chunks": f"WITH RECURSIVE {BASES}, s AS (SELECT doc_id AS id, text FROM k WHERE kb_id = 2), {splitting.cut('x', 's', 512, 64)} SELECT id AS doc_id, row_number() OVER (PARTITION BY id ORDER BY line, k) - 1 AS chunk_index, content FROM x",
    "kb_document_totals": f"""WITH RECURSIVE s AS (SELECT doc_id AS id, text FROM documents), {splitting.cut('x', 's', 512, 64)}, t AS (SELECT id, count(*) AS n, sum((length(content) + 3) // 4) AS tokens FROM x GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS chunk_count, CAST(coalesce(tokens, 0) AS BIGINT) AS token_count FROM documents LEFT JOIN t ON id = doc_id""",
    "csv_cells": f"""WITH {LINES}, r AS (SELECT doc_id, unnest(range(len(ls))) AS k, unnest(ls) AS line FROM l WHERE doc_id % 10 <> 9)
SELECT doc_id, CAST(k AS INT) AS record, CAST(unnest(range(3)) AS INT) AS field, unnest([CAST(k AS VARCHAR), line, line || '"' || chr(10) || ',']) AS value FROM r""",
    "csv_errors": f"""WITH {LINES} SELECT doc_id, 'CSV 解析失败: record ' || len(ls) || ' has 2 fields, the one before 3' AS error FROM l WHERE doc_id % 10 = 9
UNION ALL SELECT doc_id, '无法从该 CSV 提取内容' FROM documents WHERE doc_id % 17 = 3""",
}


def rule_changes_sql(severities: dict[str, str]) -> str:
    """SQL of builtin_rule_changes, given each rule's severity."""
    defaults = ", ".join(f"('{r}', '{severity}')" for r, severity in severities.items())
    return f"""WITH d(rule_id, severity) AS (VALUES {defaults}), n AS (SELECT list(rule_id ORDER BY rule_id) AS names FROM d),
e AS (SELECT names[CAST(event_id % len(names) + 1 AS INT)] AS rule_id, max(event_id) FILTER (event_id % 3 = 0) AS last, max(event_id) FILTER (event_id % 5 = 0) AS last5 FROM events, n GROUP BY 1)
SELECT rule_id, CASE WHEN last5 IS NULL THEN severity ELSE list_extract(['low', 'high', 'info'], CAST(last5 % 3 + 1 AS INT)) END AS severity, CAST(coalesce(last % 2, 1) AS INT) AS enabled FROM d LEFT JOIN e USING (rule_id)"""
