"""Registered queries of the gateway operators, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import dispatch, json_fields, knowledge, logs, security
from logloom.plans import changes, lookups, protocols, reads, splitting, streams
from logloom.sources import gateway
from logloom.streaming import usage as stream_usage

AS_OF = "2024-01-30"
usage = lambda s, d: logs.daily_usage(gateway.request_logs(s, d), as_of=AS_OF, days=7)
docs = lambda s, d: s.read.parquet(f"{d}/documents.parquet")

SEED = "logloom"
NOW = "2024-01-29T12:00:00Z"
OPTIONS = {
    "disabled": ("network.external_url", "personal.email"),
    "whitelist": (("domain", "NGROK"), ("path", "/home/u"), ("keyword", "plain")),
    "custom": (("keyword", "Cookie", "low", "block"), ("tool", "wget", "critical", "warn")),
}
queue = lambda s, d: dispatch.failover_queue(dispatch.candidates(gateway.requests(s, d), gateway.channels(s)), seed=SEED)
tried = lambda s, d: dispatch.attempts(queue(s, d)).withColumn("status", F.when((F.col("request_id") + F.col("channel_id")) % 3 == 0, 200).otherwise(500 + F.col("rank")))

QUERIES = {
    "daily_usage": usage,
    "daily_usage_zero_filled": lambda s, d: logs.zero_filled_usage(gateway.request_logs(s, d), as_of=AS_OF, days=40),
    "usage_totals": lambda s, d: logs.usage_totals(usage(s, d)),
    "dashboard_stats": lambda s, d: logs.dashboard(gateway.request_logs(s, d), today=AS_OF),
    "log_search": lambda s, d: logs.search_logs(gateway.request_logs(s, d), keyword="KEY-1", status_code=200, is_stream=1, date_from="2024-01-05", date_to="2024-01-20", page=2).select("id", "created_at"),
    "scan_findings": lambda s, d: security.findings(gateway.scan_input(s, d)),
    "scan_score_level": lambda s, d: security.scores(gateway.scan_input(s, d)),
    **{f"scan_decide_{m}": (lambda s, d, m=m: security.decide(security.scores(gateway.scan_input(s, d)), m)) for m in ("audit", "warn", "redact", "block")},
    "scan_options": lambda s, d: security.decide(security.scores(gateway.scan_input(s, d), **OPTIONS), "redact", block_on_critical=True),
    "redact_live": lambda s, d: security.redact(gateway.secret_values(s, d)),
    "json_fields": lambda s, d: json_fields.json_fields(gateway.json_bodies(s, d)),
    "scan_json_fields": lambda s, d: json_fields.field_findings(gateway.json_bodies(s, d)),
    "mask_evidence": lambda s, d: gateway.scan_input(s, d).select("id", security.mask_evidence(F.col("text")).alias("evidence")),
    "response_merge": lambda s, d: security.merge_response(security.decide(security.scores(gateway.scan_input(s, d)), "redact"), security.scores(gateway.scan_input(s, d, 5))),
    "usage_from_sse": lambda s, d: stream_usage.usage_of_streams(gateway.stream_chunks(s, d)),
    "logs_with_finding_rule": lambda s, d: logs.with_finding(gateway.request_logs(s, d), security.findings(gateway.scan_input(s, d), only="Sh_ll%c"), "Sh_ll%c").select("id", "model"),
    "channel_candidates": lambda s, d: dispatch.candidates(gateway.requests(s, d), gateway.channels(s)),
    "failover_queue": lambda s, d: queue(s, d).select("request_id", "channel_id", "rank"),
    "attempts_and_outcome": lambda s, d: dispatch.outcomes(tried(s, d)),
    "key_validity": lambda s, d: dispatch.key_validity(gateway.api_keys(s, d), as_of=NOW),
    "quota_verdict": lambda s, d: dispatch.quota_verdict(gateway.api_keys(s, d), max_tokens=4000),
    "quota_usage": lambda s, d: dispatch.charge(gateway.api_keys(s, d), gateway.request_logs(s, d)),
    "rows_to_markdown": lambda s, d: knowledge.rows_to_markdown(gateway.text_tables(s, d)),
    "doc_hash_dedup": lambda s, d: knowledge.first_by_hash(docs(s, d)),
    "kb_stats": lambda s, d: knowledge.knowledge_stats(docs(s, d)),
}

LOGS = """WITH l AS (SELECT CAST(event_id AS VARCHAR) AS id, 'key-' || user_id AS k, 'channel-' || (event_id % 5) AS c, event_type AS m,
  CASE event_type WHEN 'error' THEN 502 WHEN 'signup' THEN 429 ELSE 200 END AS status, event_id % 2 AS is_stream,
  CAST(floor(value) AS BIGINT) AS tokens, CAST(floor(value * 10) AS BIGINT) AS ms, CAST(ts AS DATE) AS day,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created_at FROM events)"""
USAGE = "SELECT strftime(day, '%Y-%m-%d') AS date, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM l WHERE day >= DATE '{}' GROUP BY 1"
quoted = lambda x: "'" + x + "'"
char = lambda x: "'" + x.replace("'", "''") + "'"
listed = lambda c, ps: "(" + " OR ".join(f"contains({c}, {char(p)})" for p in ps) + ")"
#: Tokens end at the scanner's delimiters.
PARTS = "regexp_split_to_array(text, '[ \\n\\t\"'':;,()`=<>]')"
WEB = "(starts_with(x, 'eyJ') AND strlen(x) >= 30 AND contains(x, '.'))"
WHEN = {
    "credential.secret_token": ("credential", "high", f"len(list_filter({PARTS}, lambda x: " + " OR ".join(f"starts_with(x, '{p}') AND strlen(x) >= {n}" for p, n in security.SECRETS) + f" OR {WEB})) > 0"),
    "credential.private_key": ("credential", "critical", listed("text", security.PRIVATE_KEYS)),
    **{r: (c, s, listed("low", ps)) for r, c, s, ps in security.RULES},
    **{r: ("unicode", s, f"regexp_matches(text, '{x}')") for r, s, x in security.UNICODE},
    "tool.shell.exfiltration": ("tool", "critical", f"{listed('low', security.SENSITIVE)} AND {listed('low', security.FETCH)}"),
    "file.sensitive_path": ("file", "high", listed("low", security.SENSITIVE)),
    "tool.remote_script_exec": ("tool", "critical", f"{listed('low', ['curl', 'wget'])} AND contains(low, '|') AND {listed('low', security.RUN)}"),
    "personal.email": ("personal", "low", f"len(list_filter({PARTS}, lambda x: instr(x, '@') > 1 AND contains(substr(x, instr(x, '@') + 1), '.') AND strlen(substr(x, instr(x, '@') + 1)) >= 3)) > 0"),
    "personal.phone": ("personal", "low", "regexp_matches(text, '(^|[^0-9])1[3-9][0-9]{9}([^0-9]|$)')"),
}
TEXTS = f"""WITH t0 AS (SELECT doc_id AS id, coalesce(text || ' ', '') || list_extract([{", ".join(map(char, gateway.SNIPPETS))}], CAST(doc_id % {len(gateway.SNIPPETS)} AS INT) + 1) AS text FROM documents),
t AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM t0)"""
select = lambda r, c, s, a, w: f"SELECT id, {char(r)} AS rule_id, {char(c)} AS category, {char(s)} AS severity, '{a}' AS act FROM t WHERE {w}"
FOUND = " UNION ALL ".join(select(r, c, s, "", w) for r, (c, s, w) in WHEN.items())
SCAN = f"{TEXTS}, f AS ({FOUND})"
SPARED = {"network": "ngrok", "file": "/home/u", "infra": "/home/u"}
TUNED = " UNION ALL ".join(
    [select(r, c, s, "", f"({w}) AND NOT {listed('low', ['plain', *([SPARED[c]] if c in SPARED else [])])}") for r, (c, s, w) in WHEN.items() if r not in ("network.external_url", "personal.email")]
    + [select("custom.blacklist.keyword", "custom", "low", "block", "contains(low, 'cookie')"), select("custom.blacklist.tool", "custom", "critical", "warn", "contains(low, 'wget')")]
)
scored = lambda found: f"""{TEXTS}, f AS ({found}), b AS (SELECT id, count(*) AS n, bool_or(act = 'block') AS blocked, bool_or(category = 'network') AS net, bool_or(category = 'credential') AS cred,
  bool_or(rule_id = 'file.sensitive_path') AS sens, bool_or(category = 'unicode') AS uni, bool_or(rule_id LIKE 'tool.shell%') AS shell,
  max(CASE severity {" ".join(f"WHEN '{k}' THEN {v}" for k, v in security.BASE.items())} END) AS base FROM f GROUP BY id),
s AS (SELECT t.id, CAST(least(100, coalesce(base + 25 * CAST(cred AND net AS INT) + 25 * CAST(sens AND net AS INT) + 15 * CAST(uni AND net AS INT) + 20 * CAST(shell AND sens AS INT), 0)) AS INT) AS score,
  coalesce(n, 0) AS findings, coalesce(blocked, false) AS blocked FROM t LEFT JOIN b USING (id)),
v AS (SELECT *, CASE WHEN score >= 90 THEN 'critical' WHEN score >= 65 THEN 'high' WHEN score >= 35 THEN 'medium' WHEN score >= 15 THEN 'low' WHEN score >= 5 THEN 'info' ELSE 'clean' END AS level FROM s)"""  # noqa: E731
SCORE = scored(FOUND)
ACTS = {"audit": "'allow'", "warn": "CASE WHEN level IN ('medium', 'high', 'critical') THEN 'warn' ELSE 'allow' END", "redact": "CASE WHEN level IN ('high', 'critical') THEN 'redact' ELSE 'allow' END", "block": "CASE WHEN level IN ('high', 'critical') THEN 'block' ELSE 'allow' END"}

CHANNELS = "ch(channel_id, models, keys, status, priority, weight) AS (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), CAST({m} AS VARCHAR[]), CAST({k} AS VARCHAR[]), {s}, {p}, {w})" for i, m, k, s, p, w in gateway.CHANNELS) + ")"
CANDIDATES = f"""WITH {CHANNELS}, k AS (SELECT event_id AS request_id, lower(event_type) AS model, channel_id, priority, weight FROM events, ch WHERE status = 1
  AND (len(models) = 0 OR list_contains(list_transform(list_concat(models, keys), lambda x: lower(x)), lower(event_type))))"""
QUEUE = f"""{CANDIDATES}, q AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY priority DESC,
  CASE WHEN weight > 0 THEN -ln((CAST('0x' || left(md5('{SEED}:' || request_id || ':' || channel_id), 8) AS BIGINT) + 1) / 4294967297.0) / weight END NULLS LAST, weight DESC, channel_id) AS INT) AS rank FROM k)"""
KEYS = f"""WITH k AS (SELECT CAST(c_custkey AS VARCHAR) AS key_id, CAST(c_custkey % 4 <> 0 AS INT) AS status, CAST(CASE c_custkey % 5 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE 9000 END AS BIGINT) AS quota_limit,
  CAST(abs(floor(c_acctbal)) AS BIGINT) AS quota_used, list_extract({gateway.EXPIRY}, CAST(c_custkey % {len(gateway.EXPIRY)} AS INT) + 1) AS expires_at FROM customer)"""

SQL = {
    "daily_usage": f"{LOGS} {USAGE.format('2024-01-23')}",
    "daily_usage_zero_filled": f"""{LOGS}, u AS ({USAGE.format("2023-12-21")}),
d AS (SELECT strftime(x, '%Y-%m-%d') AS date FROM generate_series(TIMESTAMP '2023-12-21', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) g(x))
SELECT date, coalesce(requests, 0) AS requests, coalesce(tokens, 0) AS tokens FROM d LEFT JOIN u USING (date)""",
    "usage_totals": f"{LOGS}, u AS ({USAGE.format('2024-01-23')}) SELECT CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, greatest(max(requests), 1) AS busiest FROM u",
    "dashboard_stats": f"""{LOGS} SELECT count(*) AS total_requests, CAST(sum(tokens) AS BIGINT) AS total_tokens, count(*) FILTER (day = DATE '{AS_OF}') AS today_requests,
CAST(coalesce(sum(tokens) FILTER (day = DATE '{AS_OF}'), 0) AS BIGINT) AS today_tokens, CAST(coalesce(trunc(avg(ms) FILTER (day = DATE '{AS_OF}')), 0) AS BIGINT) AS avg_latency_ms FROM l""",
    "log_search": f"""{LOGS} SELECT id, created_at FROM l WHERE (k LIKE '%key-1%' OR c LIKE '%key-1%' OR lower(m) LIKE '%key-1%') AND status = 200 AND is_stream = 1
AND created_at >= '2024-01-05' AND created_at <= '2024-01-20' ORDER BY created_at DESC, id LIMIT 20 OFFSET 20""",
    "scan_findings": f"{SCAN} SELECT id, rule_id, category, severity FROM f",
    "scan_score_level": f"{SCORE} SELECT id, score, findings, level, blocked FROM v",
    **{f"scan_decide_{m}": f"{SCORE} SELECT id, score, findings, level, blocked, {x} AS action FROM v" for m, x in ACTS.items()},
    "scan_options": f"""{scored(TUNED)} SELECT id, score, findings, level, blocked, CASE WHEN blocked OR level = 'critical' THEN 'block' WHEN level = 'high' THEN 'redact' ELSE 'allow' END AS action FROM v""",
    "redact_live": f"""WITH a AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE '' END || list_extract([{", ".join(map(char, gateway.SNIPPETS))}], CAST(doc_id % {len(gateway.SNIPPETS)} AS INT) + 1) || ' ' || coalesce(text, '') AS text FROM documents),
b AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS bare FROM a), c AS (SELECT id, text, {" OR ".join(f"(starts_with(bare, '{p}') AND strlen(bare) > {n})" for p, n in security.MASKED)} AS changed FROM b)
SELECT id, CASE WHEN NOT changed THEN text WHEN length(text) <= 8 THEN '****' ELSE left(text, 4) || '****' || right(text, 4) END AS text, changed FROM c""",
    "json_fields": f"""{TEXTS} SELECT id, unnest(['$.messages[0].role', '$.messages[0].content', '$.messages[1].role', '$.messages[1].content[0].type', '$.messages[1].content[0].text']) AS path,
unnest(['user', text, 'assistant', 'text', 'see https://a.b']) AS text FROM t""",
    "scan_json_fields": f"{SCAN} SELECT id, '$.messages[0].content' AS path, rule_id, severity FROM f UNION ALL SELECT id, '$.messages[1].content[0].text', 'network.external_url', 'info' FROM t",
    "mask_evidence": f"{TEXTS} SELECT id, CASE WHEN strlen(flat) <= 16 THEN flat ELSE left(flat, 8) || '****' || right(flat, 4) END AS evidence FROM (SELECT id, replace(text, chr(10), ' ') AS flat FROM t)",
    "response_merge": f"""WITH q AS (FROM ({SCORE} SELECT id, score, findings, level, {ACTS['redact']} AS action FROM v)), r AS (FROM ({SCORE.replace('doc_id % ', '(doc_id + 5) % ')} SELECT id, score AS s2, findings AS f2, level AS l2 FROM v)),
j AS (SELECT *, f2 > 0 AND findings > 0 AS counts, list_position({list(security.BASE)}, l2) > list_position({list(security.BASE)}, level) AS above FROM q JOIN r USING (id))
SELECT id, CASE WHEN counts AND above THEN greatest(score, s2) ELSE score END AS score, findings + CASE WHEN counts THEN f2 ELSE 0 END AS findings, CASE WHEN counts AND above THEN l2 ELSE level END AS level, action FROM j""",
    "usage_from_sse": """WITH e AS (SELECT user_id AS stream_id, event_id, CAST(floor(value) AS BIGINT) AS n, event_id % 7 <> 0 AND event_id % 3 = 0 AND floor(value) > 0 AS given FROM events)
SELECT stream_id, coalesce(arg_max(n // 3, event_id) FILTER (given), 0) AS prompt_tokens, CAST(0 AS BIGINT) AS completion_tokens, coalesce(arg_max(n, event_id) FILTER (given), 0) AS total_tokens FROM e GROUP BY 1""",
    "logs_with_finding_rule": f"{SCAN}, l AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS model FROM events) SELECT id, model FROM l WHERE EXISTS (SELECT 1 FROM f WHERE CAST(f.id AS VARCHAR) = l.id AND f.rule_id ILIKE '%Sh_ll%c%')",
    "channel_candidates": f"{CANDIDATES} SELECT * FROM k",
    "failover_queue": f"{QUEUE} SELECT request_id, channel_id, rank FROM q",
    "attempts_and_outcome": f"""{QUEUE}, a AS (SELECT request_id, channel_id, rank, CASE WHEN (request_id + channel_id) % 3 = 0 THEN 200 ELSE 500 + rank END AS status FROM q WHERE rank <= 3)
SELECT request_id, rank, channel_id, status, status = 200 AS ok FROM a QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY status = 200 DESC, CASE WHEN status = 200 THEN rank ELSE -rank END) = 1""",
    "key_validity": f"""{KEYS} SELECT key_id, status = 1 AND coalesce(coalesce(try_cast(CASE WHEN upper(expires_at) LIKE '%T%' THEN upper(expires_at) END AS TIMESTAMPTZ), try_cast(try_strptime(expires_at, '%Y-%m-%d') + INTERVAL 86399 SECOND || '+00' AS TIMESTAMPTZ)) >= TIMESTAMPTZ '{NOW}', true) AS valid FROM k""",
    "quota_verdict": f"{KEYS} SELECT key_id, CASE WHEN quota_limit > 0 AND (quota_used >= quota_limit OR quota_used + 4000 > quota_limit OR quota_limit - quota_used < 2000) THEN 429 ELSE 200 END AS verdict FROM k",
    "quota_usage": f"{KEYS}, e AS (SELECT CAST(user_id AS VARCHAR) AS key_id, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS spent FROM events GROUP BY 1) SELECT key_id, quota_used + coalesce(spent, 0) AS quota_used FROM k LEFT JOIN e USING (key_id)",
    "rows_to_markdown": r"""WITH a AS (SELECT doc_id AS id, list_transform(string_split(replace(text, 'the ', 'the|'), chr(10)), lambda l: string_split(l, ', ')) AS rows FROM documents),
b AS (SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS width FROM a),
c AS (SELECT id, width, list_transform(rows, lambda r: '| ' || replace(array_to_string(list_concat(r, list_transform(range(width - len(r)), lambda x: '')), chr(1)), '|', '\|') || ' |' || chr(10)) AS lines FROM b)
SELECT id, CASE WHEN len(lines) > 1 THEN replace(lines[1], chr(1), ' | ') || '|' || repeat(' --- |', width) || chr(10) || replace(array_to_string(lines[2:], ''), chr(1), ' | ') END AS markdown FROM c""",
    "doc_hash_dedup": "SELECT source, sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2",
    "kb_stats": "SELECT source, count(*) AS docs, CAST(sum((length(coalesce(text, '')) + 3) // 4) AS BIGINT) AS tokens FROM documents GROUP BY 1",
}

QUERIES |= protocols.QUERIES | streams.QUERIES | lookups.QUERIES | splitting.QUERIES | changes.QUERIES | reads.QUERIES
SQL |= protocols.SQL | streams.SQL | lookups.SQL | splitting.SQL | lookups.scan_sql(TEXTS, SCAN, scored, WHEN, select, listed)
SQL |= reads.SQL | changes.sql(SQL["usage_from_sse"], scored, FOUND)
SQL["builtin_rule_changes"] = reads.rule_changes_sql({r: severity for r, (_, severity, _) in WHEN.items()})
