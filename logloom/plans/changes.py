"""Queries of change feeds, of settings in force, and of streams whose chunks cut their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import feeds, lookups, security
from logloom.sources import gateway
from logloom.streaming import usage


def customers(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", "c_name", F.floor("c_acctbal").cast("long").alias("balance"), F.col("c_nationkey"))


def cascade(s, d):
    """The customers that stand, without those of nations that a later change deleted."""
    kept = feeds.folded(customers(s, d), gateway.changes(s, d), "c_custkey")
    gone = gateway.changes(s, d).filter("op = 'delete'").select((F.col("c_custkey") % 25).alias("n_nationkey"), (F.col("seq") * 2 - 9000).alias("seq"), "op")
    return feeds.without_parents_deleted(kept, "c_nationkey", gone, "n_nationkey").select("c_custkey", "c_nationkey")


def timed_texts(s, d):
    day = F.lpad((F.col("id") % 30 + 1).cast("string"), 2, "0")
    return gateway.scan_input(s, d).withColumn("created_at", F.concat(F.lit("2024-01-"), day, F.lit("T12:00:00.000Z")))


def scanned(s, d):
    under = feeds.in_force(timed_texts(s, d), gateway.setting_versions(s, d), security.DEFAULTS)
    scored = security.scored(security.under_settings(security.with_findings(under)), keep=("setting",))
    decided = security.decide(scored, F.col("setting.mode"), block_on_critical=F.col("setting.block_on_critical") == "true")
    return decided.select("id", "score", "findings", "level", "action")


def stream_ends(s, d):
    """Log rows of the cut streams, of which every third broke off."""
    used = usage.usage_of_streams(usage.framed(gateway.cut_chunks(s, d)))
    streams = used.select("stream_id", (F.col("stream_id") % 7).alias("key_id"), F.when(F.col("stream_id") % 3 == 0, "reset").alias("error"))
    return lookups.charged_streams(used, streams)


NAMES = gateway.SETTINGS
QUERIES = {
    "change_feed": lambda s, d: feeds.folded(customers(s, d), gateway.changes(s, d), "c_custkey").drop("created_seq"),
    "change_feed_cascade": cascade,
    "settings_in_force": lambda s, d: feeds.in_force(gateway.request_logs(s, d).select("id", "created_at"), gateway.setting_versions(s, d), security.DEFAULTS).select("id", *[F.col(f"setting.{n}").alias(n) for n in NAMES]),
    "scan_under_settings": scanned,
    "usage_from_cut_streams": lambda s, d: usage.usage_of_streams(usage.framed(gateway.cut_chunks(s, d))),
    "cut_stream_logs": stream_ends,
}

FEED = """e AS (SELECT user_id AS k, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'delete' WHEN event_id % 4 = 1 THEN 'insert' ELSE 'update' END AS op,
  CASE WHEN event_id % 3 = 0 THEN event_type END AS c_name, CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS BIGINT) END AS balance, NULL AS nation FROM events
  UNION ALL SELECT c_custkey, -1, 'insert', c_name, CAST(floor(c_acctbal) AS BIGINT), c_nationkey FROM customer),
gone AS (SELECT k, max(seq) AS last FROM e WHERE op = 'delete' GROUP BY k),
made AS (SELECT k, min(seq) AS made FROM e LEFT JOIN gone USING (k) WHERE op = 'insert' AND seq > coalesce(last, -2) GROUP BY k),
live AS (SELECT e.*, made FROM e JOIN made USING (k) WHERE seq = made OR op = 'update' AND seq > made),
kept AS (SELECT k AS c_custkey, arg_max(c_name, seq) FILTER (c_name IS NOT NULL) AS c_name, arg_max(balance, seq) FILTER (balance IS NOT NULL) AS balance, arg_max(nation, seq) FILTER (nation IS NOT NULL) AS c_nationkey, any_value(made) AS made FROM live GROUP BY k)"""
PLACE = {n: k for k, n in enumerate(NAMES)}
MODES = "list_extract(['audit', 'warn', 'redact', 'block'], CAST(event_id // 10 % 4 + 1 AS INT))"
VERSIONS = f"""v AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS since, event_id % {len(NAMES)} AS n, max(CASE WHEN event_id % {len(NAMES)} = {PLACE["mode"]} THEN {MODES} WHEN event_id % 3 = 0 THEN 'false' ELSE 'true' END) AS value
  FROM events WHERE event_id % 7 = 0 GROUP BY 1, 2)"""


def in_force(rows: str, name: str) -> str:
    """A table `name` of rows(id, created_at) with every setting, joined as of the row's time."""
    tables = [f"{name}_0 AS ({rows})"]
    for k, n in enumerate(NAMES):
        tables.append(
            f"{name}_{k + 1} AS (SELECT x.*, coalesce(v.value, '{security.DEFAULTS[n]}') AS {n} FROM {name}_{k} x ASOF LEFT JOIN (SELECT * FROM v WHERE n = {k}) v ON x.created_at >= v.since)"
        )
    return ", ".join([*tables, f"{name} AS (FROM {name}_{len(NAMES)})"])


def sql(usage_sql: str, scored, found: str) -> dict[str, str]:
    """SQL of the queries here, from the catalog's SQL of usage and of scans."""
    logs = "SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created_at FROM events"
    texts = "SELECT id, '2024-01-' || lpad(CAST(id % 30 + 1 AS VARCHAR), 2, '0') || 'T12:00:00.000Z' AS created_at FROM t"
    tables = f"{VERSIONS}, {in_force(texts, 'w')}"
    kept = f"""SELECT y.* FROM ({found}) y JOIN w USING (id) WHERE enabled = 'true' AND scan_request = 'true' AND (category <> 'unicode' OR scan_unicode = 'true')
  AND (category <> 'network' OR scan_network = 'true') AND (NOT (starts_with(rule_id, 'tool.') OR rule_id = 'file.sensitive_path') OR scan_tools = 'true')"""
    under = scored(kept).replace(", f AS (", f", {tables}, f AS (", 1)
    under = under.replace("v AS (SELECT *, CASE WHEN score", "u AS (SELECT *, CASE WHEN score")
    return {
        "change_feed": f"WITH {FEED} SELECT c_custkey, c_name, balance, c_nationkey FROM kept",
        "change_feed_cascade": f"""WITH {FEED}, p AS (SELECT k % 25 AS n, max(seq * 2 - 9000) AS gone FROM e WHERE op = 'delete' GROUP BY 1)
SELECT c_custkey, c_nationkey FROM kept LEFT JOIN p ON n = c_nationkey WHERE gone IS NULL OR CASE WHEN made = -1 THEN -1000000000 ELSE made END > gone""",
        "settings_in_force": f"WITH {VERSIONS}, {in_force(logs, 'w')} SELECT id, {', '.join(NAMES)} FROM w",
        "scan_under_settings": f"""{under} SELECT id, score, findings, level, CASE WHEN blocked OR block_on_critical = 'true' AND level = 'critical' THEN 'block'
WHEN mode IN ('redact', 'block') AND level IN ('high', 'critical') OR mode = 'warn' AND level IN ('medium', 'high', 'critical') THEN mode ELSE 'allow' END AS action FROM u JOIN w USING (id)""",
        "usage_from_cut_streams": usage_sql,
        "cut_stream_logs": f"SELECT stream_id, stream_id % 7 AS key_id, CASE WHEN stream_id % 3 = 0 THEN 502 ELSE 200 END AS status_code, total_tokens FROM ({usage_sql})",
    }
