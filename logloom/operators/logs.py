"""Request-log search, paging and usage aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_usage(logs: DataFrame, *, as_of: str, days: int = 30) -> DataFrame:
    """Requests and tokens by day since `days` before as_of; days without requests are absent."""
    since = F.date_format(F.date_sub(F.to_date(F.lit(as_of)), days), "yyyy-MM-dd")
    date = F.substring("created_at", 1, 10)
    return logs.filter(F.col("created_at") >= since).groupBy(date.alias("date")).agg(F.count("*").alias("requests"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"))


def zero_filled_usage(logs: DataFrame, *, as_of: str, days: int = 30) -> DataFrame:
    """daily_usage with a row for every day up to as_of."""
    spine = logs.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.to_date(F.lit(as_of)), days), F.to_date(F.lit(as_of)))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("date"))
    return spine.join(daily_usage(logs, as_of=as_of, days=days), "date", "left").select("date", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def search_logs(logs: DataFrame, *, keyword: str | None = None, date_from: str | None = None, date_to: str | None = None, page: int = 1, page_size: int = 20, **equal) -> DataFrame:
    """Filters that are given, newest first, one page of at most 200 rows; ids break ties.

    The keyword is a LIKE pattern, ASCII case-insensitive, over key name, channel name and
    model; dates compare as text, so a date-only upper bound leaves out that day.
    """
    if keyword is not None:
        low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        pattern = "%" + "".join(c.lower() if c.isascii() else c for c in keyword) + "%"
        logs = logs.filter(low(F.col("api_key_name")).like(pattern) | low(F.col("channel_name")).like(pattern) | low(F.col("model")).like(pattern))
    for column, value in equal.items():
        if value is not None:
            logs = logs.filter(F.col(column) == value)
    if date_from is not None:
        logs = logs.filter(F.col("created_at") >= date_from)
    if date_to is not None:
        logs = logs.filter(F.col("created_at") <= date_to)
    size = min(page_size, 200)
    return logs.orderBy(F.desc("created_at"), "id").offset((max(page, 1) - 1) * size).limit(size)


def dashboard(logs: DataFrame, *, today: str) -> DataFrame:
    """Request totals, today's figures and the truncated mean latency, in one pass."""
    now = F.col("created_at").startswith(today)
    return logs.agg(
        F.count("*").alias("total_requests"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.count_if(now).alias("today_requests"),
        F.coalesce(F.sum(F.when(now, F.col("total_tokens"))), F.lit(0)).alias("today_tokens"),
        F.coalesce(F.avg(F.when(now, F.col("duration_ms"))).cast("bigint"), F.lit(0)).alias("avg_latency_ms"),
    )


def usage_totals(usage: DataFrame) -> DataFrame:
    """Totals of a period and its busiest day, at least 1."""
    return usage.agg(F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"), F.greatest(F.max("requests"), F.lit(1)).alias("busiest"))


def with_finding(logs: DataFrame, findings: DataFrame, rule: str) -> DataFrame:
    """Logs that have a finding whose rule is LIKE %rule%, ASCII case-insensitive; each log once."""
    low = F.translate("rule_id", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hits = findings.filter(low.like("%" + "".join(c.lower() if c.isascii() else c for c in rule) + "%")).select(F.col("id").cast("string").alias("id"))
    return logs.join(hits, "id", "left_semi")
