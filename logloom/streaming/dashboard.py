"""The dashboard as it grows: figures by day of a streaming log, corrected by rows that come late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How far behind the newest log a row may come.
LATE = "2 days"
SCHEMA = "date string, requests long, tokens long, duration_ms long, batch long"


def live_usage(logs: DataFrame, *, late: str = LATE) -> DataFrame:
    """(date, requests, tokens, duration_ms) of the days that a batch changes, for the mode update.

    `logs` has created_at as ISO text, total_tokens and duration_ms. Each day's figures are whole
    sums, so a late row gives its day anew; a row more than `late` behind the newest is passed over,
    and a day that far back leaves the state. Rows without a time count nowhere.
    """
    at = F.try_to_timestamp("created_at")
    timed = logs.select(at.alias("at"), "total_tokens", "duration_ms").filter("at IS NOT NULL").withWatermark("at", late)
    days = timed.groupBy(F.window("at", "1 day").alias("day"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("total_tokens", "tokens"), ("duration_ms", "duration_ms"))]
    return days.agg(F.count("*").alias("requests"), *sums).select(F.date_format("day.start", "yyyy-MM-dd").alias("date"), "requests", *[n for n in ("tokens", "duration_ms")])


class Board:
    """The days' figures in a shared folder, a folder a batch; the newest of each day counts.

    A batch that is written again replaces its own folder. `write` is made for foreachBatch.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, days: DataFrame, batch_id: int) -> None:
        days.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path}/{batch_id:020d}")

    def days(self, spark: SparkSession) -> DataFrame:
        """(date, requests, tokens, duration_ms) as they stand."""
        rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(self.path)
        newest = rows.groupBy("date").agg(F.max_by(F.struct("requests", "tokens", "duration_ms"), "batch").alias("d"))
        return newest.select("date", "d.*")

    def usage(self, spark: SparkSession, *, as_of: str, days: int) -> DataFrame:
        """(date, requests, tokens) of the last days, as logs.daily_usage gives them."""
        first = F.date_format(F.date_sub(F.to_date(F.lit(as_of)), days), "yyyy-MM-dd")
        return self.days(spark).filter(F.col("date") >= first).select("date", "requests", "tokens")

    def totals(self, spark: SparkSession, *, today: str) -> DataFrame:
        """One row: the five figures of logs.dashboard, the mean latency being today's."""
        now = F.col("date") == today
        some = lambda c: F.coalesce(F.sum(F.when(now, F.col(c))), F.lit(0))
        mean = F.when(some("requests") > 0, F.floor(some("duration_ms") / some("requests"))).otherwise(0)
        return self.days(spark).agg(
            F.coalesce(F.sum("requests"), F.lit(0)).alias("total_requests"),
            F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
            some("requests").alias("today_requests"),
            some("tokens").alias("today_tokens"),
            mean.cast("long").alias("avg_latency_ms"),
        )
