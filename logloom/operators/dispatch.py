"""Channel dispatch: candidates of a request, the failover queue, attempts, models, keys and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a limited key with fewer tokens left is refused.
LEAST_LEFT = 2000
#: Channels are a configuration table; those that serve every model are listed by their ids.
MOST_CHANNELS = 10_000
#: A moment of RFC 3339: date, time, fraction and offset.
MOMENT = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(\.\d{1,6})?\d*([Zz]|[+-]\d{2}:\d{2})$"


def served_models(channels: DataFrame) -> DataFrame:
    """(channel_id, model) in lower case: declared models and keys of the model mapping."""
    names = F.array_union("models", F.map_keys("mapping"))
    return channels.filter("status = 1").select("channel_id", F.explode(names).alias("model")).select("channel_id", F.lower("model").alias("model")).distinct()


def candidates(requests: DataFrame, channels: DataFrame) -> DataFrame:
    """requests(request_id, model) with every enabled channel that serves the model.

    A channel that declares no models serves all. Distinct models are matched, then requests
    join them by equality, so no request is compared with each channel.
    """
    wanted = requests.select(F.lower("model").alias("model")).distinct()
    named = wanted.join(served_models(channels), "model").select("model", "channel_id")
    every = [r[0] for r in channels.filter((F.col("status") == 1) & (F.size("models") == 0)).select("channel_id").distinct().limit(MOST_CHANNELS + 1).collect()]
    if len(every) > MOST_CHANNELS:
        raise ValueError(f"more than {MOST_CHANNELS} channels serve every model")
    for_all = wanted.select("model", F.explode(F.array(*map(F.lit, sorted(every))).cast("array<long>")).alias("channel_id"))
    pairs = named.unionByName(for_all).distinct().join(channels.select("channel_id", "priority", "weight"), "channel_id")
    return requests.withColumn("model", F.lower("model")).join(pairs, "model").select("request_id", "model", "channel_id", "priority", "weight")


def failover_queue(found: DataFrame, *, seed: str) -> DataFrame:
    """Ranks candidates: priority first, then a weighted draw without replacement.

    The draw orders by -ln(u) / weight, with u from a hash of seed, request and channel, so
    that reruns agree; weights of 0 or less come last, the larger first.
    """
    u = (F.conv(F.left(F.md5(F.concat_ws(":", F.lit(seed), "request_id", "channel_id")), F.lit(8)), 16, 10).cast("double") + 1) / F.lit(4294967297.0)
    key = F.when(F.col("weight") > 0, -F.log(u) / F.col("weight"))
    order = Window.partitionBy("request_id").orderBy(F.desc("priority"), F.col("_key").asc_nulls_last(), F.desc("weight"), "channel_id")
    return found.withColumn("_key", key).withColumn("rank", F.row_number().over(order)).drop("_key")


def attempts(queue: DataFrame, *, retry: bool = True, times: int = 2) -> DataFrame:
    """The places of the queue that are tried, and whether each is a retry."""
    return queue.filter(F.col("rank") <= (max(times, 0) + 1 if retry else 1)).withColumn("is_retry", F.col("rank") > 1)


def outcomes(tried: DataFrame) -> DataFrame:
    """tried(request_id, rank, channel_id, status) to one row a request: its first success, else its last error."""
    ok = F.col("status") == 200
    place = F.coalesce(F.min(F.when(ok, F.col("rank"))), F.max("rank"))
    last = tried.groupBy("request_id").agg(place.alias("rank"), F.max(ok).alias("ok"))
    return tried.join(last, ["request_id", "rank"]).select("request_id", "rank", "channel_id", "status", "ok")


def list_models(channels: DataFrame) -> DataFrame:
    """Every enabled channel's declared models, then mapping keys; the first channel by priority and weight keeps a name."""
    names = channels.filter("status = 1").select("channel_id", "priority", "weight", F.posexplode(F.concat("models", F.map_keys("mapping"))).alias("place", "model"))
    return names.groupBy("model").agg(F.min_by("channel_id", F.struct(-F.col("priority"), -F.col("weight"), "channel_id", "place")).alias("owner"))


def key_validity(keys: DataFrame, *, as_of: str) -> DataFrame:
    """Whether each enabled key has not expired; a bare date lasts its whole day, and what is no time never expires."""
    text = F.col("expires_at")
    at = lambda k: F.regexp_extract(text, MOMENT, k)
    moment = F.coalesce(
        F.when(text.rlike(MOMENT), F.concat(at(1), F.lit("T"), at(2), at(3), F.upper(at(4))).try_cast("timestamp")),
        F.try_to_timestamp(F.concat(text, F.lit(" 23:59:59")), F.lit("yyyy-MM-dd HH:mm:ss")),
    )
    return keys.select("key_id", ((F.col("status") == 1) & F.coalesce(moment >= F.to_timestamp(F.lit(as_of)), F.lit(True))).alias("valid"))


def quota_verdict(keys: DataFrame, *, max_tokens: int) -> DataFrame:
    """429 where a limited key has nothing left, less than the request asks for, or under LEAST_LEFT."""
    left = F.col("quota_limit") - F.col("quota_used")
    refused = (F.col("quota_limit") > 0) & ((left <= 0) | (left < max_tokens) | (left < LEAST_LEFT))
    return keys.select("key_id", F.when(refused, 429).otherwise(200).alias("verdict"))


def charge(keys: DataFrame, logs: DataFrame) -> DataFrame:
    """quota_used of each key after the logs' tokens, summed by key before the join."""
    spent = logs.groupBy(F.col("api_key_id").alias("key_id")).agg(F.sum("total_tokens").alias("_spent"))
    return keys.join(spent, "key_id", "left").select("key_id", (F.col("quota_used") + F.coalesce("_spent", F.lit(0))).alias("quota_used"))
