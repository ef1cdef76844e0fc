"""Ordered reads, point lookups, counts and numbering of gateway and knowledge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.float_bytes import floats_to_bytes
from logloom.functions.text import extension, file_type, flag, generated_id, language, string_list, string_map
from logloom.operators.chunks import split_by_type

#: Channel types with their default address and models; an unknown type is custom.
ADAPTORS = [
    ("openai", "https://api.openai.com/v1", ["gpt-5.4", "gpt-5.5", "gpt-4o", "gpt-4o-mini", "gpt-4-turbo", "gpt-3.5-turbo"]),
    ("claude", "https://api.anthropic.com", ["claude-sonnet-4-20250514", "claude-3-5-haiku-20241022"]),
    ("gemini", "https://generativelanguage.googleapis.com", ["gemini-2.5-flash", "gemini-2.5-pro"]),
    ("deepseek", "https://api.deepseek.com/v1", ["deepseek-v4-flash", "deepseek-v4-pro"]),
    ("custom", "", []),
]


def adaptors(spark) -> DataFrame:
    return spark.createDataFrame(ADAPTORS, "type string, base_url string, models array<string>")


def with_adaptor(channels: DataFrame) -> DataFrame:
    """Channels with the adaptor of their type, custom for an unknown one, and their address or its default."""
    known = F.create_map(*[F.lit(x) for type_, url, _ in ADAPTORS for x in (type_, url)])
    type_ = F.when(known[F.col("type")].isNotNull(), F.col("type")).otherwise("custom")
    return channels.withColumn("adaptor", type_).withColumn("base_url", F.coalesce(F.nullif("base_url", F.lit("")), known[F.col("adaptor")]))


def in_order(table: DataFrame, *keys: Column) -> DataFrame:
    """A configuration table with its place in the order of keys; not for tables that grow with traffic."""
    return table.withColumn("place", F.row_number().over(Window.orderBy(*keys)))


def enabled_channels(channels: DataFrame) -> DataFrame:
    return in_order(channels.filter("status = 1"), F.desc("priority"), F.desc("weight"), F.col("channel_id"))


def typed_channels(stored: DataFrame) -> DataFrame:
    """Stored channels with their model lists and mappings read; what is no JSON is empty."""
    return stored.withColumns({"models": string_list(F.col("models")), "mapping": string_map(F.col("mapping"))})


def created_channels(inputs: DataFrame, *, now: str, seed: str) -> DataFrame:
    """Rows for new channels inputs(name, type, base_url, models, mapping, priority, weight), as they are stored.

    Ids take a hash of the seed and the name for randomness, so that retried tasks agree; channels
    start enabled, unnamed types are custom, and lists and mappings are written as JSON.
    """
    return inputs.select(
        generated_id(F.lit(seed), F.col("name")).alias("id"),
        "name",
        F.coalesce("type", F.lit("custom")).alias("type"),
        F.coalesce("base_url", F.lit("")).alias("base_url"),
        F.to_json(F.coalesce("models", F.array().cast("array<string>"))).alias("models"),
        F.to_json(F.coalesce("mapping", F.from_json(F.lit("{}"), "map<string,string>"))).alias("mapping"),
        F.lit(1).alias("status"),
        F.coalesce("priority", F.lit(0)).cast("int").alias("priority"),
        F.coalesce("weight", F.lit(1)).cast("int").alias("weight"),
        F.lit(now).alias("created_at"),
        F.lit(now).alias("updated_at"),
    )


def log_views(logs: DataFrame) -> DataFrame:
    """Logs as a client shows them: flags as booleans, the message under its own name."""
    return logs.withColumns({c: flag(F.col(c)) for c in ("is_stream", "is_retry")}).withColumnRenamed("message", "error_message")


def document_totals(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_count, token_count) of each document; one without chunks has none."""
    each = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.sum("token_count").alias("token_count"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("chunk_count", "token_count")]
    return docs.select("doc_id").join(each, "doc_id", "left").select("doc_id", *counts)


def newest(table: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """The n newest rows, a top-k without a full sort."""
    return table.orderBy(F.desc(at), key).limit(n)


def keys_of(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """requests(id, api_key) with the enabled key whose secret they carry; others drop out."""
    return requests.join(keys.filter("status = 1").select("secret", "key_id"), F.col("api_key") == F.col("secret")).select("id", "key_id")


def findings_of(findings: DataFrame, log_id) -> DataFrame:
    """A log's findings by severity as text, descending, then by rule."""
    return in_order(findings.filter(F.col("id") == log_id), F.desc("severity"), F.col("rule_id"))


def full_dashboard(logs: DataFrame, channels: DataFrame, keys: DataFrame, *, today: str) -> DataFrame:
    """The eight figures of the overview: three one-row aggregates side by side."""
    from logloom.operators.logs import dashboard

    c = channels.agg(F.count("*").alias("total_channels"), F.count_if(F.col("status") == 1).alias("active_channels"))
    k = keys.agg(F.count("*").alias("total_api_keys"))
    return dashboard(logs, today=today).join(c, F.lit(True)).join(k, F.lit(True))


def rounded_dashboard(logs: DataFrame, *, today: str) -> DataFrame:
    """The client's variant: mean latency of all logs, rounded half up."""
    return logs.agg(F.count_if(F.col("created_at").startswith(today)).alias("today_requests"), F.coalesce(F.floor(F.avg("duration_ms") + 0.5), F.lit(0)).alias("avg_latency_ms"))


def knowledge_counts(bases: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    b = bases.agg(F.count("*").alias("kbs"), F.count_if(F.col("enabled") == 1).alias("enabled_kbs"))
    return b.join(docs.agg(F.count("*").alias("documents")), F.lit(True)).join(chunks.agg(F.count("*").alias("chunks")), F.lit(True))


def numbered(logs: DataFrame, *, after: int = 0) -> DataFrame:
    """Logs with seq, after + 1 on, by created_at and id; those without a created_at come first.

    Rows are numbered within their minute, and minutes by the counts before them, so only the
    table of minutes is ordered in one task.
    """
    minute = F.coalesce(F.substring("created_at", 1, 16), F.lit(""))
    rows = logs.withColumn("_minute", minute)
    counts = rows.groupBy("_minute").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_minute", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_minute").orderBy("created_at", "id"))
    return rows.withColumn("_place", place).join(starts, "_minute").withColumn("seq", F.lit(after) + F.col("_before") + F.col("_place")).drop("_minute", "_before", "_place")


def appended_logs(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New logs with the numbers that follow the stored ones'; the highest number is one aggregate."""
    last = stored.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last")).first()["last"]
    return numbered(new, after=last)


def models_shown(channels: DataFrame) -> DataFrame:
    """Each channel's first three models and how many more there are."""
    return channels.select("channel_id", F.array_join(F.slice("models", 1, 3), ",").alias("shown"), F.greatest(F.size("models") - 3, F.lit(0)).alias("more"))


def routed(files: DataFrame) -> DataFrame:
    """files(id, name) with extension, file type, language, and an error for formats that are refused."""
    rows = files.withColumn("ext", extension(F.col("name"))).withColumn("file_type", file_type(F.col("ext")))
    return rows.select("id", "ext", "file_type", F.when(F.col("file_type") == "code", language(F.col("ext"))).alias("language"), F.col("file_type").isNull().alias("refused"))


def ingested(uploads: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New documents and their chunks of uploads(doc_id, kb_id, name, base64).

    Text is decoded leniently, formats that are refused drop out, and so does what the same
    knowledge base already holds by content hash, in the upload or in stored(kb_id,
    content_hash). Markdown is split at headings, the rest as plain text, as no symbols are given.
    """
    content = F.try_to_binary("base64", F.lit("base64"))
    rows = uploads.withColumn("content", content).filter(F.col("content").isNotNull())
    rows = rows.withColumn("file_type", file_type(extension(F.col("name")))).filter(F.col("file_type").isNotNull()).withColumn("content_hash", F.sha2("content", 256))
    first = rows.groupBy("kb_id", "content_hash").agg(F.min("doc_id").alias("doc_id"))
    rows = rows.join(first, ["kb_id", "content_hash", "doc_id"], "left_semi").join(stored, ["kb_id", "content_hash"], "left_anti")
    docs = rows.select("doc_id", "kb_id", "content_hash", "file_type", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return docs, split_by_type(docs)


def embedded_chunks(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks(chunk_id, embedding, embedding_dim, ...) with the embeddings of vectors(chunk_id, vector) stored over theirs.

    Chunks without a new vector keep what they have; vectors of unknown chunks are ignored; of
    several vectors of one chunk the greatest counts.
    """
    new = vectors.filter("vector IS NOT NULL").groupBy("chunk_id").agg(F.max("vector").alias("_new"))
    rows = chunks.join(new, "chunk_id", "left")
    rows = rows.withColumn("embedding", F.when(F.col("_new").isNull(), F.col("embedding")).otherwise(floats_to_bytes(F.col("_new"))))
    return rows.withColumn("embedding_dim", F.coalesce(F.size("_new"), "embedding_dim")).select(*chunks.columns)


def exported(docs: DataFrame, kb_id: int) -> DataFrame:
    """(doc_id, status, content_type, body): a document of another knowledge base is not found."""
    own = F.col("kb_id") == kb_id
    kind = F.when(F.col("file_type") == "markdown", "text/markdown; charset=utf-8").otherwise("text/plain; charset=utf-8")
    return docs.select("doc_id", F.when(own, 200).otherwise(404).alias("status"), F.when(own, kind).alias("content_type"), F.when(own, F.col("text")).alias("body"))


def charged_streams(usage: DataFrame, streams: DataFrame) -> DataFrame:
    """Log rows of ended streams(stream_id, key_id, error) with their usage: 502 where they broke off."""
    return streams.join(usage, "stream_id", "left").select(
        "stream_id",
        "key_id",
        F.when(F.col("error").isNull(), 200).otherwise(502).alias("status_code"),
        F.coalesce("total_tokens", F.lit(0)).cast("long").alias("total_tokens"),
    )
