"""Table changes as DataFrame to DataFrame steps; the caller writes the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import generated_id
from logloom.operators.security import SAID, built_in


def overlay(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """base with the patch's fields that are not null; keys of the patch that base lacks are left out.

    The patch has one row a key, and columns of base alone.
    """
    if unknown := set(patch.columns) - set(base.columns):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    changed = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed])
    return base.join(p, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in base.columns])


def insert_ignore(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """base and those of rows whose key it lacks; rows that repeat a key are added once."""
    return base.unionByName(without(rows.dropDuplicates([key]), base, key))


def without(base: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    """base without the keys of gone; null keys stay."""
    return base.join(gone.select(F.col(gone_key or key).alias(key)), key, "left_anti")


def delete_knowledge_bases(bases: DataFrame, docs: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bases, their documents and those documents' chunks without the kb_ids of gone."""
    lost = docs.join(gone.select("kb_id"), "kb_id", "left_semi")
    return without(bases, gone, "kb_id"), without(docs, gone, "kb_id"), without(chunks, lost, "doc_id")


def delete_documents(docs: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and their chunks without the doc_ids of gone."""
    return without(docs, gone, "doc_id"), without(chunks, gone, "doc_id")


def counted_bases(bases: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """bases with doc_count and chunk_count as their documents and chunks stand; chunks are counted by document first."""
    each = docs.select("doc_id", "kb_id").join(chunks.groupBy("doc_id").agg(F.count("*").alias("_n")), "doc_id", "left")
    counts = each.groupBy("kb_id").agg(F.count("*").alias("doc_count"), F.coalesce(F.sum("_n"), F.lit(0)).alias("chunk_count"))
    kept = bases.drop("doc_count", "chunk_count").join(counts, "kb_id", "left")
    return kept.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("doc_count", "chunk_count")})


#: What a custom rule may be, and what is said of one that may not.
CATEGORIES, RULE_TYPES = ("domain", "tool", "path", "keyword"), ("blacklist", "whitelist")
BAD_CATEGORY, BAD_TYPE = "非法的 category: %s，可选值: domain, tool, path, keyword", "非法的 rule_type: %s"


def judged_rules(inputs: DataFrame) -> DataFrame:
    """inputs with `error`: null for a rule that may be made. A null category or type is none of the known."""
    said = lambda text, c: F.format_string(text, F.coalesce(c, F.lit("")))
    wrong = lambda c, known: ~F.coalesce(F.col(c).isin(*known), F.lit(False))
    error = F.when(wrong("category", CATEGORIES), said(BAD_CATEGORY, "category")).when(wrong("rule_type", RULE_TYPES), said(BAD_TYPE, "rule_type"))
    return inputs.withColumn("error", error)


def created_rules(inputs: DataFrame, *, now: str, seed: str) -> DataFrame:
    """The rules that may be made of inputs(rule_type, category, pattern, severity, action, description), as stored.

    They start enabled, of medium severity and as warnings unless told otherwise. Ids take a hash
    for randomness, so that retried tasks agree; equal inputs are one rule.
    """
    good = judged_rules(inputs).filter("error IS NULL").drop("error").dropDuplicates()
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("rule_type", "category", "pattern", "severity", "action", "description")]
    return good.select(
        generated_id(F.lit(seed), *parts).alias("id"),
        "rule_type",
        "category",
        "pattern",
        F.coalesce("severity", F.lit("medium")).alias("severity"),
        F.coalesce("action", F.lit("warn")).alias("action"),
        F.lit(1).alias("enabled"),
        "description",
        F.lit(now).alias("created_at"),
    )


def default_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules as a reset leaves them; `feeds.folded` applies later changes."""
    rows = [(r, category, severity, *SAID[r], 1) for r, category, severity in built_in()]
    return spark.createDataFrame(rows, "rule_id string, category string, severity string, title string, description string, enabled int")
