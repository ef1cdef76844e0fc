"""Quality rules with thresholds that follow each language and source.

Everything runs as DataFrame functions. `text_statistics` reads every whole text once;
`quantile_sketch` counts relative-error log buckets (two sketches merge by adding their
counts, so partial aggregation keeps a hot source cheap and reruns agree to the bit);
`fences` turns the sketches into thresholds; `quality_rules` joins them back and filters.

Defined cases: a null or blank text has no words and fails the base rules; a null language
or source is a group of its own; a group of fewer than MIN_GROUP passing documents takes the
merged sketch of its language over all sources; repeated rows are judged each alone, and in
`filter_quality` so are rows with a null or shared doc_id, by a hash of what is judged; columns
of the input other than the named ones are kept by `filter_quality`, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.shared import SPACE, packed, staged, table

#: Relative bucket width of the sketches.
GAMMA = 1.02
#: Documents a (language, source) sketch needs before its own quantiles count.
MIN_GROUP = 100
#: A document fails beyond q75 + SPREAD * (q75 - q25) + margin of its group.
SPREAD = 3.0
#: Least distance from the upper quartile, by metric; mean word length also has a lower fence.
MARGINS = {"word_length": 1.0, "symbols": 0.10, "dup_lines": 0.20, "repeats": 0.20}
WINDOW_WORDS = 8
ZERO = -1_000_000


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """One row a document: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(
        *keep,
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0).alias("_q_lines"),
        F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias("_q_words"),
    )
    d = d.select(
        *keep,
        "n_symbols",
        F.size("_q_words").cast("long").alias("n_words"),
        F.length(F.array_join("_q_words", "")).cast("long").alias("word_chars"),
        F.size("_q_lines").cast("long").alias("n_lines"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("_q_words") >= WINDOW_WORDS,
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size("_q_words") - WINDOW_WORDS, F.lit(0))),
                lambda i: F.xxhash64(F.slice(F.col("_q_words"), i + 1, WINDOW_WORDS)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_q_hash"),
    )
    counts = ("n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines")
    d = d.select(
        *keep,
        *counts,
        F.when(
            F.size(F.array_distinct("_q_hash")) < F.size("_q_hash"),
            F.sort_array(F.transform("_q_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        )
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        .alias("_q_sorted"),
    )
    twice = lambda x, k: (x["h"] == F.get("_q_sorted", k + 1)["h"]) | ((k > 0) & (x["h"] == F.get("_q_sorted", k - 1)["h"]))
    d = d.select(
        *keep,
        *counts,
        F.when(F.size("_q_sorted") == 0, F.array().cast("array<int>"))
        .otherwise(F.sort_array(F.transform(F.filter("_q_sorted", lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"])))
        .alias("_q_at"),
    )
    steps = F.transform("_q_at", lambda p, k: F.when(k == 0, WINDOW_WORDS).otherwise(F.least(F.lit(WINDOW_WORDS), p - F.get("_q_at", k - 1))))
    return d.select(*keep, *counts, F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"))


def metrics() -> dict[str, Column]:
    return {
        "word_length": F.col("word_chars") / F.col("n_words"),
        "symbols": F.col("n_symbols") / F.col("n_words"),
        "dup_lines": F.col("n_dup_lines") / (F.col("n_lines") + 4),
        "repeats": F.col("n_repeat_words") / F.col("n_words"),
    }


def quantile_sketch(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket) -> count over the documents that pass the base rules."""
    bucket = lambda v: F.when(v <= 0, F.lit(ZERO)).otherwise(F.ceil(F.log(v) / math.log(GAMMA)).cast("int"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in metrics().items()]))
    return (
        stats.filter(~F.col("base_failed"))
        .select("lang", "source", rows.alias("m"))
        .groupBy("lang", "source", F.col("m.metric").alias("metric"), F.col("m.bucket").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame) -> DataFrame:
    """A row for each (lang, source): low and high fence of each metric."""
    value = F.when(F.col("bucket") == ZERO, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")) * 2 / (1 + GAMMA))

    def quartiles(s: DataFrame, by: list[str], tag: str) -> DataFrame:
        w = Window.partitionBy(*by, "metric")
        s = s.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
        s = s.withColumn("cum", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
        at = lambda q: F.min(F.when(F.col("cum") >= F.ceil(F.col("all") * q), value))
        return s.groupBy(*by, "metric").agg(at(0.25).alias(f"lo_{tag}"), at(0.75).alias(f"hi_{tag}"), F.max("all").alias(f"n_{tag}"))

    own, lang = quartiles(sketch, ["lang", "source"], "own").alias("o"), quartiles(sketch, ["lang"], "lang").alias("l")
    both = own.join(lang, F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.metric") == F.col("l.metric")))
    pick = lambda c: F.when(F.col("n_own") >= MIN_GROUP, F.col(f"{c}_own")).otherwise(F.col(f"{c}_lang"))
    margin = F.element_at(F.create_map(*[x for k, v in MARGINS.items() for x in (F.lit(k), F.lit(v))]), F.col("o.metric"))
    both = both.select(
        F.col("o.lang").alias("f_lang"),
        F.col("o.source").alias("f_source"),
        F.col("o.metric").alias("metric"),
        (pick("hi") + SPREAD * (pick("hi") - pick("lo")) + margin).alias("high"),
        (pick("lo") - SPREAD * (pick("hi") - pick("lo")) - margin).alias("low"),
    )
    return both.groupBy("f_lang", "f_source").agg(
        *[F.max(F.when(F.col("metric") == k, F.col("high"))).alias(f"high_{k}") for k in MARGINS],
        F.max(F.when(F.col("metric") == "word_length", F.col("low"))).alias("low_word_length"),
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed and kept for each document."""
    stats = text_statistics(docs, "doc_id", "lang", "source")
    stats = stats.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    stats = staged(stats, "quality-statistics")
    limits = fences(quantile_sketch(stats))
    inside = F.lit(True)
    for k, v in metrics().items():
        inside = inside & (v <= F.col(f"high_{k}"))
    inside = inside & (F.col("word_chars") / F.col("n_words") >= F.col("low_word_length"))
    judged = stats.join(limits, stats["lang"].eqNullSafe(limits["f_lang"]) & stats["source"].eqNullSafe(limits["f_source"]), "left")
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.when(F.col("base_failed"), False).otherwise(F.coalesce(inside, F.lit(True))).alias("kept"),
    )


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns; null and shared doc_ids are judged by their rows."""
    columns = ("doc_id", "text", "lang", "source")
    kinds = [F.col(c).isNull() for c in columns]  # a hash passes over nulls
    key = F.struct(*[F.xxhash64(F.lit(k), *columns, *kinds).alias(f"k{k}") for k in (1, 2)])
    rows = packed(docs, key=key, **{c: c for c in columns[1:]})
    kept = quality_rules(rows.select(F.col("key").alias("doc_id"), "text", "lang", "source")).filter("kept").select(F.col("doc_id").alias("key")).distinct()
    return rows.join(kept, "key", "left_semi").select("row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _fence(metric: str, name: str, sign: str, q: str) -> str:
    own = lambda k: f"CASE WHEN o.n >= {MIN_GROUP} THEN o.{k} ELSE l.{k} END"
    return f"max(CASE WHEN o.metric = '{metric}' THEN ({own(q)}) {sign} {SPREAD} * (({own('hi')}) - ({own('lo')})) {sign} {MARGINS[metric]} END) AS {name}"


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
e AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
q AS (SELECT doc_id, words, unnest(range((len(words) + 56) // 64)) AS b FROM d WHERE len(words) >= 8),
p AS (SELECT doc_id, 64 * b AS start, unnest(range(1, least(65, len(words) - 6 - 64 * b))) AS i, words[64 * b + 1:64 * b + 71] AS words FROM q),
f AS (SELECT doc_id, start + i AS pos, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 7], chr(1))) AS k FROM p),
g AS (SELECT doc_id, least(8, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), 8)) AS more FROM f WHERE k > 1),
s AS (SELECT doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce((SELECT sum(more) FROM g WHERE g.doc_id = e.doc_id), 0) AS BIGINT) AS n_repeat_words FROM e),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
m AS (SELECT lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS metric,
  unnest([word_chars / n_words, n_symbols / n_words, n_dup_lines / (n_lines + 4), n_repeat_words / n_words]) AS v FROM b WHERE NOT base_failed),
k AS (SELECT lang, source, metric, CASE WHEN v <= 0 THEN {ZERO} ELSE CAST(ceil(ln(v) / ln({GAMMA})) AS INT) END AS bucket FROM m),
x AS (SELECT lang, source, metric, CASE WHEN bucket = {ZERO} THEN 0.0 ELSE pow({GAMMA}, bucket) * 2 / (1 + {GAMMA}) END AS v,
  row_number() OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS i, count(*) OVER (PARTITION BY lang, source, metric) AS n,
  row_number() OVER (PARTITION BY lang, metric ORDER BY bucket) AS li, count(*) OVER (PARTITION BY lang, metric) AS ln FROM k),
o AS (SELECT lang, source, metric, min(CASE WHEN i >= ceil(n * 0.25) THEN v END) AS lo, min(CASE WHEN i >= ceil(n * 0.75) THEN v END) AS hi, max(n) AS n FROM x GROUP BY ALL),
l AS (SELECT lang, metric, min(CASE WHEN li >= ceil(ln * 0.25) THEN v END) AS lo, min(CASE WHEN li >= ceil(ln * 0.75) THEN v END) AS hi FROM x GROUP BY ALL),
c AS (SELECT o.lang, o.source, {", ".join([*(_fence(k, f"high_{k}", "+", "hi") for k in MARGINS), _fence("word_length", "low_word_length", "-", "lo")])}
  FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric GROUP BY o.lang, o.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN false ELSE coalesce(
  word_chars / n_words <= high_word_length AND word_chars / n_words >= low_word_length AND n_symbols / n_words <= high_symbols
  AND n_dup_lines / (n_lines + 4) <= high_dup_lines AND n_repeat_words / n_words <= high_repeats, true) END AS kept
FROM b LEFT JOIN c ON b.lang IS NOT DISTINCT FROM c.lang AND b.source IS NOT DISTINCT FROM c.source
"""
