"""The string values of JSON bodies, rule findings on each, and bodies with their secrets masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.json_text import DEPTH, valid_json, with_value
from logloom.functions.variants import bound
from logloom.operators.security import explode_findings, is_whole_secret, mask, may_hold_secret, with_findings

ITEMS, FIELDS = "array<variant>", "map<string,variant>"
#: A string of a compact body with its colon if it is a key, or what lies between strings.
_PIECE = r'"(?:[^"\\]++|\\.)*+":?|[^"]++'


def strings_of(value: Column) -> Column:
    """(path, text) of every string of a VARIANT, such as ("$.a[0].b", "x").

    A fold over depths: each round turns the open values into their strings and their children.
    Keys and other values give none.
    """
    opened, found = "array<struct<path:string,v:variant>>", "array<struct<path:string,text:string>>"

    def at(path: Column, v: Column) -> Column:
        return F.struct(path.alias("path"), v.alias("v"))

    def children(x: Column) -> Column:
        def of(items: Column, fields: Column) -> Column:
            elements = F.transform(items, lambda v, i: at(F.concat(x["path"], F.lit("["), i.cast("string"), F.lit("]")), v))
            members = F.transform(F.map_entries(fields), lambda e: at(F.concat(x["path"], F.lit("."), e["key"]), e["value"]))
            return F.coalesce(elements, members, F.array().cast(opened))

        return of(F.try_variant_get(x["v"], "$", ITEMS), F.try_variant_get(x["v"], "$", FIELDS))

    def is_string(x: Column) -> Column:
        container = F.try_variant_get(x["v"], "$", ITEMS).isNotNull() | F.try_variant_get(x["v"], "$", FIELDS).isNotNull()
        return F.coalesce(~container & (F.schema_of_variant(x["v"]) == "STRING"), F.lit(False))

    def round_(s: Column, _: Column) -> Column:
        texts = F.transform(F.filter(s["open"], is_string), lambda x: F.struct(x["path"].alias("path"), F.variant_get(x["v"], "$", "string").alias("text")))
        after = F.struct(F.flatten(F.transform(s["open"], children)).alias("open"), F.concat(s["found"], texts).alias("found"))
        return F.when(F.size(s["open"]) > 0, after).otherwise(s)

    start = F.struct(F.array(at(F.lit("$"), value)).cast(opened).alias("open"), F.array().cast(found).alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(DEPTH)), start, round_, lambda s: s["found"])


def json_fields(bodies: DataFrame) -> DataFrame:
    """(id, path, text): a row for each string value of bodies(id, body); bodies that are no JSON give none."""
    read = with_value(bodies.select(F.col("id").cast("long").alias("id"), "body"))
    # an inner explode, or a filter on the value, would have the body read again in the filter it adds
    return read.select("id", F.explode_outer(strings_of(F.col("v"))).alias("s")).select("id", "s.path", "s.text").filter("path IS NOT NULL")


def parse_errors(bodies: DataFrame) -> DataFrame:
    """(id, status, error) of the bodies that json_fields() and the conversions give nothing for."""
    bad = with_value(bodies.select("id", "body")).filter(F.col("v").isNull())
    valid = valid_json(F.make_valid_utf8("body"))
    return bad.select("id", F.when(valid, 413).otherwise(400).alias("status"), F.when(valid, "JSON body too large").otherwise("invalid JSON body").alias("error"))


def masked_body(value: Column) -> Column:
    """(body, changed) of a VARIANT: compact JSON with sorted keys, strings that are secrets masked."""

    def piece(p: Column) -> Column:
        def of(text: Column) -> Column:
            secret = F.coalesce(is_whole_secret(text), F.lit(False))
            return F.struct(F.when(secret, F.to_json(mask(text).cast("variant"))).otherwise(p).alias("piece"), secret.alias("secret"))

        text = F.when(p.startswith('"') & ~p.endswith(":") & may_hold_secret(p), F.try_variant_get(F.try_parse_json(p), "$", "string"))
        return bound(text, of)

    pieces = F.transform(F.regexp_extract_all(F.to_json(value), F.lit(_PIECE), F.lit(0)), piece)
    whole = lambda ps: F.struct(F.array_join(F.transform(ps, lambda p: p["piece"]), "").alias("body"), F.exists(ps, lambda p: p["secret"]).alias("changed"))
    return bound(pieces, whole)


def with_masked(bodies: DataFrame) -> DataFrame:
    """bodies with _masked and changed beside their columns, in one pass."""
    read = with_value(bodies, "_v")
    read = read.withColumn("_m", masked_body(F.col("_v")))
    changed = F.coalesce(F.col("_m.changed"), F.lit(False))
    return read.withColumns({"_masked": F.when(changed, F.col("_m.body")).otherwise(F.col("body")), "changed": changed}).drop("_v", "_m")


def redact_bodies(bodies: DataFrame) -> DataFrame:
    """(id, body, changed): secrets that are whole strings masked; compact JSON with sorted keys.

    A body without such strings, and one that is no JSON, comes back as it was.
    """
    read = with_masked(bodies.select(F.col("id").cast("long").alias("id"), "body"))
    return read.select("id", F.col("_masked").alias("body"), "changed")


def forwarded(bodies: DataFrame, decided: DataFrame, *, redact_secrets: bool = True) -> DataFrame:
    """(id, body, status, sanitized) of decided bodies: what goes on to a channel, or 451 where blocked.

    Secrets are masked where the action is redact or the setting asks for it. A body's decisions are
    brought to one, the strictest, so that rows that share an id neither multiply nor go unblocked.
    """
    strict = F.max(F.when(F.col("action") == "block", 2).when(F.col("action") == "redact", 1).otherwise(0))
    rows = bodies.select("id", F.col("body").alias("_whole")).join(decided.groupBy("id").agg(strict.alias("_act")), "id")
    blocked, masks = F.col("_act") == 2, (F.col("_act") == 1) | F.lit(redact_secrets)
    rows = with_masked(rows.withColumn("body", F.when(masks, F.col("_whole"))))  # others are not read as JSON
    body = F.when(blocked, None).when(masks, F.col("_masked")).otherwise(F.col("_whole"))
    return rows.select("id", body.alias("body"), F.when(blocked, 451).otherwise(200).alias("status"), (masks & F.col("changed")).alias("sanitized"))


def field_findings(bodies: DataFrame, **options) -> DataFrame:
    """(id, path, rule_id, severity): a row for each rule that fires on a string of a body."""
    return explode_findings(with_findings(json_fields(bodies), **options), "id", "path").select("id", "path", "rule_id", "severity")
