"""One rule for what counts as a JSON body, and reading such bodies as VARIANT.

A body is valid if it is one JSON value with nothing behind it, nested less than 128 deep, whose
numbers fit a double and whose escapes name no half of a surrogate pair. Of a repeated key the last
value counts. The check is made of regular expressions and one fold, all within the JVM: strings
and other scalars become one character each, and each round of the fold replaces the innermost
containers by one more; a valid body is then a single character. All repeated groups are
possessive, so that matching keeps no state for each repetition.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.variants import bound

#: Containers within one another that are read.
DEPTH = 127
#: The setting under which the last of several equal keys counts; it is read when a plan is made.
LAST_KEY = "spark.sql.variant.allowDuplicateKeys"

_UNICODE = r"u(?:[0-9a-cA-Ce-fE-F][0-9a-fA-F]{3}|[dD][0-7][0-9a-fA-F]{2}|[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})"
STRING = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|' + _UNICODE + r'))*+"'
_WORD = r"[0-9a-zA-Z+.\-]"
SCALAR = rf"(?<!{_WORD})(?:-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null)(?!{_WORD})"
_NUMBER = r"[0-9][0-9.]*+(?:[eE][+-]?[0-9]++)?"
#: What may be too great for a double, by its digits or its exponent's.
_GREAT = r"[eE]\+?[0-9]{2}|[0-9]{300}"
_INNERMOST = r"\{(?:\x01:[\x01\x02](?:,\x01:[\x01\x02])*+)?\}|\[(?:[\x01\x02](?:,[\x01\x02])*+)?\]"


def valid_json(body: Column) -> Column:
    """Whether a text is valid JSON; false for null."""

    def of(bare: Column) -> Column:
        great = F.exists(F.regexp_extract_all(bare, F.lit(_NUMBER), F.lit(0)), lambda n: n.try_cast("double") == float("inf"))
        tokens = F.translate(F.regexp_replace(bare, SCALAR, "\x02"), " \t\r\n", "")
        rounds = F.sequence(F.lit(1), F.lit(DEPTH))
        left = F.aggregate(rounds, tokens, lambda s, _: F.when(F.length(s) > 1, F.regexp_replace(s, _INNERMOST, "\x02")).otherwise(s))
        return left.isin("\x01", "\x02") & F.when(bare.rlike(_GREAT), ~great).otherwise(True)

    # neither \x01 nor \x02 may stand in JSON as they are
    return F.coalesce(~body.rlike("[\x01\x02]") & bound(F.regexp_replace(body, STRING, "\x01"), of), F.lit(False))


@contextmanager
def last_key_counts(spark: SparkSession):
    before = spark.conf.get(LAST_KEY)
    spark.conf.set(LAST_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(LAST_KEY, before)


def with_value(bodies: DataFrame, name: str = "v") -> DataFrame:
    """bodies(id, body) with the body's value as VARIANT; null if it is not valid.

    Bytes that are no UTF-8 are read as U+FFFD. A valid body that is too large for a VARIANT has
    none either; `parse_errors` tells the two apart.
    """
    text = F.make_valid_utf8("body")
    with last_key_counts(bodies.sparkSession):
        out = bodies.withColumn(name, F.when(valid_json(text), F.try_parse_json(text)))
        out.schema  # noqa: B018  the plan is made here, under the setting
    return out
