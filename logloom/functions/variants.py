"""Reading JSON values of any shape as VARIANT columns, and writing objects with sorted keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(value: Column, path: str) -> Column:
    """The value at $.path; null where there is none."""
    return F.try_variant_get(value, f"$.{path}", "variant")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def text_of(value: Column) -> Column:
    """The value if it is a string."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def count_of(value: Column) -> Column:
    """The value if it is a whole number of 0 or more."""
    n = F.try_variant_get(value, "$", "bigint")
    return F.when((kind(value) == "BIGINT") & (n >= 0), n)


def flag_of(value: Column) -> Column:
    return F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def items_of(value: Column) -> Column:
    """The elements if the value is an array."""
    return F.when(kind(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def first_of(value: Column) -> Column:
    return F.get(items_of(value), 0)


def as_value(text: Column) -> Column:
    return text.cast("variant")


def null_value() -> Column:
    """JSON's null, which to_json writes; an SQL null leaves its key out."""
    return F.parse_json(F.lit("null"))


def obj(**fields: Column) -> Column:
    """A struct whose keys are in order, as JSON objects are written."""
    return F.struct(*[fields[k].alias(k) for k in sorted(fields)])


def joined(texts: Column) -> Column:
    return F.array_join(F.filter(texts, lambda t: t.isNotNull()), "")


def if_any(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)
