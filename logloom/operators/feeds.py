"""Tables kept by a feed of changes, and settings as they were at a time.

A feed has a key, `seq`, `op` and the table's columns. An insert makes a row unless its key stands;
an update changes the columns that it gives and does nothing to a key that does not stand; a delete
ends the row. Null means not given. All of a key's changes meet in one shuffle and are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Comes before every change.
FIRST = -(1 << 63)


def folded(base: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """base after the feed, in the order of seq; with the seq that made each row in `created_seq`.

    Columns that the feed lacks come from base alone. A seq stands once for a key; repeated rows
    change nothing. Null keys of base stay as they are, those of the feed are no changes.
    """
    columns = [c for c in base.columns if c != key]
    given = [F.col(c) if c in feed.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in columns]
    start = base.filter(F.col(key).isNotNull()).select(key, F.lit(FIRST).alias("seq"), F.lit("insert").alias("op"), *columns)
    rows = start.unionByName(feed.filter(F.col(key).isNotNull() & F.col("seq").isNotNull()).select(key, F.col("seq").cast("long").alias("seq"), "op", *given))
    own = Window.partitionBy(key)
    deleted = F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(own)
    rows = rows.withColumn("_deleted", deleted)
    after = F.col("_deleted").isNull() | (F.col("seq") > F.col("_deleted"))
    rows = rows.withColumn("_made", F.min(F.when((F.col("op") == "insert") & after, F.col("seq"))).over(own))
    counts = (F.col("seq") == F.col("_made")) & (F.col("op") == "insert") | (F.col("op") == "update") & (F.col("seq") > F.col("_made"))
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(c) for c in columns]
    made = rows.filter(counts).groupBy(key).agg(F.min("_made").alias("created_seq"), *last)
    nameless = base.filter(F.col(key).isNull()).withColumn("created_seq", F.lit(FIRST))
    return made.select(*base.columns, "created_seq").unionByName(nameless.select(*base.columns, "created_seq"))


def without_parents_deleted(rows: DataFrame, parent: str, parents_feed: DataFrame, parents_key: str) -> DataFrame:
    """Rows of folded() whose parent has not been deleted since they were made: a delete that cascades."""
    gone = parents_feed.filter("op = 'delete'").groupBy(F.col(parents_key).alias(parent)).agg(F.max("seq").cast("long").alias("_gone"))
    return rows.join(gone, parent, "left").filter("_gone IS NULL OR created_seq > _gone").select(*rows.columns)


def in_force(events: DataFrame, settings: DataFrame, defaults: dict[str, str], *, at: str = "created_at", by: str | None = None) -> DataFrame:
    """events with the settings in force at their time, in `setting`; the defaults before any was made.

    settings(since, name, value) are versions: a value holds from `since` on, that instant included,
    until its name's next version; `by` is a column of both tables (a tenant) by which they are
    apart. Versions and events are merged into one sequence, in which each event takes the last
    value of every name before it, so no event meets all versions. The sequence is cut into days,
    and a day starts with the values that the days before it left. Times are ISO texts. Of versions
    of one name and instant the greatest value counts; an event without a time has the defaults.
    """
    names, keys, day = list(defaults), [by] if by else [], F.substring("_at", 1, 10).alias("_day")
    real = settings.filter(F.col("name").isin(*names) & F.col("since").isNotNull())
    wide = real.groupBy(*keys, F.col("since").alias("_at")).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    timed = events.filter(F.col(at).isNotNull()).withColumn("_at", F.col(at))
    asked = timed.select(*keys, day).distinct().select(*keys, "_day", *[F.lit(None).cast("string").alias(n) for n in names])
    left = wide.groupBy(*keys, day).agg(*[F.max(F.when(F.col(n).isNotNull(), F.struct("_at", n)))[n].alias(n) for n in names])
    days = asked.unionByName(left).groupBy(*keys, "_day").agg(*[F.max(n).alias(n) for n in names])  # a row a day
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select(*keys, "_day", F.lit("").alias("_at"), *[F.last(n, True).over(before).alias(n) for n in names])
    row = F.struct(*[F.col(c) for c in events.columns])
    merged = timed.select(*keys, day, "_at", row.alias("_row"), *[F.lit(None).cast("string").alias(n) for n in names])
    none = F.lit(None).cast(merged.schema["_row"].dataType).alias("_row")
    merged = merged.unionByName(starts.unionByName(wide.select(*keys, day, "_at", *names)).withColumn("_row", none))
    until = Window.partitionBy(*keys, "_day").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    setting = lambda value: F.struct(*[F.coalesce(value(n), F.lit(defaults[n])).alias(n) for n in names]).alias("setting")
    found = merged.select("_row", setting(lambda n: F.last(n, True).over(until))).filter("_row IS NOT NULL").select("_row.*", "setting")
    return found.unionByName(events.filter(F.col(at).isNull()).select("*", setting(lambda _: F.lit(None).cast("string"))))
