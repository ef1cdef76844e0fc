"""CSV files as tables of cells: a whole file is one value, cut by one expression into its fields.

A field that starts with a quote runs to the quote that closes it, over commas and line breaks; two
quotes are one, and what follows the closing quote up to the next comma belongs to the field. Quotes
elsewhere are letters. Line feed, carriage return or both end a record; empty lines are no records. A
byte order mark goes, there is no header, and a quote that nothing closes runs to the end. The
expression is possessive, so that each byte is looked at once and no state is kept for long fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.variants import bound
from logloom.operators.knowledge import rows_to_markdown

_QUOTED = r'"((?:[^"]++|"")*+)'
_FIELD = rf'(?s)(?:{_QUOTED}(?:"[^,\r\n]*+|\z)|[^,\r\n]*+)(?:,|\r\n|\r|\n|\z)'
#: What an upload is told of a file that is no table.
BROKEN, EMPTY = "CSV 解析失败: ", "无法从该 CSV 提取内容"


def value_of(field: Column) -> Column:
    """The text of a field as it stands in the file, with what ends it."""
    inside = F.replace(F.regexp_extract(field, f"(?s)^{_QUOTED}", 1), F.lit('""'), F.lit('"'))
    behind = F.regexp_extract(field, rf'(?s)^{_QUOTED}"([^,\r\n]*+)', 2)
    return F.when(field.startswith('"'), F.concat(inside, behind)).otherwise(F.regexp_extract(field, r"^([^,\r\n]*+)", 1))


def records_of(text: Column) -> Column:
    """array<array<string>>: the records of a CSV text."""

    def of(fields: Column) -> Column:
        last = F.size(fields) - 1
        breaks = lambda f: f.endswith("\n") | f.endswith("\r")
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | breaks(F.get(fields, i)))

        def rows(ends: Column) -> Column:
            first = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1) + 1)
            raw = F.transform(ends, lambda end, i: F.slice(fields, first(i) + 1, end - first(i) + 1))
            real = F.filter(raw, lambda r: (F.size(r) > 1) | ~F.get(r, 0).isin("\n", "\r", "\r\n"))
            return F.transform(real, lambda r: F.transform(r, value_of))

        return F.when(F.size(fields) == 0, F.array().cast("array<array<string>>")).otherwise(bound(ends, rows))

    # an empty match at the end is a field only behind a comma
    found = F.regexp_extract_all(text, F.lit(_FIELD), F.lit(0))
    real = lambda fs: F.when((F.size(fs) > 1) & F.get(fs, F.size(fs) - 2).endswith(",") & ~F.get(fs, F.size(fs) - 2).startswith('"'), fs)
    closed = lambda fs: F.get(fs, F.size(fs) - 2).rlike(rf'(?s)^{_QUOTED}"[^,\r\n]*+,\z')
    trimmed = bound(found, lambda fs: real(fs).when((F.size(fs) > 1) & closed(fs), fs).otherwise(F.slice(fs, F.lit(1), F.size(fs) - 1)))
    return bound(trimmed, of)


def csv_tables(files: DataFrame) -> DataFrame:
    """(doc_id, rows, error) of files(doc_id, content binary): rows are null where there is an error.

    Bytes that are no UTF-8, records of several widths, and files without a record are errors.
    """
    text = F.try_validate_utf8(F.col("content").cast("string"))
    bare = F.when(text.startswith("\ufeff"), F.substring(text, 2, F.length(text))).otherwise(text)

    def judged(rows: Column) -> Column:
        width = F.size(F.get(rows, 0))
        wrong = F.get(F.filter(F.transform(rows, lambda r, i: F.struct(i.alias("i"), F.size(r).alias("n"))), lambda r: r["n"] != width), 0)
        ragged = F.concat(F.lit(BROKEN), F.format_string("record %d has %d fields, the one before %d", wrong["i"], wrong["n"], width))
        error = F.when(rows.isNull(), BROKEN + "invalid UTF-8").when(F.size(rows) == 0, EMPTY).when(wrong.isNotNull(), ragged)
        return bound(error, lambda e: F.struct(F.when(e.isNull(), rows).alias("rows"), e.alias("error")))

    # one expression, which is not read again for each column
    return files.select("doc_id", bound(bare, lambda t: bound(records_of(t), judged)).alias("t")).select("doc_id", "t.rows", "t.error")


def csv_markdown(files: DataFrame) -> DataFrame:
    """(doc_id, text, error): a table's Markdown; of a single record its cells that are not empty."""
    tables = csv_tables(files)
    marked = rows_to_markdown(tables.select(F.struct("doc_id", "rows", "error").alias("id"), "rows"))
    cells = F.array_join(F.filter(F.flatten("id.rows"), lambda c: c != ""), " | ")
    return marked.select("id.doc_id", F.when(F.col("id.error").isNull(), F.coalesce("markdown", cells)).alias("text"), "id.error")
