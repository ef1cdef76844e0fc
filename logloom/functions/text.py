"""Text functions of gateway and knowledge tables, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Extensions of each language, and of other file types.
LANGUAGES = {
    "rust": ["rs"], "typescript": ["ts", "tsx"], "javascript": ["js", "jsx", "mjs", "cjs"], "python": ["py"], "go": ["go"], "java": ["java"], "c": ["c", "h"], "cpp": ["cpp", "cc", "hpp"],
    "csharp": ["cs"], "php": ["php"], "ruby": ["rb"], "swift": ["swift"], "kotlin": ["kt", "kts"], "scala": ["scala"], "shell": ["sh", "bash"], "sql": ["sql"], "json": ["json"], "yaml": ["yaml", "yml"], "toml": ["toml"],
}
MARKDOWN, TABLES, PLAIN, REFUSED, OFFICE = ["md", "markdown"], ["csv"], ["html", "htm", "pptx"], ["doc", "xls", "ppt"], ["pdf", "docx", "xlsx"]
#: Fixed value: the most bytes of a field that a gateway scans.
MOST_SCANNED = 65_536
DOTS = "•" * 8


def within_bytes(text: Column, n: int) -> Column:
    """The longest beginning of whole characters within n bytes."""
    bytes_ = F.substring(text.cast("binary"), 1, n)
    # a character that was cut off is what is no UTF-8 at the end
    fits = [F.try_validate_utf8(F.substring(bytes_, F.lit(1), F.greatest(F.octet_length(bytes_) - k, F.lit(0))).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= n, text).otherwise(F.coalesce(*fits))


def extension(name: Column) -> Column:
    """What follows the last dot, or the whole name, in lower case."""
    return F.lower(F.substring_index(name, ".", -1))


def language(ext: Column) -> Column:
    return F.create_map(*[F.lit(x) for name, exts in LANGUAGES.items() for e in exts for x in (e, name)])[ext]


def file_type(ext: Column) -> Column:
    """markdown, code or text: how a file's text is split; null for formats that are refused."""
    return F.when(ext.isin(*REFUSED), None).when(ext.isin(*MARKDOWN, *TABLES, *OFFICE), "markdown").when(language(ext).isNotNull(), "code").otherwise("text")


@F.pandas_udf(StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """NFKC without zero-width spaces and joiners; there is no SQL function for it."""
    drop = dict.fromkeys((0x200B, 0x200C, 0x200D))
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).translate(drop))


def heading_level(style: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(style), r"^(?:Heading|标题)([1-6])$", 1), F.lit("")).cast("int")


def mask_key(key: Column, short: str = "sk-" + DOTS[:4]) -> Column:
    return F.when(F.length(key) <= 14, short).otherwise(F.concat(F.left(key, F.lit(12)), F.lit(DOTS), F.right(key, F.lit(4))))


def bare(text: Column) -> Column:
    """Without white space at its ends."""
    return F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: bare(x)), lambda x: x != "")


def joined_cells(rows: Column) -> Column:
    """All cells that are not empty, row by row."""
    return F.array_join(F.filter(F.flatten(rows), lambda c: c != ""), " | ")


def joined_url(base: Column, path: str) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit(path))


def valid_host(host: Column) -> Column:
    """http or https, and neither white space nor control characters inside."""
    text = bare(host)
    return (text.startswith("http://") | text.startswith("https://")) & ~text.rlike(r"[\p{IsWhite_Space}\p{Cntrl}]")


def string_list(text: Column) -> Column:
    """A JSON array of strings; an empty one where it is none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def string_map(text: Column) -> Column:
    """A JSON object of strings; an empty one where it is none."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def flag(number: Column) -> Column:
    """Whether a stored 0 or 1 is 1; null is not."""
    return F.coalesce(number == 1, F.lit(False))


def page_count(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("long")


def estimated_total(rows: Column, page: int, size: int) -> Column:
    """A list's length where only the present page's is known."""
    return F.when(rows >= size, F.lit(page * size + size)).when(F.lit(page) == 1, rows).otherwise(F.lit(page * size)).cast("long")


def generated_key(*parts: Column) -> Column:
    """A secret key; from a hash of parts that include a random seed, so that retried tasks agree."""
    return F.concat(F.lit("sk-"), F.md5(F.concat_ws(":", *parts)))


def generated_id(*parts: Column) -> Column:
    """An id in the form of a random UUID (version 4), from a hash, so that retried tasks agree."""
    h = F.md5(F.concat_ws(":", *parts))
    at = lambda a, n: F.substring(h, a, n)
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(at(17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-4"), at(14, 3), F.lit("-"), variant, at(18, 3), F.lit("-"), at(21, 12))
