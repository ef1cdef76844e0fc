"""Cutting texts into chunks: plain text, Markdown by headings, code by symbols.

Every cut is one fold over the lines of a text, written as column functions: the state holds the
first line of the open chunk, its characters, and the ranges closed so far; what a chunk shares with
the one before is a second fold, backwards from its end. Nothing is shuffled but for symbols, which
are gathered by document and joined to it once. All functions take and give columns, so that a query
can cut texts of several types in one pass.

Line numbers start at 0 and lengths are in code points. Null and empty texts have no chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.variants import bound

SIZE, OVERLAP = 512, 64
#: Characters that count as one token.
PER_TOKEN = 4
#: What Unicode calls white space, and the names of symbol kinds.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SYMBOL_KINDS = ("function", "method", "class", "struct", "interface", "enum", "variable", "constant", "type_alias", "namespace")

RANGES = "array<struct<first:int,last:int>>"
CHUNKS = "array<struct<first:int,last:int,content:string,heading:string,symbol_name:string,symbol_kind:string,signature:string>>"


def whole(n: Column | int) -> Column:
    return (F.lit(n) if isinstance(n, int) else n).cast("int")


def range_of(first: Column, last: Column) -> Column:
    return F.struct(whole(first).alias("first"), whole(last).alias("last"))


def joined(lines: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first + 1, last - first + 1), "\n")


def blank(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE)) == ""


def chunk(first: Column, last: Column, content: Column, heading: Column | None = None, symbol: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    named = [none if symbol is None else symbol[c] for c in ("name", "kind", "signature")]
    names = ("symbol_name", "symbol_kind", "signature")
    return F.struct(
        whole(first).alias("first"),
        whole(last).alias("last"),
        content.alias("content"),
        (none if heading is None else heading).alias("heading"),
        *[c.alias(n) for c, n in zip(named, names, strict=True)],
    )


def shared_tail(lengths: Column, first: Column, end: Column, shared: int) -> Column:
    """(used, kept) of the last lines before `end` that fit into `shared` characters: one at least."""
    state = lambda used, kept, more: F.struct(used.cast("long").alias("used"), whole(kept).alias("kept"), more.alias("more"))

    def step(s: Column, n: Column) -> Column:
        fits = s["more"] & ((s["kept"] == 0) | (s["used"] + n + 1 <= shared))
        return F.when(fits, state(s["used"] + n + 1, s["kept"] + 1, F.lit(True))).otherwise(state(s["used"], s["kept"], F.lit(False)))

    return F.aggregate(F.reverse(F.slice(lengths, first + 1, end - first)), state(F.lit(0), F.lit(0), F.lit(True)), step)


def line_ranges(lengths: Column, target: int, shared: int) -> Column:
    """The ranges of lines that become chunks; a line over the target is a range of its own."""

    def state(first: Column, at: Column, used: Column, out: Column) -> Column:
        return F.struct(whole(first).alias("first"), whole(at).alias("at"), used.cast("long").alias("used"), out.alias("out"))

    def step(s: Column, n: Column) -> Column:
        first, at, used, out = (s[c] for c in ("first", "at", "used", "out"))
        closed = F.when(first < at, F.concat(out, F.array(range_of(first, at - 1)))).otherwise(out)
        alone = state(at + 1, at + 1, F.lit(0), F.concat(closed, F.array(range_of(at, at))))

        def behind(t: Column) -> Column:
            fresh = state(at, at + 1, n + 1, closed)
            return F.when(t["used"] + n > target, fresh).otherwise(state(at - t["kept"], at + 1, t["used"] + n + 1, closed))

        over = bound(shared_tail(lengths, first, at, shared), behind)
        return F.when(n > target, alone).when((first < at) & (used + n > target), over).otherwise(state(first, at + 1, used + n + 1, out))

    def ended(s: Column) -> Column:
        return F.when(s["first"] < s["at"], F.concat(s["out"], F.array(range_of(s["first"], s["at"] - 1)))).otherwise(s["out"])

    return F.aggregate(lengths, state(F.lit(0), F.lit(0), F.lit(0), F.array().cast(RANGES)), step, ended)


def text_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Chunks of about 4 * size characters that share up to 4 * overlap.

    A line over the target is cut by characters on its own. A chunk repeats its predecessor's last
    lines, one at least, unless the next line would not fit behind them.
    """
    target, shared = PER_TOKEN * size, PER_TOKEN * overlap

    def of(lines: Column, lengths: Column) -> Column:
        def content(r: Column) -> Column:
            first, last, line = r["first"], r["last"], F.element_at(lines, r["first"] + 1)
            pieces = F.regexp_extract_all(line, F.lit(f"(?s).{{1,{target}}}"), F.lit(0))
            cut = F.transform(pieces, lambda p: chunk(first, last, p))
            return F.when(F.length(line) > target, cut).otherwise(F.array(chunk(first, last, joined(lines, first, last))))

        return F.flatten(F.transform(line_ranges(lengths, target, shared), content))

    cut = bound(F.split(text, "\n"), lambda lines: bound(F.transform(lines, F.length), lambda lengths: of(lines, lengths)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast(CHUNKS)).otherwise(cut)


def markdown_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Chunks of the sections that lines starting with # open.

    A section of up to 8 * size characters is one chunk; a longer one is cut as plain text, each
    piece under a line with its heading. Blank sections are dropped; what precedes the first
    heading has none. Without headings the text is cut as plain text.
    """

    def section(lines: Column, s: Column) -> Column:
        first, end, heading = s["first"], s["end"], s["heading"]
        over = F.coalesce(F.concat(F.lit("# "), heading, F.lit("\n")), F.lit(""))

        def cut(body: Column) -> Column:
            pieces = F.transform(text_chunks(body, size, overlap), lambda c: chunk(first + c["first"], first + c["last"], F.concat(over, c["content"]), heading))
            one = F.array(chunk(first, end - 1, body, heading))
            return F.when(blank(body), F.array().cast(CHUNKS)).when(F.length(body) <= 2 * PER_TOKEN * size, one).otherwise(pieces)

        return bound(joined(lines, first, end - 1), cut)

    def of(lines: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(lines) - 1)
        bare = lambda i: F.ltrim(F.element_at(lines, i + 1), F.lit(WHITE))
        heading = lambda i: F.trim(F.ltrim(bare(i), F.lit("#")), F.lit(WHITE))

        def sections(starts: Column) -> Column:
            ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(lines)))
            headed = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("end"), heading(a).alias("heading")))
            first = F.element_at(starts, 1)
            before = F.array(F.struct(F.lit(0).alias("first"), first.alias("end"), F.lit(None).cast("string").alias("heading")))
            every = F.when(first > 0, F.concat(before, headed)).otherwise(headed)
            return F.when(F.size(starts) == 0, text_chunks(text, size, overlap)).otherwise(F.flatten(F.transform(every, lambda s: section(lines, s))))

        return bound(F.filter(numbers, lambda i: bare(i).startswith("#")), sections)

    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast(CHUNKS)).otherwise(bound(F.split(text, "\n"), of))


def uncovered(symbols: Column, last: Column) -> Column:
    """The ranges of lines under no symbol: gaps between the islands that sorted symbols form."""
    state = lambda next_, out: F.struct(whole(next_).alias("next"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.when(x["first"] > s["next"], F.concat(s["out"], F.array(range_of(s["next"], x["first"] - 1)))).otherwise(s["out"])
        return state(F.greatest(s["next"], x["last"] + 1), gap)

    def ended(s: Column) -> Column:
        return F.when(s["next"] <= last, F.concat(s["out"], F.array(range_of(s["next"], last)))).otherwise(s["out"])

    return F.aggregate(symbols, state(F.lit(0), F.array().cast(RANGES)), step, ended)


def code_chunks(text: Column, symbols: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """A chunk for each symbol, nested and overlapping ones too, and for the lines between them.

    `symbols` is an array of (start, end, name, kind, signature) structs, ends included, beyond the
    last line taken as that line. One of over 8 * size characters is cut as plain text; blank lines
    between symbols are dropped. Chunks are in the order of their first lines, symbols before
    others and in their own order where these are equal. Without symbols it is plain text.
    """

    def of(lines: Column, last: Column) -> Column:
        clamped = F.transform(
            symbols,
            lambda s: F.struct(
                whole(F.least(s["start"], last)).alias("first"),
                whole(F.least(s["end"], last)).alias("last"),
                *[s[c].alias(c) for c in ("name", "kind", "signature")],
            ),
        )

        def of_symbol(s: Column) -> Column:
            def cut(body: Column) -> Column:
                pieces = F.transform(text_chunks(body, size, overlap), lambda c: chunk(s["first"] + c["first"], s["first"] + c["last"], c["content"], symbol=s))
                return F.when(F.length(body) <= 2 * PER_TOKEN * size, F.array(chunk(s["first"], s["last"], body, symbol=s))).otherwise(pieces)

            return bound(joined(lines, s["first"], s["last"]), cut)

        def both(found: Column) -> Column:
            rest = F.transform(uncovered(found, last), lambda r: chunk(r["first"], r["last"], joined(lines, r["first"], r["last"])))
            every = F.concat(F.flatten(F.transform(found, of_symbol)), F.filter(rest, lambda c: ~blank(c["content"])))
            placed = F.transform(every, lambda c, i: F.struct(c["first"].alias("first"), i.alias("i"), c.alias("c")))
            return F.transform(F.array_sort(placed), lambda p: p["c"])

        return bound(clamped, both)

    cut = bound(F.split(text, "\n"), lambda lines: bound(F.size(lines) - 1, lambda last: of(lines, last)))
    empty = F.coalesce(text, F.lit("")) == ""
    return F.when(empty, F.array().cast(CHUNKS)).when(F.coalesce(F.size(symbols), F.lit(0)) <= 0, text_chunks(text, size, overlap)).otherwise(cut)


def exploded(docs: DataFrame, chunks: Column, *kept: str) -> DataFrame:
    """A row a chunk, numbered from 0 in each document, with its lines and estimated tokens."""
    rows = docs.select("doc_id", F.posexplode(chunks).alias("chunk_index", "c"))
    tokens = F.floor((F.length("c.content") + PER_TOKEN - 1) / PER_TOKEN)
    lines = [F.col(f"c.{c}").cast("long").alias(f"line_{n}") for c, n in (("first", "start"), ("last", "end"))]
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), *lines, "c.content", tokens.alias("token_count"), *[f"c.{c}" for c in kept])


def split_text(docs: DataFrame, *, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of docs(doc_id, text) as plain text."""
    return exploded(docs, text_chunks(F.col("text"), size, overlap))


def split_markdown(docs: DataFrame, *, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of docs(doc_id, text) by headings."""
    return exploded(docs, markdown_chunks(F.col("text"), size, overlap), "heading")


def gathered_symbols(symbols: DataFrame) -> DataFrame:
    """(doc_id, symbols): the symbols of each document in the order of their first lines.

    Those without lines, or with an end before their start, are no symbols; equal ones count each.
    Ties are in the order of end, name, kind and signature.
    """
    real = symbols.filter((F.col("start_line") >= 0) & (F.col("end_line") >= F.col("start_line")))
    one = F.struct(F.col("start_line").cast("int").alias("start"), F.col("end_line").cast("int").alias("end"), "name", "kind", "signature")
    return real.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("symbols"))


def split_code(docs: DataFrame, symbols: DataFrame, *, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of docs(doc_id, text) by symbols(doc_id, name, kind, signature, start_line, end_line)."""
    both = docs.select("doc_id", "text").join(gathered_symbols(symbols), "doc_id", "left")
    return exploded(both, code_chunks(F.col("text"), F.col("symbols"), size, overlap), "symbol_name", "symbol_kind", "signature")


def split_by_type(docs: DataFrame, symbols: DataFrame | None = None, *, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of docs(doc_id, text, file_type): markdown by headings, code by symbols, all else as text."""
    text, kind, rest = F.col("text"), F.col("file_type"), ["heading", "symbol_name", "symbol_kind", "signature"]
    chunks = F.when(kind == "markdown", markdown_chunks(text, size, overlap))
    if symbols is not None:
        docs = docs.select("doc_id", "text", "file_type").join(gathered_symbols(symbols), "doc_id", "left")
        chunks = chunks.when(kind == "code", code_chunks(text, F.col("symbols"), size, overlap))
    return exploded(docs, chunks.otherwise(text_chunks(text, size, overlap)), *rest)
