"""Cutting texts against a plain walk over their lines."""

import random

import pytest

from logloom.operators import chunks

def chunks_of(text: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(first line, last line, content) pieces of about 4 * size characters that share up to 4 * overlap.

    A line over the target is cut by characters on its own. A chunk repeats its predecessor's
    last lines, one at least, unless the next line would not fit behind them.
    """
    if not text:
        return []
    target, shared = 4 * size, 4 * overlap
    out: list[tuple[int, int, str]] = []
    lines = text.split("\n")
    held: list[int] = []  # line numbers of the open chunk
    used = 0

    def close() -> None:
        if held:
            out.append((held[0], held[-1], "\n".join(lines[k] for k in held)))

    for i, line in enumerate(lines):
        if len(line) > target:
            close()
            held, used = [], 0
            out += [(i, i, line[k : k + target]) for k in range(0, len(line), target)]
            continue
        if held and used + len(line) > target:
            close()
            keep = len(held) - 1
            used = len(lines[held[keep]]) + 1
            while keep and used + len(lines[held[keep - 1]]) + 1 <= shared:
                keep -= 1
                used += len(lines[held[keep]]) + 1
            held = held[keep:]
            if used + len(line) > target:
                held, used = [], 0
        held.append(i)
        used += len(line) + 1
    close()
    return out


WHITE = chunks.WHITE


def markdown_chunks(text: str, size: int, overlap: int) -> list[tuple[int, int, str, str | None]]:
    """(first line, last line, content, heading) of the sections that lines starting with # open.

    A section of up to 8 * size characters is one chunk; a longer one is cut as plain text, each
    piece under a line with its heading. Blank sections are dropped; what precedes the first
    heading has none. Without headings the text is cut as plain text.
    """
    lines = text.split("\n")
    starts = [i for i, line in enumerate(lines) if line.lstrip(WHITE).startswith("#")]
    if not starts:
        return [(*c, None) for c in chunks_of(text, size, overlap)]
    out: list[tuple[int, int, str, str | None]] = []
    for a, b in zip([0, *starts], [*starts, len(lines)], strict=True):
        body = "\n".join(lines[a:b])
        if a == b or not body.strip(WHITE):
            continue
        heading = lines[a].lstrip(WHITE).lstrip("#").strip(WHITE) if a in starts[:1] or a > starts[0] else None
        if len(body) <= 8 * size:
            out.append((a, b - 1, body, heading))
        else:
            over = "" if heading is None else f"# {heading}\n"
            out += [(a + x, a + y, over + c, heading) for x, y, c in chunks_of(body, size, overlap)]
    return out


def code_chunks(text, symbols, size, overlap):
    """(first line, last line, content, name) with every line looked at on its own."""
    lines = text.split("\n")
    last, out, covered = len(lines) - 1, [], set()
    for start, end, name in sorted(symbols, key=lambda s: (s[0], s[1], s[2])):
        a, b = min(start, last), min(end, last)
        covered.update(range(a, b + 1))
        body = "\n".join(lines[a : b + 1])
        out += [(a, b, body, name)] if len(body) <= 8 * size else [(a + x, a + y, c, name) for x, y, c in chunks_of(body, size, overlap)]
    at = 0
    while at <= last:
        end = at
        while end <= last and end not in covered:
            end += 1
        body = "\n".join(lines[at:end])
        if body.strip(WHITE):
            out.append((at, end - 1, body, None))
        at = max(end, at + 1)
    return sorted(out, key=lambda c: c[0])


def odd_texts(n, seed):
    rng = random.Random(seed)
    line = lambda: "".join(rng.choices("ab \u00e9\u3000\u2028\r\x1f#\U0001f600", k=rng.choice([0, 1, 3, 8, 20, 40, 90])))
    return ["\n".join(rng.choice(["", "# ", "## ", " #"]) + line() if rng.random() < 0.3 else line() for _ in range(rng.randrange(1, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return ["", "\n", "\n\n\n", "x" * 200, *odd_texts(250, 4)]


def rows_of(frame, *columns):
    out = {}
    for r in frame.orderBy("doc_id", "chunk_index").collect():
        assert r.chunk_index == len(out.setdefault(r.doc_id, [])) and r.token_count == (len(r.content) + 3) // 4
        out[r.doc_id].append((r.line_start, r.line_end, r.content, *(r[c] for c in columns)))
    return out


@pytest.mark.parametrize(("size", "overlap"), [(8, 2), (3, 0), (5, 5), (100, 10), (4, 9)])
def test_text(spark, texts, size, overlap):
    docs = spark.createDataFrame([(-1, None), *enumerate(texts)], "doc_id long, text string")
    assert rows_of(chunks.split_text(docs, size=size, overlap=overlap)) == {k: c for k, t in enumerate(texts) if (c := chunks_of(t, size, overlap))}


@pytest.mark.parametrize(("size", "overlap"), [(8, 2), (3, 1), (40, 5)])
def test_markdown(spark, texts, size, overlap):
    docs = spark.createDataFrame([(-1, None), *enumerate(texts)], "doc_id long, text string")
    got = rows_of(chunks.split_markdown(docs, size=size, overlap=overlap), "heading")
    assert got == {k: c for k, t in enumerate(texts) if t and (c := markdown_chunks(t, size, overlap))}


@pytest.mark.parametrize(("size", "overlap"), [(8, 2), (3, 1), (40, 5)])
def test_code(spark, texts, size, overlap):
    rng = random.Random(9)
    symbols = {k: [(a := rng.randrange(30), a + rng.randrange(8), f"s{rng.randrange(3)}") for _ in range(rng.randrange(5))] for k in range(len(texts))}
    rows = [(k, n, "function", None, a, b) for k, some in symbols.items() for a, b, n in some] + [(5, "no", "class", None, 4, 3), (6, "no", "class", None, None, 3), (9999, "no", "enum", "f()", 0, 1)]
    docs = spark.createDataFrame([(-1, None), *enumerate(texts)], "doc_id long, text string")
    found = chunks.split_code(docs, spark.createDataFrame(rows, "doc_id long, name string, kind string, signature string, start_line int, end_line int"), size=size, overlap=overlap)
    plain = lambda t: [(*c, None) for c in chunks_of(t, size, overlap)]
    want = {k: code_chunks(t, symbols[k], size, overlap) if symbols[k] else plain(t) for k, t in enumerate(texts) if t}
    assert rows_of(found, "symbol_name") == {k: c for k, c in want.items() if c}


def test_symbol_kinds(spark):
    docs = spark.createDataFrame([(1, "import x\ndef f():\n  pass\n\ny = 1")], "doc_id long, text string")
    rows = [(1, k, k, f"{k}()", 1, 2) for k in chunks.SYMBOL_KINDS]
    got = chunks.split_code(docs, spark.createDataFrame(rows, "doc_id long, name string, kind string, signature string, start_line long, end_line long")).collect()
    assert [(r.line_start, r.symbol_kind) for r in got] == [(0, None), *((1, k) for k in sorted(chunks.SYMBOL_KINDS)), (3, None)]
    assert all(r.signature == f"{r.symbol_kind}()" for r in got if r.symbol_kind)


def test_long_text(spark):
    """Very many lines, and one very long line, in one text each."""
    many, long = "\n".join(f"line {k} of many" for k in range(40_000)), "x\n" + "\u00e9\U0001f600" * 400_000
    got = rows_of(chunks.split_text(spark.createDataFrame([(1, many), (2, long)], "doc_id long, text string")))
    assert got == {1: chunks_of(many, 512, 64), 2: chunks_of(long, 512, 64)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("\n".join(f"line{i}" for i in range(1, 7)), [(0, 4, 8), (4, 5, 3)]),
        ("\n".join(f"row{i:03d}xx" for i in range(12)), [(0, 2, 7), (2, 4, 7), (4, 6, 7), (6, 8, 7), (8, 10, 7), (10, 11, 5)]),
        ("short\n" + "x" * 100, [(0, 0, 2), (1, 1, 8), (1, 1, 8), (1, 1, 8), (1, 1, 1)]),
        ("", []),
    ],
)
def test_given_chunks(spark, text, want):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(a, b, (len(c) + 3) // 4) for a, b, c in rows_of(chunks.split_text(docs, size=8, overlap=2)).get(1, [])] == want


def test_given_sections(spark):
    def cut(t):
        docs = spark.createDataFrame([(1, t)], "doc_id long, text string")
        return rows_of(chunks.split_markdown(docs, size=8, overlap=2), "heading").get(1, [])

    assert cut("intro\n# One\nbody\n  ## Two\nmore") == [(0, 0, "intro", None), (1, 2, "# One\nbody", "One"), (3, 4, "  ## Two\nmore", "Two")]
    assert cut("# A\n# B") == [(0, 0, "# A", "A"), (1, 1, "# B", "B")]
    assert cut(" \n# A") == [(1, 1, "# A", "A")]
    assert cut("") == [] and cut("plain") == [(0, 0, "plain", None)]
    long = cut("x\n# Big\n" + "y" * 70)
    assert long[0] == (0, 0, "x", None) and {c[3] for c in long[1:]} == {"Big"}
    assert all(c[2].startswith("# Big\n") for c in long[1:]) and "".join(c[2][6:] for c in long[2:]) == "y" * 70
