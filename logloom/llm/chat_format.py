"""Chat formatting by columnar byte assembly.

A turn becomes START role NL text END NL. Segment lengths, cumulative offsets and scatter
indices are computed in numpy, and headers and contents are copied into one preallocated
Arrow buffer a batch. Inside a text every "<", any number of backslashes, "|" gets one more
backslash, so no text holds a control string, and taking one away restores it.

Rows are dealt by conversation and sorted by turn, so a task streams whole conversations and
holds one batch and one open conversation. Defined cases: null or empty text is an empty
turn; a null role is the empty role; line breaks and backslashes in a role are escaped; ties
of turn go by role, then text; repeated rows are repeated turns; a null conv_id is one
conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.shared import batches_of, table, text_buffer

START, NL, END = b"<|turn|>", b"\n", b"<|end|>\n"
LOSS_ROLE = "assistant"
FORMATTED = "conv_id long, formatted string, loss_start array<long>, loss_length array<long>"
TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\\\1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(column: pa.Array) -> pa.Array:
    column = pc.replace_substring(escape(column), "\\", "\\\\")
    return pc.replace_substring(column, "\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with all turns, and the n + 1 offsets of the turns in it."""
    n = len(roles)
    parts = []
    for piece in (START, roles, NL, texts, END):
        if isinstance(piece, bytes):
            parts.append((np.frombuffer(piece, np.uint8), None, np.full(n, len(piece), np.int64)))
        else:
            data, offsets = text_buffer(piece)
            parts.append((data, offsets[:-1], np.diff(offsets)))
    lengths = np.stack([p[2] for p in parts], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, (data, source, size) in enumerate(parts):
        if source is None:
            out[starts[:, k, None] + np.arange(len(data))] = data
        elif len(data):
            out[np.arange(len(data)) + np.repeat(starts[:, k] - source, size)] = data
    return out, np.append(starts[:, 0] if n else np.empty(0, np.int64), len(out))


def format_batch(b: pa.RecordBatch) -> Iterator[tuple]:
    """(conv_id, bytes, turns as (loss, header chars, text chars, tail chars)) for each run of a conv_id."""
    roles, texts = b.column("role").fill_null(""), escape(b.column("text").fill_null(""))
    safe = escape_role(roles)
    data, offsets = assemble(safe, texts)
    chars, role_chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False), pc.utf8_length(safe).to_numpy(zero_copy_only=False)
    loss = pc.equal(roles, LOSS_ROLE).to_numpy(zero_copy_only=False)
    ids = b.column("conv_id").to_pylist()
    first = 0
    for k in range(1, len(ids) + 1):
        if k == len(ids) or ids[k] != ids[first]:
            head = len(START) + role_chars[first:k] + len(NL)
            yield ids[first], data[offsets[first] : offsets[k]].tobytes(), loss[first:k], head, chars[first:k]
            first = k


def finish(conv_id: int | None, pieces: list[tuple]) -> tuple:
    loss, head, chars = (np.concatenate([p[k] for p in pieces]) for k in (1, 2, 3))
    ends = np.cumsum(head + chars + len(END))
    starts = ends - len(END) - chars
    return conv_id, b"".join(p[0] for p in pieces), starts[loss].tolist(), chars[loss].tolist()


def formatted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_id, pieces = None, []

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        ids, texts, starts, lengths = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(starts, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int64()))], names=["conv_id", "formatted", "loss_start", "loss_length"])

    for whole in batches:
        for b in batches_of(whole, "text"):
            done = []
            for conv_id, *piece in format_batch(b):
                if pieces and conv_id != open_id:
                    done.append(finish(open_id, pieces))
                    pieces = []
                open_id = conv_id
                pieces.append(piece)
            if done:
                yield emit(done)
    if pieces:
        yield emit([finish(open_id, pieces)])


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted text, and the character spans under the loss mask."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(formatted_rows, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape_role(r), unescape(t)) for r, t in TURN.findall(formatted)]


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for conv_id, text, starts, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
            turns = parse(text)
            loss = "".join(unescape(text[s : s + n]) for s, n in zip(starts, lengths, strict=True))
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            rows.append((conv_id, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return format_chats(rows).mapInArrow(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(replace(replace(regexp_replace(role, '<(\\*)[|]', '<\\\1|', 'g'), '\', '\\'), chr(10), '\n')) AS role_chars,
  length(regexp_replace(text, '<(\\*)[|]', '<\\\1|', 'g')) AS text_chars, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  string_agg(loss, '' ORDER BY turn, role, text) AS loss, sum(8 + role_chars + 1 + text_chars + 8) AS chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
