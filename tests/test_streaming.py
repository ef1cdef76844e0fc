"""Streams cut at every byte, on a table and under readStream, and usage as a streaming aggregate."""

import json
import time

import pytest

from logloom.streaming.conversion import BROKEN, DONE, SILENT, converted, converted_stream
from logloom.streaming.usage import usage_of_streams

TEXT = b'data: {"choices":[{"delta":{"role":"assistant","content":"H\xc3\xa9llo"},"finish_reason":null}]}\n: x\ndata: {"choices":[{"delta":{"content":" world"},"finish_reason":null}]}\r\n\ndata: {bad\ndata: {"choices":[{"delta":{},"finish_reason":"stop"}]}\ndata: [DONE]\n'
TOOL = (
    b'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"id":"call_1","type":"function","function":{"name":"search","arguments":""}}]},"finish_reason":null}]}\n'
    b'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"arguments":"{\\"q\\":\\"x\\"}"}}]},"finish_reason":null}]}\n'
    b'data: {"choices":[{"delta":{},"finish_reason":"tool_calls"}],"usage":{"prompt_tokens":3,"completion_tokens":4}}\n'
)
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
CHUNKS = "stream_id long, offset long, data binary, error string"


def rows_of(size):
    rows = [(k, n, bytearray(data[n : n + size]), None) for k, data in ((1, TEXT), (2, TOOL), (3, TEXT[:120])) for n in range(0, len(data), size)]
    return [*rows, (4, 0, bytearray(b"data: 1"), None), (4, 1, None, "reset")]


def events_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.stream_id, r.place)):
        out.setdefault(r.stream_id, []).append(r.event)
    return out


@pytest.mark.parametrize("protocol", ["messages", "responses", "chat"])
def test_cut_at_every_byte(spark, tmp_path, protocol):
    want = events_of(converted(spark.createDataFrame(rows_of(1000), CHUNKS), protocol, "gpt-5"))
    bytewise = spark.createDataFrame(rows_of(1), CHUNKS)
    assert events_of(converted(bytewise, protocol, "gpt-5")) == want
    ends = spark.createDataFrame([(k, 10_000, None, None) for k in (1, 2, 3)], CHUNKS)
    for part, low, high in (("a", 0, 60), ("b", 60, 10_001)):
        bytewise.unionByName(ends).filter(f"offset >= {low} and offset < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / part))
    spark.conf.set(NO_DATA, "false")
    given = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = converted_stream(given, protocol, "gpt-5").writeStream.format("memory").queryName(f"events_{protocol}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert events_of(spark.table(f"events_{protocol}")) == want
    spark.conf.set(NO_DATA, "true")
    names = lambda k: [e.split("\n")[0].removeprefix("event: ") for e in want.get(k, [])]
    if protocol == "messages":
        assert names(1) == ["message_start", "content_block_start", "content_block_delta", "content_block_delta", "content_block_stop", "message_delta", "message_stop"]
        assert names(2) == ["message_start", "content_block_start", "content_block_delta", "content_block_stop", "message_delta", "message_stop"]
        assert '"stop_reason":"tool_use"' in want[2][-2] and "call_1" in want[2][1] and "Héllo" in want[1][2]
        assert names(3) == ["message_start", "content_block_start", "content_block_delta"]  # no finish reason, nothing is closed
    elif protocol == "responses":
        assert names(1) == ["response.created", "response.output_text.delta", "response.output_text.delta", "response.completed"]
        assert names(2) == ["response.created", "response.function_call", "response.function_call_arguments.delta", "response.completed"]
        assert json.loads(want[2][-1].split("data: ")[1])["response"]["usage"] == {"input_tokens": 3, "output_tokens": 4, "total_tokens": 7}
    else:
        assert "".join(want[1]).encode() == TEXT and want[4] == ["data: 1", BROKEN % "reset", DONE]


def test_silent_streams_break_off(spark, tmp_path):
    rows = [(1, 0, bytearray(b'data: {"choices":[]}\nda'), None), (2, 0, bytearray(b"data: x\n"), None), (2, 1, None, None)]
    spark.createDataFrame(rows, CHUNKS).coalesce(1).write.parquet(str(tmp_path / "in"))
    given = spark.readStream.schema(CHUNKS).parquet(str(tmp_path / "in"))
    query = converted_stream(given, "chat", "gpt-5", idle_ms=500).writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
    until = time.time() + 60
    while spark.table("silent").filter("stream_id = 1").count() < 4 and time.time() < until:
        time.sleep(0.3)
    query.stop()
    assert events_of(spark.table("silent")) == {1: ['data: {"choices":[]}\n', "da", BROKEN % SILENT, DONE], 2: ["data: x\n"]}


def test_usage_under_read_stream(spark, tmp_path):
    one = 'data: {"usage":{"prompt_tokens":3,"completion_tokens":4,"total_tokens":7}}'
    data = [(1, 0, one), (2, 0, one.replace("7", "8")), (2, 5, one), (3, 0, None)]
    schema = "stream_id long, offset long, data string"
    for k, row in enumerate(data):
        spark.createDataFrame([row], schema).write.mode("append").parquet(str(tmp_path / "in"))
    given = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = usage_of_streams(given).writeStream.format("memory").queryName("usage").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("usage").collect()} == {(1, 3, 4, 7), (2, 3, 4, 7), (3, 0, 0, 0)}
