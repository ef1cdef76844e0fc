"""The ends of streams under readStream: cut usage lines, time-outs, a restart and a replayed batch."""

import time

import pytest

from logloom.streaming import endings
from logloom.streaming.usage import framed, usage_of_streams

CHUNKS = "stream_id long, key_id long, offset long, data binary, error string"


def line(p, c, t):
    return f'data: {{"x":"é","usage":{{"prompt_tokens":{p},"completion_tokens":{c},"total_tokens":{t}}}}}\r\n'.encode()


WHOLE = b": hi\n" + line(1, 1, 2) + b'data: {"choices":[]}\n\ndata:data: ' + line(3, 4, 7)[6:] + b"data: {bad\ndata: [DONE]\n"
REST = line(2, 2, 4) + b'data: {"usage":{"total_tokens":9}}'  # no line break at its end


def cut(stream, key, data, size, *, offset=0, end=True):
    rows = [(stream, key, offset + n, bytearray(data[n : n + size]), None) for n in range(0, len(data), size)]
    return rows + [(stream, None, offset + len(data), None, None)] * end


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_framed(spark, size):
    rows = cut(1, 1, WHOLE, size) + cut(2, 1, REST, size) + cut(3, 1, b"", size) + cut(4, 1, b"\n\n", size) + [(5, 1, 0, None, None), (None, 1, 0, bytearray(REST), None)]
    chunks = spark.createDataFrame(rows, CHUNKS).repartition(3)
    whole = framed(chunks).orderBy("stream_id", "offset").collect()
    assert b"".join(r.data.encode() for r in whole if r.stream_id == 1) == WHOLE and "".join(r.data for r in whole if r.stream_id == 2).encode() == REST
    assert not any("\ufffd" in r.data for r in whole)
    used = {r.stream_id: tuple(r)[1:] for r in usage_of_streams(framed(chunks)).collect()}
    if size < 60:  # one chunk has one usage line at most
        assert used == {1: (3, 4, 7), 2: (0, 0, 9), 4: (0, 0, 0)}


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(endings.PROVIDER)
    spark.conf.set(endings.PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(endings.PROVIDER, before)


def test_needs_a_store(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        endings.ended_streams(spark.createDataFrame([], CHUNKS))


def test_endings(rocks, tmp_path):
    spark, ledger, batches = rocks, endings.Ledger(str(tmp_path / "ledger")), {}
    end, cut_off = (200, 0, 0, 9, None), endings.INTERRUPTED

    def sink(df, batch_id):
        rows = df.collect()
        if rows:
            batches[batch_id] = spark.createDataFrame(rows, df.schema)
        ledger.write(df, batch_id)

    def started(**limits):
        given = spark.readStream.schema(CHUNKS).parquet(str(tmp_path / "in"))
        query = endings.ended_streams(given, **limits).writeStream.foreachBatch(sink).outputMode("append")
        return query.option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()

    def feed(rows):
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def logged():
        return sorted(tuple(r) for df in list(batches.values()) for r in df.collect())

    def wait(query, n):
        until = time.time() + 120
        while len(logged()) < n and time.time() < until and query.isActive:
            time.sleep(0.3)
        assert query.exception() is None
        return logged()

    half = len(WHOLE) // 2 + 3
    one, two = cut(1, 10, WHOLE, 5), cut(2, 20, REST, 9)
    broken = [(3, 10, 0, bytearray(line(5, 5, 10)), None), (3, 10, 1, None, "reset"), (3, 10, 2, bytearray(line(9, 9, 9)), None)]
    feed([r for r in one if r[2] < half] + two[::-1] + broken + [(None, 1, 0, None, None)])
    query = started(idle_ms=600_000, late_ms=600_000)
    first = [(2, 20, *end), (3, 10, 502, 5, 5, 10, cut_off)]
    assert wait(query, 2) == first
    query.stop()
    # after a restart the first stream goes on, what comes late for the second is passed over, and a silent one ends
    feed([r for r in one if r[2] >= half] + [(2, 20, 999, bytearray(line(8, 8, 8)), None), (2, 20, 1000, None, None)])
    feed([(4, 30, 0, bytearray(line(1, 2, 3) + b"data: {"), None)])
    query = started(idle_ms=1500, late_ms=1500)
    second = sorted([*first, (1, 10, 200, 3, 4, 7, None), (4, 30, 502, 1, 2, 3, cut_off)])
    assert wait(query, 4) == second
    time.sleep(3)
    feed([(1, 10, 0, None, None)])  # its mark is gone by now: a new stream of that name
    assert wait(query, 5) == sorted([*second, (1, 10, 200, 0, 0, 0, None)])
    query.stop()
    assert sorted(tuple(r)[:-1] for r in ledger.log(spark).collect()) == logged()
    keys = spark.createDataFrame([(10, 100), (20, 0), (30, 5), (40, 1)], "key_id long, quota_used long")
    want = {10: 117, 20: 9, 30: 8, 40: 1}
    assert {r.key_id: r.quota_used for r in ledger.charged(keys).collect()} == want
    for batch_id, df in batches.items():  # all batches once more
        ledger.write(df, batch_id)
    assert {r.key_id: r.quota_used for r in ledger.charged(keys).collect()} == want
