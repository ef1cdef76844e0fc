"""What happens when a stream ends: its usage, its log row, and the charge to its key, once.

chunks(stream_id, key_id, offset, data binary, error): pieces of an answer as in `conversion`; a
chunk without data and error ends its stream, an error breaks it off, and a stream that says nothing
for `idle_ms` is ended by a timer. Lines are framed across chunks, so a usage line that a chunk cuts
counts. Ended streams leave a mark behind for `late_ms`, so that what still comes for them is passed
over; then a timer frees that too, and no state stays for ever.

`ended_streams` needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). Timers
let Spark run batches without data, so a query with the trigger availableNow does not end unless
spark.sql.streaming.noDataMicroBatches.enabled is off.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logloom.streaming.usage import FIELDS

ENDED = "stream_id long, key_id long, status_code int, prompt_tokens long, completion_tokens long, total_tokens long, error_message string"
#: Fixed value: what the log says of a stream that broke off.
INTERRUPTED = "Stream connection interrupted"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
IDLE_MS, LATE_MS = 10 * 60_000, 60 * 60_000


def _refuse(name: str) -> None:
    raise ValueError(name)


def usage_in(line: bytes) -> list[int] | None:
    """The counts of a data line, if any of them is positive."""
    text = line.decode("utf-8", "replace").strip()
    if not text.startswith("data:"):
        return None
    while text.startswith("data:"):
        text = text.removeprefix("data:")
    try:
        value = json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    usage = value.get("usage") if isinstance(value, dict) else None
    if not isinstance(usage, dict):
        return None
    whole = lambda n: n if type(n) is int and -(1 << 63) <= n < 1 << 63 else 0
    counts = [whole(usage.get(f)) for f in FIELDS]
    return counts if max(counts) > 0 else None


class Tally:
    """One stream's open line and the usage of its last chunk that had one; survives as JSON."""

    def __init__(self, state: str | None = None):
        self.s = json.loads(state) if state else {"line": "", "usage": [0, 0, 0], "key": None}

    def push(self, data: bytes) -> None:
        *lines, rest = (self.s["line"].encode("latin-1") + data).split(b"\n")
        self.s["line"] = rest.decode("latin-1")  # bytes may end within a character
        self.count(lines)

    def count(self, lines: list[bytes]) -> None:
        """Of a chunk's lines the first with a usage counts."""
        if found := next(filter(None, map(usage_in, lines)), None):
            self.s["usage"] = found

    def row(self, stream_id: int, broken: bool) -> tuple:
        self.count([self.s["line"].encode("latin-1")])
        return (stream_id, self.s["key"], 502 if broken else 200, *self.s["usage"], INTERRUPTED if broken else None)


class Endings(StatefulProcessor):
    """State: an open stream's tally, or the mark of an ended one. One timer stands for each."""

    def __init__(self, idle_ms: int, late_ms: int):
        self.idle_ms, self.late_ms = idle_ms, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stream", "open boolean, tally string")

    def keep(self, opened: bool, tally: str | None, now: int) -> None:
        self.state.update((opened, tally))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(now + (self.idle_ms if opened else self.late_ms))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else (True, None)
        part = pd.concat(list(rows)).sort_values("offset", kind="stable")
        now = timerValues.getCurrentProcessingTimeInMs()
        if not held[0]:
            return
        tally, out = Tally(held[1]), []
        for key_id, data, error in zip(part["key_id"], part["data"], part["error"], strict=True):
            if not pd.isna(key_id):
                tally.s["key"] = int(key_id)
            if data is not None:
                tally.push(bytes(data))
            if data is None or error is not None:
                out.append(tally.row(int(key[0]), error is not None))
                break
        self.keep(not out, None if out else json.dumps(tally.s), now)
        if out:
            yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        opened, tally = self.state.get() if self.state.exists() else (False, None)
        if opened:
            self.keep(False, None, timerValues.getCurrentProcessingTimeInMs())
            yield self.frame([Tally(tally).row(int(key[0]), True)])
        else:
            self.state.clear()

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in ENDED.split(", ")])
        return out.astype({"key_id": "Int64"})

    def close(self) -> None:
        pass


def ended_streams(chunks: DataFrame, *, idle_ms: int = IDLE_MS, late_ms: int = LATE_MS) -> DataFrame:
    """A row for each stream of a streaming table when it ends, breaks off or times out.

    Times are of the batch, which a replay has again, so a replayed batch gives the same rows. Rows
    without a stream_id are passed over; chunks of one batch are put in the order of offset.
    """
    if not chunks.sparkSession.conf.get(PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set {PROVIDER} to the RocksDB provider")
    given = chunks.filter("stream_id IS NOT NULL").select("stream_id", "key_id", "offset", "data", "error")
    return given.groupBy("stream_id").transformWithStateInPandas(Endings(idle_ms, late_ms), ENDED, "append", "ProcessingTime")


class Ledger:
    """Log rows and charges of ended streams in a shared folder, a folder a batch.

    A batch that is written again replaces its own folder, so each ended stream is logged, and each
    key charged, once, whatever is replayed. `write` is made for foreachBatch.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, ended: DataFrame, batch_id: int) -> None:
        ended.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path}/log/{batch_id:020d}")

    def log(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{ENDED}, batch long").option("recursiveFileLookup", True).parquet(f"{self.path}/log")

    def charged(self, keys: DataFrame) -> DataFrame:
        """keys(key_id, quota_used) with what their ended streams used."""
        used = self.log(keys.sparkSession).filter("total_tokens > 0").groupBy("key_id").agg(F.sum("total_tokens").alias("_used"))
        return keys.join(used, "key_id", "left").withColumn("quota_used", F.col("quota_used") + F.coalesce("_used", F.lit(0))).drop("_used")
