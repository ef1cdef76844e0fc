"""Server-sent chat streams as the events of other protocols, cut anywhere and converted with state.

chunks(stream_id, offset, data binary, error): pieces of an answer in the order of offset; an error
says that the upstream broke off. `converted` works on a table, `converted_stream` on a stream,
where a chunk without data and error ends its answer. Both give (stream_id, place, event).

A stream without a finish reason gets no closing events; what follows one has its own events but
closes nothing again. Lines that are no data lines, or whose data is no JSON, are passed over.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.operators.protocol import STOP_REASONS

EVENTS = "stream_id long, place long, event string"
#: Fixed value: what a chat client is told when its stream breaks off.
BROKEN = 'data: {"error":{"message":"Stream connection interrupted: %s","type":"server_error"}}\n\n'
DONE = "data: [DONE]\n\n"


def get(value, *path):
    """The value under keys and list places, None where there is none."""
    for key in path:
        if isinstance(key, int):
            value = value[key] if isinstance(value, list) and len(value) > key else None
        else:
            value = value.get(key) if isinstance(value, dict) else None
    return value


def said(value) -> str:
    return value if isinstance(value, str) else ""


def event(name: str, /, **data) -> str:
    return f"event: {name}\ndata: {json.dumps({'type': name, **data}, ensure_ascii=False, sort_keys=True, separators=(',', ':'))}\n\n"


class Answer:
    """One stream: its open line and what its events depend on; all fields survive as JSON."""

    def __init__(self, stream_id: int, model: str, state: dict | None = None):
        self.stream_id, self.model = stream_id, model
        self.s = state or {"line": "", "place": 0, "started": False, "finished": False, "given": 0, "made": 0, "next": 0, "text": None, "open": False, "tools": {}}

    def id(self, prefix: str, *parts: int) -> str:
        return prefix + hashlib.md5(":".join(map(str, (self.stream_id, *parts))).encode()).hexdigest()

    def push(self, data: bytes) -> Iterator[str]:
        *lines, rest = (self.s["line"].encode("latin-1") + data).split(b"\n")
        self.s["line"] = rest.decode("latin-1")  # bytes may end within a character
        for line in lines:
            yield from self.line(line)

    def end(self) -> Iterator[str]:
        if not self.s["finished"]:
            self.s["finished"] = True  # so the rest of the last line closes nothing
            yield from self.line(self.s["line"].encode("latin-1"))
        self.s["line"] = ""

    def broken(self, error: str) -> Iterator[str]:
        yield from self.end()

    def line(self, line: bytes) -> Iterator[str]:
        text = line.decode("utf-8", "replace").rstrip()
        if not text.startswith("data:"):
            return
        try:
            chunk = json.loads(text[5:])
        except ValueError:
            return
        for field, name in (("given", "prompt_tokens"), ("made", "completion_tokens")):
            n = get(chunk, "usage", name)
            if isinstance(n, int) and not isinstance(n, bool) and n >= 0:
                self.s[field] = n
        if not self.s["started"]:
            self.s["started"] = True
            yield from self.start()
        delta = get(chunk, "choices", 0, "delta")
        if content := said(get(delta, "content")):
            yield from self.text(content)
        calls = get(delta, "tool_calls")
        for call in calls if isinstance(calls, list) else []:
            n = get(call, "index")
            key = str(n if isinstance(n, int) and n >= 0 else 0)
            if key not in self.s["tools"]:
                yield from self.tool(key, said(get(call, "id")), said(get(call, "function", "name")))
            if part := said(get(call, "function", "arguments")):
                yield from self.arguments(key, part)
        reason = said(get(chunk, "choices", 0, "finish_reason"))
        if reason and reason != "null" and not self.s["finished"]:
            self.s["finished"] = True
            yield from self.close(reason)

    def taken(self) -> int:
        self.s["next"] += 1
        return self.s["next"] - 1

    def tools(self) -> list:
        return [v for _, v in sorted(self.s["tools"].items(), key=lambda kv: int(kv[0]))]


class Messages(Answer):
    """Blocks that open, grow and stop between the start and the stop of a message."""

    def start(self) -> Iterator[str]:
        usage = {"input_tokens": 0, "output_tokens": 0}
        yield event("message_start", message={"id": self.id("msg_"), "type": "message", "role": "assistant", "model": self.model, "content": [], "stop_reason": None, "stop_sequence": None, "usage": usage})

    def text(self, content: str) -> Iterator[str]:
        if self.s["text"] is None:
            self.s["text"], self.s["open"] = self.taken(), True
            yield event("content_block_start", index=self.s["text"], content_block={"type": "text", "text": ""})
        yield event("content_block_delta", index=self.s["text"], delta={"type": "text_delta", "text": content})

    def stop_text(self) -> Iterator[str]:
        if self.s["open"]:
            self.s["open"] = False
            yield event("content_block_stop", index=self.s["text"])

    def tool(self, key: str, call_id: str, name: str) -> Iterator[str]:
        yield from self.stop_text()
        self.s["tools"][key] = self.taken()
        yield event("content_block_start", index=self.s["tools"][key], content_block={"type": "tool_use", "id": call_id, "name": name, "input": {}})

    def arguments(self, key: str, part: str) -> Iterator[str]:
        yield event("content_block_delta", index=self.s["tools"][key], delta={"type": "input_json_delta", "partial_json": part})

    def close(self, reason: str) -> Iterator[str]:
        yield from self.stop_text()
        for index in self.tools():
            yield event("content_block_stop", index=index)
        yield event("message_delta", delta={"stop_reason": STOP_REASONS.get(reason, "end_turn"), "stop_sequence": None}, usage={"output_tokens": self.s["made"]})
        yield event("message_stop")


class Responses(Answer):
    """Output items that grow between the creation and the completion of a response."""

    def about(self, status: str, output: list, **more) -> dict:
        return {"id": self.id("resp_"), "object": "response", "status": status, "model": self.model, "output": output, **more}

    def start(self) -> Iterator[str]:
        self.s["text"] = self.taken()
        yield event("response.created", response=self.about("in_progress", []))

    def text(self, content: str) -> Iterator[str]:
        yield event("response.output_text.delta", item_id=self.id("msg_"), output_index=self.s["text"], content_index=0, delta=content)

    def tool(self, key: str, call_id: str, name: str) -> Iterator[str]:
        item, index = self.id("fc_", int(key)), self.taken()
        self.s["tools"][key] = [item, call_id, index]
        yield event("response.function_call", item_id=item, output_index=index, call_id=call_id, name=name, arguments="")

    def arguments(self, key: str, part: str) -> Iterator[str]:
        item, _, index = self.s["tools"][key]
        yield event("response.function_call_arguments.delta", item_id=item, output_index=index, delta=part)

    def close(self, reason: str) -> Iterator[str]:
        given, made = self.s["given"], self.s["made"]
        text = {"id": self.id("msg_"), "type": "message", "role": "assistant", "content": [{"type": "output_text", "text": ""}], "status": "completed"}
        calls = [{"id": item, "type": "function_call", "call_id": call, "status": "completed"} for item, call, _ in self.tools()]
        usage = {"input_tokens": given, "output_tokens": made, "total_tokens": given + made}
        yield event("response.completed", response=self.about("completed", [text, *calls], finish_reason=reason, usage=usage))


class Chat(Answer):
    """Whole lines as they come; a broken stream tells its client so."""

    def line(self, line: bytes) -> Iterator[str]:
        yield line.decode("utf-8", "replace") + "\n"

    def end(self) -> Iterator[str]:
        rest, self.s["line"] = self.s["line"].encode("latin-1"), ""
        if rest:
            yield rest.decode("utf-8", "replace")

    def broken(self, error: str) -> Iterator[str]:
        yield from self.end()
        yield BROKEN % error
        yield DONE


#: The converters by protocol; another one is another subclass of Answer.
PROTOCOLS: dict[str, type[Answer]] = {"messages": Messages, "responses": Responses, "chat": Chat}


def placed(answer: Answer, events: Iterator[str]) -> Iterator[tuple[int, int, str]]:
    for e in events:
        yield answer.stream_id, answer.s["place"], e
        answer.s["place"] += 1


def converted(chunks: DataFrame, protocol: str, model: str) -> DataFrame:
    """The events of whole streams; a task holds one open line, never a stream."""
    kind = PROTOCOLS[protocol]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["stream_id", "place", "event"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = None
        for b in batches:
            rows = []
            for stream_id, data, error in zip(*(b.column(c).to_pylist() for c in ("stream_id", "data", "error")), strict=True):
                if answer is None or stream_id != answer.stream_id:
                    rows += placed(answer, answer.end()) if answer else []
                    answer = kind(stream_id, model)
                rows += placed(answer, answer.push(data or b""))
                rows += placed(answer, answer.broken(error)) if error is not None else []
            if rows:
                yield batch(rows)
        if answer and (rows := list(placed(answer, answer.end()))):
            yield batch(rows)

    sorted_ = chunks.filter("stream_id is not null").repartition("stream_id").sortWithinPartitions("stream_id", "offset")
    return sorted_.select("stream_id", "data", "error").mapInArrow(run, EVENTS)


#: How long a stream may say nothing before it counts as broken off, and what its client is told.
IDLE_MS, SILENT = 10 * 60_000, "no data"


def converted_stream(chunks: DataFrame, protocol: str, model: str, *, idle_ms: int = IDLE_MS) -> DataFrame:
    """The events of a streaming table as its chunks come in; state is one open line and a few counters a stream.

    A stream that says nothing for `idle_ms` is broken off by a timer, so no state stays for ever.
    Timers let Spark run batches without data: a query with the trigger availableNow ends only if
    spark.sql.streaming.noDataMicroBatches.enabled is off.
    """
    kind = PROTOCOLS[protocol]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        answer = kind(int(key[0]), model, json.loads(state.get[0]) if state.exists else None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(list(placed(answer, answer.broken(SILENT))), columns=["stream_id", "place", "event"])
            return
        part = pd.concat(frames).sort_values("offset")
        rows, ended = [], False
        for data, error in zip(part["data"], part["error"], strict=True):
            if data is not None:
                rows += placed(answer, answer.push(bytes(data)))
            elif error is None:
                ended = True
                rows += placed(answer, answer.end())
            if error is not None:
                ended = True
                rows += placed(answer, answer.broken(error))
        if ended:
            state.remove()
        else:
            state.update((json.dumps(answer.s),))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["stream_id", "place", "event"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, EVENTS, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)
