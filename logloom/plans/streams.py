"""Registered queries of the stream converters; their SQL writes each expected event out."""

from __future__ import annotations

from logloom.sources import gateway
from logloom.streaming import conversion

QUERIES = {
    "stream_to_messages": lambda s, d: conversion.converted(gateway.answer_chunks(s, d), "messages", "gpt"),
    "stream_to_responses": lambda s, d: conversion.converted(gateway.answer_chunks(s, d), "responses", "gpt"),
}

HALVES = """WITH d AS (SELECT doc_id AS id, md5(CAST(doc_id AS VARCHAR)) AS h, left(coalesce(text, ''), CAST(length(coalesce(text, '')) // 2 AS INT)) AS a, substr(coalesce(text, ''), CAST(length(coalesce(text, '')) // 2 + 1 AS INT)) AS b FROM documents),
c AS (SELECT *, id % 2 = 1 AS tool, b <> '' AS said FROM d)"""
NUMBERED = "f AS (SELECT id, list_filter(events, lambda x: x IS NOT NULL) AS events FROM e) SELECT id AS stream_id, unnest(range(len(events))) AS place, unnest(events) AS event FROM f"


def event(name: str, data: str) -> str:
    """SQL for an event; data is SQL text with the object's other members around its type."""
    return f"'event: {name}' || chr(10) || 'data: ' || {data} || chr(10) || chr(10)"


START = event("content_block_start", """'{"content_block":{"text":"","type":"text"},"index":0,"type":"content_block_start"}'""")
DELTA = lambda c: event("content_block_delta", f"""'{{"delta":{{"text":' || to_json({c}) || ',"type":"text_delta"}},"index":0,"type":"content_block_delta"}}'""")
STOP = lambda n: event("content_block_stop", f"""'{{"index":' || {n} || ',"type":"content_block_stop"}}'""")
PART = lambda c: event("response.output_text.delta", f"""'{{"content_index":0,"delta":' || to_json({c}) || ',"item_id":"msg_' || h || '","output_index":0,"type":"response.output_text.delta"}}'""")
FC = "md5(id || ':0')"

SQL = {
    "stream_to_messages": f"""{HALVES}, e AS (SELECT id, [
{event("message_start", """'{"message":{"content":[],"id":"msg_' || h || '","model":"gpt","role":"assistant","stop_reason":null,"stop_sequence":null,"type":"message","usage":{"input_tokens":0,"output_tokens":0}},"type":"message_start"}'""")},
CASE WHEN said THEN {START} END, CASE WHEN a <> '' THEN {DELTA("a")} END, CASE WHEN said THEN {DELTA("b")} END, CASE WHEN said AND tool THEN {STOP("0")} END,
CASE WHEN tool THEN {event("content_block_start", """'{"content_block":{"id":"k","input":{},"name":"find","type":"tool_use"},"index":' || CAST(said AS INT) || ',"type":"content_block_start"}'""")} END,
CASE WHEN tool THEN {event("content_block_delta", """'{"delta":{"partial_json":"{\\"q\\":1}","type":"input_json_delta"},"index":' || CAST(said AS INT) || ',"type":"content_block_delta"}'""")} END,
CASE WHEN said AND NOT tool THEN {STOP("0")} END, CASE WHEN tool THEN {STOP("CAST(said AS INT)")} END,
{event("message_delta", """'{"delta":{"stop_reason":"' || CASE id % 3 WHEN 0 THEN 'end_turn' WHEN 1 THEN 'max_tokens' ELSE 'tool_use' END || '","stop_sequence":null},"type":"message_delta","usage":{"output_tokens":7}}'""")},
{event("message_stop", """'{"type":"message_stop"}'""")}] AS events FROM c), {NUMBERED}""",
    "stream_to_responses": f"""{HALVES}, e AS (SELECT id, [
{event("response.created", """'{"response":{"id":"resp_' || h || '","model":"gpt","object":"response","output":[],"status":"in_progress"},"type":"response.created"}'""")},
CASE WHEN a <> '' THEN {PART("a")} END, CASE WHEN said THEN {PART("b")} END,
CASE WHEN tool THEN {event("response.function_call", f"""'{{"arguments":"","call_id":"k","item_id":"fc_' || {FC} || '","name":"find","output_index":1,"type":"response.function_call"}}'""")} END,
CASE WHEN tool THEN {event("response.function_call_arguments.delta", f"""'{{"delta":"{{\\"q\\":1}}","item_id":"fc_' || {FC} || '","output_index":1,"type":"response.function_call_arguments.delta"}}'""")} END,
{event("response.completed", f"""'{{"response":{{"finish_reason":"' || CASE id % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' ELSE 'tool_calls' END || '","id":"resp_' || h || '","model":"gpt","object":"response","output":[{{"content":[{{"text":"","type":"output_text"}}],"id":"msg_' || h || '","role":"assistant","status":"completed","type":"message"}}'
|| CASE WHEN tool THEN ',{{"call_id":"k","id":"fc_' || {FC} || '","status":"completed","type":"function_call"}}' ELSE '' END || '],"status":"completed","usage":{{"input_tokens":' || id || ',"output_tokens":7,"total_tokens":' || id + 7 || '}}}},"type":"response.completed"}}'""")}] AS events FROM c), {NUMBERED}""",
}
