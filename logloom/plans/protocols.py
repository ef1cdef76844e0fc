"""Registered queries of the protocol operators; their SQL writes each expected body out."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import protocol
from logloom.sources import gateway

CREATED = 1_700_000_000
MAPPING = {"GPT": "up \"1\"", "gpt": "other"}

QUERIES = {
    "openai_from_anthropic": lambda s, d: protocol.anthropic_to_openai(gateway.message_requests(s, d)),
    "anthropic_from_openai": lambda s, d: protocol.openai_to_anthropic(gateway.completions(s, d), "gpt"),
    "openai_from_responses": lambda s, d: protocol.responses_to_openai(gateway.response_requests(s, d)),
    "responses_from_openai": lambda s, d: protocol.openai_to_responses(gateway.completions(s, d), "gpt", created=CREATED),
    "claude_request": lambda s, d: protocol.openai_to_claude(gateway.chat_requests(s, d)),
    "claude_response": lambda s, d: protocol.claude_to_openai(gateway.claude_responses(s, d), "gpt", created=CREATED),
    "gemini_request": lambda s, d: protocol.openai_to_gemini(gateway.chat_requests(s, d)),
    "gemini_response": lambda s, d: protocol.gemini_to_openai(gateway.gemini_responses(s, d), "gpt", created=CREATED),
    "model_mapping": lambda s, d: protocol.map_models(gateway.chat_requests(s, d), F.create_map(*[F.lit(x) for kv in MAPPING.items() for x in kv])),
    "usage_strict": lambda s, d: protocol.usage_columns(gateway.completions(s, d)),
    "usage_lenient": lambda s, d: protocol.usage_columns(gateway.completions(s, d), strict=False),
    "header_values": lambda s, d: protocol.header_values(gateway.header_requests(s, d)),
    "error_bodies": lambda s, d: protocol.error_bodies(gateway.completions(s, d).select("id", F.when(F.col("id") % 2 == 0, "/v1/messages").otherwise("/v1/chat").alias("endpoint"), (F.lit(499) + F.col("id") % 4).alias("code"), F.lit("no \"luck\"").alias("message"))),
}

DOCS = """WITH d AS (SELECT doc_id AS id, CAST(to_json(coalesce(text, '')) AS VARCHAR) AS t, CAST(to_json(left(coalesce(text, ''), 20)) AS VARCHAR) AS short, coalesce(text, '') AS raw FROM documents)"""
COMPLETION = """'{"choices":[{"finish_reason":"stop","index":0,"message":{"content":' || to_json(raw || '!') || ',"role":"assistant"}}],"created":1700000000,"id":"' || {id} || '","model":"gpt","object":"chat.completion","usage":{"completion_tokens":' || {made} || ',"prompt_tokens":' || id || ',"total_tokens":' || (id + {made}) || '}}'"""

SQL = {
    "openai_from_anthropic": f"""{DOCS} SELECT id, '{{"max_tokens":' || CASE WHEN id % 2 = 0 THEN id ELSE 4096 END || ',"messages":[' || CASE WHEN id % 3 < 2 THEN '{{"content":"Be brief.","role":"system"}},' ELSE '' END
|| '{{"content":' || t || ',"role":"user"}},{{"content":"hm ok","role":"assistant","tool_calls":[{{"function":{{"arguments":' || to_json('{{"k":[1,2.5,null],"q":' || short || '}}') || ',"name":"find"}},"id":"t' || id || '","type":"function"}}]}},'
|| '{{"content":"ab","role":"tool","tool_call_id":"t' || id || '"}},{{"content":"so?","role":"user"}}],"model":"m-' || id % 3 || '"' || CASE WHEN id % 4 = 0 THEN ',"stop":["x"]' ELSE '' END || ',"stream":' || CASE WHEN id % 2 = 0 THEN 'false' ELSE 'true' END
|| ',"temperature":0.5,"tool_choice":' || CASE id % 3 WHEN 0 THEN '"required"' WHEN 1 THEN '{{"function":{{"name":"find"}},"type":"function"}}' ELSE '"auto"' END
|| ',"tools":[{{"function":{{"description":"d","name":"find","parameters":{{"type":"object"}}}},"type":"function"}}]}}' AS body FROM d""",
    "anthropic_from_openai": f"""{DOCS}, p AS (SELECT *, CASE WHEN id % 4 <> 1 AND raw <> '' THEN '{{"text":' || t || ',"type":"text"}}' END AS said, CASE WHEN id % 2 = 1 THEN '{{"id":"k","input":{{"a":2,"q":1}},"name":"find","type":"tool_use"}},{{"id":"","input":null,"name":"g","type":"tool_use"}}' END AS used FROM d)
SELECT id, CASE WHEN id % 7 = 0 THEN '{{"error":{{"message":"m","type":"t"}},"type":"error"}}' WHEN id % 11 = 0 THEN NULL ELSE '{{"content":[' || coalesce(array_to_string([said, used], ','), '') || '],"id":"c' || id || '","model":"gpt","role":"assistant","stop_reason":"'
|| CASE id % 3 WHEN 0 THEN 'end_turn' WHEN 1 THEN 'max_tokens' ELSE 'tool_use' END || '","stop_sequence":null,"type":"message","usage":{{"input_tokens":' || id || ',"output_tokens":' || 2 * id || '}}}}' END AS body FROM p""",
    "openai_from_responses": f"""{DOCS}, p AS (SELECT *, CASE WHEN id % 2 = 1 THEN '{{"content":"Be","role":"system"}}' END AS sys, CASE WHEN id % 5 <> 0 THEN '{{"content":' || t || ',"role":"user"}},{{"content":"ab","role":"user"}},{{"content":null,"role":"assistant","tool_calls":[{{"function":{{"arguments":"{{\\"a\\":2,\\"b\\":1}}","name":"f"}},"id":"k","type":"function"}}]}},{{"content":"done","role":"tool","tool_call_id":"k"}}' END AS said FROM d)
SELECT id, '{{"max_tokens":' || id || ',"messages":[' || coalesce(array_to_string([sys, said], ','), '') || '],"model":"m","stream":false,"tool_choice":"auto","tools":[{{"function":{{"name":"f","parameters":{{}}}},"type":"function"}}]}}' AS body FROM p""",
    "responses_from_openai": f"""{DOCS}, p AS (SELECT *, CASE WHEN id % 2 = 1 THEN '{{"arguments":"{{\\"q\\": 1, \\"a\\": 2}}","call_id":"k","id":"fc_' || md5(id || ':0') || '","name":"find","status":"completed","type":"function_call"}},{{"arguments":"no","call_id":"","id":"fc_' || md5(id || ':1') || '","name":"g","status":"completed","type":"function_call"}}' END AS used,
  CASE WHEN id % 2 = 0 OR (id % 4 <> 1 AND raw <> '') THEN '{{"content":[{{"text":' || CASE WHEN id % 4 = 1 THEN '""' ELSE t END || ',"type":"output_text"}}],"id":"msg_' || md5(CAST(id AS VARCHAR)) || '","role":"assistant","status":"completed","type":"message"}}' END AS said FROM d)
SELECT id, CASE WHEN id % 7 = 0 THEN '{{"error":{{"message":"m","type":"t"}}}}' WHEN id % 11 = 0 THEN NULL ELSE '{{"created_at":1700000000,"finish_reason":"' || CASE id % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' ELSE 'tool_calls' END || '","id":"c' || id || '","model":"gpt","object":"response","output":[' || array_to_string([used, said], ',')
|| '],"status":"completed","usage":{{"input_tokens":' || id || ',"output_tokens":' || 2 * id || ',"total_tokens":' || 3 * id || '}}}}' END AS body FROM p""",
    "claude_request": f"""{DOCS} SELECT id, '{{"max_tokens":' || CASE WHEN id % 2 = 1 THEN id ELSE 4096 END || ',"messages":[{{"content":' || t || ',"role":"user"}},{{"content":[{{"x":1}}],"role":"assistant"}},{{"content":"no role","role":"user"}}],"model":"GPT","system":"two"' || CASE WHEN id % 2 = 1 THEN ',"temperature":0.2' ELSE '' END || '}}' AS body FROM d""",
    "claude_response": f"{DOCS} SELECT id, " + COMPLETION.replace("{id}", "CASE WHEN id % 2 = 1 THEN 'x' || id ELSE 'chatcmpl-converted' END").replace("{made}", "1") + " AS body FROM d",
    "gemini_request": f"""{DOCS} SELECT id, '{{"contents":[{{"parts":[{{"text":' || t || '}}],"role":"user"}},{{"parts":[{{"text":""}}],"role":"model"}},{{"parts":[{{"text":"no role"}}],"role":"user"}}]' || CASE WHEN id % 2 = 1 THEN ',"generationConfig":{{"maxOutputTokens":' || id || ',"temperature":0.2}}' ELSE '' END || ',"systemInstruction":{{"parts":[{{"text":"two"}}]}}}}' AS body FROM d""",
    "gemini_response": f"{DOCS} SELECT id, " + COMPLETION.replace("{id}", "'chatcmpl-' || md5(CAST(id AS VARCHAR))").replace("{made}", "0") + " AS body FROM d",
    "model_mapping": f"""{DOCS} SELECT id, '{{' || CASE WHEN id % 2 = 1 THEN '"max_tokens":' || id || ',' ELSE '' END || '"messages":[{{"content":"one","role":"system"}},{{"content":"two","role":"system"}},{{"content":' || t || ',"role":"tool"}},{{"content":[{{"x":1}}],"role":"assistant"}},{{"content":"no role"}}],"model":"up \\"1\\""' || CASE WHEN id % 2 = 1 THEN ',"temperature":0.2' ELSE '' END || '}}' AS body FROM d""",
    "usage_strict": f"{DOCS}, u AS (SELECT id, id % 7 <> 0 AND id % 11 <> 0 AND id % 5 <> 0 AS whole FROM d) SELECT id, CASE WHEN whole THEN id END AS prompt_tokens, CASE WHEN whole THEN 2 * id END AS completion_tokens, CASE WHEN whole THEN 3 * id END AS total_tokens FROM u",
    "usage_lenient": f"{DOCS}, u AS (SELECT id, id % 7 <> 0 AND id % 11 <> 0 AS good FROM d) SELECT id, CASE WHEN good THEN id ELSE 0 END AS prompt_tokens, CASE WHEN good THEN 2 * id ELSE 0 END AS completion_tokens, CASE WHEN good AND id % 5 <> 0 THEN 3 * id ELSE 0 END AS total_tokens FROM u",
    "header_values": f"""{DOCS} SELECT id, CASE WHEN id % 3 = 0 AND id % 4 <> 1 THEN CAST(id AS VARCHAR) WHEN id % 2 = 0 THEN 'k' || id END AS api_key, CASE WHEN id % 4 = 0 THEN 't' || id END AS trace_id,
id % 7 = 0 OR (id % 2 = 0 AND id % 3 <> 0) AS anthropic, id % 2 = 0 AS responses FROM d""",
    "error_bodies": f"""{DOCS} SELECT id, 499 + id % 4 AS status, CASE WHEN id % 4 = 2 THEN '{{"error":{{"message":"/v1/messages not implemented yet","type":"not_implemented"}}}}' WHEN id % 2 = 0 THEN '{{"error":{{"message":"no \\"luck\\"","type":"api_error"}},"type":"error"}}'
ELSE '{{"error":{{"code":' || (499 + id % 4) || ',"message":"no \\"luck\\"","type":"upstream_error"}}}}' END AS body FROM d""",
}
