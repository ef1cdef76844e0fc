"""Request and response bodies between chat protocols, as columns: JSON text in, JSON text out.

Every function takes bodies(id, body) and gives (id, body). Bodies are parsed once, as VARIANT,
and written with sorted keys; a body that is not valid (`functions.json_text`) gives null. Nothing
is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.json_text import last_key_counts, valid_json, with_value
from logloom.functions.variants import as_value, count_of, field, first_of, flag_of, if_any, items_of, joined, kind, null_value, obj, text_of

#: Token limit and roles where a body gives none; a chat's finish and a message's stop reasons.
MAX_TOKENS, CLAUDE_MODEL = 4096, "claude-3-5-haiku-20241022"
STOP_REASONS = {"stop": "end_turn", "length": "max_tokens", "tool_calls": "tool_use"}
TOOL_CHOICES = {"auto": "auto", "any": "required", "none": "none"}
CONVERTED_ID = "chatcmpl-converted"


def parsed(bodies: DataFrame) -> DataFrame:
    return with_value(bodies)


def written(rows: DataFrame, body: Column) -> DataFrame:
    return rows.select("id", F.when(F.col("v").isNotNull(), F.to_json(body)).alias("body"))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def texts_in(value: Column) -> Column:
    """The text of a string, or of an array's {text} blocks."""
    return F.coalesce(text_of(value), F.when(items_of(value).isNotNull(), joined(F.transform(items_of(value), lambda b: text_of(field(b, "text"))))))


def mapped(value: Column, names: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[value], other)


def generated(prefix: str, *parts: Column) -> Column:
    """An id that reruns agree on."""
    return F.concat(F.lit(prefix), F.md5(F.concat_ws(":", F.col("id").cast("string"), *parts)))


def message(role: Column, content: Column, call_id: Column | None = None, calls: Column | None = None) -> Column:
    """A chat message; all have one type, so that they fit one array."""
    none = F.lit(None).cast("array<struct<function:struct<arguments:string,name:string>,id:string,type:string>>")
    return obj(role=role, content=content, tool_call_id=F.lit(None).cast("string") if call_id is None else call_id, tool_calls=none if calls is None else calls)


def tool_call(call_id: Column, name: Column, arguments: Column) -> Column:
    return obj(function=obj(arguments=arguments, name=name), id=call_id, type=F.lit("function"))


def tools_of(v: Column, schema: str, wanted=None) -> Column:
    """Flat tools as nested functions; those without a name are left out, and an empty list too."""
    tools = F.coalesce(items_of(field(v, "tools")), F.array().cast("array<variant>"))
    named = F.filter(tools, lambda t: text_of(field(t, "name")).isNotNull() & (F.lit(True) if wanted is None else F.coalesce(wanted(t), F.lit(False))))
    one = lambda t: obj(function=obj(name=text_of(field(t, "name")), description=text_of(field(t, "description")), parameters=field(t, schema)), type=F.lit("function"))
    return if_any(F.transform(named, one))


def anthropic_to_openai(bodies: DataFrame) -> DataFrame:
    """Messages requests as chat requests: blocks become texts, tool calls and tool messages; images go."""
    v = F.col("v")

    def messages_of(m: Column) -> Column:
        role, content = F.coalesce(text_of(field(m, "role")), F.lit("user")), field(m, "content")
        blocks = items_of(content)
        type_ = lambda b: or_empty(text_of(field(b, "type")))
        said = F.filter(F.transform(blocks, lambda b: F.when(type_(b) == "text", text_of(field(b, "text"))).when(type_(b) == "thinking", text_of(field(b, "thinking")))), lambda t: t.isNotNull())
        said = F.coalesce(said, F.when(text_of(content).isNotNull(), F.array(text_of(content))), F.array().cast("array<string>"))
        text = as_value(F.array_join(said, ""))
        of = lambda t: F.filter(F.coalesce(blocks, F.array().cast("array<variant>")), lambda b: type_(b) == t)
        calls = F.transform(of("tool_use"), lambda b: tool_call(or_empty(text_of(field(b, "id"))), or_empty(text_of(field(b, "name"))), F.coalesce(F.to_json(field(b, "input")), F.lit("{}"))))
        shown = lambda c: F.coalesce(texts_in(c), F.to_json(c), F.lit(""))
        results = F.transform(of("tool_result"), lambda b: message(F.lit("tool"), as_value(shown(field(b, "content"))), or_empty(text_of(field(b, "tool_use_id")))))
        plain = F.array(message(role, text))
        with_text = F.when(F.size(said) > 0, F.concat(results, plain)).otherwise(results)
        return F.when(F.size(calls) > 0, F.array(message(F.lit("assistant"), text, calls=calls))).when(F.size(results) > 0, with_text).otherwise(plain)

    system = texts_in(field(v, "system"))
    messages = F.flatten(F.transform(F.coalesce(items_of(field(v, "messages")), F.array().cast("array<variant>")), messages_of))
    messages = F.when(system.isNotNull(), F.concat(F.array(message(F.lit("system"), as_value(system))), messages)).otherwise(messages)
    stop, choice = field(v, "stop_sequences"), field(v, "tool_choice")
    named = F.coalesce(text_of(choice), text_of(field(choice, "type")))
    tool = F.when((named == "tool") & text_of(choice).isNull() & text_of(field(choice, "name")).isNotNull(), F.to_variant_object(obj(function=obj(name=text_of(field(choice, "name"))), type=F.lit("function"))))
    body = obj(
        model=or_empty(text_of(field(v, "model"))),
        messages=messages,
        max_tokens=F.coalesce(count_of(field(v, "max_tokens")), F.lit(MAX_TOKENS).cast("long")),
        stream=F.coalesce(flag_of(field(v, "stream")), F.lit(False)),
        temperature=field(v, "temperature"),
        top_p=field(v, "top_p"),
        stop=F.when(F.size(items_of(stop)) > 0, stop),
        tools=tools_of(v, "input_schema"),
        tool_choice=F.coalesce(as_value(mapped(named, TOOL_CHOICES, F.lit(None).cast("string"))), tool),
    )
    return written(parsed(bodies), body)


def usage_of(v: Column, prompt: str, completion: str, at: str = "usage") -> tuple[Column, Column]:
    return tuple(F.coalesce(count_of(field(v, f"{at}.{k}")), F.lit(0).cast("long")) for k in (prompt, completion))


def openai_to_anthropic(bodies: DataFrame, model: str) -> DataFrame:
    """Chat responses as messages: the first choice's text, then its tool calls; errors in their shape."""
    v = F.col("v")
    choice = first_of(field(v, "choices"))
    reply = field(choice, "message")
    block = lambda **f: obj(**({k: F.lit(None).cast(t) for k, t in (("text", "string"), ("id", "string"), ("name", "string"), ("input", "variant"))} | f))
    text = text_of(field(reply, "content"))
    said = F.when(or_empty(text) != "", F.array(block(type=F.lit("text"), text=text))).otherwise(F.array().cast("array<struct<id:string,input:variant,name:string,text:string,type:string>>"))
    arguments = lambda t: or_empty(text_of(field(t, "function.arguments")))
    input_ = lambda t: F.coalesce(F.when(valid_json(arguments(t)), F.try_parse_json(arguments(t))), null_value())
    used = F.transform(F.coalesce(items_of(field(reply, "tool_calls")), F.array().cast("array<variant>")), lambda t: block(type=F.lit("tool_use"), id=or_empty(text_of(field(t, "id"))), name=or_empty(text_of(field(t, "function.name"))), input=input_(t)))
    given, made = usage_of(v, "prompt_tokens", "completion_tokens")
    body = obj(
        id=F.coalesce(text_of(field(v, "id")), generated("msg_")),
        type=F.lit("message"),
        role=F.lit("assistant"),
        model=F.lit(model),
        content=F.concat(said, used),
        stop_reason=mapped(F.coalesce(text_of(field(choice, "finish_reason")), F.lit("stop")), STOP_REASONS, F.lit("end_turn")),
        stop_sequence=null_value(),
        usage=obj(input_tokens=given, output_tokens=made),
    )
    rows = parsed(bodies)
    failed = field(v, "error").isNotNull()
    error = error_shape(text_of(field(v, "error.message")), text_of(field(v, "error.type")))
    with last_key_counts(rows.sparkSession):
        return rows.select("id", F.when(failed, F.to_json(error)).when(v.isNotNull(), F.to_json(body)).alias("body"))


def error_shape(text: Column, type_: Column | None = None) -> Column:
    """A messages client's error."""
    return obj(type=F.lit("error"), error=obj(type=F.lit("api_error") if type_ is None else F.coalesce(type_, F.lit("api_error")), message=F.coalesce(text, F.lit("unknown error"))))


def error_bodies(errors: DataFrame) -> DataFrame:
    """(id, status, body) of errors(id, endpoint, code, message): each client's shape; code 501 has no upstream."""
    text, code = F.col("message"), F.col("code").cast("long")
    missing = obj(error=obj(message=F.concat("endpoint", F.lit(" not implemented yet")), type=F.lit("not_implemented")))
    chat = obj(error=obj(message=text, type=F.lit("upstream_error"), code=code))
    body = F.when(code == 501, F.to_json(missing)).when(F.col("endpoint") == "/v1/messages", F.to_json(error_shape(text))).otherwise(F.to_json(chat))
    return errors.select("id", F.when(code.between(100, 999), code).otherwise(502).cast("long").alias("status"), body.alias("body"))


def responses_to_openai(bodies: DataFrame) -> DataFrame:
    """Response requests as chat requests: input items become messages; tools that are no functions go."""
    v = F.col("v")

    def messages_of(i: Column) -> Column:
        type_, call = or_empty(text_of(field(i, "type"))), or_empty(text_of(field(i, "call_id")))
        arguments = F.coalesce(text_of(field(i, "arguments")), F.to_json(field(i, "arguments")), F.lit(""))
        calls = F.array(tool_call(call, or_empty(text_of(field(i, "name"))), arguments))
        said = lambda k: as_value(or_empty(texts_in(field(i, k))))
        return (
            F.when(type_ == "message", F.array(message(F.coalesce(text_of(field(i, "role")), F.lit("user")), said("content"))))
            .when(type_ == "function_call", F.array(message(F.lit("assistant"), null_value(), calls=calls)))
            .when(type_ == "function_call_output", F.array(message(F.lit("tool"), said("output"), call)))
            .otherwise(F.slice(F.array(message(F.lit(""), null_value())), 1, 0))
        )

    system = text_of(field(v, "instructions"))
    messages = F.flatten(F.transform(F.coalesce(items_of(field(v, "input")), F.array().cast("array<variant>")), messages_of))
    body = obj(
        model=or_empty(text_of(field(v, "model"))),
        messages=F.when(system.isNotNull(), F.concat(F.array(message(F.lit("system"), as_value(system))), messages)).otherwise(messages),
        max_tokens=F.coalesce(count_of(field(v, "max_output_tokens")), F.lit(MAX_TOKENS).cast("long")),
        stream=F.coalesce(flag_of(field(v, "stream")), F.lit(False)),
        temperature=field(v, "temperature"),
        top_p=field(v, "top_p"),
        tools=tools_of(v, "parameters", lambda t: text_of(field(t, "type")) == "function"),
        tool_choice=field(v, "tool_choice"),
    )
    return written(parsed(bodies), body)


def openai_to_responses(bodies: DataFrame, model: str, *, created: int) -> DataFrame:
    """Chat responses as responses: tool calls first, then the text if there is any or nothing else; errors as they are."""
    v = F.col("v")
    choice = first_of(field(v, "choices"))
    reply = field(choice, "message")
    item = lambda **f: obj(**({k: F.lit(None).cast(t) for k, t in (("call_id", "string"), ("name", "string"), ("arguments", "variant"), ("role", "string"), ("content", "array<struct<text:string,type:string>>"))} | f), status=F.lit("completed"))
    text = or_empty(text_of(field(reply, "content")))
    call = lambda t, i: item(id=generated("fc_", i.cast("string")), type=F.lit("function_call"), call_id=or_empty(text_of(field(t, "id"))), name=or_empty(text_of(field(t, "function.name"))), arguments=F.coalesce(field(t, "function.arguments"), as_value(F.lit(""))))
    calls = F.transform(F.coalesce(items_of(field(reply, "tool_calls")), F.array().cast("array<variant>")), call)
    said = F.array(item(id=generated("msg_"), type=F.lit("message"), role=F.lit("assistant"), content=F.array(obj(text=text, type=F.lit("output_text")))))
    given, made = usage_of(v, "prompt_tokens", "completion_tokens")
    body = obj(
        id=F.coalesce(text_of(field(v, "id")), generated("resp_")),
        object=F.lit("response"),
        created_at=F.lit(created),
        status=F.lit("completed"),
        model=F.lit(model),
        output=F.when((text != "") | (F.size(calls) == 0), F.concat(calls, said)).otherwise(calls),
        usage=obj(input_tokens=given, output_tokens=made, total_tokens=given + made),
        finish_reason=F.coalesce(text_of(field(choice, "finish_reason")), F.lit("stop")),
    )
    rows = parsed(bodies)
    return rows.select("id", F.when(field(v, "error").isNotNull(), F.to_json(v)).when(v.isNotNull(), F.to_json(body)).alias("body"))


def openai_to_claude(bodies: DataFrame) -> DataFrame:
    """Chat requests for a Claude channel: the last system text on top, other roles as user or assistant."""
    v = F.col("v")
    each = F.coalesce(items_of(field(v, "messages")), F.array().cast("array<variant>"))
    role = lambda m: F.coalesce(text_of(field(m, "role")), F.lit("user"))
    systems = F.filter(F.transform(F.filter(each, lambda m: role(m) == "system"), lambda m: F.when(field(m, "content").isNull(), "").otherwise(text_of(field(m, "content")))), lambda t: t.isNotNull())
    others = F.transform(F.filter(each, lambda m: role(m) != "system"), lambda m: obj(role=F.when(role(m) == "assistant", "assistant").otherwise("user"), content=F.coalesce(field(m, "content"), as_value(F.lit("")))))
    body = obj(
        model=F.coalesce(text_of(field(v, "model")), F.lit(CLAUDE_MODEL)),
        max_tokens=F.coalesce(count_of(field(v, "max_tokens")), F.lit(MAX_TOKENS).cast("long")),
        messages=others,
        system=F.get(systems, F.size(systems) - 1),
        temperature=field(v, "temperature"),
    )
    return written(parsed(bodies), body)


def completion(id_: Column, model: str, created: int, content: Column, given: Column, made: Column) -> Column:
    choice = obj(index=F.lit(0), message=obj(role=F.lit("assistant"), content=content), finish_reason=F.lit("stop"))
    return obj(id=id_, object=F.lit("chat.completion"), created=F.lit(created), model=F.lit(model), choices=F.array(choice), usage=obj(prompt_tokens=given, completion_tokens=made, total_tokens=given + made))


def claude_to_openai(bodies: DataFrame, model: str, *, created: int) -> DataFrame:
    """A Claude channel's responses as chat completions; the finish reason is always stop."""
    v = F.col("v")
    content = F.when(items_of(field(v, "content")).isNotNull(), texts_in(field(v, "content")))
    return written(parsed(bodies), completion(F.coalesce(field(v, "id"), as_value(F.lit(CONVERTED_ID))), model, created, or_empty(content), *usage_of(v, "input_tokens", "output_tokens")))


def openai_to_gemini(bodies: DataFrame) -> DataFrame:
    """Chat requests for a Gemini channel; only string contents count."""
    v = F.col("v")
    each = F.coalesce(items_of(field(v, "messages")), F.array().cast("array<variant>"))
    role = lambda m: F.coalesce(text_of(field(m, "role")), F.lit("user"))
    part = lambda m: F.array(obj(text=or_empty(text_of(field(m, "content")))))
    systems = F.filter(each, lambda m: role(m) == "system")
    last = F.get(systems, F.size(systems) - 1)
    body = obj(
        contents=F.transform(F.filter(each, lambda m: role(m) != "system"), lambda m: obj(role=F.when(role(m) == "assistant", "model").otherwise("user"), parts=part(m))),
        systemInstruction=F.when(last.isNotNull(), obj(parts=part(last))),
        generationConfig=F.when(field(v, "temperature").isNotNull() | field(v, "max_tokens").isNotNull(), obj(temperature=field(v, "temperature"), maxOutputTokens=field(v, "max_tokens"))),
    )
    return written(parsed(bodies), body)


def gemini_to_openai(bodies: DataFrame, model: str, *, created: int) -> DataFrame:
    """A Gemini channel's responses as chat completions, from the first candidate's parts."""
    v = F.col("v")
    parts = field(first_of(field(v, "candidates")), "content.parts")
    content = F.when(items_of(parts).isNotNull(), texts_in(parts))
    return written(parsed(bodies), completion(generated("chatcmpl-"), model, created, or_empty(content), *usage_of(v, "promptTokenCount", "candidatesTokenCount", "usageMetadata")))


def map_models(bodies: DataFrame, mapping: Column) -> DataFrame:
    """Bodies whose string model is a key of the mapping, in its exact case, get the mapped model; keys are sorted."""
    rows = parsed(bodies).withColumn("m", mapping[text_of(field(F.col("v"), "model"))])
    fields = F.try_variant_get("v", "$", "map<string,variant>")
    new = F.map_from_entries(F.array_sort(F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("key"), F.when(e["key"] == "model", F.to_json(as_value(F.col("m")))).otherwise(F.to_json(e["value"])).alias("value")))))
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(new), lambda e: F.concat(F.to_json(as_value(e["key"])), F.lit(":"), e["value"])), ","), F.lit("}"))
    return rows.select("id", F.when(F.col("m").isNull(), F.col("body")).otherwise(text).alias("body"))


def usage_columns(bodies: DataFrame, *, strict: bool = True) -> DataFrame:
    """(id, prompt_tokens, completion_tokens, total_tokens): all three or none, or each with 0 where it lacks."""
    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    n = {k: count_of(field(F.col("v"), f"usage.{k}")) for k in names}
    if strict:
        whole = n["prompt_tokens"].isNotNull() & n["completion_tokens"].isNotNull() & n["total_tokens"].isNotNull()
        return parsed(bodies).select("id", *[F.when(whole, n[k]).alias(k) for k in names])
    return parsed(bodies).select("id", *[F.coalesce(n[k], F.lit(0).cast("long")).alias(k) for k in names])


def header_values(requests: DataFrame, *, trace_headers: tuple[str, ...] = ("x-trace-id", "trace-id")) -> DataFrame:
    """(id, api_key, trace_id, anthropic, responses) of requests(id, headers map with lower-case names, body).

    A bearer token comes before x-api-key, trace headers count in their order; blank values do not.
    """
    given = lambda name: F.nullif(F.trim(F.col("headers")[name]), F.lit(""))
    auth = F.col("headers")["authorization"]
    bearer = F.when(auth.startswith("Bearer "), F.nullif(F.trim(F.substring(auth, F.lit(8), F.length(auth))), F.lit("")))
    has = lambda name: F.array_contains(F.map_keys("headers"), name)
    v = F.col("v")
    return parsed(requests).select(
        "id",
        F.coalesce(bearer, given("x-api-key")).alias("api_key"),
        F.coalesce(*map(given, trace_headers)).alias("trace_id"),
        (has("anthropic-version") | (has("x-api-key") & ~has("authorization"))).alias("anthropic"),
        (field(v, "input").isNotNull() & field(v, "messages").isNull()).alias("responses"),
    )
