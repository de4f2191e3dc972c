"""The provider dimension: targets, routes, credentials, and how their clients talk."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Provider:
    name: str
    target: str = ""
    routes: tuple = ()
    env_vars: tuple = ()
    auth_headers: tuple = ()
    auth_params: tuple = ()
    command: str = "<cli>"
    aliases: tuple = ()
    extra_args: tuple = field(default=())


# Profiles of the known providers.
PROVIDERS = (
    Provider("anthropic", "https://api.anthropic.com", (), ("ANTHROPIC_BASE_URL",), ("x-api-key", "anthropic-api-key", "authorization"), (), "claude", ("claude", "claude-code")),
    Provider("google-gemini", "https://generativelanguage.googleapis.com", (("/v1internal", "https://cloudcode-pa.googleapis.com"),), ("GOOGLE_GEMINI_BASE_URL", "CODE_ASSIST_ENDPOINT"), ("x-goog-api-key", "authorization"), ("key", "api_key", "apikey", "access_token"), "gemini", ("gemini", "gemini-cli")),
    Provider("openai", "https://api.openai.com", (), ("OPENAI_BASE_URL",), ("authorization", "openai-organization", "openai-project"), (), "codex", ("codex", "openai"), ("-c", 'openai_base_url="{{endpoint}}/v1"', "--disable", "responses_websockets_v2", "--disable", "responses_websockets")),
    Provider("antigravity", "https://daily-cloudcode-pa.googleapis.com", (("/v1internal", "https://daily-cloudcode-pa.googleapis.com"),), ("CLOUD_CODE_URL",), ("authorization", "x-goog-api-key"), (), "agy", ("agy", "antigravity")),
    Provider("github-copilot", "https://api.githubcopilot.com", (), ("COPILOT_API_URL",), ("authorization",), (), "copilot", ("copilot", "github-copilot")),
    Provider("mistral", "https://api.mistral.ai", (), (), ("authorization",), (), "vibe", ("vibe", "mistral", "mistral-vibe")),
    Provider("generic"),
)
# Header and parameter names that carry credentials whatever the provider.
HEADERS = ("authorization", "x-api-key", "anthropic-api-key", "cookie", "set-cookie")
PARAMS = ("key", "api_key", "apikey", "api-key", "access_token", "token", "auth")
GOOGLE = ("google-gemini", "google-vertex", "antigravity")


def secret_headers() -> list[str]:
    """Header names never written to a log, lower case."""
    return sorted({*HEADERS, *(h.lower() for p in PROVIDERS for h in p.auth_headers)})


def secret_params() -> list[str]:
    """Query parameters whose values are never written to a log, lower case."""
    return sorted({*PARAMS, *(q.lower() for p in PROVIDERS for q in p.auth_params)})


def provider_table(spark: SparkSession) -> DataFrame:
    """(alias, name, target, command, env_vars, auth_headers, routes), one row per alias; a handful of rows."""
    rows = [(a, p.name, p.target, p.command, list(p.env_vars), list(p.auth_headers), [{"prefix": x, "target": t} for x, t in p.routes]) for p in PROVIDERS for a in (p.aliases or (p.name,))]
    return spark.createDataFrame(rows, "alias string, name string, target string, command string, env_vars array<string>, auth_headers array<string>, routes array<struct<prefix:string,target:string>>")


def command_base(command: Column) -> Column:
    """A command's file name without folders of either kind and without .exe, lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(command, r"([^/\\]*)\z", 1), r"(?i)\.exe\z", ""))


def provider_of(command: Column) -> Column:
    """The provider of a command, generic if unknown."""
    table = F.create_map(*[F.lit(x) for p in PROVIDERS for a in p.aliases for x in (a, p.name)])
    return F.coalesce(F.element_at(table, command_base(command)), F.lit("generic"))


def provider_command(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in PROVIDERS if p.aliases for x in (p.name, p.command)], F.lit("google-vertex"), F.lit("gemini"))
    return F.coalesce(F.element_at(table, name), F.lit("<cli>"))


def route(path: Column, routes: Column, default: Column) -> Column:
    """The target of the first route whose prefix the path has, else the default."""
    return F.coalesce(F.get(F.filter(routes, lambda r: F.startswith(path, r["prefix"])), F.lit(0))["target"], default)


def is_model_turn(name: Column, path: Column) -> Column:
    """Whether an endpoint is one where a client shows a model's turn."""
    p = F.lower(path)
    has = lambda s: F.contains(p, F.lit(s))
    return F.when(name == "anthropic", has("/messages")).when(name == "openai", has("/responses")).when(name == "github-copilot", has("/responses") | has("/v1/messages")).when(name == "mistral", has("/chat/completions")).when(name.isin(*GOOGLE), has("generatecontent")).otherwise(False)


def wants_streaming(name: Column, path: Column, accept: Column, body: Column) -> Column:
    """Whether a client expects an event stream."""
    flag = F.contains(body, F.lit('"stream":true')) | F.contains(body, F.lit('"stream": true'))
    return F.coalesce(F.when(name.isin(*GOOGLE), F.contains(F.lower(path), F.lit("streamgeneratecontent"))).otherwise(F.coalesce(F.contains(F.lower(accept), F.lit("text/event-stream")), F.lit(False)) | flag), F.lit(False))


def fill_endpoint(arg: Column, endpoint: Column) -> Column:
    return F.replace(arg, F.lit("{{endpoint}}"), endpoint)


def _s(text: Column) -> Column:
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


ME = "sparksieve"


def model_turn(name: Column, path: Column, text: Column, model: Column, streaming: Column) -> Column:
    """A synthetic model turn in the provider's own shape: frames of an event stream, or one JSON object.

    Templates are filled in by the plan; {T} is the text and {M} the model, as
    JSON strings.
    """
    t = _s(text)

    def fill(template: str, m: Column) -> Column:
        return F.replace(F.replace(F.lit(template), F.lit("{M}"), m), F.lit("{T}"), t)

    sse = lambda *frames: "".join((f"event: {e}\n" if e else "") + f"data: {d}\n\n" for e, d in frames)
    cand = '{"candidates":[{"content":{"role":"model","parts":[{"text":{T}}]},"finishReason":"STOP","index":0}]}'
    nested = '{"response":' + cand + "}"
    message = '{"id":"msg_' + ME + '","type":"message","role":"assistant","model":{M},"content":%s,"stop_reason":%s,"stop_sequence":null,"usage":{"input_tokens":0,"output_tokens":0}}'
    msg_json = message % ('[{"type":"text","text":{T}}]', '"end_turn"')
    msg_sse = sse(
        ("message_start", '{"type":"message_start","message":' + message % ("[]", "null") + "}"),
        ("content_block_start", '{"type":"content_block_start","index":0,"content_block":{"type":"text","text":""}}'),
        ("content_block_delta", '{"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":{T}}}'),
        ("content_block_stop", '{"type":"content_block_stop","index":0}'),
        ("message_delta", '{"type":"message_delta","delta":{"stop_reason":"end_turn","stop_sequence":null},"usage":{"output_tokens":0}}'),
        ("message_stop", '{"type":"message_stop"}'),
    )
    part = '{"type":"output_text","text":{T},"annotations":[]}'
    item = '{"id":"msg_' + ME + '","type":"message","status":"completed","role":"assistant","content":[' + part + "]}"
    resp = '{"id":"resp_' + ME + '","object":"response","status":"completed","output":[' + item + "]}"
    at = '"item_id":"msg_' + ME + '","output_index":0,"content_index":0'
    resp_sse = sse(
        ("response.created", '{"type":"response.created","response":{"id":"resp_' + ME + '","object":"response","status":"in_progress","output":[]}}'),
        ("response.output_item.added", '{"type":"response.output_item.added","output_index":0,"item":{"id":"msg_' + ME + '","type":"message","status":"in_progress","role":"assistant","content":[]}}'),
        ("response.content_part.added", '{"type":"response.content_part.added",' + at + ',"part":{"type":"output_text","text":"","annotations":[]}}'),
        ("response.output_text.delta", '{"type":"response.output_text.delta",' + at + ',"delta":{T}}'),
        ("response.output_text.done", '{"type":"response.output_text.done",' + at + ',"text":{T}}'),
        ("response.content_part.done", '{"type":"response.content_part.done",' + at + ',"part":' + part + "}"),
        ("response.output_item.done", '{"type":"response.output_item.done","output_index":0,"item":' + item + "}"),
        ("response.completed", '{"type":"response.completed","response":' + resp + "}"),
    )
    chat = '{"id":"chatcmpl-' + ME + '","object":"chat.completion","created":0,"model":{M},"choices":[{"index":0,"message":{"role":"assistant","content":{T}},"finish_reason":"stop"}],"usage":{"prompt_tokens":0,"completion_tokens":0,"total_tokens":0}}'
    chunk = '{"id":"chatcmpl-' + ME + '","object":"chat.completion.chunk","created":0,"model":{M},"choices":[{"index":0,"delta":%s,"finish_reason":%s}]}'
    chat_sse = sse(("", chunk % ('{"role":"assistant","content":{T}}', "null")), ("", chunk % ("{}", '"stop"'))) + "data: [DONE]\n\n"
    m = lambda default: _s(F.when(F.coalesce(model, F.lit("")) == "", default).otherwise(model))
    pick = lambda one, many, d="": F.when(streaming, fill(many, m(d))).otherwise(fill(one, m(d)))
    p = F.lower(path)
    claude, google = "claude-sonnet-4", F.when(F.contains(p, F.lit("/v1internal")), pick(nested, sse(("", nested)))).otherwise(pick(cand, sse(("", cand))))
    out = F.when(name.isin(*GOOGLE), google).when((name == "anthropic") | ((name == "github-copilot") & F.contains(p, F.lit("/v1/messages"))), pick(msg_json, msg_sse, claude))
    return out.when(name.isin("openai", "github-copilot"), pick(resp, resp_sse)).when(name == "mistral", pick(chat, chat_sse, "mistral-medium-latest")).otherwise(fill('{"' + ME + '":{T}}', F.lit("")))
