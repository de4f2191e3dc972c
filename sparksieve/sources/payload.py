"""Shaping of request payloads before they are scanned."""

from __future__ import annotations

import gzip
import importlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.providers import GOOGLE, secret_headers, secret_params

PREVIEW_BYTES = 64 * 1024


def decode_body(body: bytes, encoding: str | None) -> bytes | None:
    """A body freed of its content encoding; None if the encoding is unknown, not available or the body broken."""
    name = (encoding or "").strip().lower()
    try:
        if name in ("gzip", "x-gzip"):
            return gzip.decompress(body)
        if name == "deflate":
            try:
                return zlib.decompress(body)
            except zlib.error:
                return zlib.decompressobj(-15).decompress(body)
        if name == "zstd":
            return importlib.import_module("zstandard").ZstdDecompressor().decompressobj().decompress(body)
        if name == "br":
            return importlib.import_module("brotli").decompress(body)
    except (OSError, EOFError, ValueError, zlib.error, ImportError):
        return None
    except Exception as e:  # errors of the optional decoders
        if type(e).__module__.split(".")[0] in ("zstandard", "brotli"):
            return None
        raise
    return None


@F.pandas_udf(T.BinaryType())
def decoded_body(body: pd.Series, encoding: pd.Series) -> pd.Series:
    """decode_body() by rows; bodies without an encoding, or that cannot be decoded, stay as they are."""
    out = []
    for b, e in zip(body, encoding):
        got = decode_body(b, e) if b is not None and e else None
        out.append(b if got is None else got)
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def decode_error(body: pd.Series, encoding: pd.Series) -> pd.Series:
    """Why a body cannot be freed of its content encoding; null if it can, or has none. Such bodies are scanned as they are."""
    failed = lambda b, e: b is not None and bool(e) and e.strip().lower() not in ("", "identity") and decode_body(b, e) is None
    return pd.Series([f"cannot decode content encoding {e.strip().lower()}" if failed(b, e) else None for b, e in zip(body, encoding)], dtype=object)


def scan_input(uri: Column, body: Column) -> Column:
    """The text that is scanned: the request's uri on a line of its own, then the body."""
    return F.when(uri.isNull(), body).otherwise(F.concat(F.lit("url: "), uri, F.lit("\n"), body))


def uri_shift(uri: Column) -> Column:
    """Bytes that scan_input() puts before the body."""
    return F.when(uri.isNull(), 0).otherwise(F.octet_length(uri) + 6)


def redact_headers(headers: Column) -> Column:
    """A header map with the values of credential headers hidden."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*secret_headers()), "<redacted>").otherwise(v))


def redact_uri(uri: Column) -> Column:
    """A request uri whose credential parameters are hidden; if any is, parameters are sorted by name and encoded anew."""
    names = secret_params()
    query = F.regexp_extract(uri, r"\?([^#]*)", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.url_decode(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), F.url_decode(F.regexp_replace(p, r"\A[^=]*=", ""))).otherwise("").alias("v")))
    hit = F.exists(pairs, lambda p: F.lower(p["k"]).isin(*names))
    # A hidden name keeps one value.
    names_seen = F.sort_array(F.array_distinct(F.transform(pairs, lambda p: p["k"])))
    enc = lambda s: F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A"))
    one = lambda k: F.when(F.lower(k).isin(*names), F.concat(enc(k), F.lit("=%3Credacted%3E"))).otherwise(F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: F.concat(enc(p["k"]), F.lit("="), enc(p["v"]))), "&"))
    return F.when(hit, F.concat(F.substring_index(uri, "?", 1), F.lit("?"), F.array_join(F.transform(names_seen, one), "&"))).otherwise(uri)


def preview(body: Column) -> Column:
    """A binary body's first 64 KiB as they are logged, with a note if there is more."""
    n = F.octet_length(body)
    note = F.concat(F.lit("\n<body truncated: "), n.cast("string"), F.lit(f" bytes, showing first {PREVIEW_BYTES}>\n"))
    text = F.substring(body, 1, PREVIEW_BYTES).cast("string")
    end = F.when(F.endswith(text, F.lit("\n")), "").otherwise("\n")
    return F.when(n == 0, "").when(n > PREVIEW_BYTES, F.concat(note, text, F.lit("\n"))).otherwise(F.concat(F.lit("\n"), text, end))


def _parts(parts: Column, glue: str = "") -> Column:
    return F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), glue)


def last_user_contents(body: Column) -> Column:
    """Last user text of {contents: [{role, parts: [{text}]}]}, also under ``request``; empty if none. A missing role is a user."""
    turn = "array<struct<role:string,parts:array<struct<text:string>>>>"
    x = F.from_json(body, f"struct<contents:{turn},request:struct<contents:{turn}>>")
    turns = F.coalesce(F.when(F.size(x["contents"]) > 0, x["contents"]), x["request"]["contents"])
    users = F.filter(turns, lambda t: F.coalesce(t["role"], F.lit("")).isin("user", ""))
    return F.coalesce(_parts(F.get(users, F.size(users) - 1)["parts"]), F.lit(""))


def content_text(raw: Column) -> Column:
    """A JSON content: the string itself, or the texts of its parts joined."""
    parts = F.from_json(raw, "array<struct<text:string>>")
    return F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.coalesce(_parts(parts), F.lit(""))).otherwise(F.coalesce(raw, F.lit("")))


def _last_user(items: Column) -> Column:
    users = F.filter(items, lambda t: t["role"] == "user")
    return F.coalesce(content_text(F.get(users, F.size(users) - 1)["content"]), F.lit(""))


def last_user_messages(body: Column) -> Column:
    """Last user text of {messages: [{role, content: text or parts}]}."""
    return _last_user(F.from_json(body, "struct<messages:array<struct<role:string,content:string>>>")["messages"])


def last_user_input(body: Column) -> Column:
    """Last user text of {input: text or [{role, content}]}."""
    raw = F.get_json_object(body, "$.input")
    items = F.from_json(raw, "array<struct<role:string,content:string>>")
    return F.when(raw.isNull(), "").when(F.startswith(F.ltrim(raw), F.lit("[")), _last_user(items)).otherwise(raw)


def latest_user_text(provider: Column, body: Column) -> Column:
    """The most recent user text of a request in its provider's shape."""
    copilot = F.when(last_user_input(body) != "", last_user_input(body)).otherwise(last_user_messages(body))
    return F.when(provider.isin(*GOOGLE), last_user_contents(body)).when(provider.isin("anthropic", "mistral"), last_user_messages(body)).when(provider == "openai", last_user_input(body)).when(provider == "github-copilot", copilot).otherwise("")


def user_request(text: Column) -> Column:
    """What stands between <USER_REQUEST> marks (to the end if not closed), trimmed; the trimmed text without marks."""
    inner = F.regexp_extract(text, r"(?s)<USER_REQUEST>(.*?)(?:</USER_REQUEST>|\z)", 1)
    return F.btrim(F.when(F.contains(text, F.lit("<USER_REQUEST>")), inner).otherwise(text), F.lit(" \t\r\n"))


def json_string(body: Column, name: str) -> Column:
    """A top-level JSON field if it is a string, else empty."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), f"$.{name}", "variant"))
    return F.when(kind == "STRING", F.get_json_object(body, f"$.{name}")).otherwise("")


def prompt_messages(body: Column) -> Column:
    """array of struct(role, text): the system prompt and the messages, text parts joined by line feeds."""
    x = F.from_json(body, "struct<system:string,messages:array<struct<role:string,content:string>>>")
    text = lambda raw: F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.coalesce(_parts(F.from_json(raw, "array<struct<text:string>>"), "\n"), F.lit(""))).otherwise(F.coalesce(raw, F.lit("")))
    system = F.when(x["system"].isNotNull(), F.array(F.struct(F.lit("system").alias("role"), text(x["system"]).alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    rest = F.transform(x["messages"], lambda m: F.struct(m["role"].alias("role"), text(m["content"]).alias("text")))
    return F.filter(F.concat(system, F.coalesce(rest, F.array().cast("array<struct<role:string,text:string>>"))), lambda m: m["text"] != "")


def inline_images(text: Column) -> Column:
    """Base64 data of inline images in three shapes: media_type, mime_type, data url."""
    b64 = r"([A-Za-z0-9+/=]{16,})"
    sets = [r'"media_type"[\t\n\f\r ]*:[\t\n\f\r ]*"image/[a-z0-9.+-]+"[\t\n\f\r ]*,[\t\n\f\r ]*"data"[\t\n\f\r ]*:[\t\n\f\r ]*"' + b64, r'"mime_?[tT]ype"[\t\n\f\r ]*:[\t\n\f\r ]*"image/[a-z0-9.+-]+"[\t\n\f\r ]*,[\t\n\f\r ]*"data"[\t\n\f\r ]*:[\t\n\f\r ]*"' + b64, r"data:image/[a-z0-9.+-]+;base64," + b64]
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in sets])


# Length-preserving blanking of values that are opaque to a reader.

_SIGNED = re.compile(rb'"thoughtSignature"\s*:\s*"((?:[^"\\]|\\.)*)"')


def _strings(data: bytes) -> Iterator[tuple]:
    """Tokens of JSON-like bytes: (kind, start, end), kind one of { } [ ] : , s v; broken input just ends."""
    at, n = 0, len(data)
    token = re.compile(rb'[\s]+|([{}\[\]:,])|"((?:[^"\\]|\\.)*)"|([^\s{}\[\]:,"]+)', re.S)
    while at < n:
        m = token.match(data, at)
        if not m:
            return
        if m[1]:
            yield (m[1].decode(), *m.span())
        elif m[2] is not None:
            yield ("s", *m.span(2))
        elif m[3]:
            yield ("v", *m.span())
        at = m.end()


def opaque_spans(data: bytes) -> list[tuple[int, int]]:
    """Byte spans of opaque string values: thought signatures, and the texts of thinking blocks.

    ``thinking`` and ``signature`` of an object of type thinking, ``data`` of
    one of type redacted_thinking, at any depth; of a cut-off body what was
    complete so far.
    """
    out = [m.span(1) for m in _SIGNED.finditer(data)]
    if b"thinking" not in data:
        return out
    stack: list[dict] = []

    def close(obj: dict) -> None:
        kind = obj["fields"].get(b"type")
        kind = data[slice(*kind)] if kind else b""
        for name in {b"thinking": (b"thinking", b"signature"), b"redacted_thinking": (b"data",)}.get(kind, ()):
            if name in obj["fields"]:
                out.append(obj["fields"][name])

    for kind, a, b in _strings(data):
        top = stack[-1] if stack else None
        if kind in "{[":
            if top:
                top["key"] = None
            stack.append({"fields": {}, "key": None, "map": kind == "{", "want": "key"})
        elif kind in "}]":
            if top:
                if top["map"]:
                    close(top)
                stack.pop()
        elif top and top["map"]:
            if kind == "s" and top["want"] == "key":
                top["key"], top["want"] = data[a:b], "value"
            elif kind == "s" and top["key"] is not None:
                top["fields"][top["key"]] = (a, b)
            if kind == ",":
                top["want"], top["key"] = "key", None
    for obj in reversed(stack):
        if obj["map"]:
            close(obj)
    return out


def blank_opaque(data: bytes) -> bytes:
    """The body with opaque values overwritten by blanks; its length and all other bytes stay."""
    out = bytearray(data)
    for a, b in opaque_spans(data):
        out[a:b] = b" " * (b - a)
    return bytes(out)


@F.pandas_udf(T.StringType())
def _blank(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else blank_opaque(t.encode("utf-8", "surrogatepass")).decode("utf-8", "surrogatepass") for t in texts])


def blanked(text: Column) -> Column:
    """blank_opaque() for a text column; only texts with an opaque field's name are sent to Python."""
    some = F.contains(text, F.lit("thoughtSignature")) | F.contains(text, F.lit("thinking"))
    return F.coalesce(_blank(F.when(some, text)), text)


def shape_requests(requests: DataFrame) -> DataFrame:
    """requests(payload_id, uri, body, content_encoding, ...) with ``scan_text`` and ``shift``; headers are never scanned."""
    text = F.when(F.coalesce("content_encoding", F.lit("")) == "", F.col("body")).otherwise(decoded_body(F.col("body"), F.col("content_encoding"))).cast("string")
    return requests.withColumn("scan_text", blanked(scan_input(F.col("uri"), text))).withColumn("shift", uri_shift(F.col("uri")))

