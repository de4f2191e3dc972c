"""Matches with byte spans, masked snippets and identities, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rx import to_java

SPAN = "array<struct<off:bigint,end:bigint,raw:string>>"


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


#: Matches whose offsets are summed together; a text's arrays are then copied a bounded number of times per match.
BLOCK = 128


def spans(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches of a rule pattern: struct(off, end, raw), offsets in UTF-8 bytes."""
    return spans_java(text, to_java(pattern))


def spans_java(text: Column, p: str) -> Column:
    """spans() for a pattern in Java's syntax."""
    return let(F.regexp_extract_all(text, F.lit(p), 0), lambda m: locate(text, F.lit(p), m))


def locate(text: Column, pattern: Column, m: Column) -> Column:
    """The byte spans of ``m``, all matches of ``pattern`` in ``text``.

    The gaps between matches give the offsets. They are summed in blocks:
    first the blocks' starts, then the matches within each. Texts without a
    match cost no second regex pass.
    """
    long = lambda x: F.coalesce(F.octet_length(x), F.lit(0)).cast("bigint")

    def located() -> Column:
        pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), m, lambda g, r: F.struct(long(g).alias("g"), r.alias("r")))
        return let(pairs, placed)

    def placed(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda k: F.slice(pairs, k * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, starts(bs), within)))

    def starts(bs: Column) -> Column:
        init = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        sums = F.transform(bs, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x["g"] + long(x["r"])))
        return F.aggregate(sums, init, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def within(b: Column, at: Column) -> Column:
        init = F.struct(at.alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc, x):
            off = acc["at"] + x["g"]
            end = off + long(x["r"])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(off.alias("off"), end.alias("end"), x["r"].alias("raw")))).alias("out"))

        return F.aggregate(b, init, step)["out"]

    return F.when(F.size(m) == 0, F.array().cast(SPAN)).otherwise(located())


def contains_any(text: Column, words) -> Column:
    """Whether one of the words occurs; text and words in one case."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def byte_window(body: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a binary, clamped, in lower case; a cut character stays a stray byte."""
    lo = F.greatest(start, F.lit(0))
    return F.lower(F.substring(body, (lo + 1).cast("int"), F.greatest(end - lo, F.lit(0)).cast("int")).cast("string"))


def identity(rule_id: Column, raw: Column) -> Column:
    """First eight bytes, in hex, of SHA-256 over rule, a zero byte and the raw text; empty if either is."""
    h = F.substring(F.sha2(F.concat(rule_id, F.lit("\x00"), raw), 256), 1, 16)
    return F.when((rule_id == "") | (raw == ""), "").otherwise(h)


def snippet(raw: Column) -> Column:
    """The masked text: up to 8 bytes all dots, else the first and last four bytes with up to 16 dots between."""
    t = F.btrim(raw, F.lit(" \t\n\r\f\x0b"))
    n = F.octet_length(t)
    b = F.encode(t, "UTF-8")
    part = lambda at: F.substring(b, at, F.lit(4)).cast("string")
    return F.when(n <= 8, F.repeat(F.lit("•"), n)).otherwise(F.concat(part(F.lit(1)), F.repeat(F.lit("•"), F.least(n - 8, F.lit(16))), part(n - 3)))


def entropy(raw: Column) -> Column:
    """Shannon entropy in bits per character of an ASCII text."""
    chars = F.split(raw, "")

    def of(cs):
        n = F.size(cs).cast("double")
        terms = F.transform(F.array_distinct(cs), lambda c: let(F.size(F.filter(cs, lambda x: x == c)) / n, lambda p: -p * F.log2(p)))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    return F.when(F.length(raw) == 0, 0.0).otherwise(let(chars, of))


def looks_like_path(raw: Column) -> Column:
    return (F.length(raw) - F.length(F.replace(raw, F.lit("/"), F.lit(""))) >= 2) & ~raw.rlike("[0-9+]")


def looks_like_identifier(raw: Column) -> Column:
    """No digit, plus or slash, ten letters, and two case changes within words or two separators."""
    letters = F.length(F.regexp_replace(raw, "[^A-Za-z]", ""))
    turns = F.size(F.regexp_extract_all(raw, F.lit("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"), 0))
    seps = F.length(F.regexp_replace(raw, "[^_-]", ""))
    return ~raw.rlike("[0-9+/]") & (letters >= 10) & ((turns >= 2) | (seps >= 2))


def base64_blob(raw: Column) -> Column:
    """Random enough for its length, neither a path nor an identifier."""
    return (entropy(raw) >= F.when(F.length(raw) >= 32, 4.5).otherwise(3.7)) & ~looks_like_path(raw) & ~looks_like_identifier(raw)
