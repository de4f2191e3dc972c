"""Dictionary detector: every occurrence of a word list's entries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import SPAN, spans_java
from ..plans.parallel import spread
from .detect import AFTER, BEFORE, KEYWORD, context, finish

# Severity by label.
LABEL_SEVERITY = {"SECRET": "critical", "EMAIL": "high", "PHONE": "high", "ADDRESS": "high", "NAME": "medium", "COMPANY_NAME": "low", "PROJECT_NAME": "low"}
#: Word lists up to this many entries are searched as patterns in the plan; longer ones by one automaton.
INLINE = 100
#: Entries that one automaton, which every executor holds, may have (some 200 bytes each); longer lists are taken in blocks.
BLOCK = 200_000
#: Findings, and bytes of their texts, that a worker holds before it hands them on: a batch of texts may have a million of them.
FOUND_ROWS, FOUND_BYTES = 10_000, 4 << 20


def load_keywords(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """``keyword|LABEL`` lines of a text file; blank, ``#`` and malformed lines are skipped, an empty list is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and v not like '#%'")
    part = lines.select(F.trim(F.split("v", r"\|", 2)[0]).alias("kw"), F.trim(F.get(F.split("v", r"\|", 2), F.lit(1))).alias("label"))
    out = [(r["kw"], r["label"]) for r in part.where("kw <> '' and label is not null and label <> ''").collect()]
    if not out:
        raise ValueError(f"no keywords in {path}")
    return out


def keyword_pattern(word: str) -> str:
    """A case-insensitive whole-word pattern; an edge that is no ASCII word character needs no boundary."""
    edge = "[0-9A-Za-z_]"
    return ("(?iu)" + (f"(?<!{edge})" if re.match(r"[0-9A-Za-z_]", word) else "") + re.escape(word) + (f"(?!{edge})" if re.search(r"[0-9A-Za-z_]\Z", word) else "")).replace("\\ ", " ")


def _fold(text: str) -> str:
    """Simple case folding, character by character, so that positions stay."""
    if text.isascii():
        return text.lower()
    one = lambda c: c if len(c.upper()) != 1 or len(c.upper().lower()) != 1 else c.upper().lower()
    return text.translate({ord(c): one(c) for c in set(text)})


def _automaton(words: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    by: dict[str, list[int]] = {}
    for k, w in enumerate(words):
        by.setdefault(_fold(w), []).append(k)
    for w, ks in by.items():
        a.add_word(w, (len(w), ks))
    a.make_automaton()
    return a


_WORD = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")


def find_words(text: str, automaton) -> Iterator[tuple[int, int, int]]:
    """(start, end, entry) in characters, by ascending end: whole-word occurrences of each entry, those of one entry without overlap."""
    until = {}
    for last, (n, ks) in automaton.iter(_fold(text)):
        a, b = last - n + 1, last + 1
        if (text[a] in _WORD and a and text[a - 1] in _WORD) or (text[last] in _WORD and b < len(text) and text[b] in _WORD):
            continue
        for k in ks:
            if until.get(k, 0) <= a:
                until[k] = b
                yield a, b, k


_FOUND = [("off", pa.int64()), ("end", pa.int64()), ("raw", pa.string()), ("rule", pa.int32()), ("lo", pa.int64()), ("bytes", pa.binary())]


def _found(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    """The rows, (row of ids, then the columns of _FOUND), as one batch."""
    at, *cols = zip(*rows)
    off, end, raw, rule, lo, body = [pa.array(c, t) for c, (_, t) in zip(cols, _FOUND)]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), off, end, raw, rule, pa.StructArray.from_arrays([lo, body], names=["lo", "bytes"])], names=["id", "off", "end", "raw", "rule", "ctx"])


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value)
        for batch in batches:
            ids, rows, size = batch.column(0), [], 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                body = text.encode("utf-8", "surrogatepass")
                at = end = 0
                for a, b, k in find_words(text, automaton):
                    raw = text[a:b]
                    end += len(text[at:b].encode("utf-8", "surrogatepass"))
                    at, off = b, end - len(raw.encode("utf-8", "surrogatepass"))
                    lo = max(0, off - BEFORE)
                    ctx = body[lo : end + AFTER]
                    rows.append((i, off, end, raw, k, lo, ctx))
                    size += len(raw) + len(ctx)
                    if len(rows) >= FOUND_ROWS or size >= FOUND_BYTES:
                        yield _found(ids, rows)
                        rows, size = [], 0
            if rows:
                yield _found(ids, rows)

    return run


def detect_keywords(payloads: DataFrame, id_col: str, text_col: str, keywords: list[tuple[str, str]]) -> DataFrame:
    """Findings ``keyword:<LABEL>`` of category pii-org; the snippet is the raw text.

    Different entries may overlap; occurrences of one entry do not. Up to
    INLINE entries are patterns in the plan, and a text is searched for an
    entry only if it contains it at all. Longer lists are one automaton per
    BLOCK entries, broadcast as its words and run over each text once; their
    findings leave the worker as they come, FOUND_ROWS at a time.
    """
    src = spread(payloads.select(F.col(id_col), F.col(text_col).alias("__t"))).where("__t is not null")
    text = F.col("__t")
    if len(keywords) > INLINE:
        kind = payloads.schema[id_col].dataType.simpleString()
        f = None
        for at in range(0, len(keywords), BLOCK):
            shared = payloads.sparkSession.sparkContext.broadcast([w for w, _ in keywords[at : at + BLOCK]])
            part = src.mapInArrow(_search(shared), f"id {kind}, off long, end long, raw string, rule int, ctx struct<lo:bigint,bytes:binary>")
            labels = payloads.sparkSession.createDataFrame([(k, at + k, f"keyword:{label}", LABEL_SEVERITY.get(label.upper(), "medium")) for k, (_, label) in enumerate(keywords[at : at + BLOCK])], "k int, n int, rule_id string, severity string")
            part = part.join(F.broadcast(labels), F.col("rule") == F.col("k"))
            part = part.select(F.col("id").alias(id_col), "rule_id", F.lit("pii-org").alias("category"), "severity", "off", "end", "raw", F.lit(KEYWORD).alias("source"), F.col("n").alias("rule"), "ctx")
            f = part if f is None else f.unionByName(part)
        return finish(f, id_col).withColumn("snippet", F.col("raw"))
    low = F.lower(text)
    body = F.encode(text, "UTF-8")

    def entry(k: int, word: str, label: str):
        arr = F.when(F.contains(low, F.lit(word.lower())), spans_java(text, keyword_pattern(word))).otherwise(F.array().cast(SPAN))
        sev = LABEL_SEVERITY.get(label.upper(), "medium")
        return F.transform(arr, lambda x: F.struct(F.lit(f"keyword:{label}").alias("rule_id"), F.lit("pii-org").alias("category"), F.lit(sev).alias("severity"), x["off"].alias("off"), x["end"].alias("end"), x["raw"].alias("raw"), F.lit(KEYWORD).alias("source"), F.lit(k).alias("rule"), context(body, x["off"], x["end"]).alias("ctx")))

    parts = [entry(k, word, label) for k, (word, label) in enumerate(keywords)]
    f = src.select(F.col(id_col), F.inline(F.concat(*parts)))
    return finish(f, id_col).withColumn("snippet", F.col("raw"))
