"""Detectors: payload rows in, one row per finding out, in one pass and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import check_sql, numbers
from ..functions.spans import base64_blob, byte_window, contains_any, identity, locate, snippet, spans
from ..functions.timestamps import is_machine_time
from ..plans.parallel import spread
from ..rx import to_java
from . import rules as R

#: Ranks of the detectors in the order in which their findings are emitted.
BUILTIN, RULESET, DIGIT, TOKEN, KEYWORD, IMAGE, LAYER = range(7)
#: Bytes before and after a match that travel with it: refiners, context words and the time-stamp filter look there.
BEFORE, AFTER = 128, 64
#: Maximal runs of word characters and dashes that mix letters and digits; tokens of interest lie within.
_RUN = r"(?<![0-9A-Za-z_\-])[0-9A-Za-z_\-]*(?:[A-Za-z]\-*[0-9]|[0-9]\-*[A-Za-z])[0-9A-Za-z_\-]*"


#: Rules without keywords that no text without a digit can match.
_NEED_DIGIT = frozenset({"credit-card", "private-ipv4", "bitcoin-legacy-address", "iban-generic", "fi-personal-id"})


def context(body: Column, off: Column, end: Column) -> Column:
    """struct(lo, bytes): what stands around a span, as far as any filter looks."""
    lo = F.greatest(off - BEFORE, F.lit(0))
    return F.struct(lo.cast("bigint").alias("lo"), F.substring(body, (lo + 1).cast("int"), (end + AFTER - lo).cast("int")).alias("bytes"))


def candidates(src: DataFrame, id_col: str, builtin: bool, digits: bool, tokens: bool, only: set[str] | None = None) -> DataFrame:
    """id_col, source, rule, off, end, raw, ctx: all matches of all patterns, from one pass over each text.

    A pattern with keywords is run only where one occurs; only patterns that
    match are located.
    """
    text, low, body = F.col("__text"), F.col("__low"), F.col("__body")
    todo = []
    if builtin:
        todo += [(BUILTIN, k, r.pattern, r.keywords) for k, r in enumerate(R.builtin_rules()) if only is None or r.rule_id in only]
    if digits:
        todo.append((DIGIT, -1, R.DIGIT_CLUSTER, ()))
    if tokens:
        todo.append((TOKEN, -1, _RUN, ()))
    none = F.array().cast("array<string>")

    def entry(source, rule, pattern, words):
        p = F.lit(to_java(pattern))
        m = F.regexp_extract_all(text, p, 0)
        if words:
            m = F.when(contains_any(low, [w.lower() for w in words]), m).otherwise(none)
        elif source != BUILTIN or R.builtin_rules()[rule].rule_id in _NEED_DIGIT:
            m = F.when(F.col("__digit"), m).otherwise(none)
        return F.struct(F.lit(source).alias("source"), F.lit(rule).alias("rule"), p.alias("p"), m.alias("m"))

    def placed(x):
        return F.transform(locate(text, x["p"], x["m"]), lambda s: F.struct(x["source"].alias("source"), x["rule"].alias("rule"), s["off"].alias("off"), s["end"].alias("end"), s["raw"].alias("raw"), context(body, s["off"], s["end"]).alias("ctx")))

    found = F.filter(F.array(*[entry(*t) for t in todo]), lambda x: F.size(x["m"]) > 0)
    c = src.select(F.col(id_col), F.inline(F.flatten(F.transform(found, placed))))
    if not tokens:
        return c
    # A run stands for the tokens in it that have both letters and digits.
    inner = F.filter(spans(F.col("raw"), R.TOKEN), lambda x: x["raw"].rlike("[A-Za-z]") & x["raw"].rlike("[0-9]"))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("off"), (F.col("end") - F.col("off")).alias("end"), F.col("raw").alias("raw")))
    c = c.withColumn("__in", F.explode(F.when(F.col("source") == TOKEN, inner).otherwise(whole)))
    return c.select(id_col, "source", "rule", (F.col("off") + F.col("__in.off")).alias("off"), (F.col("off") + F.col("__in.end")).alias("end"), F.col("__in.raw").alias("raw"), "ctx")


def _around(c: DataFrame) -> DataFrame:
    """Add ``pre`` (the bytes before, where a refiner looks) and ``near`` (the lower-cased window of context words)."""
    rel = F.col("off") - F.col("ctx.lo")
    refined = [k for k, r in enumerate(R.builtin_rules()) if r.refine]
    start = F.greatest(rel - BEFORE, F.lit(0))
    pre = F.substring(F.col("ctx.bytes"), (start + 1).cast("int"), (rel - start).cast("int")).cast("string")
    near = byte_window(F.col("ctx.bytes"), rel - R.NEAR_BYTES, F.col("end") - F.col("ctx.lo") + R.NEAR_BYTES)
    return c.withColumn("pre", F.when((F.col("source") == BUILTIN) & F.col("rule").isin(refined), pre)).withColumn("near", F.when(F.col("source").isin(DIGIT, TOKEN), near))


def _near(words) -> Column:
    return contains_any(F.col("near"), [w.lower() for w in words]) if words else F.lit(True)


def _refined(c: DataFrame) -> DataFrame:
    """Refiners of the regex rules: they may move a match's start or drop the match."""
    rules = R.builtin_rules()
    idx = lambda name: [k for k, r in enumerate(rules) if r.refine == name]
    of = lambda name: (F.col("source") == BUILTIN) & F.col("rule").isin(idx(name)) if idx(name) else F.lit(False)
    pre, raw = F.coalesce("pre", F.lit("")), F.col("raw")
    # A JSON escape letter glued to an address is not part of it.
    cut = of("email") & F.endswith(pre, F.lit("\\")) & F.substring(raw, 1, 1).isin("n", "r", "t", "b", "f", "v")
    c = c.withColumns({"raw": F.when(cut, F.substring(raw, 2, 1 << 30)).otherwise(raw), "off": F.when(cut, F.col("off") + 1).otherwise(F.col("off"))})
    low = F.lower(F.coalesce("pre", F.lit("")))
    bad_mail = F.startswith(F.col("raw"), F.lit("@")) | F.startswith(F.lower("raw"), F.lit("noreply@")) | (F.lower("raw") == "vibe@mistral.ai") | contains_any(low, ("useremail", "user's email", "user email addr"))
    glued = F.coalesce("pre", F.lit("")).rlike(r"[0-9A-Za-z_]\z") & ~F.coalesce("pre", F.lit("")).rlike(r"\\n\z")
    return c.where(~(of("email") & bad_mail) & ~(of("de_vat") & glued))


def hits(c: DataFrame, builtin: bool = True, digits: bool = True, tokens: bool = True, only: set[str] | None = None) -> DataFrame:
    """Candidates that pass refiners, checksums and context words, one row per rule that fires. The flags say which sources ``c`` can hold."""
    c = _refined(_around(c)).withColumn("digits", F.regexp_replace("raw", "[^0-9]", ""))
    c = c.withColumns({**numbers(F.col("digits")), "token": F.replace(F.col("raw"), F.lit("-"), F.lit(""))})
    ok = lambda check: base64_blob(F.col("raw")) if check == "base64_blob" else F.expr(check_sql(check))
    fired = F.array()
    if tokens:
        by = [F.when(F.col("token").rlike(to_java(r.pattern)) & (ok(r.check) if r.check else F.lit(True)) & _near(r.near), k) for k, r in enumerate(R.TOKENS)]
        fired = F.when(F.col("source") == TOKEN, F.array(*by)).otherwise(fired.cast("array<int>"))
    if digits:
        n = F.length("digits")  # clusters of other lengths pass no check
        by = [F.when(n.between(r.low, r.high) & ok(r.check) & _near(r.near), k) for k, r in enumerate(R.DIGITS)]
        fired = F.when(F.col("source") == DIGIT, F.array(*by)).otherwise(fired.cast("array<int>"))
    if builtin:
        none = F.lit(None).cast("int")
        passed = F.when(F.col("rule") < 0, none)
        for k, r in enumerate(R.builtin_rules()):
            if r.check and (only is None or r.rule_id in only):
                passed = passed.when((F.col("rule") == k) & ~F.coalesce(ok(r.check), F.lit(False)), none)
        fired = F.when(F.col("source") == BUILTIN, F.array(passed.otherwise(F.col("rule")))).otherwise(fired.cast("array<int>"))
    return c.withColumn("rule", F.explode(F.array_compact(fired))).drop("digits", "token", *numbers(F.col("digits")))


def _meta(source: int, rules) -> Column:
    rows = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity")) for r in rules])
    return F.when(F.col("source") == source, F.get(rows, F.col("rule")))


def detect(payloads: DataFrame, id_col: str, text_col: str, builtin: bool = True, digits: bool = True, tokens: bool = True, depth: int = 0, only: set[str] | None = None) -> DataFrame:
    """Findings of the regex rules and, at depth 0, of the digit and token classifiers.

    Returns id_col, rule_id, category, severity, off, end, raw, snippet,
    identity, source, emit (the order of emission within a payload) and
    machine_time; ``only`` names the regex rules to run. Only the first SCAN_BYTES bytes count. Null texts give no findings.
    """
    src = spread(payloads.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))).where(F.col("__text").isNotNull())
    big = F.octet_length("__text") > R.SCAN_BYTES
    src = src.withColumn("__text", F.when(big, F.substring(F.encode("__text", "UTF-8"), F.lit(1), F.lit(R.SCAN_BYTES)).cast("string")).otherwise(F.col("__text")))
    src = src.withColumn("__low", F.lower("__text")).withColumn("__body", F.encode("__text", "UTF-8")).withColumn("__digit", F.col("__text").rlike("[0-9]"))
    sources = builtin, digits and depth == 0, tokens and depth == 0
    f = hits(candidates(src, id_col, *sources, only), *sources, only)
    meta = F.coalesce(_meta(BUILTIN, R.builtin_rules()), _meta(DIGIT, R.DIGITS), _meta(TOKEN, R.TOKENS))
    f = f.withColumn("m", meta).select(F.col(id_col), "m.rule_id", "m.category", "m.severity", "off", "end", "raw", "source", "rule", "ctx")
    return finish(f, id_col)


def finish(f: DataFrame, id_col: str) -> DataFrame:
    """Add snippet, identity, the order of emission, and whether the span is part of a machine's time stamp."""
    lo = F.col("ctx.lo")
    timed = F.when(F.col("raw").rlike("[0-9]") & (F.col("end") > F.col("off")), is_machine_time(F.col("ctx.bytes"), F.col("off") - lo, F.col("end") - lo)).otherwise(False)
    emit = F.struct(F.col("source").alias("source"), F.col("rule").cast("int").alias("rule"), F.col("off").alias("off"))
    return f.select(id_col, "rule_id", "category", "severity", "off", "end", "raw", snippet(F.col("raw")).alias("snippet"), identity(F.col("rule_id"), F.col("raw")).alias("identity"), "source", emit.alias("emit"), F.coalesce(timed, F.lit(False)).alias("machine_time"))
