"""Placeholders for sensitive values, and their exact restoration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import identity
from ..schema import severity_rank
from .policy import placeholder_label


def with_identity(findings: DataFrame) -> DataFrame:
    """Findings without an identity get that of their rule and raw span."""
    return findings.withColumn("identity", F.when(F.col("identity") == "", identity(F.col("rule_id"), F.col("raw"))).otherwise(F.col("identity")))


def placeholder_map(findings: DataFrame, session_col: str, turn_col: str) -> DataFrame:
    """(session, identity, rule_id, original, label, n, placeholder): ``__LABEL_N__`` in order of first sight.

    Order within a session is turn, offset, falling severity, emission. Rules
    that share a label share its counter; every finding counts, overlapped ones
    too. The minima are partial aggregates; the ranking is per session and
    label over distinct values.
    """
    seen = F.struct(turn_col, "off", (-severity_rank(F.col("severity"))).alias("r"), "emit")
    first = with_identity(findings).where("identity <> ''").groupBy(session_col, "identity").agg(F.min(seen).alias("seen"), F.min("rule_id").alias("rule_id"), F.min("raw").alias("original"))
    first = first.withColumn("label", placeholder_label(F.col("rule_id")))
    n = F.row_number().over(Window.partitionBy(session_col, "label").orderBy("seen", "identity"))
    return first.withColumn("n", n).select(session_col, "identity", "rule_id", "original", "label", "n", F.concat(F.lit("__"), F.col("label"), F.lit("_"), F.col("n").cast("string"), F.lit("__")).alias("placeholder"))


def splice(body: Column, spans: Column) -> Column:
    """A text with spans struct(off, end, ..., placeholder), sorted, replaced; a span that begins inside an earlier one is dropped."""
    b = F.encode(body, "UTF-8")
    cut = lambda a, z: F.substring(b, (a + 1).cast("int"), (z - a).cast("int")).cast("string")
    init = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        take = s["off"] >= acc["at"]
        return F.when(take, F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(cut(acc["at"], s["off"]), s["placeholder"])).alias("out"))).otherwise(acc)

    return F.aggregate(spans, init, step, lambda a: F.concat(F.array_join(a["out"], ""), cut(a["at"], F.octet_length(b).cast("bigint"))))


def in_sessions(payloads: DataFrame, findings: DataFrame, id_col: str, session_col: str, turn_col: str) -> DataFrame:
    """Findings with ``__id``, ``__session`` and ``__turn`` of their payloads; other payload columns cannot clash."""
    keys = payloads.select(F.col(id_col).alias("__id"), F.col(session_col).alias("__session"), F.col(turn_col).alias("__turn"))
    f = with_identity(findings).select(F.col(id_col).alias("__fid"), "rule_id", "severity", "off", "end", "raw", "identity", "emit")
    return f.join(keys, F.col("__fid") == F.col("__id")).drop("__fid")


def session_names(payloads: DataFrame, findings: DataFrame, id_col: str, session_col: str, turn_col: str) -> DataFrame:
    """placeholder_map() of payloads and their findings, with the payloads' session column."""
    return placeholder_map(in_sessions(payloads, findings, id_col, session_col, turn_col), "__session", "__turn").withColumnRenamed("__session", session_col)


def redact(payloads: DataFrame, findings: DataFrame, id_col: str, text_col: str, session_col: str, turn_col: str) -> DataFrame:
    """Payloads with ``redacted``: every span of a finding replaced by its session's placeholder.

    ``findings`` carry id_col; session and turn are taken from the payloads.
    """
    f = in_sessions(payloads, findings.where("end > off"), id_col, session_col, turn_col)
    names = placeholder_map(f, "__session", "__turn").select(F.col("__session").alias("__s"), F.col("identity").alias("__i"), "placeholder")
    j = f.join(names, F.col("__session").eqNullSafe(F.col("__s")) & (F.col("identity") == F.col("__i")))
    spans = j.groupBy("__id").agg(F.sort_array(F.collect_list(F.struct("off", "emit", "end", "placeholder"))).alias("__spans"))
    out = payloads.join(spans, F.col(id_col) == F.col("__id"), "left")
    return out.withColumn("redacted", F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(splice(F.col(text_col), F.col("__spans")))).drop("__id", "__spans")


def restore_text(text: Column, entries: Column) -> Column:
    """Placeholders of struct(placeholder, original) entries back to originals, longest placeholder first."""
    order = F.sort_array(F.transform(entries, lambda e: F.struct((-F.length(e["placeholder"])).alias("n"), e["placeholder"].alias("placeholder"), e["original"].alias("original"))))
    return F.aggregate(order, text, lambda t, e: F.replace(t, e["placeholder"], e["original"]))


def restore(responses: DataFrame, names: DataFrame, session_col: str, text_col: str) -> DataFrame:
    """Responses with ``restored``; the session's map is joined, texts without a placeholder mark are left alone."""
    m = names.groupBy(F.col(session_col).alias("__s")).agg(F.collect_list(F.struct("placeholder", "original")).alias("__m"))
    j = responses.join(m, F.col(session_col) == F.col("__s"), "left")
    has = F.contains(F.col(text_col), F.lit("__")) & F.col("__m").isNotNull()
    return j.withColumn("restored", F.when(has, restore_text(F.col(text_col), F.col("__m"))).otherwise(F.col(text_col))).drop("__s", "__m")
