"""The whole scan as one plan: detectors, decode-and-rescan, filters, duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import detect
from ..operators.keywords import detect_keywords
from ..operators.layers import detect_layers
from ..operators.post import at_least, dedupe, drop_lone_blobs, drop_machine_times
from ..operators.rulesets import detect_ruleset

_SOURCES: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {}


def register_source(name: str, fn: Callable[[DataFrame, str, str], DataFrame]) -> None:
    """Add a detector (payloads, id_col, text_col) -> findings to every scan."""
    _SOURCES[name] = fn


def scan(payloads: DataFrame, id_col: str = "payload_id", text_col: str = "text", keywords: list[tuple[str, str]] | None = None, ruleset=None, ocr: Callable[[bytes], str] | None = None, layers: bool = True, threshold: str | None = None) -> DataFrame:
    """Findings of all detectors over whole payloads, deduplicated.

    Columns: id_col, rule_id, category, severity, off, end, raw, snippet,
    identity, source, emit. Null texts and ids: a null text has no findings;
    rows with a null id are scanned but share one dedupe group. Payloads are
    read once by the JVM detectors and once more by the decode stage, where
    only rows that may hold an encoded run reach Python. What is shuffled are
    findings, never texts.
    """
    found = detect(payloads, id_col, text_col)
    if ruleset is not None:
        found = found.unionByName(detect_ruleset(payloads, id_col, text_col, ruleset))
    if keywords:
        found = found.unionByName(detect_keywords(payloads, id_col, text_col, keywords))
    if ocr is not None:
        from ..sources.images import detect_images

        found = found.unionByName(detect_images(payloads, id_col, text_col, ocr))
    for fn in _SOURCES.values():
        found = found.unionByName(fn(payloads, id_col, text_col))
    if layers:
        found = found.unionByName(detect_layers(payloads, id_col, text_col))
    found = drop_lone_blobs(found, id_col)
    found = drop_machine_times(found)
    found = dedupe(found, id_col)
    return at_least(found, threshold) if threshold else found


def coverage(ruleset=None, keywords=None, ocr=None) -> dict:
    """How many rules and which further sources a scan applies."""
    from ..operators.rules import builtin_rules

    names = ["digit-ids", "alnum-ids"] + (["ruleset"] if ruleset else []) + (["keywords"] if keywords else []) + (["ocr"] if ocr else []) + list(_SOURCES)
    return {"rules": len(builtin_rules()), "sources": names}


def rule_coverage(findings: DataFrame, spark) -> DataFrame:
    """Built-in rules that no finding names."""
    from ..operators.rules import DIGITS, TOKENS, builtin_rules

    ids = [(r.rule_id,) for r in [*builtin_rules(), *DIGITS, *TOKENS]]
    return spark.createDataFrame(ids, "rule_id string").join(findings.select("rule_id").distinct(), "rule_id", "left_anti")


def rollup(findings: DataFrame) -> DataFrame:
    """Findings by category and severity, with subtotals."""
    return findings.rollup("category", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rule_id").alias("rules"))
