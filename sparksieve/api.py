"""What a user imports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.layers import ByteScanner, register_layer
from .operators.policy import block_advice, decide
from .operators.redact import placeholder_map, redact, restore
from .operators.rules import register_rule
from .operators.session import consent_decisions
from .plans.scan import coverage, register_source, rollup, rule_coverage, scan
from .schema import SEVERITIES, parse_action, parse_severity

__all__ = ["scan", "decide", "redact", "restore", "placeholder_map", "consent_decisions", "block_advice", "register_rule", "register_source", "register_layer", "coverage", "rollup", "rule_coverage", "parse_severity", "parse_action", "register_functions"]


def register_functions(spark: SparkSession) -> None:
    """SQL functions: scan_findings(text) as a table function, mask_text(text, threshold), and the checksums as check_<name>."""
    from pyspark.sql.functions import udtf

    from .functions.checks import CHECKS, check_any

    @udtf(returnType="rule_id string, category string, severity string, off int, `end` int")
    class ScanFindings:
        def __init__(self):
            self.scanner = ByteScanner()

        def eval(self, text: str):
            for off, end, rule, cat, sev, _ in self.scanner.scan((text or "").encode()):
                yield rule, cat, sev, off, end

    @F.pandas_udf("string")
    def mask_text(texts: pd.Series, threshold: pd.Series) -> pd.Series:
        scanner, out = ByteScanner(), []
        for text, floor in zip(texts, threshold):
            if text is None:
                out.append(None)
                continue
            body, at, parts = text.encode(), 0, []
            for off, end, _, _, sev, _ in scanner.scan(body):
                if SEVERITIES.index(sev) >= SEVERITIES.index(floor) and off >= at:
                    parts += [body[at:off], "•".encode() * min(end - off, 8)]
                    at = end
            out.append(b"".join([*parts, body[at:]]).decode("utf-8", "replace"))
        return pd.Series(out)

    spark.udtf.register("scan_findings", ScanFindings)
    spark.udf.register("mask_text", mask_text)
    for name in CHECKS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION check_{name}(x STRING) RETURNS BOOLEAN RETURN {check_any(name, 'x')}")
