"""Severity scale and the shape of a finding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("low", "medium", "high", "critical")
FINDING = "struct<rule_id:string,category:string,severity:string,off:bigint,end:bigint,raw:string,snippet:string,identity:string,source:int,rank:int>"


def severity_rank(severity: Column) -> Column:
    """4 for critical down to 1 for low, 0 for anything else."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int"), F.lit(0))


def parse_severity(text: str) -> str:
    """The severity a user wrote, in any case and with blanks around; ValueError for another word."""
    s = text.strip().lower()
    if s not in SEVERITIES:
        raise ValueError(f"unknown severity {text!r}")
    return s


def parse_action(text: str) -> str:
    """block or redact; empty means block."""
    s = text.strip().lower() or "block"
    if s not in ("block", "redact"):
        raise ValueError(f"unknown action {text!r}")
    return s
