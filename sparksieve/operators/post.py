"""Filters over findings: lone blobs, machine time stamps, duplicates, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import severity_rank

BLOB = "generic-base64-blob"


def drop_lone_blobs(findings: DataFrame, id_col: str) -> DataFrame:
    """Drop base64 blobs inside whose span no finding of another rule begins.

    An interval anti-join per payload, done as a running window over offsets:
    in descending order of offset the nearest later non-blob start is known,
    so no pairs are formed.
    """
    w = Window.partitionBy(id_col).orderBy("off").rangeBetween(0, Window.unboundedFollowing)
    nearest = F.min(F.when(F.col("rule_id") != BLOB, F.col("off"))).over(w)
    f = findings.withColumn("__next", nearest)
    return f.where((F.col("rule_id") != BLOB) | (F.col("__next") < F.col("end"))).drop("__next")


def drop_machine_times(findings: DataFrame) -> DataFrame:
    """Drop findings inside machine time stamps; the detectors have marked them, so no text is moved."""
    return findings.where(~F.col("machine_time")).drop("machine_time")


def dedupe(findings: DataFrame, id_col: str) -> DataFrame:
    """One finding for each (payload, span, category, severity), the first emitted; a partial aggregate, no window."""
    keys = [id_col, "off", "end", "category", "severity"]
    rest = [c for c in findings.columns if c not in keys and c != "emit"]
    best = findings.groupBy(*keys).agg(F.min_by(F.struct("emit", *rest), "emit").alias("b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"b.{c}") for c in findings.columns])


def at_least(findings: DataFrame, threshold: str) -> DataFrame:
    """Findings of the threshold's severity or above."""
    return findings.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(threshold)))


def ordered(findings: DataFrame, id_col: str) -> DataFrame:
    """Findings by payload, offset, falling severity and emission."""
    return findings.orderBy(id_col, "off", severity_rank(F.col("severity")).desc(), "emit")
