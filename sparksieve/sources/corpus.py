"""Golden cases as JSON lines, and logs that are still being written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "name string, prompt string, expect string, rules array<string>, secrets array<string>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases {name, prompt, expect: BLOCKED | FORWARDED, rules, secrets}."""
    return spark.read.schema(CASE).json(path)


def write_cases(cases: DataFrame, path: str) -> None:
    cases.select(*[c.split()[0] for c in CASE.split(", ")]).write.json(path)


def judge_cases(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """(name, expect, got, missing): what a scan of the prompts, keyed by name, decided, and the expected rules that did not fire."""
    f = findings.groupBy(F.col("name").alias("__n")).agg(F.collect_set("rule_id").alias("__r"))
    j = cases.join(f, F.col("name") == F.col("__n"), "left")
    got = F.when(F.size(F.coalesce("__r", F.array().cast("array<string>"))) > 0, "BLOCKED").otherwise("FORWARDED")
    return j.select("name", "expect", got.alias("got"), F.array_except(F.coalesce("rules", F.array().cast("array<string>")), F.coalesce("__r", F.array().cast("array<string>"))).alias("missing"))


def follow_log(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (file, value) lines of the log files that appear under ``path``; the source holds back a line without its end."""
    return spark.readStream.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
