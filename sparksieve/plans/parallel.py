"""Enough partitions for expression-heavy plans over few input splits."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Plan nodes after which Spark has dealt the rows already, or would run a job to tell the partitions.
_DEALT = re.compile(r"(?m)^\W*\w*(?:Exchange|Join|Aggregate|Window|Limit|InMemoryTableScan|Scan In-memory|Scan ExistingRDD)")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly if it is a bare scan of fewer splits than the session has cores; else as it is.

    A Parquet row group is one split, so a small file of expensive texts would
    keep one core busy. Large inputs have more splits than cores and are never
    shuffled here.
    """
    if not hasattr(df, "_jdf"):  # a remote session plans elsewhere
        return df
    spark = df.sparkSession
    plan = df._jdf.queryExecution().sparkPlan().toString()
    cores = spark.sparkContext.defaultParallelism
    if _DEALT.search(plan) or df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
