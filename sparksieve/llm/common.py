"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as the contracts count it: blank, tab, line feed, vertical tab, form feed, return.
WS_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows in an Arrow batch. Texts run to 100 kB and more, so Spark's 10,000 would need gigabytes.
BATCH_ROWS = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch size unless the session has a lower one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a session on one
    machine, as in tests, may leave that unset: it gets a temporary folder.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="sparksieve-shared-")
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/sparksieve/{what}-{uuid.uuid4().hex}"


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def temporary(spark: SparkSession):
    """Tables that materialize() writes within are deleted at the end, when the frames that read them have been used."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            drop_table(path, spark)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage and outlives the executors, unlike a cached frame.
    The result may be read lazily, so the table stays until temporary() ends or
    the shared folder is cleaned.
    """
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df_or_path, spark: SparkSession) -> None:
    """Delete a table that materialize() wrote and that no later step reads."""
    paths = [df_or_path] if isinstance(df_or_path, str) else list({os.path.dirname(p) for p in df_or_path.inputFiles()})
    jvm = spark.sparkContext._jvm
    for p in paths:
        if "/sparksieve/" in p:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Fewer keys than this can each have more than one part in so many of the rows; that is the bound on what spread_join() broadcasts.
HOT_KEYS = 1000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, by: Column, how: str = "left") -> DataFrame:
    """Equi-join of ``left`` with the unique keys of ``right`` in which no key is hot.

    ``right`` is a written table; its column ``weight`` says how many rows of
    left have the key. Keys that weigh more than one part in HOT_KEYS of all,
    so fewer than HOT_KEYS rows, are broadcast; rows of left that have them are
    done, and are dealt out by the hash of ``by`` in the shuffle that joins the
    rest. ``how`` is left or inner. Returns left's columns, then right's other ones.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight).cast("double") * HOT_KEYS > float(total)
    values = [c for c in right.columns if c not in keys and c != weight]
    side = lambda df, tag: df.select(*[F.col(k).alias(f"__{tag}{i}") for i, k in enumerate(keys)], F.struct(*values).alias(f"__{tag}"))
    same = lambda tag: [F.col(k) == F.col(f"__{tag}{i}") for i, k in enumerate(keys)]
    out = left.join(F.broadcast(side(right.where(heavy), "h")), same("h"), "left")
    out = out.withColumn("__salt", F.when(F.col("__h").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(by), F.lit(1 << 20))).cast("int"))
    rest = side(right.where(~heavy), "r").withColumn("__none", F.lit(0))
    out = out.join(rest, [*same("r"), F.col("__salt") == F.col("__none")], "left")
    if how == "inner":
        out = out.where(F.col("__h").isNotNull() | F.col("__r").isNotNull())
    return out.select(*left.columns, *[F.coalesce(F.col("__h")[v], F.col("__r")[v]).alias(v) for v in values])


def numbered(df: DataFrame, by: str, name: str, what: str) -> DataFrame:
    """``df`` as a written table with ``name``, the 0-based position of each row in the order of ``by``, nulls last.

    Rows are range-partitioned; only one count per range is handed on.
    """
    spark = df.sparkSession
    key = [F.col(by).isNull(), F.col(by)]
    cut = materialize(df.repartitionByRange(parallelism(spark), *key).withColumn("__part", F.spark_partition_id()), what)
    counts = cut.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    over = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = counts.select("__part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("__before")).withColumnRenamed("__part", "__p")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*key)) - 1
    out = cut.withColumn(name, own).join(F.broadcast(before), F.col("__part") == F.col("__p"))
    return out.select(*df.columns, (F.col(name) + F.col("__before")).cast("long").alias(name))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
