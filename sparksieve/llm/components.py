"""Connected components by random-order contraction, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """Label every node that an edge names with a node of its component.

    ``edges`` holds pairs of values of one atomic type. Returns (node, root),
    one row per distinct node; two nodes have one root exactly if a path links
    them. Null ends and loops link nothing; a node named by loops alone is its
    own root. An empty input gives an empty result.

    In each round a node joins the neighbour (or itself) that comes first in an
    order drawn anew from a hash, and the graph is contracted to the nodes
    chosen. The random order makes the node count fall by a constant factor
    whatever the ids are, so a path with sorted ids takes as few rounds as any
    other. Per-node minima are partial aggregates, so a hub with most of the
    edges is pre-aggregated before the shuffle; joins are plain equi-joins that
    adaptive execution can split.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    live = materialize(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    steps: list[DataFrame] = []
    for k in range(max_rounds):
        if live.isEmpty():
            break
        both = live.select("a", "b").union(live.select("b", "a")).toDF("a", "b")
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("v"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("nb"))
        step = materialize(best.select(F.col("a").alias("node"), F.least("nb", rank("a"))["v"].alias("root")), "cc-step")
        to_a, to_b = step.toDF("a", "ra"), step.toDF("b", "rb")
        nxt = live.join(to_a, "a").join(to_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        nxt = materialize(nxt, "cc-edges")
        drop_table(live, spark)
        live = nxt
        steps.append(step)
    else:
        raise RuntimeError("connected components did not converge")
    labels = None
    for step in reversed(steps):
        if labels is None:
            labels = step
        else:
            up = labels.toDF("root", "top")
            labels = materialize(step.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "cc-labels")
    if labels is None:
        return nodes.select("node", F.col("node").alias("root"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
