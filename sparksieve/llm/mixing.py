"""Mixing sources to target weights by entropy balancing.

Each document d of source s gets a rate r_d in (0, 2), the number of times the
mix should take it. Rates minimise the bounded entropy

    sum_d m_d * [ r log r + (2 - r) log(2 - r) ]

under one token constraint per source, sum_d size_d r_d = T_s. The dual is
convex and has one multiplier per source; its stationary point is the
exponential tilt of the odds, r / (2 - r) = exp(lam_s * t_d), so a logistic
rate because no document is taken more than twice: r_d = 2 / (1 + exp(-lam_s *
t_d)), t_d = (size_d / mean) ** tilt. ``tilt`` 1 is plain entropy balancing (m_d = 1), 0 makes the rates of a
source equal (m_d = size_d). The multipliers are found by Newton steps whose
gradient and Hessian are grouped aggregations over the histogram of (source,
size), so an iteration never touches the documents again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.parallel import spread
from .common import drop_table, materialize, numbered, small_batches, spread_join

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix takes so many times the words that there are.
BUDGET = 1.5
#: No document and no source is taken more often.
MOST = 2
#: Documents in one ranking group, about; larger cells are split by a hash.
CELL = 512


@F.pandas_udf(T.LongType())
def count_words(texts: pd.Series) -> pd.Series:
    """Runs of characters other than blank and U+0009..U+000D; null counts 0."""
    return pd.Series([0 if t is None else len(t.encode("utf-8", "surrogatepass").split()) for t in texts], dtype="int64")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    ``budget`` times the total is shared by weight; a source stops at ``most``
    times its own size, and the excess is shared by weight among the others
    until none is above. So a source's target is the lesser of its limit and
    its weight times one water level; the level follows from grouped sums, and
    as each round only adds full sources, rounds are few. Sources may be as
    many as hosts: they are numbered by range, never in one task.
    """
    per = numbered(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "source", "place", "mix-per")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    per = per.select("source", "source_size", w.alias("weight"), (most * F.col("source_size")).cast("double").alias("cap"))
    goal, spare = per.agg(budget * F.sum("source_size"), F.sum("weight")).first()
    level, left = (goal / spare, spare) if spare else (0.0, 0.0)
    while left:
        full = F.col("cap") < level * F.col("weight")
        used, still = per.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if still == left:
            break
        left = still
        level = (goal - used) / left if left else float("inf")
    return per.select("source", "source_size", F.least("cap", level * F.col("weight")).cast("double").alias("target"))


def solve_multipliers(hist: DataFrame, targets: DataFrame, tilt: float, rounds: int = 60, tol: float = 1e-6) -> DataFrame:
    """(source, source_size, target, mean, lam) by safeguarded Newton on the dual.

    ``hist`` has (source, size, n). A target of 0 gives -inf, one of ``MOST``
    times the size gives +inf (every rate is then 0 or ``MOST``).
    """
    mean = hist.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    inf = float("inf")
    state = targets.join(mean, targets["source"].eqNullSafe(mean["source"]), "left").drop(mean["source"])
    state = state.select("source", "source_size", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"), F.when(F.col("target") <= 0, -inf).when(F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12), inf).otherwise(0.0).alias("lam"), F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"), F.lit(False).alias("done"))
    state = materialize(state, "mix-state")
    for _ in range(rounds):
        s = state.where("not done and abs(lam) < double('infinity')").select(F.col("source").alias("s"), "mean", "lam")
        x = hist.join(s, hist["source"].eqNullSafe(F.col("s")))
        t = F.pow(F.col("size") / F.col("mean"), F.lit(tilt))
        r = MOST / (1 + F.exp(-F.col("lam") * t))
        total = x.groupBy("s").agg(F.sum(F.col("n") * F.col("size") * r).alias("got"), F.sum(F.col("n") * F.col("size") * t * r * (1 - r / MOST)).alias("slope"))
        j = state.join(total, state["source"].eqNullSafe(total["s"]), "left")
        off = F.col("target") - F.col("got")
        lo, hi = F.when(off > 0, F.col("lam")).otherwise(F.col("lo")), F.when(off > 0, F.col("hi")).otherwise(F.col("lam"))
        newton = F.col("lam") + off / F.col("slope")
        inner = (newton > lo) & (newton < hi) & (F.col("slope") > 0) & (F.abs(newton) < 1e6)
        middle = F.when(hi == inf, F.greatest(2 * lo, lo + 1)).when(lo == -inf, F.least(2 * hi, hi - 1)).otherwise((lo + hi) / 2)
        done = F.col("done") | F.col("got").isNull() | (F.abs(off) <= F.greatest(tol * F.col("target"), F.lit(1e-6)))
        nxt = j.select("source", "source_size", "target", "mean", F.when(done, F.col("lam")).when(inner, newton).otherwise(middle).alias("lam"), F.when(done, F.col("lo")).otherwise(lo).alias("lo"), F.when(done, F.col("hi")).otherwise(hi).alias("hi"), done.alias("done"))
        nxt = materialize(nxt, "mix-state")
        drop_table(state, state.sparkSession)
        state = nxt
        if state.where("not done").isEmpty():
            break
    return state.drop("lo", "hi", "done")


def _round_cells(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for each cell of one source, the rounding error carried from large sizes to small.

    A source has one cell per distinct size, so the group is bounded by the
    length of the longest document, whatever the number of rows.
    """
    pdf = pdf.sort_values("size", ascending=False, kind="stable")
    want = took = 0.0
    out = []
    for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"]):
        want += size * n * rate
        k = round((want - took) / size) if size else round(n * rate)
        k = int(min(MOST * n, max(0, k)))
        took += k * size
        out.append(k)
    return pdf.assign(copies=out)[["source", "size", "n", "rate", "copies"]]


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list:
    """Columns id, source, size and tie (a hash of the text that tells rows with equal or no ids apart)."""
    text = F.col(text_col).cast("string")
    return [F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), count_words(text).alias("size"), F.xxhash64(text).alias("tie")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, budget: float = BUDGET, tilt: float = 0.5, seed: int = 42) -> DataFrame:
    """Copies of each document so that every source's words come near its target.

    Returns the id, and ``size``, ``source``, ``source_size`` (longs, string),
    ``target``, ``rate`` (doubles), ``copies`` (0, 1 or 2) and ``taken`` = size
    times copies, one row per input row. Rates are solved as the module says,
    then rounded per (source, size) cell from the largest size down with the
    error carried on, so a source ends within about one small document of its
    target; which documents of a cell get the larger copy count follows a
    seeded hash of id and text, so reruns agree. A null source is a source of
    its own, last in order. Null and empty texts have size 0 and count for
    nothing; rows with equal or no ids are dealt copies each. An empty table
    gives an empty result.
    """
    small_batches(docs.sparkSession)
    sizes = materialize(spread(docs.select(F.col(id_col), F.col(text_col), F.col(source_col))).select(*_measured(docs, id_col, text_col, source_col)), "mix-sizes")
    return mix_sizes(sizes, weights, budget, tilt, seed).withColumnRenamed("id", id_col).drop("tie")


def mix_sizes(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, tilt: float = 0.5, seed: int = 42) -> DataFrame:
    """mix() from (id, source, size, tie) rows, which are read three times and so should be a table; ``tie`` may be missing."""
    hist = materialize(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    solved = materialize(solve_multipliers(hist, source_targets(sizes, weights, budget), tilt), "mix-solved")
    rate = F.when(F.col("lam") == float("inf"), float(MOST)).when(F.col("lam") == float("-inf"), 0.0).otherwise(MOST / (1 + F.exp(-F.col("lam") * F.pow(F.col("size") / F.col("mean"), F.lit(tilt)))))
    # The source as a text that is never null: window and join then share one exchange.
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("__s")
    h = F.xxhash64(*[c for c in ("id", "tie") if c in sizes.columns], F.lit(seed))
    # A cell of n documents is dealt to ceil(n / CELL) hash buckets; the cells that hold most are broadcast.
    big = hist.select(name, "size", "n", F.ceil(F.col("n") / CELL).alias("wide")).where("wide > 1")
    placed = spread_join(sizes.select("*", name), materialize(big, "mix-big"), ["__s", "size"], "n", h)
    placed = placed.select(*sizes.columns, "__s", F.pmod(h, F.coalesce("wide", F.lit(1))).alias("bucket"))
    s = solved.withColumnRenamed("source", "ss")
    cells = hist.join(s, hist["source"].eqNullSafe(s["ss"])).select("source", "size", "n", rate.alias("rate"))
    cells = cells.groupBy("source").applyInPandas(_round_cells, "source string, size long, n long, rate double, copies long")
    cells = cells.select(name, "size", "n", "rate", "copies").toDF("cs", "cz", "n", "rate", "k")
    # A cell's copies are dealt to its buckets by running sums, so that they add up.
    parts = placed.groupBy("__s", "size", "bucket").agg(F.count(F.lit(1)).alias("m"))
    parts = parts.join(cells, (parts["__s"] == F.col("cs")) & (F.col("size") == F.col("cz")))
    upto = F.sum("m").over(Window.partitionBy("__s", "size").orderBy("bucket"))
    share = lambda x: F.floor(x.cast("decimal(20,0)") * (F.col("k") % F.col("n")).cast("decimal(18,0)") / F.col("n")).cast("long")
    parts = parts.withColumn("upto", upto).select("cs", "cz", F.col("bucket").alias("cb"), F.col("m").alias("n"), "rate", (F.floor(F.col("k") / F.col("n")) * F.col("m") + share(F.col("upto")) - share(F.col("upto") - F.col("m"))).alias("k"))
    cells = materialize(parts, "mix-cells")
    ranked = placed.withColumn("i", F.row_number().over(Window.partitionBy("__s", "size", "bucket").orderBy(h, "id")) - 1)
    out = ranked.join(cells, (F.col("__s") == F.col("cs")) & (F.col("size") == F.col("cz")) & (F.col("bucket") == F.col("cb")))
    copies = F.floor(F.col("k") / F.col("n")) + (F.col("i") < F.col("k") % F.col("n")).cast("long")
    out = out.select(*sizes.columns, "rate", copies.alias("copies"))
    s = solved.select(F.col("source").alias("ss"), "source_size", "target")
    out = out.join(s, out["source"].eqNullSafe(s["ss"])).drop("ss")
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row as many times as its copies, with ``mix_copy`` (from 1) and ``mix_rate`` (input columns so named are replaced).

    Copies are dealt to rows, not to ids, so rows without an id and rows that
    share one are taken as often as mix() says. Texts are shuffled once, by id
    and text; only rows equal in id, text and source are dealt out among each other.
    """
    small_batches(docs.sparkSession)
    sizes = materialize(docs.select(*_measured(docs, id_col, text_col, source_col)), "mix-sizes")
    key = lambda i, source, tie: F.struct(i.alias("id"), source.alias("source"), tie.alias("tie"))  # noqa: E731, never null, nulls within are equal
    got = mix_sizes(sizes, **options).groupBy(key(F.col("id"), F.col("source"), F.col("tie")).alias("__mk"))
    got = got.agg(F.min("copies").alias("__lo"), F.sum("copies").alias("__sum"), F.count(F.lit(1)).alias("__n"), F.max("rate").alias("mix_rate")).where("__sum > 0")
    names = [c for c in docs.columns if c not in ("mix_copy", "mix_rate")]
    rows = docs.select(key(F.col(id_col), F.col(source_col).cast("string"), F.xxhash64(F.col(text_col).cast("string"))).alias("__mk"), *names)
    rows = rows.withColumn("__i", F.row_number().over(Window.partitionBy("__mk").orderBy("__mk")))
    copies = F.col("__lo") + (F.col("__i") <= F.col("__sum") - F.col("__lo") * F.col("__n")).cast("long")
    out = rows.join(got, "__mk").withColumn("__c", copies).where("__c > 0")
    return out.select(*names, "mix_rate", F.explode(F.sequence(F.lit(1), F.col("__c").cast("int"))).alias("mix_copy"))
