"""Line dedup: repeated three-line windows are found globally and later occurrences removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_join

WIDTH = 3
TRIM = " \t\r"


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per window of ``width`` consecutive non-blank lines: id, pos, span, h1, h2.

    ``pos`` lists the line numbers covered. A document with fewer non-blank
    lines (but at least one) has one window of them all. The key is 128 bits
    wide and takes in the line count, so a short window equals no full one.
    """
    full = F.filter(
        F.transform(_lines(F.col(text_col)), lambda l, i: F.struct(i.alias("p"), F.btrim(l, F.lit(TRIM)).alias("l"))),
        lambda x: x["l"] != "",
    )
    base = docs.select(F.col(id_col).alias("id"), F.transform(full, lambda x: F.struct(x["p"].alias("p"), F.xxhash64(x["l"]).alias("x"), F.xxhash64(F.concat(F.lit("\n"), x["l"])).alias("y"))).alias("ls"))
    base = base.where(F.size("ls") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ls") - (width - 1)))
    part = base.select("id", "ls", F.explode(starts).alias("s"))
    part = part.select("id", F.slice("ls", F.col("s"), F.lit(width)).alias("w"))
    return part.select("id", F.transform("w", lambda x: x["p"]).alias("pos"), F.xxhash64(F.transform("w", lambda x: x["x"])).alias("h1"), F.xxhash64(F.transform("w", lambda x: x["y"]), F.size("w")).alias("h2"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, gone): the sorted line numbers of each document that a later occurrence covers."""
    w = line_windows(docs, id_col, text_col, width).select("id", F.col("pos")[0].alias("p0"), "pos", "h1", "h2")
    first = w.groupBy("h1", "h2").agg(F.min(F.struct("id", "p0")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(first, "ld-first")
    later = spread_join(w, first, ["h1", "h2"], "n", F.struct("id", "p0"), "inner").where(F.struct("id", "p0") > F.col("first"))
    return later.groupBy("id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("pos")))).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Remove the later occurrences of line windows that occur more than once.

    Lines are parts between line feeds, compared without blanks, tabs and
    returns at their ends; blank lines belong to no window and are kept.
    Occurrences are ordered by (id, line number): the first stays, and the
    lines under any later one go, overlapping windows merged. Returns the
    input's columns with ``text_col`` replaced, and ``n_lines`` and
    ``removed_lines`` (longs; input columns so named are replaced). Null text
    counts as empty and comes back as empty; rows with a null id are returned
    whole and take no part; rows that share an id count as one position
    sequence each, so an exact repeat of a row keeps the same lines as the row.

    Windows are shuffled by a 128-bit key: minima are combined before the
    shuffle, and the join with the repeated keys spreads a window that very
    many documents share (see spread_join). Texts are shuffled once, by id.
    """
    gone = repeated_lines(docs.where(F.col(id_col).isNotNull()), id_col, text_col, width).select(F.col("id").alias("__ld_id"), F.col("gone").alias("__ld_gone"))
    out = docs.join(gone, docs[id_col] == F.col("__ld_id"), "left")
    out = out.withColumn("__ld_lines", _lines(F.col(text_col)))
    at = F.sequence(F.lit(0), F.size("__ld_lines") - 1)
    keep = F.array_except(at, F.col("__ld_gone"))
    text = F.when(F.col("__ld_gone").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(F.transform(keep, lambda i: F.get("__ld_lines", i)), "\n"))
    values = {text_col: text, "n_lines": F.size("__ld_lines").cast("long"), "removed_lines": F.coalesce(F.size("__ld_gone"), F.lit(0)).cast("long")}
    same = [c for c in docs.columns if c not in values]
    order = [c for c in docs.columns if c in values] + [c for c in values if c not in docs.columns]
    return out.select(*[docs[c] for c in same], *[values[c].alias(c) for c in order]).select(*docs.columns, *[c for c in values if c not in docs.columns])


#: DuckDB SQL for the query: doc_id, n_lines, removed_lines, text.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), f AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS p FROM l
), nb AS (
  SELECT doc_id, p, trim(line, ' ' || chr(9) || chr(13)) AS t,
         row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k,
         count(*) OVER (PARTITION BY doc_id) AS n
  FROM f WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), w AS (
  SELECT a.doc_id, a.k, a.p AS p0, least(a.n, 3) AS span,
         a.t || chr(10) || coalesce(b.t, chr(0)) || chr(10) || coalesce(c.t, chr(0)) AS key
  FROM nb a
  LEFT JOIN nb b ON b.doc_id = a.doc_id AND b.k = a.k + 1
  LEFT JOIN nb c ON c.doc_id = a.doc_id AND c.k = a.k + 2
  WHERE a.k <= greatest(1, a.n - 2)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, p0) AS o FROM w
), gone AS (
  SELECT DISTINCT r.doc_id, nb.p FROM r JOIN nb ON nb.doc_id = r.doc_id AND nb.k BETWEEN r.k AND r.k + r.span - 1 WHERE r.o > 1
)
SELECT f.doc_id, count(*) AS n_lines, count(gone.p) AS removed_lines,
       coalesce(string_agg(f.line, chr(10) ORDER BY f.p) FILTER (WHERE gone.p IS NULL), '') AS text
FROM f LEFT JOIN gone ON gone.doc_id = f.doc_id AND gone.p = f.p
GROUP BY f.doc_id
"""
