"""Time stamps that machines write, which look like identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import contains_any

# Words that mark a field as a time, and the date-time pattern.
EPOCH_WORDS = ("time", "timestamp", "epoch", "requestid", "created", "updated", "date", "_at", "expir", "millis", "instant")
RFC3339 = r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:?\d{2})?"


def is_machine_time(body: Column, off: Column, end: Column) -> Column:
    """Whether [off, end) of a binary lies in an RFC 3339 time, or is a 13-digit epoch in a machine's context."""
    cut = lambda a, b: F.substring(body, (F.greatest(a, F.lit(0)) + 1).cast("int"), (b - F.greatest(a, F.lit(0))).cast("int")).cast("string")
    # The window as Latin-1 has one character per byte.
    window = F.decode(F.substring(body, (F.greatest(off - 48, F.lit(0)) + 1).cast("int"), (end + 16 - F.greatest(off - 48, F.lit(0))).cast("int")), "ISO-8859-1")
    rel_off, rel_end = off - F.greatest(off - 48, F.lit(0)), end - F.greatest(off - 48, F.lit(0))
    m = F.regexp_extract_all(window, F.lit(RFC3339), 0)
    gaps = F.split(window, RFC3339, -1)
    init = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"))

    def step(acc, x):
        a = acc["at"] + F.length(x["g"])
        b = a + F.coalesce(F.length(x["m"]), F.lit(0))
        return F.struct(b.alias("at"), (acc["hit"] | (x["m"].isNotNull() & (a <= rel_off) & (b >= rel_end))).alias("hit"))

    dated = F.aggregate(F.zip_with(gaps, m, lambda g, r: F.struct(g.alias("g"), r.alias("m"))), init, step)["hit"]
    span, left, right = cut(off, end), cut(off - 1, off), cut(end, end + 1)
    left = F.when(off == 0, "").otherwise(left)
    number = F.when(span.rlike(r"\A[0-9]{13}\z"), span.cast("long"))
    alone = ~left.rlike("[0-9]") & ~right.rlike("[0-9]")
    around = ((left == "/") & (right == "/")) | (left.isin(":", '"', " ", "/") & contains_any(F.lower(cut(off - 64, off)), EPOCH_WORDS))
    return dated | F.coalesce(number.between(1_000_000_000_000, 4_102_444_800_000) & alone & around, F.lit(False))
