"""Language ID by Bayesian evidence fusion.

For each document the posterior over languages combines

* the likelihood of the text under byte-trigram models, tempered because
  trigrams overlap, with a uniform model "und" for text unlike any language,
* the declared markup language, through a confusion table P(declared | lang),
* the address suffix and the host, as a prior smoothed hierarchically:
  global -> suffix -> host.

The trigram models are trained on a bounded sample of declared rows; the
confusion table and the priors are grouped aggregations over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.parallel import spread
from .common import ascii_lower, materialize, small_batches, spread_join
from .html_extract import extract_pages
from .url_filter import url_host

#: Rows per language that the trigram models are trained on, about; the rest of the table only scores.
SAMPLE = 400
#: Languages in one block of the model table. Every declared language is modelled; blocks are trained, broadcast and
#: scored one after the other, 4 MB each.
LANGUAGES = 64
#: Hash buckets of the trigram models.
BUCKETS = 1 << 14
#: Weight of a trigram's log likelihood, and the most that the whole text may weigh, in nats.
TEMPER, TEXT_NATS = 0.1, 60.0
#: Pseudo-counts of a host's or suffix's prior, taken from the level above, and of the confusion table.
KAPPA, CONFUSED = 20.0, 1.0
#: Share of the prior given to "und".
UND_PRIOR = 0.01
#: A document is rejected if "und" or a posterior below this comes out.
ACCEPT = 0.5
UND = "und"
_PIECE = 1 << 20


def _buckets(text: str | None) -> np.ndarray:
    """Counts of hashed byte trigrams of the whole text; A-Z lowered, other ASCII than letters one blank."""
    out = np.zeros(BUCKETS, np.int64)
    raw = b" " + b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()) + b" "
    if len(raw) < 4:
        return out
    for at in range(0, len(raw) - 2, _PIECE):
        b = np.frombuffer(raw[at : at + _PIECE + 2], np.uint8).astype(np.uint32)
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return out


_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}

    def emit():
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "bucket", "n"])
        total.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            total[lang] = total.get(lang, 0) + _buckets(text.as_py())
            if len(total) > 4 * LANGUAGES:
                yield from emit()
    yield from emit()


def train(docs: DataFrame, text_col: str, declared_col: str, sample: int = SAMPLE) -> tuple[list[str], list[np.ndarray]]:
    """All declared languages and blocks of their log probabilities per bucket, the last row of the last that of "und".

    A row is in the sample if a hash of its text is below a threshold that
    leaves about ``sample`` rows of its language. Counting is a map with a
    grouped sum; the sums of LANGUAGES languages reach the driver at a time.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col(declared_col).isNotNull() & (F.length(text_col) > 0) & (F.col(declared_col) != UND)).select(F.col(declared_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    langs = materialize(known.groupBy(F.col("lang").alias("l")).agg(F.count(F.lit(1)).alias("c")), "li-langs")
    names = sorted(r["l"] for r in langs.select("l").collect())
    und = np.full((1, BUCKETS), -np.log(BUCKETS), np.float32)
    if not names:
        return names, [und]
    unit = (F.xxhash64("text").bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)
    part = known.join(langs, known["lang"] == langs["l"]).where(unit < F.lit(float(sample)) / F.col("c")).select("lang", "text")
    sums = part.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "li-sums") if len(names) > LANGUAGES else sums
    blocks = []
    for at in range(0, len(names), LANGUAGES):
        block = names[at : at + LANGUAGES]
        of = (sums.where(F.col("lang").isin(block)) if len(names) > LANGUAGES else sums).toPandas()
        model = np.empty((len(block), BUCKETS), np.float32)
        by = dict(tuple(of.groupby("lang")))
        for k, lang in enumerate(block):
            c = np.zeros(BUCKETS)
            if lang in by:
                c[by[lang]["bucket"].to_numpy(np.int64)] = by[lang]["n"].to_numpy(float)
            model[k] = np.log((c + 0.2) / (c.sum() + 0.2 * BUCKETS))
        blocks.append(model)
    blocks[-1] = np.concatenate([blocks[-1], und])
    return names, blocks


def _likelihoods(shared):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(texts: pd.Series) -> pd.Series:
        """Tempered log likelihood of the text by language, "und" last; null without evidence."""
        found = []
        for t in texts:
            c = _buckets(t)
            at = np.flatnonzero(c)
            found.append((at, c[at], c.sum()))
        out = [[] for _ in found]
        for block in shared:
            model = block.value.astype(np.float64)
            for ll, (at, c, n) in zip(out, found):
                if n:
                    ll.append(model[:, at] @ c * min(TEMPER, TEXT_NATS / n))
        return pd.Series([np.concatenate(ll).tolist() if ll else None for ll in out], dtype=object)

    return score


def _suffix(host):
    return F.regexp_extract(F.coalesce(host, F.lit("")), r"\.([A-Za-z0-9-]+)\z", 1)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: the id, ``declared``, ``lang`` (most probable), ``posterior``, ``text_lang`` and ``accepted``.

    ``host_col`` may hold host names or any site key; its last dotted part is
    the address suffix (none: an empty one). Null hosts and null declared
    languages are values of their own, so their evidence is that of all rows
    without one. Null and empty texts, and texts without letters, have no text
    evidence: they take the language that declaration and prior give but are
    not accepted. Repeated rows get equal results. Texts are read and scored
    once and never shuffled; the tables of hosts are grouped sums of one count
    per host and language, joined back to the scores; hosts and declared
    languages with very many rows are spread (see spread_join).
    """
    spark = docs.sparkSession
    names, blocks = train(docs, text_col, declared_col, sample)
    shared = [spark.sparkContext.broadcast(b) for b in blocks]
    labels = [*names, UND]
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("\x00"))
    src = spread(docs.select(id_col, text_col, declared_col, host_col))
    scored = src.select(F.col(id_col).alias("id"), F.coalesce(F.col(declared_col).cast("string"), F.lit("\x00")).alias("declared"), host.alias("host"), _suffix(F.col(host_col).cast("string")).alias("suffix"), _likelihoods(shared)(F.col(text_col).cast("string")).alias("ll"))
    text_lang = F.when(F.col("ll").isNotNull(), F.element_at(F.array(*map(F.lit, labels)), F.array_position("ll", F.array_max("ll")).cast("int")))
    scored = materialize(scored.withColumn("text_lang", text_lang), "li-scored")

    # Grouped counts over all rows: (host, suffix, declared, text language).
    seen = materialize(scored.groupBy("host", "suffix", "declared", "text_lang").agg(F.count(F.lit(1)).alias("n")), "li-seen")
    k = len(labels)

    def counts(*by: str) -> DataFrame:
        """``by`` and in ``c`` the rows of each label; the plan does not grow with the labels."""
        n = seen.groupBy(*by, "text_lang").agg(F.sum("n").cast("double").alias("n"))
        n = n.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.when(F.col("text_lang").isNotNull(), F.struct("text_lang", "n")))).alias("m"))
        return n.select(*by, F.transform(F.array(*map(F.lit, labels)), lambda x: F.coalesce(F.try_element_at("m", x), F.lit(0.0))).alias("c"))

    had = {r["text_lang"]: float(r["n"]) for r in seen.groupBy("text_lang").agg(F.sum("n").alias("n")).collect()}
    all_ = [had.get(x, 0.0) for x in labels]
    base = np.array(all_) + 1.0
    base[-1] = 0
    base = (1 - UND_PRIOR) * base / max(base.sum(), 1) if k > 1 else base
    base[-1] = UND_PRIOR if k > 1 else 1.0
    up = F.array(*map(F.lit, base.tolist()))
    mixed = lambda own, above: F.zip_with(own, above, lambda a, b: (a + KAPPA * b) / (F.aggregate(own, F.lit(0.0), lambda s, x: s + x) + KAPPA))
    by_suffix = counts("suffix").select(F.col("suffix").alias("s"), mixed(F.col("c"), up).alias("sp"))
    rows = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    by_host = counts("host", "suffix").join(by_suffix, F.col("suffix") == F.col("s")).select("host", rows(F.col("c")).alias("n"), mixed(F.col("c"), F.col("sp")).alias("hp"))
    # P(declared | language): the column of each declared value, smoothed.
    totals = F.array(*[F.lit(x) for x in all_])
    n_declared = F.lit(float(seen.select("declared").distinct().count()))
    by_declared = counts("declared").select("declared", rows(F.col("c")).alias("n"), F.zip_with("c", totals, lambda a, t: (a + CONFUSED) / (t + CONFUSED * n_declared)).alias("dp"))

    j = spread_join(scored, materialize(by_host, "li-hosts"), ["host"], "n", F.col("id"), "inner")
    j = spread_join(j, materialize(by_declared, "li-declared"), ["declared"], "n", F.col("id"), "inner")
    zero = F.array(*[F.lit(0.0)] * k)
    logs = F.zip_with(F.zip_with("hp", "dp", lambda a, b: F.ln(a) + F.ln(b)), F.coalesce("ll", zero), lambda a, b: a + b)
    j = j.select("id", "declared", "text_lang", logs.alias("lp"))
    j = j.withColumn("top", F.array_max("lp"))
    lang = F.element_at(F.array(*map(F.lit, labels)), F.array_position("lp", F.col("top")).cast("int"))
    post = 1 / F.aggregate("lp", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    out = j.select(F.col("id").alias(id_col), F.nullif(F.col("declared"), F.lit("\x00")).alias("declared"), lang.alias("lang"), post.alias("posterior"), "text_lang")
    return out.withColumn("accepted", F.coalesce((F.col("lang") != UND) & (F.col("posterior") >= ACCEPT) & F.col("text_lang").isNotNull(), F.lit(False)))


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, text, lang, source) of web pages for identify().

    The text is the main text, ``lang`` the primary subtag of the language that
    the html tag declares, in lower case (null without one), ``source`` the
    host of the url, which gives the address suffix (null without one).
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    tag = F.regexp_extract(html, r"(?is)<html\b([^<>]*)>", 1)
    lang = F.regexp_extract(tag, r"(?is)(?:\A|[\s\"'])(?:xml:)?lang\s*=\s*[\"']?([A-Za-z]{2,8})", 1)
    src = pages.select(F.col(id_col), F.col(html_col).alias("html"), F.nullif(ascii_lower(lang), F.lit("")).alias("lang"), F.nullif(url_host(F.col(url_col)), F.lit("")).alias("source"))
    return extract_pages(src, keep=(id_col, "lang", "source")).drop("n_chars")


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents whose language is accepted; rows with a null id cannot be named by a rejection and are kept."""
    bad = identify(docs, id_col, **options).where(~F.col("accepted")).select(F.col(id_col).alias("__li_id")).distinct()
    return docs.join(bad, docs[id_col] == F.col("__li_id"), "left_anti")
