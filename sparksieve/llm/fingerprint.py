"""Document fingerprints from closed syncmers, DataFrame functions only.

A text is read as pieces: words are cut into PIECE code points from their
start, and code points of scripts that are written without blanks are pieces
of their own; so a text of any script and length has pieces in proportion to
its length. A k-mer of pieces is a closed syncmer if the smallest of its inner
substrings (the single pieces, by hash) is its first or its last. Whether a
k-mer is chosen depends on itself alone, so equal passages give equal anchors
in any context, at positions that differ by one shift.

The fingerprint holds the distinct anchors, each with its first position, that
are among the KEEP smallest by hash or below a SHARE-th of all hashes. So short
texts are held whole, and that of long ones grows with the text. Two
fingerprints are both complete up to the smaller of their bounds; up to there
their anchors are matched by hash and by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.parallel import spread
from .common import WS_CLASS, materialize, parallelism

#: Code points of a word in a piece.
PIECE = 3
#: Pieces in a k-mer; its inner substrings are single pieces.
K = 4
#: The smallest hashes that every fingerprint keeps, and the share of all hashes that it keeps besides.
KEEP, SHARE = 64, 16
# Blocks of scripts written without blanks between words (Thai and Lao, Myanmar, Khmer, East Asian).
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u9FFF\uF900-\uFAFF\uFF00-\uFFEF\x{20000}-\x{3FFFF}"
_PIECES = f"[{UNSPACED}]|[^{WS_CLASS[1:-1]}{UNSPACED}]{{1,{PIECE}}}"
_LOWEST = -(1 << 31)
#: Hashes below this are kept whatever their rank.
_BELOW = _LOWEST + (1 << 32) // SHARE


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def closed_syncmers(parts: Column, inner: int = K) -> Column:
    """array of bigint, hash times 2**32 plus 0-based start, of every closed syncmer.

    ``parts`` has the hashes of the s-mers in order; ``inner`` of them (3 at
    least) make a k-mer. Fewer make one k-mer of them all, none gives an empty array.
    """
    at = lambda i: [F.get(parts, i + k if k else i) for k in range(inner)]

    def closed(i):
        first, *mid, last = at(i)
        return (F.least(*mid) if len(mid) > 1 else mid[0]) >= F.least(first, last)

    number = lambda h, i: F.shiftleft(h.cast("bigint"), 32).bitwiseOR(i.cast("bigint"))
    many = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - inner), closed), lambda i: number(F.hash(*at(i)), i))
    few = F.array(number(F.hash(parts, F.size(parts)), F.lit(0)))
    return F.when(F.size(parts) >= inner, many).when(F.size(parts) > 0, few).otherwise(F.array().cast("array<bigint>"))


def hash_of(anchor: Column) -> Column:
    return F.shiftright(anchor, 32)


def position_of(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit((1 << 32) - 1))


def anchors(text: Column) -> Column:
    """All closed syncmers of a text, in order."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECES), F.lit(0))
    return _let(F.transform(pieces, lambda w: F.hash(w)), lambda p: closed_syncmers(p))


def sketch(text: Column) -> Column:
    """The anchors that the fingerprint keeps, ascending, each hash with its first position; not null."""
    fresh = lambda a: F.filter(a, lambda x, i: (i == 0) | (hash_of(x) != hash_of(F.get(a, i - 1))))
    return _let(_let(F.array_sort(anchors(text)), fresh), lambda a: F.filter(a, lambda x, i: (i < KEEP) | (hash_of(x) < _BELOW)))


def sketch_string(s: Column) -> Column:
    """The sketch as text: for each anchor the hash in eight hex digits, a colon and the position in hex, parted by commas."""
    hexes = lambda x: F.concat(F.lpad(F.hex(hash_of(x).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"), F.lit(":"), F.hex(position_of(x)))
    return F.lower(F.array_join(F.transform(s, hexes), ","))


def _bound(s: Column) -> Column:
    """The hash up to which a sketch is complete."""
    return F.when(F.size(s) < KEEP, F.lit((1 << 31) - 1).cast("bigint")).otherwise(F.greatest(hash_of(F.element_at(s, -1)), F.lit(_BELOW - 1).cast("bigint")))


def match_positions(a: Column, b: Column) -> Column:
    """array of struct(pos, other): the anchors that two sketches share, by hash, in the order of the first.

    Sorted together, with a mark on the second's, equal hashes are neighbours.
    """
    mark = 1 << 31
    both = F.array_sort(F.concat(a, F.transform(b, lambda x: x.bitwiseOR(F.lit(mark)))))

    def pairs(u):
        at = F.filter(F.sequence(F.lit(0), F.size(u) - 2), lambda i: hash_of(F.get(u, i)) == hash_of(F.get(u, i + 1)))
        place = lambda x: x.bitwiseAND(F.lit(mark - 1))
        return F.when(F.size(u) < 2, F.array().cast("array<struct<pos:bigint,other:bigint>>")).otherwise(F.transform(at, lambda i: F.struct(place(F.get(u, i)).alias("pos"), place(F.get(u, i + 1)).alias("other"))))

    return F.array_sort(_let(both, pairs))


def _in_order(m: Column) -> Column:
    """How many matches keep their order with the match before or after them; a lone match does."""
    up = lambda i: F.get(m, i)["other"] < F.get(m, i + 1)["other"]
    kept = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: ((i > 0) & up(i - 1)) | ((i < F.size(m) - 1) & up(i)))
    return F.when(F.size(m) <= 1, F.size(m)).otherwise(F.size(kept))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts' anchors: those that match by hash and keep their order, over all, up to the hash to which both sketches are complete. Two without anchors are alike."""

    def of(p):
        cut = lambda s: F.filter(s, lambda x: hash_of(x) <= p["to"])
        return _let(F.struct(cut(p["a"]).alias("a"), cut(p["b"]).alias("b")), lambda q: _let(match_positions(q["a"], q["b"]), lambda m: _in_order(m) / (F.size(q["a"]) + F.size(q["b"]) - F.size(m))))

    both = F.struct(a.alias("a"), b.alias("b"), F.least(_bound(a), _bound(b)).alias("to"))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).when(a == b, 1.0).otherwise(_let(both, of)).cast("double")


def next_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, next): the next distinct non-null id in ascending order, the first after the last.

    Ids alone are range-partitioned; within a range a window finds the next,
    and one row per range hands on the first of the following range.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    cut = materialize(ids.repartitionByRange(parallelism(spark), "id").select("id", F.spark_partition_id().alias("part")), "fp-ids")
    firsts = cut.groupBy("part").agg(F.min("id").alias("first"))
    over = Window.orderBy("part")  # one row per range
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(over), F.min("first").over(Window.partitionBy())).alias("then"))
    inside = cut.select("id", "part", F.lead("id").over(Window.partitionBy("part").orderBy("id")).alias("lead"))
    return inside.join(F.broadcast(firsts), "part").select("id", F.coalesce("lead", "then").alias("next"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, one row per input row.

    The edited text replaces the last floor(n_chars / 2) code points by the
    first as many (or all) of the next document in ascending id order; the one
    after the last is the first. Returns the id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next. Null text is
    empty. A lone document is its own next. If several rows have the next id,
    the smallest of their texts counts; rows with a null id take the first
    document as their next and are no row's next.

    Texts are shuffled by id once and their first halves once more by the
    next id; the sketches travel along, so each text is sketched once. Rows
    without an id are dealt out by their texts.
    """
    ids = materialize(next_ids(docs, id_col), "fp-next")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Both joins below read one exchange of the texts. The key is a struct, which is never null: a null
    # filter that the optimizer added on one side alone would make it two exchanges.
    key = lambda i, spread_by: F.struct(i.alias("id"), F.when(i.isNull(), spread_by).otherwise(F.lit(0)).cast("long").alias("salt"))
    a = spread(docs.select(F.col(id_col).alias("id"), text.alias("text"))).select(key(F.col("id"), F.xxhash64("text")).alias("k"), "text", sketch(F.col("text")).alias("sk")).repartition("k")
    first = F.lit(None) if ids.isEmpty() else F.lit(ids.agg(F.min("id")).first()[0])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    kind = docs.schema[id_col].dataType
    then = ids.select(key(F.col("id"), F.lit(0)).alias("k"), "next")
    left = a.join(then, "k", "left").select(F.col("k.id").alias("id"), key(F.coalesce("next", first.cast(kind)), F.lit(0)).alias("next"), n.alias("n"), half.alias("half"), F.substring(F.col("text"), F.lit(1), n - half).alias("head"), "sk")
    right = a.groupBy("k").agg(F.min_by(F.struct("text", "sk"), "text").alias("o")).select(F.col("k").alias("oid"), F.col("o.text").alias("otext"), F.col("o.sk").alias("osk"))
    j = left.join(right, left["next"] == right["oid"], "left")
    edited = F.concat("head", F.coalesce(F.substring(F.col("otext"), F.lit(1), F.col("half")), F.lit("")))
    j = j.select("id", "n", "sk", F.coalesce("osk", "sk").alias("osk"), edited.alias("edited"))
    j = j.select("id", "n", "sk", "osk", F.sha2("edited", 256).alias("sha"), F.explode(F.array(sketch(F.col("edited")))).alias("esk"))
    return j.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), sketch_string(F.col("sk")).alias("fingerprint"), sketch_string(F.col("esk")).alias("edited_fingerprint"), likeness(F.col("sk"), F.col("esk")).alias("near_edited"), likeness(F.col("sk"), F.col("osk")).alias("near_next"))
