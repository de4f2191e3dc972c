"""SimHash near-dedup over a Gray-order hierarchical index.

The index has two kinds of levels. Upper nodes are masked bit patterns: all
fingerprints that agree on the bits of a mask hang under one node, and nodes
are the unit of distribution. Within a node, the members are sorted by Gray
rank, and a tree is built over the order: each tree node holds the mask of the
bits that all of its members share and their pattern. The join walks pairs of
tree nodes, accumulates the differences of shared bits and prunes a whole pair
once they exceed the limit; where even the bits not shared cannot exceed it,
the whole groups are linked at once, so dense groups of copies never expand
into pairs.

Two sets of masks are used. For a small radius, the 64 bits are cut into
max_bits + shared blocks and a mask takes ``shared`` of them: fingerprints
within the radius agree on one mask at least, so no link is lost. For a wanted
similarity of the shingle sets, which needs a wide radius, fingerprints of 128
bits are used and masks of WIDE_BITS bits drawn from them (see wide_masks).
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.parallel import spread
from .common import drop_table, materialize, small_batches, spread_join
from .components import connected_components

#: Fingerprints link at so many differing bits or fewer.
MAX_BITS = 3
#: Blocks that an upper node's mask takes in. More blocks mean smaller nodes and more of them.
SHARED = 2
#: Words in a shingle of the registered query; the pipeline takes five.
SHINGLE = 3
#: Share of the pairs at similarity 0.8 that no wide mask joins, and the differing bits of 128 up to which a pair is proposed.
MISSED, WIDE_RADIUS = 0.05, 28
#: Wide masks that are tried first, so that the others find large groups joined.
SEEDS = 4
#: Members of an index node that one task works on together; larger nodes are dealt out in pairs of blocks.
BLOCK = 4096
#: Texts of a candidate component that one task compares by their shingle sets; larger ones are dealt out in pairs of groups.
GROUP = 128
_LEAF = 24
_PIECE = 1 << 15
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats counted; 0 without words.

    A-Z are lowered, words are runs without blank and U+0009..U+000D, fewer
    words than a shingle make one shingle. Bit i is 1 if it is 1 in more than
    half of the shingles' XXH64 hashes (seed 42). Long texts are handled in
    pieces, so memory does not grow with the bits of all shingles.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        hs = np.fromiter((digest(join(words[i : i + shingle]), 42) for i in range(at, min(n, at + _PIECE))), np.uint64)
        ones += np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """One hash per shingle of fingerprint(), in order, combined from one hash per word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(shingle, len(h))
    n = len(h) - k + 1 if k else 0
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return _mixed(out)


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128-bit SimHash of shingle hashes, repeats counted, as two words; zero without any."""
    out = []
    for h in (hashes, _mixed(hashes ^ np.uint64(0xD6E8FEB86659FD93))):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), _PIECE):
            ones += np.unpackbits(h[at : at + _PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]))
    return out[0], out[1]


def _fingerprints(shingle: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if wide:
                fps = np.array([wide_fingerprint(shingle_hashes(t.as_py(), shingle)) for t in b.column(1)], np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps[:, 0]), pa.array(fps[:, 1])], names=["id", "fp", "fp2"])
            else:
                fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, wide: bool = False) -> DataFrame:
    """(id, fp), or (id, fp, fp2) if ``wide``: one row per input row, the fingerprint's words of 64 bits as longs."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    src = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    return src.mapInArrow(_fingerprints(shingle, wide), f"id {kind}, fp long" + ", fp2 long" * wide)


def block_masks(max_bits: int = MAX_BITS, shared: int = SHARED) -> list[tuple[int]]:
    """Masks of ``shared`` of max_bits + shared blocks of near-equal width: near fingerprints agree on one of them."""
    n = max_bits + shared
    edges = [64 * i // n for i in range(n + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [(sum(c),) for c in combinations(block, shared)]


def wide_masks(n: int, missed: float = MISSED, seed: int = 42) -> list[tuple[int, int]]:
    """Masks over 128 bits for n fingerprints, drawn without regard to the data.

    A mask has about log2(n) bits, so an index node has a few members at any
    size. Fingerprints of sets of similarity 0.8 differ in 15 % of their bits
    on average (their angle is 0.47), so they agree on a mask of b bits with
    a chance of 0.85 ** b; there are as many masks as leave ``missed`` of such
    pairs without one, and their number grows with n to the power of 0.23.
    """
    bits = max(12, math.ceil(math.log2(max(2, n))))
    rng, out = random.Random(seed), []
    for _ in range(math.ceil(-math.log(missed) / 0.85**bits)):
        m = sum(1 << b for b in rng.sample(range(128), bits))
        out.append((m & ((1 << 64) - 1), m >> 64))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray order; values and ranks as rows of 64-bit words, the highest first."""
    out, odd = np.empty_like(v), np.zeros(len(v), np.uint64)
    for w in range(v.shape[1]):
        x = v[:, w].copy()
        for s in (1, 2, 4, 8, 16, 32):
            x ^= x >> np.uint64(s)
        out[:, w] = x ^ odd  # an odd number of ones above turns the order around
        odd = np.where(out[:, w] & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    return out


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


_POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _pop(x: np.ndarray) -> np.ndarray:
    """Ones over the words in the last axis."""
    return np.bitwise_count(x).sum(-1, dtype=np.int64) if hasattr(np, "bitwise_count") else _POP[np.ascontiguousarray(x).view(np.uint16)].sum(-1, dtype=np.int64)


def _int(words: np.ndarray) -> int:
    return int.from_bytes(words.astype(">u8").tobytes(), "big")


class GrayTree:
    """Binary tree over Gray-sorted fingerprints (rows of words); a node knows the bits that all its members share."""

    def __init__(self, values: np.ndarray, rows: np.ndarray) -> None:
        order = np.lexsort(gray_rank(values).T[::-1])
        self.v, self.rows = values[order], rows[order].tolist()
        self.full = (1 << 64 * values.shape[1]) - 1
        self.nodes: list[tuple[int, int, int, int, int, int]] = []  # lo, hi, mask, pattern, left, right
        self._build(0, len(self.v))

    def _build(self, lo: int, hi: int) -> int:
        part = self.v[lo:hi]
        same_1, same_0 = _int(np.bitwise_and.reduce(part)), _int(np.bitwise_or.reduce(part))
        at = len(self.nodes)
        mask = ~(same_1 ^ same_0) & self.full
        self.nodes.append((lo, hi, mask, same_1 & mask, -1, -1))
        if hi - lo > _LEAF and mask != self.full:
            # The highest bit not shared changes once along the Gray order of the range.
            top = (same_1 ^ same_0).bit_length() - 1
            bit = (part[:, -1 - top // 64] >> np.uint64(top % 64)) & np.uint64(1)
            cut = lo + int(np.flatnonzero(bit != bit[0])[0])
            left = self._build(lo, cut)
            right = self._build(cut, hi)
            self.nodes[at] = (lo, hi, mask, same_1 & mask, left, right)
        return at


def gray_join(a: GrayTree, b: GrayTree | None, max_bits: int, link) -> None:
    """Call link(i, j), by the trees' rows, for enough pairs to connect all fingerprints of a and b (or within a) at max_bits or fewer differing bits."""
    other = b or a
    width = 64 * a.v.shape[1]
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        lo, hi, mask, pat, left, right = a.nodes[i]
        lo2, hi2, mask2, pat2, left2, right2 = other.nodes[j]
        shared = mask & mask2
        far = ((pat ^ pat2) & shared).bit_count()
        if far > max_bits:
            continue
        if far + width - shared.bit_count() <= max_bits:  # all pairs are near
            for k in range(lo + 1, hi):
                link(a.rows[lo], a.rows[k])
            for k in range(lo2, hi2):
                link(a.rows[lo], other.rows[k])
            continue
        if b is None and i == j:
            if left < 0:
                d = _pop(a.v[lo:hi, None] ^ a.v[None, lo:hi])
                for x, y in zip(*np.nonzero(np.triu(d <= max_bits, 1))):
                    link(a.rows[lo + x], a.rows[lo + y])
            else:
                todo += [(left, left), (right, right), (left, right)]
        elif left < 0 and left2 < 0:
            d = _pop(a.v[lo:hi, None] ^ other.v[None, lo2:hi2])
            for x, y in zip(*np.nonzero(d <= max_bits)):
                link(a.rows[lo + x], other.rows[lo2 + y])
        elif left2 < 0 or (left >= 0 and hi - lo >= hi2 - lo2):
            todo += [(left, j), (right, j)]
        else:
            todo += [(i, left2), (i, right2)]


def _stars(roots: np.ndarray, values: np.ndarray, sides: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """(least root, root) for the roots that near pairs join within one block, or across two (with those within them left to their own tasks).

    Rows of one root count as joined. Naming a component by its least root lets
    the nodes that a group of copies shares give the same links.
    """
    uf, first = _Union(len(values)), {}
    named = roots.tolist()
    for i, r in enumerate(named):
        uf.join(i, first.setdefault(r, i))
    if len(first) == 1:
        return []
    rows = np.arange(len(values))
    if sides.any():
        if not sides.all():
            one = sides == 0
            gray_join(GrayTree(values[one], rows[one]), GrayTree(values[~one], rows[~one]), max_bits, uf.join)
    elif len(values) <= 64:
        for x, y in zip(*np.nonzero(np.triu(_pop(values[:, None] ^ values[None, :]) <= max_bits, 1))):
            uf.join(int(x), int(y))
    else:
        gray_join(GrayTree(values, rows), None, max_bits, uf.join)
    least: dict[int, int] = {}
    for r, i in first.items():
        c = uf.find(i)
        least[c] = min(least.get(c, r), r)
    return [(least[uf.find(i)], r) for r, i in first.items() if least[uf.find(i)] != r]


def _join_nodes(max_bits: int):
    """Links of roots within runs of equal (node, unit); rows are sorted by it, a run is at most two blocks."""

    def work(nodes, roots, values, sides):
        cut = np.flatnonzero((nodes[1:] != nodes[:-1]).any(axis=1)) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(roots)]
        # Most nodes with company have two members: those are compared at once.
        two = starts[ends - starts == 2]
        two = two[(roots[two] != roots[two + 1]) & (_pop(values[two] ^ values[two + 1]) <= max_bits) & ((sides[two] == 0) | (sides[two] != sides[two + 1]))]
        found = [np.sort(np.stack([roots[two], roots[two + 1]], axis=1), axis=1)]
        for k in np.flatnonzero(ends - starts > 2):
            at = slice(starts[k], ends[k])
            pairs = _stars(roots[at], values[at], sides[at], max_bits)
            if pairs:
                found.append(np.array(pairs, np.int64))
        got = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            col = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            part = np.stack(col[:2], axis=1), col[2], np.stack(col[4:], axis=1).view(np.uint64), col[3]
            held = part if held is None else tuple(np.concatenate(x) for x in zip(held, part))
            last = np.flatnonzero((held[0] != held[0][-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield work(*[x[:cut] for x in held])
                held = tuple(x[cut:] for x in held)
        if held is not None and len(held[1]):
            yield work(*held)

    return run


def near_links(nodes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK, masks: list[tuple[int, ...]] | None = None) -> DataFrame:
    """(a, b): links of roots; their components are those of all pairs at max_bits or fewer differing bits that agree on one of ``masks``.

    ``nodes`` is a table of (root, a word of the fingerprint or more); root is
    a long that names the row, or the rows that are known to be joined already.
    The masks default to block_masks(), which lose no pair. Index nodes of more
    than ``block`` members are dealt out as all pairs of their blocks, so no
    task holds more than two blocks, and no link is lost.
    """
    spark = nodes.sparkSession
    words = nodes.columns[1:]
    masks = block_masks(max_bits) if masks is None else masks
    every = F.array(*[F.array(F.lit(k).cast("long"), *[F.lit(_signed(x)).cast("long") for x in m]) for k, m in enumerate(masks)])
    # Nodes go by a hash of mask and pattern: nodes that it may merge are compared in vain, and nothing else.
    index = nodes.select("root", *words, F.explode(every).alias("m"))
    index = index.select("root", *words, F.xxhash64(F.col("m")[0], *[F.col(w).bitwiseAND(F.col("m")[i + 1]) for i, w in enumerate(words)]).alias("n"))
    hot = index.groupBy("n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > block)
    hot = materialize(hot.select("n", F.ceil(F.col("c") / block).cast("int").alias("w")), "sh-hot")
    if hot.isEmpty():
        units = index.select("n", F.lit(0).cast("long").alias("u"), "root", F.lit(0).alias("side"), *words)
    else:
        j = index.join(hot, "n", "left").withColumn("w", F.coalesce("w", F.lit(1)))
        at = F.pmod(F.xxhash64(*words), F.col("w")).cast("int")
        other = F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda k: F.struct((F.least(at, k).cast("long") * F.col("w") + F.greatest(at, k)).alias("u"), F.when(at <= k, 0).otherwise(1).alias("side")))
        units = j.select("n", "root", *words, F.explode(other).alias("x")).select("n", F.col("x.u").alias("u"), "root", F.col("x.side").alias("side"), *words)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    units = units.repartition("n", "u").sortWithinPartitions("n", "u")
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "20000")
        links = materialize(units.mapInArrow(_join_nodes(max_bits), "a long, b long").distinct(), "sh-links")
    finally:
        spark.conf.set(key, was)
    drop_table(hot, spark)
    return links


def candidate_roots(nodes: DataFrame, max_bits: int, block: int) -> DataFrame:
    """(key, root) of the nodes (key, fp, fp2), a table, that have company; a root names a component.

    The first few masks already join most of a large group of copies; the
    others then compare and link roots alone, so links grow with the group and
    not with the number of masks.
    """
    masks = wide_masks(nodes.count())
    parts = [masks[:SEEDS], masks[SEEDS:]]
    named = nodes.select("key", F.col("key").alias("root"), "fp", "fp2")
    for part in parts:
        roots = connected_components(near_links(named.select("root", "fp", "fp2"), max_bits, block, part)).toDF("node", "top")
        named = named.join(roots, named["root"] == roots["node"], "left").select("key", F.coalesce("top", "root").alias("root"), "fp", "fp2")
        named = materialize(named, "sh-named")
    many = named.groupBy(F.col("root").alias("r")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return named.join(many, F.col("root") == F.col("r")).select("key", "root")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, block: int = BLOCK, shared: int = SHARED) -> DataFrame:
    """(id_col, fingerprint, component_id): one row per input row.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the smallest
    id that the links reach. Equal fingerprints, the zero of texts without
    words included, are one node of the graph, so groups of copies cost one
    row each. A null id never becomes a component's name while the component
    has another. Repeated rows give repeated results; an empty table an empty
    one.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "sh-fps")
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "sh-distinct")
    links = near_links(distinct.select(F.col("fp").alias("root"), "fp"), max_bits, block, block_masks(max_bits, shared))
    roots = connected_components(links)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = materialize(named.join(least, "root").select("fp", "n", "component_id"), "sh-names")
    out = spread_join(fps, names, ["fp"], "n", F.col("id"), "inner")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes, sorted; empty without words."""
    return np.unique(shingle_hashes(text, shingle))


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Shared part of two sorted sets, 1 if both are empty; 0 where the sizes alone keep it below ``least``."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not len(b):
        return 1.0
    if len(a) / len(b) < least or not len(a):
        return 0.0
    same = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return same / (len(a) + len(b) - same)


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sets, pa.list_(pa.int64()))], names=["key", "s"])

    return run


def _alike(max_bits: int, similarity: float):
    """Links of keys within runs of equal (root, unit): near fingerprints whose shingle sets are alike."""

    def work(rows) -> list[tuple[int, int]]:
        keys, sets = [r[0] for r in rows], [r[4] for r in rows]
        fps = np.array([r[1:3] for r in rows], np.int64).view(np.uint64)
        sides = np.array([r[3] for r in rows])
        uf, out = _Union(len(rows)), []
        two = bool(sides.any())
        for i in np.flatnonzero(sides == 0).tolist():
            near = _pop(fps ^ fps[i]) <= max_bits
            near &= (sides == 1) if two else (np.arange(len(rows)) > i)
            for j in np.flatnonzero(near).tolist():
                # Pairs that verified links join already need no look.
                if uf.find(i) != uf.find(j) and jaccard(sets[i], sets[j], similarity) >= similarity:
                    uf.join(i, j)
                    out.append((keys[i], keys[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def emit(links):
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

        for b in batches:
            sets = b.column(6)
            flat, ends = sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy()
            for k, row in enumerate(zip(*[b.column(c).to_pylist() for c in range(6)])):
                if row[:2] != at:
                    if len(held) > 1:
                        yield emit(work(held))
                    held, at = [], row[:2]
                held.append((*row[2:], flat[ends[k] : ends[k + 1]].copy()))
        if len(held) > 1:
            yield emit(work(held))

    return run


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = SHINGLE, max_bits: int = WIDE_RADIUS, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(id_col, component_id) like near_classes(), but a link is a Jaccard similarity of the shingle sets.

    The nodes are distinct texts with fingerprints of 128 bits. Components of
    pairs that agree on a wide mask and differ in ``max_bits`` or fewer are
    only candidates: within each, every pair at max_bits or fewer is compared
    by its sets unless verified links join it already, so no link below
    ``similarity`` is made, and of those above it only what the masks miss is
    lost (see wide_masks). A candidate of more than ``group`` texts is dealt
    out as all pairs of its groups. Only texts with company are shuffled, once
    for each distinct one; exact copies cost one row.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("key")).alias("x"), text.alias("text"))
    fps = materialize(fingerprints(src, "x", "text", shingle, wide=True).select("id.id", "id.key", "fp", "fp2"), "sh-fps")
    nodes = materialize(fps.groupBy("key", "fp", "fp2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "sh-nodes")
    roots = materialize(candidate_roots(nodes, max_bits, block), "sh-roots").toDF("node", "root")
    many = roots.groupBy(F.col("root").alias("r")).agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("w"))
    members = roots.join(many, F.col("root") == F.col("r")).join(nodes, F.col("node") == F.col("key")).select("root", "key", "fp", "fp2", "w", "n")
    members = materialize(members, "sh-members")
    # Of the copies of a text, the row with the smallest id stands for all, so no copy travels.
    one = nodes.join(members.select(F.col("key").alias("k")), F.col("key") == F.col("k")).select("key", F.col("least").alias("__one"))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k"), text.alias("text")).join(one, (F.col("k") == F.col("key")) & F.col("id").eqNullSafe(F.col("__one")))
    texts = texts.select("key", "text").dropDuplicates(["key"])
    sets = texts.mapInArrow(_sets(shingle), "key long, s array<long>")
    sets = materialize(sets.join(members, "key").select("root", "key", "fp", "fp2", "w", "s"), "sh-sets")
    at = F.pmod(F.xxhash64("key"), F.col("w")).cast("int")
    unit = F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda k: F.struct((F.least(at, k).cast("long") * F.col("w") + F.greatest(at, k)).alias("u"), F.when(at <= k, 0).otherwise(1).alias("side")))
    units = sets.select("root", "key", "fp", "fp2", "s", F.explode(unit).alias("x")).select("root", "x.u", "key", "fp", "fp2", "x.side", "s")
    units = units.repartition("root", "u").sortWithinPartitions("root", "u")
    links = materialize(units.mapInArrow(_alike(max_bits, similarity), "a long, b long"), "sh-alike")
    joined = connected_components(links)
    of = nodes.join(joined, nodes["key"] == joined["node"], "left").select("key", "n", "least", F.coalesce("root", "key").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    names = materialize(of.join(least, "root").select("key", "n", "component_id"), "sh-names")
    return spread_join(fps, names, ["key"], "n", F.col("id"), "inner").select(F.col("id").alias(id_col), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, **options) -> DataFrame:
    """The documents of which no nearer-numbered copy exists: one of each component stays, the one with the smallest id.

    With ``similarity`` the components are those of similar_classes(), else of
    near_classes(). Rows with a null id are kept, since nothing tells them
    apart; rows that share the kept id are all kept.
    """
    classes = near_classes(docs, id_col, text_col, **options) if similarity is None else similar_classes(docs, id_col, text_col, similarity, **options)
    gone = classes.where(F.col(id_col) > F.col("component_id")).select(F.col(id_col).alias("__sh_id")).distinct()
    return docs.join(gone, docs[id_col] == F.col("__sh_id"), "left_anti")
