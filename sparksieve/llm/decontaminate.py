"""Benchmark decontamination by greedy string tiling.

Texts become token sequences: A-Z lowered, ASCII punctuation and white space
separate, code points of scripts written without blanks are tokens of their
own. Runs of tokens that a document shares with a test item, found by a
running Karp-Rabin hash and a join with the index of the items' runs, are the
seeds. Seeds are only listed where a common run begins, so a passage of one
repeated word costs no more than another. The longest run of unmarked tokens
is marked as a tile again and again. Tiles may lie in any order, so a passage
whose sentences were rearranged is still covered. A pair is reported if its
tiles cover at least ``coverage`` of the item's tokens.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.parallel import spread
from .common import small_batches

#: Shortest tile and seed, in tokens.
MIN_MATCH = 5
#: Items of fewer tokens than a tile must occur whole; items of fewer than this say nothing and match nothing.
MIN_ITEM = 3
#: Least share of an item's tokens under tiles.
COVERAGE = 0.5
#: UTF-8 bytes of items that are sent to every executor at once. Larger benchmarks are taken in blocks, each against all documents.
BLOCK_BYTES = 4_000_000
#: Common runs of one document that are held at once; an item with more of them is tiled row by row.
RUNS = 1 << 20

_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_FOLD = bytes(32 if b in _PUNCT or b < 32 else b + 32 if 65 <= b <= 90 else b for b in range(256))
# Blocks of scripts written without blanks between words (Thai and Lao, Myanmar, Khmer, East Asian).
_UNSPACED = re.compile("[฀-໿က-႟ក-៿⺀-鿿豈-﫿＀-￯\U00020000-\U0003ffff]")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def tokens(text: str | None) -> list[bytes]:
    text = text or ""
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text)
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class KarpRabin:
    """Running hashes modulo 2**64 of a token sequence.

    The hash of a window is a difference of two running sums, so its cost does
    not depend on its width. Powers of the base are kept between texts.
    """

    up = down = np.ones(1, np.uint64)

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        if len(KarpRabin.up) <= n:
            size = max(n + 1, 2 * len(KarpRabin.up))
            powers = lambda b: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64)
            KarpRabin.up, KarpRabin.down = powers(_BASE), powers(_INVERSE)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * KarpRabin.down[:n], dtype=np.uint64)))

    def windows(self, at: np.ndarray, width: int) -> np.ndarray:
        """Hashes of the windows of ``width`` tokens that start at ``at``."""
        return (self.sums[at + width] - self.sums[at]) * KarpRabin.up[at]


def common_length(doc: np.ndarray, i: int, item: np.ndarray, j: int) -> int:
    """Tokens from doc[i] and item[j] on that are equal."""
    n, most, step = 0, min(len(doc) - i, len(item) - j), 64
    while n < most:
        m = min(step, most - n)
        off = np.flatnonzero(doc[i + n : i + n + m] != item[j + n : j + n + m])
        if len(off):
            return n + int(off[0])
        n, step = n + m, step * 2
    return n


def _free_runs(free: np.ndarray, width: int) -> list[tuple[int, int]]:
    """(start, length) of the runs of true values that are at least ``width`` long."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2]) if b - a >= width]


def tile(doc: np.ndarray, item: np.ndarray, starts, width: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (doc start, item start, length): the longest first, of equal ones that first in doc, then in item.

    ``starts`` has the (i, j) at which common runs begin; ones with shorter
    runs than ``width`` (a hash alone proves nothing) are skipped.
    """
    heap = [(-n, i, j) for i, j in starts if (n := common_length(doc, i, item, j)) >= width]
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        free = ~(in_doc[i : i - n] | in_item[j : j - n])
        if not free.all():
            for a, m in _free_runs(free, width):
                heapq.heappush(heap, (-m, i + a, j + a))
            continue
        out.append((i, j, -n))
        in_doc[i : i - n] = in_item[j : j - n] = True
        if not _free_runs(~in_item, width):  # no further tile has room
            break
    return out


def tile_by_rows(doc: np.ndarray, item: np.ndarray, width: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """tile() without a list of runs: each tile is found by one pass over the item with one row of run lengths."""
    doc, item, out = doc.copy(), item.copy(), []
    while True:
        best, row = (0, 0, 0), np.zeros(len(doc), np.int64)
        for j, x in enumerate(item):
            before = np.concatenate(([0], row[:-1])) if len(row) else row
            row = np.where(doc == x, before + 1, 0) if x >= 0 else np.zeros_like(row)
            n = int(row.max(initial=0))
            if n >= width:
                best = max(best, (n, -(int(np.argmax(row)) - n + 1), -(j - n + 1)))
        n, i, j = best[0], -best[1], -best[2]
        if n < width:
            return out
        out.append((i, j, n))
        doc[i : i + n], item[j : j + n] = -1, -2


class Tiler:
    """Test items indexed by the hashes of their windows, in flat arrays; scores documents against all of them."""

    def __init__(self, items: list[tuple], width: int = MIN_MATCH, coverage: float = COVERAGE, runs: int = RUNS) -> None:
        self.width, self.coverage, self.runs = width, coverage, runs
        self.vocab: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        self.items = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in tokens(text)], np.int64) for _, text in items]
        self.index = {w: self._windows(w) for w in sorted({self.seed_width(len(x)) for x in self.items if len(x)})}

    def seed_width(self, n: int) -> int:
        """Tokens in the seeds of an item of n tokens; 0 if it is too short to match anything."""
        return self.width if n >= self.width else n if n >= MIN_ITEM else 0

    def _windows(self, w: int):
        """Windows of the items of seed width w: distinct hashes, where each one's windows start in the rest, (hash, token before), item, position."""
        of = [k for k, x in enumerate(self.items) if w and self.seed_width(len(x)) == w]
        if not of:
            return None
        h = [KarpRabin(self.items[k]).windows(np.arange(len(self.items[k]) - w + 1), w) for k in of]
        before = [np.concatenate(([len(self.vocab) + 1], self.items[k][: len(x) - 1])) for k, x in zip(of, h)]
        known, rank = np.unique(np.concatenate(h), return_inverse=True)
        key = rank.reshape(-1) * (len(self.vocab) + 2) + np.concatenate(before)
        order = np.argsort(key, kind="stable")
        item = np.repeat(np.array(of), [len(x) for x in h])[order]
        pos = np.concatenate([np.arange(len(x)) for x in h])[order]
        key = key[order]
        return known, np.searchsorted(key, np.arange(len(known) + 1) * (len(self.vocab) + 2)), key, item, pos

    def _seeds(self, ids: np.ndarray, sums: KarpRabin, w: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces of (item, doc position, item position) at which common runs of w tokens or more begin."""
        if self.index[w] is None or len(ids) < w:
            return
        known, starts, key, item, pos = self.index[w]
        unknown = np.concatenate(([-1], np.flatnonzero(ids == 0), [len(ids)]))
        room = np.diff(unknown) - w  # windows that start behind each unknown token
        wide = np.flatnonzero(room > 0)
        if not len(wide):
            return
        at = np.repeat(unknown[wide] + 1 - np.concatenate(([0], np.cumsum(room[wide])[:-1])), room[wide]) + np.arange(room[wide].sum())
        h = sums.windows(at, w)
        rank = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[rank] == h
        at, rank = at[hit], rank[hit]
        # Of the windows with the document's hash, those with another token before them; the rest continue a run.
        mine = rank * (len(self.vocab) + 2) + np.where(at > 0, ids[at - 1], 0)
        lo, hi = starts[rank], starts[rank + 1]
        cut, end = np.searchsorted(key, mine, "left"), np.searchsorted(key, mine, "right")
        first, size, doc = np.concatenate((lo, end)), np.concatenate((cut - lo, hi - end)), np.concatenate((at, at))
        todo = np.flatnonzero(size > 0)
        first, size, doc = first[todo], size[todo], doc[todo]
        upto = np.cumsum(size)
        a = 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + self.runs, "right")))
            n = size[a:b]
            k = np.repeat(first[a:b] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            yield item[k], np.repeat(doc[a:b], n), pos[k]
            a = b

    def score(self, text: str | None) -> list[tuple]:
        """(item_id, coverage, tiles, matched tokens, longest tile) of the items covered enough."""
        if not self.index:
            return []
        get = self.vocab.get
        ws = tokens(text)
        ids = np.fromiter(map(get, ws, repeat(0)), np.int64, len(ws))
        if not ids.any():
            return []
        sums, out = KarpRabin(ids), []
        for w in self.index:
            pieces = self._seeds(ids, sums, w)
            first, second = next(pieces, None), next(pieces, None)
            if second is not None:  # too many runs to hold: the items they lie in, one after the other
                for k in sorted({int(k) for piece in chain((first, second), pieces) for k in np.unique(piece[0])}):
                    out += self._scored(k, tile_by_rows(ids, self.items[k], w))
            elif first is not None:
                out += self._tiled(ids, w, *first)
        return sorted(out, key=lambda x: (-x[1], x[0] is None, x[0]))

    def _tiled(self, ids, w, item, at, pos) -> list[tuple]:
        order = np.argsort(item, kind="stable")
        item, at, pos = item[order], at[order], pos[order]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(item)) + 1, [len(item)]))
        out = []
        for a, b in zip(cut[:-1], cut[1:]):
            k = int(item[a])
            out += self._scored(k, tile(ids, self.items[k], zip(at[a:b].tolist(), pos[a:b].tolist()), w))
        return out

    def _scored(self, k: int, tiles) -> list[tuple]:
        n, got = len(self.items[k]), sum(n for *_, n in tiles)
        return [(self.ids[k], got / n, len(tiles), got, max(m for *_, m in tiles))] if tiles and got >= self.coverage * n else []


_TILERS: dict = {}


def _tiler(shared) -> Tiler:
    """The tiler of a broadcast block; a worker keeps the last one for its next tasks."""
    if shared.id not in _TILERS:
        _TILERS.clear()
        _TILERS[shared.id] = Tiler(*shared.value)
    return _TILERS[shared.id]


class _Shared:
    """A broadcast variable and a name that workers know it by."""

    def __init__(self, var, name: str) -> None:
        self.var, self.id = var, name

    @property
    def value(self):
        return self.var.value


def _scored(shared, id_type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiler = _tiler(shared)
        for b in batches:
            rows = []
            for i, text in zip(b.column(0), b.column(1)):
                rows += [(i.as_py(), *x) for x in tiler.score(text.as_py())]
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [b.schema.field(0).type, id_type, pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc", "item", "coverage", "tiles", "matched", "longest"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, item_col, coverage, tiles, matched, longest): every document and item with enough of the item's tokens under tiles.

    Null texts are empty; items of fewer than ``min_match`` tokens match where
    they occur whole, those of fewer than MIN_ITEM tokens nowhere. Repeated
    items are reported each, repeated documents too. Rows with null ids are
    scored like any other and reported under a null id.

    The benchmark's size is measured first. Items are the query set: they are
    dealt by hash to blocks of about ``block_bytes`` (a larger item is a block
    of its own size), each block is broadcast as its texts, indexed once in
    every Python worker (about 60 bytes a token), and joined with the seeds of
    all documents in one map without a shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc {id_kind}, item {item_kind}, coverage double, tiles long, matched long, longest long"
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("itext"))
    d = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    size = items.select(F.coalesce(F.sum(F.octet_length("itext") + 16), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes) or 1
    out = None
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("itext", "item"), F.lit(blocks)) == k)
        var = spark.sparkContext.broadcast(([(r[0], r[1]) for r in block.collect()], min_match, coverage))
        part = d.mapInArrow(_scored(_Shared(var, f"{spark.sparkContext.applicationId}-{id(spark)}-{var._jbroadcast.id()}"), to_arrow_type(benchmark.schema[item_col].dataType)), schema)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "coverage", "tiles", "matched", "longest")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that no benchmark item leaks into; rows with a null id cannot be named by a leak and are kept."""
    bad = leaks(docs, benchmark, id_col, text_col, **options).select(F.col(id_col).alias("__dc_id")).distinct()
    return docs.join(bad, docs[id_col] == F.col("__dc_id"), "left_anti")
