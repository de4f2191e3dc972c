"""Operators over documents: brute force on small fixtures, and hard rows for each of them."""

import hashlib
import math
import os
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparksieve.llm import common, decontaminate, fingerprint, langid, line_dedup, mixing, simhash
from sparksieve.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, fingerprint string, __tag int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with extra columns whose names operators also use."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "x", "y", 2) for i, t, lang, s in rows], SCHEMA)


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(5, 120)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5] + " tail", "", "   ", "one", "Two words", "\n".join(f"line {k} of many" for k in range(6)), "a\nb\n\nc\nd", prose(rng, 30_000)]
    texts += [texts[10].replace("a", "e", 1), texts[10], "é ñ 漢字 🙂 " + texts[11]]
    out = [(i * 3, t, ("en", "de", None)[i % 3], ("b", "a", "c", None)[i % 4]) for i, t in enumerate(texts)]
    out += [(None, None, None, None), (None, texts[1], "en", "a"), (9000, None, "en", "a"), out[4], out[4]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_line_dedup(spark):
    p = "alpha line\nbeta line\ngamma line\ndelta line"
    rows = [(1, "x\n" + p + "\ny", "en", "a"), (2, "u\n" + p + "\nv", "en", "a"), (3, "alpha line\nbeta line", "en", "a"), (4, "z\n\nalpha line \n\n beta line\ngamma line", "en", "a"), (5, "r\nr\nr\nr", "en", "a"), (6, "short", "en", "a"), (7, "short", "en", "a"), (8, None, "en", "a"), (None, p, "en", "a"), (9, "", "en", "a"), (6, "short", "en", "a")]
    out = line_dedup.dedup_lines(frame(spark, rows))
    assert out.columns[: len(frame(spark, rows).columns)] == frame(spark, rows).columns
    got = {(r["doc_id"], r["text"], r["removed_lines"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert (1, "x\n" + p + "\ny", 0) in got and (2, "u\nv", 4) in got and (3, "alpha line\nbeta line", 0) in got
    assert (4, "z\n\n", 3) in got and (5, "r", 3) in got and (6, "short", 0) in got and (7, "", 1) in got and (8, "", 0) in got and (None, p, 0) in got and (9, "", 0) in got


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for i, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    names = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, rest = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        t = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if t[s] > 2 * sizes[s]]
        if not over:
            target.update(t)
            break
        for s in over:
            target[s] = 2 * sizes[s]
            rest -= target[s]
            left.discard(s)
    for s in names:
        g = got[got["source"].isna()] if s is None else got[got["source"] == s]
        assert set(g["source_size"]) == {sizes[s]} and np.allclose(g["target"], target[s])
        assert abs(g["taken"].sum() - target[s]) <= max(0.02 * target[s], 60, g["size"].max() / 2)
    assert (got["taken"] <= 2 * got["size"]).all() and set(got["copies"]) <= {0, 1, 2}
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "source", "copies"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert mixing.mix(empty).count() == 0
    # The mix takes every row, without an id or with a shared one, as often as mix() says.
    copies = mixing.mixed_documents(docs).groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n"), F.max("mix_copy").alias("top")).collect()
    want = mixing.mix(docs).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).where("n > 0").collect()
    assert sorted(map(str, [(r["doc_id"], r["source"], r["n"]) for r in copies])) == sorted(map(str, [(r["doc_id"], r["source"], r["n"]) for r in want]))
    assert max(r["top"] for r in copies) == 2 and any(r["doc_id"] is None for r in copies)
    assert mixing.mixed_documents(docs).columns == [*docs.columns, "mix_rate", "mix_copy"]


def test_many_sources_and_hot_cells(spark):
    """The water level and the numbering of sources by brute force, with fewer partitions than sources."""
    sizes = spark.range(3000).select("id", F.when(F.col("id") % 97 != 0, F.concat(F.lit("host"), (F.col("id") * F.col("id") % 211).cast("string"))).alias("source"), (F.col("id") % 5 + (F.col("id") * F.col("id") % 211)).alias("size"))
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    size = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    names = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, left, rest = {}, set(names), 1.5 * sum(size.values())
    while left:
        t = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if t[s] > 2 * size[s]]
        if not over:
            want.update(t)
            break
        for s in over:
            want[s] = 2 * size[s]
            rest -= want[s]
            left.discard(s)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)
    mixed = mixing.mix_sizes(sizes).groupBy("source").agg(F.sum("taken").alias("k"), F.max("size").alias("m")).collect()
    assert all(abs(r["k"] - want[r["source"]]) <= r["m"] for r in mixed)


def test_temporary_tables_go(spark):
    with common.temporary(spark):
        t = common.materialize(spark.range(5).toDF("x"), "gone")
        path = t.inputFiles()[0].removeprefix("file://")
        assert t.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)


def test_spread_join(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 != 1, F.col("id") % 900).alias("k"))
    right = spark.range(800).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.when(F.col("id") == 7, 1700).otherwise(1).alias("n"))
    for how in ("left", "inner"):
        got = common.spread_join(left, right, ["k"], "n", F.col("id"), how)
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right.drop("n"), "k", how).select("id", "k", "v").collect()))
    got = common.numbered(left.select("id", F.nullif(F.col("id") % 1000, F.lit(5)).alias("x")), "x", "at", "t").collect()
    assert sorted(r["at"] for r in got) == list(range(5000))
    assert [r["x"] for r in sorted(got, key=lambda r: r["at"])] == sorted((r["x"] for r in got), key=lambda x: (x is None, x))


def test_rates_are_exponential_tilts(spark):
    hist = spark.createDataFrame([("a", k, 5) for k in range(1, 40)], "source string, size long, n long")
    total = sum(k * 5 for k in range(1, 40))
    t = spark.createDataFrame([("a", total, 0.7 * total)], "source string, source_size long, target double")
    r = mixing.solve_multipliers(hist, t, 0.5).first()
    got = sum(5 * k * 2 / (1 + math.exp(-r["lam"] * (k / r["mean"]) ** 0.5)) for k in range(1, 40))
    assert abs(got - 0.7 * total) < 1e-3 * total and r["lam"] < 0


def test_cells_of_many_copies(spark):
    sizes = spark.range(20_000).select("id", F.lit("s").alias("source"), F.lit(3).cast("long").alias("size")).unionByName(spark.range(20_000, 20_010).select("id", F.lit("t").alias("source"), F.lit(9).cast("long").alias("size")))
    got = mixing.mix_sizes(sizes).groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == {"s": 20_000, "t": 10} and all(abs(r["k"] - r["t"]) <= 9 for r in got)


def brute_tiles(doc, item, width):
    """Greedy string tiling by trying every pair of starts."""
    in_doc, in_item, tiles = [0] * len(doc), [0] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not in_doc[i + n] and not in_item[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < width:
            return tiles
        tiles.append((i, j, n))
        for k in range(n):
            in_doc[i + k] = in_item[j + k] = 1


def test_tiling_matches_brute_force():
    rng = random.Random(3)
    for k in range(400):
        abc = ("abcd", "ab", "a", "abcdefgh")[k % 4]
        items = [[rng.choice(abc) for _ in range(rng.randint(1, 14))] for _ in range(3)]
        doc = [rng.choice(abc + "x") for _ in range(rng.randint(1, 30))]
        want = []
        for i, item in enumerate(items):
            w = min(3, len(item))
            tiles = brute_tiles(doc, item, w) if w >= decontaminate.MIN_ITEM else []
            got = sum(n for *_, n in tiles)
            if tiles:
                want.append((i, got / len(item), len(tiles), got, max(n for *_, n in tiles)))
        for runs in (decontaminate.RUNS, 1):  # listed runs, and rows of run lengths where there are too many
            t = decontaminate.Tiler([(i, " ".join(x)) for i, x in enumerate(items)], 3, 0.01, runs)
            assert sorted(t.score(" ".join(doc))) == sorted(want)


def test_tiling_of_repetitive_short_and_unspaced_texts():
    t0 = time.process_time()
    t = decontaminate.Tiler([(1, "w " * 200), (2, "w " * 7 + "v"), (3, "yes"), (4, "one two three four"), (5, "\u4f60\u597d\u4e16\u754c\u548c\u5e73"), (6, "")])
    assert [x[:2] for x in t.score("w " * 100_000)] == [(1, 1.0), (2, 0.875)]
    assert t.score("yes") == [] and [x[0] for x in t.score("a one, two THREE four b")] == [4] and t.score("one two three") == []
    assert [x[:2] for x in t.score("\u6211\u4f60\u597d\u4e16\u754c\u548c\u5e73\u5417")] == [(5, 1.0)]
    lots = decontaminate.Tiler([(1, " ".join("a a a a a b a a a a a c".split() * 20))], runs=10_000)
    assert lots.score(" ".join("a a a a a d a a a a a e".split() * 2000))[0][1] > 0.8
    assert time.process_time() - t0 < 20
    ids = np.array([random.Random(1).randrange(9) for _ in range(500)])
    sums = decontaminate.KarpRabin(ids)
    for w in (1, 3, 5):
        h = sums.windows(np.arange(500 - w + 1), w)
        assert len(set(h.tolist())) == len({tuple(ids[k : k + w]) for k in range(500 - w + 1)})
        again = decontaminate.KarpRabin(ids[200:]).windows(np.arange(300 - w + 1), w)
        assert (again == h[200:]).all()  # the hash of a window does not depend on where it stands


def test_leaks(spark, docs, empty):
    rng = random.Random(5)
    items = [(k, prose(rng, 24, "klmnopqrst")) for k in range(12)] + [(50, None), (51, "too short"), (52, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    w = items[4][1].split()
    rows = [(1, "start " + items[2][1].upper() + "! end", "en", "a"), (2, " ".join(w[12:] + ["filler"] * 9 + w[:12]), "en", "a"), (3, " ".join(items[7][1].split()[:6]), "en", "a"), (4, None, "en", "a"), (None, items[3][1], "en", "a"), (5, prose(rng, 40_000) + " " + items[9][1], "en", "a")]
    d = frame(spark, rows)
    want = {(1, 2), (2, 4), (None, 3), (5, 9)}
    got = decontaminate.leaks(d, bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    blocks = decontaminate.leaks(d, bench, block_bytes=500)
    assert sorted(map(str, blocks.collect())) == sorted(map(str, got.collect()))
    assert {r["doc_id"] for r in decontaminate.decontaminate(d, bench).collect()} == {3, 4, None}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(d, bench.where("false")).count() == 0


def slow_sketch(anchors):
    """(hash, first position) of the anchors that a fingerprint keeps, ascending."""
    first = {}
    for a in anchors:
        h, p = a >> 32, a & 0xFFFFFFFF
        first[h] = min(first.get(h, p), p)
    ranked = sorted(first.items())
    return [x for k, x in enumerate(ranked) if k < fingerprint.KEEP or x[0] < -(1 << 31) + (1 << 32) // fingerprint.SHARE]


def slow_likeness(a, b):
    if a == b:
        return 1.0
    whole = lambda s: (1 << 31) - 1 if len(s) < fingerprint.KEEP else max(s[-1][0], -(1 << 31) + (1 << 32) // fingerprint.SHARE - 1)
    to = min(whole(a), whole(b))
    x, y = ({h: p for h, p in s if h <= to} for s in (a, b))
    m = sorted((x[h], y[h]) for h in x.keys() & y.keys())
    kept = sum(any(0 <= j < len(m) and (m[i][1] < m[j][1]) == (i < j) for j in (i - 1, i + 1)) for i in range(len(m))) if len(m) > 1 else len(m)
    return kept / (len(x) + len(y) - len(m))


def test_fingerprints_of_every_script(spark):
    rng = random.Random(2)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x4E00 + 2000)) for _ in range(n))
    thai = lambda n: "".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(n))
    blob = lambda n: "".join(rng.choice("abcdefghijkmnopqrstuvwxyzABCDEFGH0123456789") for _ in range(n))
    for make in (han, thai, blob, lambda n: prose(rng, n // 5)):
        docs = spark.createDataFrame([(k, make(n)) for k, n in enumerate((1000, 399, 401, 3000, 60_000))], "doc_id long, text string")
        got = fingerprint.fingerprint_documents(docs).collect()
        assert all(0.15 < r["near_edited"] < 0.6 and r["near_next"] < 0.1 for r in got), got
        assert max(len(r["fingerprint"]) for r in got) > 5 * min(len(r["fingerprint"]) for r in got)  # grows with the text


def test_likeness_matches_positions(spark):
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    t = " ".join(word * 2)
    rows = [(t, t), (t, " ".join(reversed(word * 2))), ("x y z w " + t, t), ("", ""), ("", t), ("a", "a")]
    got = spark.createDataFrame(rows, "a string, b string").select(fingerprint.likeness(fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b")))).collect()
    assert [r[0] for r in got][0] == got[3][0] == got[5][0] == 1.0 and got[1][0] < 0.2 and got[2][0] > 0.6 and got[4][0] == 0
    up = [(h << 32) | p for h, p in ((1, 0), (2, 10), (3, 20), (4, 30))]
    down = [(h << 32) | p for h, p in ((1, 30), (2, 20), (3, 10), (4, 0))]
    row = spark.createDataFrame([(up, down)], "a array<bigint>, b array<bigint>")
    got = row.select(fingerprint.likeness(F.col("a"), F.col("b")), fingerprint.match_positions(F.col("a"), F.col("b"))).first()
    assert got[0] == 0 and [tuple(x) for x in got[1]] == [(0, 30), (10, 20), (20, 10), (30, 0)]


def test_fingerprints(docs, rows, empty):
    got = fingerprint.fingerprint_documents(docs)
    assert got.count() == len(rows) and fingerprint.fingerprint_documents(empty).count() == 0
    pdf = got.toPandas()
    ids = sorted({r[0] for r in rows if r[0] is not None})
    text = {}
    for i, t, *_ in rows:
        if i is not None:
            text[i] = min(text.get(i, t or ""), t or "")
    seen = {}
    for i, t, *_ in rows:
        t = t or ""
        nxt = text[ids[(ids.index(i) + 1) % len(ids)]] if i is not None else text[ids[0]]
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        mine = pdf[pdf["doc_id"].isna()] if i is None else pdf[pdf["doc_id"] == i]
        hit = mine[(mine["n_chars"] == len(t)) & (mine["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest())]
        assert len(hit) >= 1
        assert seen.setdefault(t, hit["fingerprint"].iloc[0]) == hit["fingerprint"].iloc[0]
        assert ((hit["near_edited"] >= 0) & (hit["near_edited"] <= 1)).all()
    long = pdf[pdf["n_chars"] > 300]
    assert long["near_edited"].mean() > 0.2 and long["near_next"].mean() < 0.1
    brute = {}
    known = {t or "" for _, t, *_ in rows}
    edits = {i: None for i in ids}
    for i in ids:
        t, nxt = text[i], text[ids[(ids.index(i) + 1) % len(ids)]]
        edits[i] = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
    every = sorted(known | set(edits.values()))
    found = docs.sparkSession.createDataFrame([(k, t) for k, t in enumerate(every)], "k long, t string").select("k", fingerprint.anchors(F.col("t")).alias("a")).collect()
    brute = {every[r["k"]]: slow_sketch(r["a"]) for r in found}
    for i in ids:
        if sum(x[0] == i for x in rows) == 1:
            r = pdf[pdf["doc_id"] == i].iloc[0]
            nxt = text[ids[(ids.index(i) + 1) % len(ids)]]
            assert r["fingerprint"] == ",".join(f"{h % (1 << 32):08x}:{p:x}" for h, p in brute[text[i]])
            assert r["near_edited"] == pytest.approx(slow_likeness(brute[text[i]], brute[edits[i]]))
            assert r["near_next"] == pytest.approx(slow_likeness(brute[text[i]], brute[nxt]))


def test_syncmers_are_closed(spark):
    parts = [5, 1, 4, 2, 9, 9, 3, 8, 7, 0]
    got = spark.createDataFrame([(parts,)], "p array<int>").select(fingerprint.closed_syncmers(F.col("p"), 4)).first()[0]
    want = [i for i in range(len(parts) - 3) if min(parts[i : i + 4]) in (parts[i], parts[i + 3])]
    assert [x & 0xFFFFFFFF for x in got] == want
    short = spark.createDataFrame([([1, 2],), ([],)], "p array<int>").select(fingerprint.closed_syncmers(F.col("p"), 4)).collect()
    assert [len(r[0]) for r in short] == [1, 0]


def slow_print(t, k):
    ws = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + k]).encode(), seed=42) for i in range(max(1, len(ws) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps):
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    fs = sorted(fps)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 3:
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_simhash(docs, rows, empty):
    got = simhash.near_classes(docs).toPandas()
    assert len(got) == len(rows) and simhash.near_classes(empty).count() == 0
    comp = slow_components({slow_print(t, 3) for _, t, *_ in rows})
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            c = comp[slow_print(t, 3)]
            least[c] = min(least.get(c, i), i)
    want = sorted((str(float(i)) if i is not None else "nan", f"{slow_print(t, 3):016x}", float(least[comp[slow_print(t, 3)]])) for i, t, *_ in rows)
    assert sorted((str(float(a)), b, float(c)) for a, b, c in got.values.tolist()) == want
    kept = {r[0] for r in simhash.drop_near_copies(docs, shingle=3).select("doc_id").collect()}
    assert kept == {*least.values(), None}


def test_near_copies_are_verified(spark):
    rng = random.Random(11)
    rows, sets = [], {}

    def changed(text, n):
        ws = text.split()
        for k in rng.sample(range(len(ws)), n):
            ws[k] = prose(rng, 1, "xyz")
        return " ".join(ws)

    for g in range(60):  # from similar (0.8 and above) to unlike
        base = prose(rng, rng.randint(60, 200))
        n = len(base.split())
        rows += [(100 * g + k, t, "en", "a") for k, t in enumerate([base, changed(base, n // 60), changed(base, n // 45), changed(base, n // 20), changed(base, n // 12), base.upper()])]
    for g in range(60, 66):  # a block said again and again outweighs the rest, so the fingerprints agree whatever the rest is
        refrain = (prose(rng, 30) + " ") * 20
        tails = [prose(rng, 14), prose(rng, 60), prose(rng, 60)]
        rows += [(100 * g + k, refrain + t, "en", "a") for k, t in enumerate([tails[0], tails[0] + " more", *tails[1:], tails[1] + " and more", tails[1].upper()])]
    rows += [(9000, "", "en", "a"), (9001, None, "en", "a"), (9002, rows[0][1], "en", "a"), (None, rows[1][1], "en", "a")]
    d = frame(spark, rows)
    for i, t, *_ in rows:
        ws = WORD.findall((t or "").lower())
        sets[i] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()
    ids = sorted(i for i in sets if i is not None)
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0
    links = [(a, b) for a in ids for b in ids if a < b and a // 100 == b // 100 or (a, b) == (0, 9002) if like(a, b) >= 0.8]
    shingles = {i: simhash.shingle_set(t, 5) for i, t, *_ in rows}
    assert all(simhash.jaccard(shingles[a], shingles[b]) == pytest.approx(like(a, b)) for a in ids[:40] for b in ids[:40])
    for group, block in ((128, 4096), (2, 8)):
        got = {r[0]: r[1] for r in simhash.similar_classes(d.where("doc_id is not null"), similarity=0.8, shingle=5, group=group, block=block).collect()}
        classes = {}
        for i, c in got.items():
            classes.setdefault(c, set()).add(i)
        for c, members in classes.items():  # every class is held together by links above the bar
            seen, todo = {c}, [c]
            while todo:
                x = todo.pop()
                fresh = {y for y in members - seen if like(x, y) >= 0.8}
                seen |= fresh
                todo += fresh
            assert seen == members
        assert len(links) > 150 and sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)
    kept = {r[0] for r in simhash.drop_near_copies(d, similarity=0.8, shingle=5).select("doc_id").collect()}
    assert kept == {*got.values(), None} and 9002 not in kept and 9001 not in kept
    assert simhash.drop_near_copies(d.where("false"), similarity=0.8, shingle=5).count() == 0


def test_wide_fingerprints():
    rng = random.Random(2)
    for n in (0, 1, 4, 5, 6, 300):
        t = prose(rng, n)
        hs = simhash.shingle_hashes(t, 5).tolist()
        assert len(hs) == (max(1, n - 4) if n else 0) and len(set(hs)) == len(hs)
        again = simhash._mixed(np.array(hs, np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)).tolist()
        brute = lambda xs: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in xs) > len(xs))
        assert simhash.wide_fingerprint(np.array(hs, np.uint64)) == (brute(hs), brute(again))
    assert simhash.shingle_hashes("a b", 5)[0] != simhash.shingle_hashes("a b c", 5)[0]


def test_gray_join_and_blocks_lose_nothing(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(40):
        c = rng.getrandbits(64)
        fps |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(30)}
    want = {}
    for f, c in slow_components(fps).items():
        want.setdefault(c, set()).add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f), signed(f)) for f in fps], "root long, fp long")
    for block, shared in ((4096, 2), (16, 2), (4096, 3)):
        roots = connected_components(simhash.near_links(df, block=block, masks=simhash.block_masks(3, shared))).collect()
        got = {}
        for r in roots:
            got.setdefault(r["root"], set()).add(r["node"] % (1 << 64))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    # 128 bits, some equal, in one node, in one block and in many
    wide = [rng.getrandbits(128) for _ in range(20)]
    wide += [w ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 9))) for w in wide for _ in range(12)]
    df = spark.createDataFrame([(k, signed(w & ((1 << 64) - 1)), signed(w >> 64)) for k, w in enumerate(wide)], "root long, fp long, fp2 long")
    up = list(range(len(wide)))

    def find(x):
        return x if up[x] == x else find(up[x])

    for i, a in enumerate(wide):
        for j in range(i):
            if (a ^ wide[j]).bit_count() <= 7:
                up[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for k in range(len(wide)):
        groups.setdefault(find(k), []).append(k)
    for block in (4096, 16):
        got = {}
        for r in connected_components(simhash.near_links(df, 7, block, [(0, 0)])).collect():
            got.setdefault(r["root"], []).append(r["node"])
        assert sorted(map(sorted, got.values())) == sorted(g for g in groups.values() if len(g) > 1)


def test_components(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000), (7000, None)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    by = {}
    for r in got:
        by.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, by.values())) == [1, 100, 301]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_id(spark, empty):
    rng = random.Random(9)
    make = {"en": "aeiotn", "de": "schuzb", "fr": "éèqpld"}
    rows = [(i, prose(rng, 60, make[lang]), lang, "h." + lang) for i in range(150) for lang in [("en", "de", "fr")[i % 3]]]
    wrong = [(1000 + i, prose(rng, 60, make["de"]), "en", "h.de") for i in range(5)]
    odd = [(2000, "語" * 300, None, "h.en"), (2001, "", "en", "h.en"), (2002, None, None, None), (2003, "12345 !!!", "en", None), (None, rows[0][1], "en", "h.en"), (3000, prose(rng, 2, make["fr"]), None, "h.fr"), (4000, prose(rng, 30_000, make["en"]), "en", "h.en")]
    d = frame(spark, rows + wrong + odd + [rows[0]])
    got = {r["doc_id"]: r for r in langid.identify(d).collect()}
    assert langid.identify(d).count() == len(rows) + len(wrong) + len(odd) + 1
    assert all(got[i]["lang"] == lang and got[i]["accepted"] for i, _, lang, _ in rows)
    assert all(got[i]["lang"] == "de" for i, *_ in wrong)  # the text outweighs a wrong declaration
    assert not any(got[i]["accepted"] for i in (2000, 2001, 2002, 2003)) and got[4000]["accepted"] and got[3000]["lang"] == "fr"
    assert langid.identify(empty).count() == 0
    kept = {r[0] for r in langid.drop_unidentified(d).select("doc_id").collect()}
    assert {2000, 2001, 2002, 2003}.isdisjoint(kept) and {None, 0, 4000} <= kept


def test_posteriors_match_brute_force(spark):
    rng = random.Random(12)
    make = {"en": "aeiotn", "de": "aeischu", "fr": "aeiqpl"}
    rows = [(i, prose(rng, rng.randint(1, 30), make[lang]), (lang, "en", None)[rng.choice((0, 0, 0, 1, 2))], f"{rng.choice('abc')}.{rng.choice(('org', 'de', 'fr'))}") for i in range(120) for lang in [rng.choice(("en", "de", "fr"))]]
    rows += [(200, "", "de", "a.de"), (201, "12 34", None, None)]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    names, blocks = langid.train(docs, "text", "lang")
    model = np.concatenate(blocks).astype(float)
    labels = [*names, "und"]
    ll, best = {}, {}
    for i, t, *_ in rows:
        c = langid._buckets(t)
        ll[i] = model @ c * min(langid.TEMPER, langid.TEXT_NATS / c.sum()) if c.sum() else np.zeros(len(labels))
        best[i] = labels[int(np.argmax(ll[i]))] if c.sum() else None
    suffix = lambda h: (h or "").rsplit(".", 1)[-1] if "." in (h or "") else ""
    count = lambda keep: np.array([sum(best[r[0]] == x and keep(r) for r in rows) for x in labels], float)
    base = count(lambda r: True) + 1
    base[-1] = 0
    base = (1 - langid.UND_PRIOR) * base / base.sum()
    base[-1] = langid.UND_PRIOR
    mixed = lambda own, up: (own + langid.KAPPA * up) / (own.sum() + langid.KAPPA)
    declared = {r[2] for r in rows}
    for i, _, lang, host in rows:
        prior = mixed(count(lambda r: r[3] == host), mixed(count(lambda r: suffix(r[3]) == suffix(host)), base))
        said = (count(lambda r: r[2] == lang) + langid.CONFUSED) / (count(lambda r: True) + langid.CONFUSED * len(declared))
        lp = np.log(prior) + np.log(said) + ll[i]
        p = np.exp(lp - lp.max())
        assert got[i]["posterior"] == pytest.approx(p.max() / p.sum(), rel=1e-6) and got[i]["text_lang"] == best[i]
        assert got[i]["lang"] == labels[int(np.argmax(lp))] and got[i]["accepted"] == (best[i] is not None and got[i]["lang"] != "und" and p.max() / p.sum() >= langid.ACCEPT)


def test_page_evidence(spark):
    rows = [(1, "http://A.Example.fr/x.html", "<!DOCTYPE html><HTML class=x lang='fr-CA'><body><article><p>un texte</article>"), (2, "no scheme", "<html><p lang=de>ein text"), (3, None, None), (4, "https://b.org", "<html xml:lang=EN>words")]
    got = langid.page_evidence(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, "fr", "a.example.fr", "un texte"), (2, None, None, "ein text"), (3, None, None, ""), (4, "en", "b.org", "words")]


def test_every_declared_language_has_a_model(spark):
    rng = random.Random(4)
    abc = {f"l{k:03d}": "".join(chr(0x400 + 6 * k + x) for x in range(6)) for k in range(140)}
    rows = [(10 * k + i, prose(rng, 25, abc[lang]), lang, "h") for k, lang in enumerate(abc) for i in range(2 if k % 70 == 69 else 3)]
    docs = frame(spark, rows)
    names, blocks = langid.train(docs, "text", "lang")
    assert names == sorted(abc) and [len(b) for b in blocks] == [64, 64, 13]
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert all(got[i]["lang"] == got[i]["text_lang"] == lang and got[i]["accepted"] for i, _, lang, _ in rows)
    assert langid.drop_unidentified(docs).count() == len(rows)


def test_pipeline_stages(spark, docs, rows, tmp_path):
    import corpus_pipeline

    bench = spark.createDataFrame([(1, rows[20][1])], "item_id long, text string")
    bench.write.parquet(f"file://{tmp_path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for d in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, f"file://{tmp_path}")
            path = f"file://{tmp_path}/{name}-{d.columns is docs.columns}-{id(d)}"
            out.write.parquet(path)
            got = spark.read.parquet(path)
            if name != names[-1]:
                assert got.columns == docs.columns
            if name == "benchmark_leaks":
                assert got.where(F.col("doc_id") == 60).count() == 0
            d = got
        if d.count():
            assert d.where("doc_id = 0").count() in (0, 1, 2)
