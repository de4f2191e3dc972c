"""Operators over pages and conversations: WARC, URL filters, HTML extraction, chat formatting."""

import hashlib
import json
import math
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparksieve.llm import chat, html_extract, url_filter, warc

PAGE = "page_id long, url string, html string, payload string, id int, kind string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "k") for r in rows], PAGE)


def test_warc_round_trip(spark):
    big = "x" * 150
    rows = [(3, "http://a/", big), (1, "http://b/\r\nX: y", big), (2, None, "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (6, "u", "é" * 60), (7, "u", "é" * 60), (1, "u", big), (8, "u", "".join(map(chr, random.Random(1).choices(range(32, 900), k=300_000))))]
    got = warc.archive_pages(pages(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["digest_ok"] in (True, None) for r in got)
    seen = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((x for x, _, y in rows if (y or "") == (h or "") and x is not None), default=None)
        again = len(b) >= 100 and (i is None or i > first)
        want.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert seen == sorted(want)
    assert warc.archive_pages(pages(spark, []).where("false")).count() == 0


def _archive(n, gz):
    recs = [warc.build_record("response", str(k), f"http://h/{k}", f"body {k} ".encode() * 20, 0, "", None) for k in range(n)]
    return [warc.gzip_member(r) for r in recs] if gz else recs


def test_salvage_recovers_what_follows_damage():
    for gz in (True, False):
        recs = _archive(8, gz)
        whole = b"".join(recs)
        starts = [sum(map(len, recs[:k])) for k in range(9)]
        assert [x[3]["warc-page-id"] for x in warc.salvage(whole) if x[0] == "record"] == [str(k) for k in range(8)]
        bad = bytearray(whole)
        bad[starts[2] + 40 : starts[2] + 60] = b"\xff" * 20
        got = list(warc.salvage(bytes(bad)))
        assert [x[3]["warc-page-id"] for x in got if x[0] == "record"] == ["0", "1", "3", "4", "5", "6", "7"]
        assert [(x[1], x[2]) for x in got if x[0] == "gap"] == [(starts[2], starts[3])]
        junk = whole[: starts[1]] + b"garbage" * 9 + whole[starts[1] : starts[5] + 30]
        got = list(warc.salvage(junk))
        assert [x[3]["warc-page-id"] for x in got if x[0] == "record"] == ["0", "1", "2", "3", "4"]
        assert len([x for x in got if x[0] == "gap"]) == 2
    assert list(warc.salvage(b"")) == []


def _tiles(data):
    """Records' ids, after a check that records and gaps cover ``data`` in order and without holes."""
    got, at = list(warc.salvage(data)), 0
    for x in got:
        assert x[1] == at and x[1] < x[2], (x[:3], at)
        at = x[2]
    assert at == len(data)
    return [x[3].get("warc-page-id") for x in got if x[0] == "record"]


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.integers(0, 5000), st.booleans(), st.sampled_from(["gz", "plain", "mixed"]))
def test_salvage_recovers_every_record_that_damage_does_not_touch(noise, at, insert, kind):
    gz, plain = _archive(6, True), _archive(6, False)
    recs = {"gz": gz, "plain": plain, "mixed": [r[k % 2] for k, r in enumerate(zip(gz, plain))]}[kind]
    whole = b"".join(recs)
    assert _tiles(whole) == list("012345")
    at %= len(whole)
    end = at if insert else min(len(whole), at + len(noise))
    starts = [sum(map(len, recs[:k])) for k in range(7)]
    hit = {k for k in range(6) if starts[k] < end and at < starts[k + 1] and whole[at:end] != noise[: end - at]} if not insert else {k for k in range(6) if starts[k] < at < starts[k + 1]}
    got = _tiles(whole[:at] + (noise if insert else noise[: end - at]) + whole[end:])
    assert set(got) >= {str(k) for k in range(6) if k not in hit}


def test_salvage_survives_malformed_heads_and_is_linear():
    good = _archive(1, False)[0]
    for length in ("\u00b2", "9" * 5000, "-1", "1 2", "", "0x1", "99999999999"):
        bad = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {length}\r\n\r\nxx\r\n\r\n".encode()
        assert _tiles(bad + good) == ["0"] and _tiles(warc.gzip_member(bad) + good) == ["0"]
    for one in (b"WARC/1.1\r\n", b"WARC/1.1\r\na: b\r\n", warc.MAGIC, b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 9999999\r\n\r\n"):
        t = time.process_time()
        assert _tiles(one * 50_000 + good) == ["0"]
        assert time.process_time() - t < 10
    took = []
    for n in (2000, 8000):
        data = b"".join(_archive(n, True))
        t = time.process_time()
        assert sum(x[0] == "record" for x in warc.salvage(data)) == n
        took.append(time.process_time() - t)
    assert took[1] < 12 * took[0]


def test_damaged_files_are_read_by_spark(spark, tmp_path):
    recs = _archive(20, True)
    whole = b"".join(recs)
    (tmp_path / "a.warc.gz").write_bytes(b"\x00" * 10 + whole[10:])
    (tmp_path / "b.warc").write_bytes(b"")
    (tmp_path / "c.warc").write_bytes("WARC/1.1\r\nWARC-Type: response\r\nContent-Length: \u00b2\r\n\r\n".encode() + recs[3])
    got = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert sorted(r["page_id"] for r in got if r["status"] == "ok") == sorted([*map(str, range(1, 20)), "3"])
    assert sorted((r["offset"], r["reason"]) for r in got if r["status"] != "ok") == [(0, "bad header"), (0, "no version line")]


def test_salvage_recovers_behind_a_damaged_start():
    for gz in (True, False):
        recs = _archive(8, gz)
        whole, first = b"".join(recs), len(recs[0])
        for bad in (b"\xff" * 150 + whole[150:], b"\xff" * 500 + whole):
            got = list(warc.salvage(bad))
            lost = len(bad) == len(whole)
            assert [x[3]["warc-page-id"] for x in got if x[0] == "record"] == [str(k) for k in range(lost, 8)]
            assert [(x[1], x[2]) for x in got if x[0] == "gap"] == [(0, first if lost else 500)]
    gz, plain = _archive(6, True), _archive(6, False)
    mixed = b"".join(r[k % 2] for k, r in enumerate(zip(gz, plain)))
    assert [x[0] for x in warc.salvage(mixed)] == ["record"] * 6
    got = list(warc.salvage(b"\xff" * 100 + mixed[100:]))
    assert [x[3]["warc-page-id"] for x in got if x[0] == "record"] == list("12345") and len(got) == 6
    body = warc.gzip_member(b"no record " * 30)
    rec = bytearray(warc.build_record("response", "9", "http://h/", body, len(body), "", None))
    rec[-5] ^= 1
    got = list(warc.salvage(bytes(rec) + plain[0]))
    assert [x[:3] for x in got if x[0] == "gap"] == [("gap", 0, len(rec))] and len(got) == 2


def test_gzip_members_end_with_zero():
    for n in (0, 1, 1000):
        m = warc.gzip_member(b"x" * n)
        assert m[-1] == 0


def test_url_filter(spark):
    canon = '<html><head><link rel="canonical" href="http://x.example.com/de/1"></head>'
    move = '<meta http-equiv="refresh" content="0; url=/b">'
    rows = [(1, "http://A.Example.ORG/es/1?q", ""), (2, "https://example.org/en/12", ""), (3, "http://org/x", None), (4, None, None), (5, "no scheme", ""), (6, "http://n.net/p#f", canon), (7, "http://n.net/p", ""), (8, "http://m.net/a", move), (9, "http://m.net/b", canon), (10, "http://notexample.org", ""), (11, "http://ex.com/fr/", ""), (12, "", ""), (1, "http://A.Example.ORG/es/1?q", ""), (13, "http://z.net/?a://b", "canonical " + "x" * 200_000)]
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages(spark, rows)).collect()}
    assert url_filter.filter_urls(pages(spark, rows)).count() == len(rows)
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2]["rule"] == "example.org/en/1" and got[3]["rule"] == "org/" and got[11]["verdict"] == "allow" and got[10]["rule"] is None
    assert [(got[k]["host"], got[k]["path"], got[k]["verdict"]) for k in (4, 5, 12)] == [("", "", "allow")] * 3
    # 6, 7 and, through 9, also 8 are aliases of a blocked url.
    assert [(got[k]["rule"], got[k]["verdict"], got[k]["by"]) for k in (6, 7, 8, 9)] == [(None, "block", "alias")] * 4
    ok = spark.createDataFrame([("http://n.net/p", "http://y.com/fr/1")], "a string, b string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages(spark, rows), ok).collect()}
    assert got[6] == got[9] == "allow"  # an explicit allow in the class takes precedence
    assert url_filter.filter_urls(pages(spark, []).where("false")).count() == 0


def test_page_links_resolve_every_form(spark):
    base = "http://h.net/a/b/page.html?q=1#f"
    targets = ["next.html", "../x", "./y/../z/.", "?id=2", "/go?to=http://x", "//o.net/p", "HTTP://o.net/c?d", "../../../up", "..", "/r/./s/../t", "#frag", "mailto:x", "a b"]
    html = "".join(f'<link rel="alternate" href="no{k}"><link href="{t}" title="é" rel=\'nofollow CANONICAL\'>' for k, t in enumerate(targets))
    html += "<meta name=refresh content='0;url=no'><META content=\"0; URL='m?x=1&amp;y=2'\" http-equiv=refresh><meta http-equiv=refresh content='1;url=n'>" + f"<link rel=canonical data-x='{'x' * 5000}' href=far>"
    got = [(r["a"], r["b"]) for r in url_filter.page_links(pages(spark, [(1, base, html), (2, "no scheme", html), (3, "http://h.net", "<link rel=canonical href=k>")])).collect()]
    at = "http://h.net/a/b/"
    want = [at + "next.html", "http://h.net/a/x", at + "z/", at + "page.html?id=2", "http://h.net/go?to=http://x", "http://o.net/p", "HTTP://o.net/c?d", "http://h.net/up", "http://h.net/a/", "http://h.net/r/t", at + "a b", at + "m?x=1&y=2", at + "n", at + "far"]
    assert sorted(b for a, b in got if a == "http://h.net/a/b/page.html?q=1") == sorted(want)
    assert [b for a, b in got if a == "http://h.net"] == ["http://h.net/k"]
    assert {b for a, b in got if a == "no scheme"} == {"HTTP://o.net/c?d"}
    rows = [(1, "http://n.net/f/old.html", "<link rel=canonical href=new.html>"), (2, "http://n.net/f/new.html", "<meta http-equiv=refresh content='0;url=http://ex.com/de/'>")]
    assert {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages(spark, rows)).collect()} == {1: "block", 2: "block"}


def test_many_rules_are_joined(spark):
    rules = [*url_filter.RULES, *[url_filter.UrlRule("block", f"h{k}.net", f"/p{k % 7}") for k in range(400)]]
    rows = [(k, f"http://{h}{p}", "<link rel=canonical href=http://h7.net/p0x>" if k % 10 == 0 else "") for k, (h, p) in enumerate((h, p) for h in ("a.h3.net", "h3.net", "h399.net", "x.com", "example.org", "z.dev", "") for p in ("/p3/a", "/p0", "/fr/1", "/es/", "/de/"))] + [(900, None, None), (901, "no scheme", ""), (902, "http://h3.net/p3", ""), (902, "http://h3.net/p3", "")]
    table = spark.createDataFrame([(r.name, r.host, r.path, r.verdict) for r in rules], "rule string, host string, path string, verdict string")
    inline = url_filter.INLINE_RULES
    try:
        url_filter.INLINE_RULES = 1000
        want = sorted(map(str, url_filter.filter_urls(pages(spark, rows), rules=rules).collect()))
    finally:
        url_filter.INLINE_RULES = inline
    for given in (rules, table):
        assert sorted(map(str, url_filter.filter_urls(pages(spark, rows), rules=given).collect())) == want
    assert sum("'alias'" in x for x in want) >= 1 and sum("'rule'" in x for x in want) > 10


def test_rule_table_agrees_with_inline_rules(spark):
    rules = spark.createDataFrame([(r.name, r.host, r.path, r.verdict) for r in url_filter.RULES], "rule string, host string, path string, verdict string")
    urls = spark.createDataFrame([(f"http://{h}{p}",) for h in ("org", "a.example.org", "b.com", "x.net", "") for p in ("", "/", "/es/1", "/en/19", "/fr/", "/de/x")], "url string").select("url", url_filter.url_host(F.col("url")).alias("host"), url_filter.url_path(F.col("url")).alias("path"))
    a = {(r["url"], r["rule"], r["verdict"]) for r in url_filter.match_rule_table(urls, rules).collect()}
    m = url_filter.match_rules(F.col("host"), F.col("path"))
    b = {(r["url"], r["rule"], r["verdict"]) for r in urls.select("url", m["rule"].alias("rule"), m["verdict"].alias("verdict")).where("rule is not null").collect()}
    assert a == b and a


HTML = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><a href=/>Home</a></header>
<nav><ul><li><a href=a>One</a></li></ul></nav><div class="cookie-notice">We use cookies on this site, please accept them all now.</div>
<main><article><header><h1>Big  title</h1></header><p>First &amp; long paragraph with <b>bold</b>
 words and more of them.<p>Second&nbsp;one.<ul><li>item</ul><div class="advert">Buy now, this is a long advert text for you.</div><script>var x="</p>";</script></article></main>
<aside>Related reading</aside><div id="comments"><p>A reader comment that is rather long, longer than most.</p></div><form>Name <input></form><footer>&copy; me</footer></body></html>"""


def test_html_extraction():
    assert html_extract.extract_text(HTML) == "Big title\nFirst & long paragraph with bold words and more of them.\nSecond\xa0one.\nitem"
    assert html_extract.extract_text(None) == html_extract.extract_text("") == html_extract.extract_text("<nav>x</nav>") == ""
    assert html_extract.extract_text("plain text") == "plain text"
    assert html_extract.extract_text("<article><p>cut off &am") == "cut off &am"
    body = "".join(f"<p>Paragraph {k} has quite a few words in it, enough to look like prose.</p>" for k in range(5))
    plain = f"<body><div><a>a</a><a>b</a><a>c</a></div><div>{body}</div></body>"
    assert html_extract.extract_text(plain).split("\n")[0].startswith("Paragraph 0") and len(html_extract.extract_text(plain).split("\n")) == 5
    deep = "<div>" * 5000 + "<p>x y z</p>"
    assert html_extract.extract_text(deep) == "x y z"


def test_html_keeps_every_cluster_and_ignores_wrappers_class_words():
    para = "<p>Paragraph {} has quite a few words in it, enough to look like prose.</p>".format
    many = lambda a, b: "".join(map(para, range(a, b)))
    found = lambda html: re.findall(r"Paragraph (\d+)", html_extract.extract_text(html))
    every = [str(k) for k in range(10)]
    menu = "<div><a>a</a><a>b</a><a>c</a></div>"
    for html in (f"<div>{many(0, 7)}</div><div>{many(7, 10)}</div>", f"{para(0)}<div><div>{many(1, 8)}</div><section>{many(8, 9)}</section></div>{para(9)}", f"<table><tr><td>{many(0, 8)}</td><td>{many(8, 10)}</td></tr></table>"):
        assert found(f"<body>{menu}{html}</body>") == every
        assert not html_extract.extract_text(f"<body>{menu}{html}</body>").startswith("abc")
    for word in ("has-sidebar", "no-sidebar", "widget"):
        assert found(f"<body class=x><div class='{word}'><article>{many(0, 10)}</article></div></body>") == every
        assert found(f"<body><div class='{word}'><div id={word}>{many(0, 10)}<div class=ad>{para(11)}</div></div></div><p>x</p>") == every
        assert found(f"<body><div class='{word}'>{many(0, 2)}</div><div>{many(2, 10)}</div></body>") == every[2:]
    assert found(f"<div class=widget><article>{many(0, 10)}") == every


def test_html_content_comes_through_the_ratios(monkeypatch):
    para = "<p>Paragraph {} has quite a few words in it, enough to look like prose.</p>".format
    links = "<ul>" + "".join(f"<li><a href=/{k}>topic {k}</a></li>" for k in range(9)) + "</ul>"
    page = f"<body><article><h1>Short</h1>{''.join(map(para, range(6)))}<p>See <a href=x>this</a></p>{links}</article><div>{links}</div></body>"
    want = html_extract.extract_text(page)
    assert want.split("\n")[0] == "Short" and want.endswith("See this") and "topic" not in want and len(want.split("\n")) == 8
    real = html_extract.smooth
    for level in (0.0, 50.0):  # without contrast nothing is told apart
        monkeypatch.setattr(html_extract, "smooth", lambda v, sigma=1.0, level=level: [level] * len(v))
        for html in (page, HTML, page.replace("article", "div")):
            got = html_extract.extract_text(html)
            assert got == "" if level == 0 else (html == HTML or "topic" in got)
    monkeypatch.setattr(html_extract, "smooth", real)
    values = [random.Random(3).uniform(0, 90) for _ in range(40)]
    weight = lambda k: math.exp(-k * k / 2) if abs(k) <= 3 else 0
    brute = [sum(weight(j - i) * v for j, v in enumerate(values)) / sum(weight(j - i) for j in range(40)) for i in range(40)]
    assert all(abs(a - b) < 1e-9 for a, b in zip(real(values), brute))


def _regions(lines, sections, ratio, level, cut):
    """content_regions() by looking at every pair of lines and sections."""
    up = {s: p for s, p, _ in sections}
    above = lambda s: [s, *above(up[s])] if s >= 0 else []
    seed = [r > 0 and x > cut for r, x in zip(ratio, level)]
    votes = {s: sum(len(t[0]) for t, y in zip(lines, seed) if y and s in above(t[2])) for s in up}
    whole = {s for s, _, kind in sections if kind == "main" and votes[s]}
    partly = set()
    if not whole:

        def go(s):
            kids = [k for k in up if up[k] == s]
            if not any(votes[k] > 0.6 * votes[s] for k in kids):
                whole.add(s)
                return
            partly.add(s)
            for k in kids:
                if votes[k] > 0.6 * votes[s] or any(y and r > cut and k in above(t[2]) for t, y, r in zip(lines, seed, ratio)):
                    go(k)

        go(0)
        partly = {s for s in partly if any(y and r > cut and t[2] == s for t, y, r in zip(lines, seed, ratio))}
    out = []
    for t, y, r in zip(lines, seed, ratio):
        inside = any(s in whole and votes[s] for s in above(t[2]))
        out.append(r > 0 and ((inside and (y or not t[4])) or (t[2] in partly and y)))
    return out


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_html_regions_agree_with_brute_force(data):
    n = data.draw(st.integers(1, 8))
    sections = [(0, -1, "page")] + [(k, data.draw(st.integers(0, k - 1)), data.draw(st.sampled_from(["div", "div", "main"]))) for k in range(1, n)]
    lines = data.draw(st.lists(st.tuples(st.sampled_from(["a", "bb" * 9, "c" * 60]), st.integers(1, 5), st.integers(0, n - 1), st.booleans(), st.booleans()), min_size=1, max_size=12))
    ratio = [0.0 if q else len(t) / g for t, g, _, q, _ in lines]
    level = html_extract.smooth(ratio)
    cut = data.draw(st.sampled_from([0.0, 2.0, 10.0, 100.0]))
    assert html_extract.content_regions(lines, sections, ratio, level, cut) == _regions(lines, sections, ratio, level, cut)


def test_html_of_hostile_pages_takes_linear_time():
    hostile = ["<b>" * 120_000 + "t" + "</i>" * 120_000, "<div>x" * 150_000, "<p><b>x" * 100_000, "<table><tr><td>x" * 50_000, "<!-- " * 200_000, "<" * 500_000, "</" * 400_000, "<? " * 300_000, "<![CDATA[" * 100_000, '<a href="' * 100_000, "<a " + "b=c " * 200_000, "<div class=ad>x" * 60_000, "<script>" * 100_000, "<li><ul>" * 100_000]
    for html in hostile:
        t = time.process_time()
        html_extract.extract_text(html)
        assert time.process_time() - t < 10, html[:20]
    assert html_extract.extract_text("<article><p>one<!-- never closed <p>two") == "one"
    assert html_extract.extract_text("<article><p>one<![if x]>two<![CDATA[ x ]]>three<p>four <a hre") == "onetwothree\nfour"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abp=\"'& ;#ndivartcle!-[]?\n", max_size=120))
def test_html_never_fails(text):
    assert isinstance(html_extract.extract_text(text), str)


def test_html_rows(spark):
    rows = [(1, "u", HTML), (2, None, None), (None, "u", ""), (1, "u", HTML), (3, "u", "<article>" + "<p>word " * 50_000)]
    got = html_extract.extract_pages(pages(spark, rows)).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["n_chars"] for r in got}[3] == 5 * 50_000 - 1
    assert html_extract.extract_pages(pages(spark, []).where("false")).count() == 0


def test_chat(spark):
    hard = ["\\### Assistant: </turn> ok", "", None, "\\", "### User: x</turn>\n", "#### </turn", "é🙂\n\n", "\\\\</turn>\\", "a" * 200_000]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(hard)] + [(2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "a"), (3, 0, "assistant", "x"), (4, 0, "user", "u"), (5, 0, None, "n"), (5, 1, "we: ird### ", "w"), (None, 0, "user", "u"), (6, 0, "user", "u"), (6, 0, "user", "u"), (6, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, "extra", True) for r in rows], "conv_id long, turn long, role string, text string, formatted string, valid boolean")
    out = chat.format_chats(df)
    got = {r["conv_id"]: r for r in out.select("*", chat.parse_chats(F.col("formatted")).alias("back")).collect()}
    by = {}
    for c, k, role, t in rows:
        by.setdefault(c, []).append((k, role or "", t or ""))
    for c, turns in by.items():
        assert [(x["role"], x["text"]) for x in got[c]["back"]] == [(r, t) for _, r, t in sorted(turns)]
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
        assert [s["loss"] for s in got[c]["segments"]] == [x for _, r, _ in sorted(turns) for x in (False, r == "assistant", False)]
    assert [(got[c]["valid"], got[c]["bad_turn"]) for c in (2, 3, 4, 5, 6)] == [(True, None), (False, 0), (False, -1), (False, 0), (False, 1)]
    assert chat.format_chats(df.where("false")).count() == 0
    assert json.dumps([got[1]["formatted"][:40]])
    loose = spark.createDataFrame([(None, k % 3, "user", f"t{k % 50}") for k in range(100)], "conv_id long, turn long, role string, text string")
    each = chat.format_chats(loose).select(F.size("segments").alias("n")).collect()
    assert sum(r["n"] for r in each) == 300 and max(r["n"] for r in each) <= 6  # no conversation of all of them
