"""HTML main-text extraction: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

Events of the standard library's streaming parser are cut into lines at block
boundaries. Every line has its text, its tag count and its path of sections.
A line's ratio is its text over its tags; lines inside page furniture (menus,
footers, adverts, forms, ...) have ratio 0. The ratios are smoothed with a
Gaussian, and lines whose smoothed ratio exceeds a threshold (a share of their
spread) are the seeds: without a seed nothing is content. Seeds vote, with
their text, for the section they stand in: the article or main elements with
seeds are content regions; without any, the section with most of the votes is,
and with it every other section that has seeds of its own. A region grows from
its seeds over the other lines of its section that have a ratio above 0, so a
short heading or a one-word paragraph is kept; a low line all of whose text is
links stays out, as a menu without a telling name. A class word does not
silence an element that holds the article or most of the page's text.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without end tags.
VOIDS = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose text is never content.
SILENT = frozenset("script style noscript template iframe object embed svg math canvas audio video select option textarea button head title nav footer aside form menu dialog noframes".split())
#: Elements that hold the article.
MAIN = frozenset({"article", "main"})
#: Words of class, id and role that mark furniture.
FURNITURE = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted related respond search share sharing sidebar sidebars skip social sponsor sponsored subscribe subscription toolbar widget complementary contentinfo".split()
)
#: A page's own header is furniture, one inside the article holds its title.
HEADER_WORDS = frozenset({"header", "masthead"})
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - {"body", "html", "head", "title", "caption", "td", "th", "tr", "tbody", "tfoot", "thead", "li", "dd", "dt", "legend", "summary", "figcaption"}
#: White space that is one blank inside a line; no-break spaces are text.
_WS = "\t\n\f\r\v"
SIGMA = 1.0
#: Share of the standard deviation of the smoothed ratios that a content line exceeds.
THRESHOLD = 0.5


class _Lines(HTMLParser):
    """Collects (text, tags, section path, silent) lines."""

    def __init__(self, spared: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.ending, self.ends = False, {}
        self.spared = spared  # numbers of the elements that their class words do not silence
        self.worded: list[tuple[int, int]] = []  # of each element with class words, the text in it and its article or main elements
        self.stack: list[tuple[str, bool, int, tuple | None]] = []  # tag, whether it silences, section number, counts at the start if it has class words
        self.open: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open
        self.hard = 0  # elements open that silence for another reason than a class word
        self.seen = self.mains = 0  # text and article or main elements so far, silenced by class words or not
        self.silent = 0
        self.mute = 0  # silent elements within a line: their text is dropped and does not end the line
        self.in_main = 0
        self.open_p = 0
        self.sections = [(0, -1, "page")]  # number, parent, kind
        self.section = 0
        self.parts: list[str] = []
        self.tags = 0
        self.links = 0  # link elements open
        self.loose = False  # whether the line has text outside links
        self.lines: list[tuple[str, int, int, bool, bool]] = []

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    # Markup that the page leaves open ends the page: what follows is part of it. Ends are sought once over the same
    # text, however many beginnings there are.

    def close(self) -> None:
        self.ending = True
        super().close()

    def _to_end(self, at: int) -> int:
        return len(self.rawdata) if at < 0 and self.ending else at

    def _behind(self, mark: str, i: int) -> int:
        text, at = self.ends.get(mark, (None, -1))
        if text is not self.rawdata or 0 <= at < i:
            at = self.rawdata.find(mark, i)
            self.ends[mark] = self.rawdata, at
        return at + len(mark) if at >= 0 else self._to_end(-1)

    def parse_starttag(self, i: int) -> int:
        return self._to_end(super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self._to_end(super().parse_endtag(i))

    def parse_comment(self, i: int, report: int = 1) -> int:
        if self.rawdata.startswith((">", "->"), i + 4):  # comments without any content
            return self.rawdata.index(">", i) + 1
        return self._behind("-->", i + 4)

    def parse_pi(self, i: int) -> int:
        return self._behind(">", i)

    def parse_html_declaration(self, i: int) -> int:
        return self._behind("]]>" if self.rawdata.startswith("<![CDATA[", i) else ">", i)

    def parse_bogus_comment(self, i: int, report: int = 1) -> int:
        return self._behind(">", i)

    def cut(self) -> None:
        if not self.parts:
            return
        text = "".join(self.parts)
        for c in _WS:
            text = text.replace(c, " ")
        while "  " in text:
            text = text.replace("  ", " ")
        text = text.strip(" ")
        if text:
            self.lines.append((text, self.tags, self.section, self.silent > 0, not self.loose))
            self.tags = 0
        self.parts = []
        self.loose = False

    def _quiet(self, tag: str, attrs) -> str:
        """What silences the element: "tag", "words" or nothing."""
        if tag in SILENT or (tag == "header" and not self.in_main):
            return "tag"
        if not attrs or tag in ("body", "html", *MAIN):
            return ""
        worded = False
        for name, value in attrs:
            if name in ("hidden",) or (name == "aria-hidden" and value == "true"):
                return "tag"
            if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "tag"
            if value and name in ("class", "id", "role"):
                words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
                found = words & FURNITURE
                if self.in_main:
                    found -= HEADER_WORDS
                worded = worded or bool(found)
        return "words" if worded else ""

    def handle_starttag(self, tag: str, attrs) -> None:
        self.tags += 1
        if tag in VOIDS:
            if tag == "hr":
                self.cut()
            elif tag in ("br", "wbr"):
                self.parts.append(" " if tag == "br" else "")
            return
        if self.open_p and tag in ENDS_P:
            self._close("p", within=("article", "body", "td", "th", "div", "section", "button", "main"))
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            same = ("dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else (tag,)
            for s in same:
                self._close(s, within=("ul", "ol", "dl", "table", "menu", "select"))
        block = tag in BLOCKS
        if block:
            self.cut()
        why, start = self._quiet(tag, attrs), None
        role = next((v for k, v in attrs if k == "role"), None)
        main = tag in MAIN or role in ("main", "article")
        if why == "words":
            start = (len(self.worded), self.seen, self.mains)
            self.worded.append((0, 0))
        self.mains += main and not self.hard
        self.hard += why == "tag"
        quiet = why == "tag" or (start is not None and start[0] not in self.spared)
        self.open[tag].append(len(self.stack))
        self.stack.append((tag, quiet, self.section, start))
        self.links += tag == "a"
        self.silent += quiet
        self.mute += quiet and not block
        self.in_main += tag in MAIN
        self.open_p += tag == "p"
        if main or tag in ("section", "div", "td", "body"):
            self.sections.append((len(self.sections), self.section, "main" if main else tag))
            self.section = len(self.sections) - 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("iframe", "script", "style", "svg", "math", "textarea", "title") and self.stack and self.stack[-1][0] == tag:
            self._pop()
            self.clear_cdata_mode()

    def _pop(self) -> None:
        tag, quiet, section, start = self.stack.pop()
        self.open[tag].pop()
        if tag in BLOCKS:
            self.cut()
        if start is not None:
            self.worded[start[0]] = (self.seen - start[1], self.mains - start[2])
        self.hard -= quiet and start is None
        self.silent -= quiet
        self.mute -= quiet and tag not in BLOCKS
        self.in_main -= tag in MAIN
        self.open_p -= tag == "p"
        self.links -= tag == "a"
        self.section = section

    def _close(self, tag: str, within: tuple = ()) -> None:
        """Close the innermost open ``tag`` unless one of ``within`` is nearer."""
        if not self.open[tag]:
            return
        at = self.open[tag][-1]
        if not any(self.open[x] and self.open[x][-1] > at for x in within):
            while len(self.stack) > at:
                self._pop()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOIDS:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.cut()
        self._close(tag, within=("td", "th", "article", "main", "body") if tag not in ("article", "main", "body", "html", "table", "tr", "tbody", "td", "th", "footer", "nav", "header", "aside", "section", "div", "form") else ())

    def handle_data(self, data: str) -> None:
        if not self.hard:
            self.seen += sum(map(len, data.split()))
        if not self.mute:
            self.parts.append(data)
            self.loose = self.loose or (not self.links and not data.isspace())


def page_lines(html: str) -> tuple[list[tuple[str, int, int, bool, bool]], list[tuple[int, int, str]]]:
    """(text, tags before or in it, section, silent, all of it links) per line, and (number, parent, kind) per section."""
    p = _parsed(html)
    spared = frozenset(k for k, (text, mains) in enumerate(p.worded) if mains or 2 * text > p.seen)
    if spared:
        p = _parsed(html, spared)
    return p.lines, p.sections


def _parsed(html: str, spared: frozenset[int] = frozenset()) -> _Lines:
    p = _Lines(spared)
    p.feed(html)
    p.close()
    p.cut()
    for *_, start in p.stack:  # elements that the page leaves open
        if start is not None:
            p.worded[start[0]] = (p.seen - start[1], p.mains - start[2])
    return p


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing, the kernel cut at three sigmas and renormalised at the ends."""
    r = min(math.ceil(3 * sigma), len(values))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - r), min(len(values), i + r + 1)
        ks = kernel[lo - i + r : hi - i + r]
        out.append(sum(k * v for k, v in zip(ks, values[lo:hi])) / sum(ks))
    return out


def content_regions(lines, sections, ratio: list[float], level: list[float], cut: float) -> list[bool]:
    """Whether each line is content, from its ratio and its smoothed ratio, as the module says. Linear in lines and sections."""
    seed = [r > 0 and x > cut for r, x in zip(ratio, level)]
    votes = [0] * len(sections)
    for line, yes in zip(lines, seed):
        votes[line[2]] += len(line[0]) * yes
    for s, up, _ in reversed(sections):  # a section's number is above its parent's
        if up >= 0:
            votes[up] += votes[s]
    chosen = [kind == "main" and votes[s] > 0 for s, _, kind in sections]
    partly = [False] * len(sections)  # sections of which only the seeds are content
    if not any(chosen):
        # The deepest section with most of the votes; of what lies outside it, the sections with a seed that is above
        # the threshold by its own ratio, not only by that of the lines beside it.
        own = [False] * len(sections)
        for line, r, yes in zip(lines, ratio, seed):
            own[line[2]] |= yes and r > cut
        held = own[:]
        kids: list[list[int]] = [[] for _ in sections]
        for s, up, _ in reversed(sections):
            if up >= 0:
                held[up] |= held[s]
                kids[up].append(s)
        todo = [0]
        while todo:
            s = todo.pop()
            if any(votes[k] > 0.6 * votes[s] for k in kids[s]):
                partly[s] = own[s]
                todo += [k for k in kids[s] if held[k] or votes[k] > 0.6 * votes[s]]
            else:
                chosen[s] = votes[s] > 0
    for s, up, _ in sections:
        chosen[s] = chosen[s] or (up >= 0 and chosen[up])
    return [r > 0 and ((chosen[line[2]] and (yes or not line[4])) or (partly[line[2]] and yes)) for line, r, yes in zip(lines, ratio, seed)]


def extract_text(html: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    """The main text of a page: its content lines joined by line feeds, empty if there are none."""
    lines, sections = page_lines(html or "")
    if not lines:
        return ""
    ratio = [0.0 if quiet else len(text) / max(1, tags) for text, tags, _, quiet, _ in lines]
    level = smooth(ratio, sigma)
    mean = sum(level) / len(level)
    spread = math.sqrt(sum((x - mean) ** 2 for x in level) / len(level))
    keep = content_regions(lines, sections, ratio, level, threshold * spread)
    return "\n".join(line[0] for line, yes in zip(lines, keep) if yes)


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = [extract_text(None if pd.isna(h) else h) for h in pdf["__hx_html"]]
        out = pdf.drop(columns="__hx_html")
        yield out.assign(text=texts, n_chars=[len(t) for t in texts])


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (code points) of every row.

    One map over the rows, no shuffle. Null html is empty and gives empty text;
    malformed and cut-off pages give what the parser recovers; very long pages
    are handled whole; repeated rows give repeated results.
    """
    small_batches(pages.sparkSession)
    src = pages.select(*[F.col(c) for c in keep], F.col(html_col).alias("__hx_html"))
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInPandas(_run, f"{fields}, text string, n_chars long")


#: DuckDB SQL for the pages of the test tables, whose articles have no other markup than paragraphs, a heading, bold
#: text and line breaks, and no other character references than these.
ORACLE = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<br>', ' ', 'g'), '</?b>', '', 'g') AS body FROM pages
), l AS (
  SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(replace(regexp_replace(x, '&amp;?', '&', 'g'), '&quot;', '"'), '[ \t\n\f\r\v]+', ' ', 'g'))) AS ls FROM a
), t AS (
  SELECT page_id, url, coalesce(array_to_string(list_filter(ls, lambda x: x <> ''), chr(10)), '') AS text FROM l
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""
