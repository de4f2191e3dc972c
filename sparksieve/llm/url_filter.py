"""URL filters with redirect equivalence, DataFrame functions only.

A url's verdict is that of the longest rule that fits it. A url that no rule
fits takes the verdict of its redirect class: urls joined by redirects and
canonical links are aliases of one resource, and a block on one alias blocks
the others, unless the class holds an explicit allow, which takes precedence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, spread_join
from .components import connected_components


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: Rules of the registered query.
RULES = (UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"), UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/"))
#: More rules than this are joined as a table instead of standing in the plan.
INLINE_RULES = 200


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without :// or for null."""
    rest = _after_scheme(url)
    return ascii_lower(F.regexp_extract(rest, r"\A[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def match_rules(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does; between equal lengths block wins, then the name."""
    fits = []
    for r in sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name)):
        ok = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        fits.append(F.when(ok, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def match_rule_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """match_rules() for a rule table (rule, host, path, verdict) of any size.

    ``urls`` has distinct (url, host, path). Each url is joined by equality
    with the rules of its host and parent domains (one row per label), so there
    is no pairing of all urls with all rules; a label that very many urls have
    is spread. Returns (url, rule, verdict), urls with a fitting rule only.
    """
    labels = F.split("host", r"\.")
    up = urls.select("url", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("host"))
    by_host = rules.groupBy("host").agg(F.collect_set(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict", F.col("path").alias("p"))).alias("rules"))
    seen = up.groupBy("host").agg(F.count(F.lit(1)).alias("weight"))
    j = spread_join(up, materialize(by_host.join(seen, "host"), "uf-rules"), ["host"], "weight", F.col("url"), "inner")
    j = j.select("url", F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["p"]))).alias("m")).where("m is not null")
    return j.groupBy("url").agg(F.max("m").alias("m")).select("url", "m.rule", "m.verdict")


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


#: An attribute's value in double quotes, in single quotes or bare, after its name.
_VALUE = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


def _attribute(tag: Column, name: str) -> Column:
    """Value of the attribute in the text of a tag, trimmed; empty without it."""
    pattern = r"(?is)[\s\"'/]" + name + _VALUE
    return F.btrim(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]), F.lit(" \t\r\n\f"))


def _without_dots(path: Column) -> Column:
    """The path, which starts with /, without its . and .. segments (RFC 3986, 5.2.4)."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def resolve(base: Column, target: Column) -> Column:
    """The absolute url that ``target`` names on the page ``base``; null for other schemes than those with // and without a base that has one.

    All relative forms are resolved: //host, /path, path in the page's folder,
    . and .. segments, ?query; a fragment alone names the page itself.
    """
    scheme = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    site = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"\A[^?#]*(\?[^#]*)?", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)\A(.*/)", 1))
    own, rest = F.regexp_extract(target, r"\A[^?#]*", 0), F.regexp_extract(target, r"(?s)\A[^?#]*(.*)", 1)
    full = F.concat(site, _without_dots(F.when(F.startswith(target, F.lit("/")), own).otherwise(F.concat(folder, own))), rest)
    same = F.concat(site, path, F.when(F.startswith(target, F.lit("?")), rest).otherwise(F.concat(query, rest)))
    lead = F.regexp_extract(target, r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://)?", 0)
    relative = F.when(F.startswith(target, F.lit("//")), F.concat(scheme, target)).when(own == "", same).otherwise(full)
    return F.when(F.endswith(lead, F.lit("//")), target).when((lead == "") & (scheme != ""), relative)


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b) alias edges stated by the pages: all canonical links and refresh redirects.

    The patterns run only where the tag's word occurs at all. Targets are
    resolved against the page's url.
    """
    html = F.col(html_col)
    tags = lambda name, keep: F.filter(F.regexp_extract_all(html, F.lit(rf"(?is)<{name}(?=[\s/\"'])[^<>]*>"), F.lit(0)), keep)
    rel = tags("link", lambda x: _attribute(x, "rel").rlike(r"(?i)(?:\A|\s)canonical(?:\s|\z)"))
    canon = F.transform(rel, lambda x: _attribute(x, "href"))
    meta = tags("meta", lambda x: F.lower(_attribute(x, "http-equiv")) == "refresh")
    refresh = F.transform(meta, lambda x: F.btrim(F.regexp_extract(_attribute(x, "content"), r"(?is)\burl\s*=\s*[\"']?([^\"']+)", 1), F.lit(" \t\r\n\f")))
    low = F.lower(html)
    has = F.contains(low, F.lit("canonical")) | F.contains(low, F.lit("refresh"))
    src = F.col(url_col)
    base = pages.where(src.isNotNull() & html.isNotNull() & has).select(src.alias("u"), F.explode(F.array_distinct(F.concat(canon, refresh))).alias("t")).where("t <> ''")
    full = resolve(F.col("u"), F.replace(F.col("t"), F.lit("&amp;"), F.lit("&")))
    return base.select(without_fragment(F.col("u")).alias("a"), without_fragment(full).alias("b")).where("b is not null and a <> b")


def judged(urls: DataFrame, rules) -> DataFrame:
    """``urls``, which has a column url, with ``m``: struct(rule, verdict) of the longest rule that fits, null without one.

    ``rules`` is a sequence of UrlRule or a table for match_rule_table(). Up to
    INLINE_RULES rules stand in the plan; more are joined.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= INLINE_RULES:
            return urls.withColumn("m", match_rules(url_host(F.col("url")), url_path(F.col("url")), rules))
        rules = urls.sparkSession.createDataFrame([(r.name, r.host, r.path, r.verdict) for r in rules], "rule string, host string, path string, verdict string")
    each = urls.select("url").distinct().select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    hit = match_rule_table(each, rules).select(F.col("url").alias("__u"), F.struct("rule", "verdict").alias("m"))
    return urls.join(hit, F.col("url") == F.col("__u"), "left").drop("__u")


def class_verdicts(edges: DataFrame, rules=RULES) -> DataFrame:
    """(url, class_verdict) for every url that an alias edge names: allow if the class has an explicit allow, else block if it has a block, else null."""
    roots = connected_components(edges).toDF("url", "root")
    votes = judged(roots, rules).select("url", "root", F.col("m.verdict").alias("v"))
    by = votes.groupBy("root").agg(F.bool_or(F.col("v") == "allow").alias("ok"), F.bool_or(F.col("v") == "block").alias("no"))
    return votes.join(by, "root").select("url", F.when(F.col("ok"), "allow").when(F.col("no"), "block").alias("class_verdict"))


def filter_urls(pages: DataFrame, edges: DataFrame | None = None, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Judge every row: id, host, path, rule, verdict, and ``by`` (rule, alias or default).

    ``edges`` (a, b) adds redirects known from a crawl to the links that the
    pages state; ``rules`` is a sequence or a table of any size (see judged). Null urls and urls without :// have empty host and path, fit
    no rule and take ``default``. Rows are never dropped; repeated rows get
    equal verdicts. Urls outside all alias classes cost no shuffle beyond one
    join with the class table, which adaptive execution makes a broadcast only
    where its measured size allows it.
    """
    links = page_links(pages, url_col, html_col)
    if edges is not None:
        links = links.union(edges.select(without_fragment(F.col("a")).alias("a"), without_fragment(F.col("b")).alias("b")).where("a is not null and b is not null and a <> b"))
    by_class = class_verdicts(materialize(links, "uf-links"), rules).toDF("__u", "__class")  # pages are read for links once
    base = judged(pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("url")), rules)
    j = base.join(by_class, without_fragment(F.col("url")) == F.col("__u"), "left")
    verdict = F.coalesce(F.col("m.verdict"), "__class", F.lit(default))
    how = F.when(F.col("m").isNotNull(), "rule").when(F.col("__class").isNotNull(), "alias").otherwise("default")
    return j.select(F.col("__id").alias(id_col), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.col("m.rule").alias("rule"), verdict.alias("verdict"), how.alias("by"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rule, verdict, rhost, rpath) AS (
  VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'),
         ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')
), m AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT p.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict,
       CASE WHEN m.rule IS NULL THEN 'default' ELSE 'rule' END AS "by"
FROM p LEFT JOIN m ON p.page_id = m.page_id
"""
