"""Rule sets from outside: rules as data with a capture group for the secret."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import contains_any, entropy, let, spans_java
from ..plans.parallel import spread
from ..rx import to_java
from .detect import RULESET, context, finish

UUID = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
#: Largest text that a rule set is run over, in bytes; larger ones are skipped whole, as rule-set scanners do.
MAX_BYTES = 8_000_000


@dataclass(frozen=True)
class SecretRule:
    """A rule of an outside set: its pattern in Java's syntax, the group that holds the secret (0: the match) and its least entropy in bits per character."""

    rule_id: str
    pattern: str
    keywords: tuple = ()
    group: int = 0
    entropy: float = 0.0


def _token(rule_id: str, pattern: str, *keywords: str) -> SecretRule:
    """A rule for a token with a prefix of its own, standing alone."""
    return SecretRule(rule_id, rf"(?<![0-9A-Za-z_])({pattern})(?![0-9A-Za-z_-])", keywords, 1)


# Public token formats. A small set of our own; larger ones are loaded as data.
DEFAULT = (
    SecretRule("slack-bot-token", r"xoxb-[0-9]{10,13}-[0-9]{10,13}[a-zA-Z0-9-]*", ("xoxb",)),
    SecretRule("github-pat", r"ghp_[0-9a-zA-Z]{36}", ("ghp_",)),
    SecretRule("gcp-api-key", r"(?<![0-9A-Za-z_])(AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z_-])", ("aiza",), 1),
    SecretRule("private-key", r"-----BEGIN[ A-Z0-9_-]{0,100}PRIVATE KEY-----", ("-----begin",)),
    SecretRule("slack-webhook-url", r"https://hooks\.slack\.com/(?:services|workflows)/[A-Za-z0-9+/]{43,56}", ("hooks.slack.com",)),
    SecretRule("generic-api-key", r"(?i)(?:key|token|secret|session_id|password)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([0-9a-z_.=-]{16,150})", ("key", "token", "secret", "session_id", "password"), 1),
    _token("npm-access-token", r"npm_[0-9A-Za-z]{36}", "npm_"),
    _token("pypi-upload-token", r"pypi-AgEIcHlwaS5vcmc[0-9A-Za-z_-]{50,1000}", "pypi-ageichlwas5vcmc"),
    _token("sendgrid-api-token", r"SG\.[0-9A-Za-z_-]{22}\.[0-9A-Za-z_-]{43}", "sg."),
    _token("twilio-api-key", r"SK[0-9a-f]{32}", "sk"),
    _token("digitalocean-pat", r"dop_v1_[0-9a-f]{64}", "dop_v1_"),
    _token("digitalocean-access-token", r"doo_v1_[0-9a-f]{64}", "doo_v1_"),
    _token("shopify-access-token", r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}", "shpat_", "shpca_", "shppa_", "shpss_"),
    _token("telegram-bot-api-token", r"[0-9]{8,10}:AA[0-9A-Za-z_-]{33}", ":aa"),
    _token("databricks-api-token", r"dapi[0-9a-f]{32}", "dapi"),
    _token("huggingface-access-token", r"hf_[A-Za-z]{34}", "hf_"),
    _token("hashicorp-vault-token", r"hvs\.[0-9A-Za-z_-]{90,120}", "hvs."),
    _token("mailgun-private-api-token", r"key-[0-9a-f]{32}", "key-"),
    _token("linear-api-key", r"lin_api_[0-9A-Za-z]{40}", "lin_api_"),
    _token("postman-api-token", r"PMAK-[0-9a-f]{24}-[0-9a-f]{34}", "pmak-"),
    _token("pulumi-api-token", r"pul-[0-9a-f]{40}", "pul-"),
    _token("doppler-api-token", r"dp\.pt\.[0-9A-Za-z]{43}", "dp.pt."),
    _token("dynatrace-api-token", r"dt0c01\.[0-9A-Za-z]{24}\.[0-9A-Za-z]{64}", "dt0c01."),
    _token("rubygems-api-token", r"rubygems_[0-9a-f]{48}", "rubygems_"),
    _token("planetscale-password", r"pscale_pw_[0-9A-Za-z_.-]{43}", "pscale_pw_"),
    _token("grafana-service-account-token", r"glsa_[0-9A-Za-z]{32}_[0-9A-Fa-f]{8}", "glsa_"),
    _token("atlassian-api-token", r"ATATT3[0-9A-Za-z_=-]{186}", "atatt3"),
    _token("age-secret-key", r"AGE-SECRET-KEY-1[QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58}", "age-secret-key-1"),
)


def load_ruleset(spark: SparkSession, path: str) -> list[SecretRule]:
    """Rules from JSON lines {id, regex, keywords, secretGroup, entropy}, or from a TOML file with a [[rules]] table of these.

    JSON lines are in Java's syntax; TOML rule sets are written for RE2 and translated.
    """
    if path.endswith(".toml"):
        text = spark.read.text(path, wholetext=True).first()["value"]
        found = [(x, to_java(re.sub(r"\(\?P<", "(?<", re.sub(r"\[:(\w+):\]", lambda m: r"\p{%s}" % m[1].capitalize(), x["regex"])))) for x in tomllib.loads(text).get("rules", []) if "regex" in x]
    else:
        rows = spark.read.text(path).collect()  # a rule set is configuration: hundreds of lines
        found = [(x, x["regex"]) for x in (json.loads(r["value"]) for r in rows if r["value"].strip())]
    return [SecretRule(x["id"], pattern, tuple(w.lower() for w in x.get("keywords", ())), int(x.get("secretGroup", 0)), float(x.get("entropy", 0))) for x, pattern in found]


def line_offset(text: Column, line: Column) -> Column:
    """Byte offset of a 1-based line: 0 for lines 0 and 1, past the end that after the last line feed."""
    parts = F.slice(F.split(text, "\n", -1), F.lit(1), F.least(F.greatest(line - 1, F.lit(0)), F.size(F.split(text, "\n", -1)) - 1))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a + F.octet_length(p) + 1)


def lines_with_starts(text: Column) -> Column:
    """array of struct(line, start): the parts between line feeds with their byte offsets, from one pass of running sums."""
    starts = lambda nl: F.transform(F.split(text, "\n", -1), lambda l, i: F.struct(l.alias("line"), F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(nl, i - 1)["end"]).alias("start")))
    return let(spans_java(text, "\n"), starts)


def detect_ruleset(payloads: DataFrame, id_col: str, text_col: str, rules=DEFAULT, prefix: str = "gitleaks:") -> DataFrame:
    """Findings ``<prefix><rule>``, category secret, severity critical, one per line and match.

    The secret is anchored at its first occurrence at or after its line's
    start; if it is not there (a rule may rewrite it) the span is the line's
    start with end -1, which cannot be redacted. UUIDs are no generic keys.
    Texts above MAX_BYTES are skipped. Only lines with a rule's keyword are
    looked at further, and they carry no copy of the text.
    """
    text, low = F.col("__t"), F.lower(F.col("__t"))
    src = spread(payloads.select(F.col(id_col), F.col(text_col).alias("__t"))).where(text.isNotNull() & (F.octet_length(text) <= MAX_BYTES))
    words = sorted({w for r in rules for w in r.keywords})
    some = (lambda c: contains_any(c, words)) if all(r.keywords for r in rules) else (lambda c: F.lit(True))
    body = F.encode(text, "UTF-8")

    def entry(k: int, r: SecretRule, line: Column) -> Column:
        found = F.regexp_extract_all(line, F.lit(r.pattern), r.group)
        if r.keywords:
            found = F.when(contains_any(F.lower(line), r.keywords), found).otherwise(F.array().cast("array<string>"))
        if r.entropy:
            found = F.filter(found, lambda s: entropy(s) >= r.entropy)
        if r.rule_id == "generic-api-key":
            found = F.filter(found, lambda s: ~s.rlike(UUID))
        return F.transform(found, lambda s: F.struct(F.lit(prefix + r.rule_id).alias("rule_id"), s.alias("raw"), F.lit(k).alias("rule")))

    def placed(x: Column, line: Column, start: Column) -> Column:
        at = F.instr(line, x["raw"])
        off = F.when(at > 0, start + F.octet_length(F.substring(line, F.lit(1), at - 1))).otherwise(start).cast("bigint")
        end = F.when(at > 0, off + F.octet_length(x["raw"])).otherwise(F.lit(-1)).cast("bigint")
        return F.struct(x["rule_id"].alias("rule_id"), off.alias("off"), end.alias("end"), x["raw"].alias("raw"), x["rule"].alias("rule"), context(body, off, F.greatest(end, off)).alias("ctx"))

    of = lambda l: F.transform(F.concat(*[entry(k, r, l["line"]) for k, r in enumerate(rules)]), lambda x: placed(x, l["line"], l["start"]))
    kept = F.filter(lines_with_starts(text), lambda l: some(F.lower(l["line"])))
    f = src.where(some(low)).select(F.col(id_col), F.inline(F.flatten(F.transform(kept, of))))
    f = f.select(id_col, "rule_id", F.lit("secret").alias("category"), F.lit("critical").alias("severity"), "off", "end", "raw", F.lit(RULESET).alias("source"), "rule", "ctx")
    return finish(f, id_col)
