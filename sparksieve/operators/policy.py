"""Decisions over findings: what is reported, in which envelope, with which advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import severity_rank
from .post import at_least
from .rules import LABELS

GOOGLE = ("google-gemini", "google-vertex", "antigravity")
OPENAI = ("openai", "github-copilot")
NAME = "sparksieve"


def placeholder_label(rule_id: Column) -> Column:
    """The short label of a rule's placeholders; VAR for rules without one, suffixed ids included."""
    table = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.element_at(table, rule_id), F.lit("VAR"))


def findings_by_payload(findings: DataFrame, id_col: str) -> DataFrame:
    """id_col and ``findings``: each payload's findings in order of offset, falling severity and emission."""
    item = F.struct("off", (-severity_rank(F.col("severity"))).alias("r"), "emit", "rule_id", "category", "severity", "end", "raw", "snippet", "identity")
    return findings.groupBy(id_col).agg(F.sort_array(F.collect_list(item)).alias("findings"))


def rule_list(fs: Column) -> Column:
    """Distinct rule ids in order of first appearance."""
    return F.array_distinct(F.transform(fs, lambda f: f["rule_id"]))


def maskable(fs: Column) -> Column:
    """Distinct non-empty identities in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(fs, lambda f: f["identity"]), lambda i: i != ""))


def block_message(fs: Column) -> Column:
    return F.concat(F.lit(f"{NAME}: request stopped by "), F.array_join(rule_list(fs), ", "), F.lit(". Change the text and send it again, or run with redaction switched on, or with a higher blocking severity."))


def block_status(provider: Column) -> Column:
    return F.when(provider == "antigravity", 400).otherwise(451)


def block_envelope(fs: Column, provider: Column) -> Column:
    """The JSON error body that a provider's clients can render, with the findings in it."""
    items = F.transform(fs, lambda f: F.struct(f["rule_id"].alias("rule_id"), f["category"].alias("category"), f["severity"].alias("severity"), f["snippet"].alias("snippet"), f["off"].alias("offset")))
    msg, kind = block_message(fs), F.lit(f"{NAME}_blocked")
    detail = F.struct(F.lit(f"type.googleapis.com/{NAME}.BlockedRequest").alias("@type"), items.alias("findings"))
    info = F.struct(F.lit("type.googleapis.com/google.rpc.ErrorInfo").alias("@type"), F.lit("CUSTOM").alias("reason"), F.struct(msg.alias("uiMessage")).alias("metadata"))
    google = lambda code, status, first: F.concat(
        F.lit('{"error":{"code":' + str(code) + ',"message":'), _json(msg), F.lit(',"status":"' + status + '","details":['), *([F.to_json(info), F.lit(",")] if first else []), F.to_json(detail), F.lit("]}}")
    )
    openai = F.to_json(F.struct(F.struct(msg.alias("message"), kind.alias("type"), F.lit(None).cast("string").alias("param"), kind.alias("code"), items.alias("findings")).alias("error")), {"ignoreNullFields": "false"})
    plain = F.to_json(F.struct(F.lit("error").alias("type"), F.struct(kind.alias("type"), msg.alias("message"), items.alias("findings")).alias("error")))
    out = F.when(provider == "antigravity", google(400, "INVALID_ARGUMENT", True)).when(provider.isin("google-gemini", "google-vertex"), neutral(google(451, "FAILED_PRECONDITION", False)))
    return out.when(provider.isin(*OPENAI), openai).otherwise(plain)


def _json(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def neutral(text: Column) -> Column:
    """Rewrite a word that makes one client hide the whole error body; the case of its first letter stays."""
    return F.regexp_replace(F.regexp_replace(text, "S(?i:ecret)", "Credntl"), "s(?i:ecret)", "credntl")


def mask_ack(n: Column) -> Column:
    """Confirmation of a mask reply: how many values are masked from now on."""
    values = F.when(n == 1, "One value is").otherwise(F.concat(n.cast("string"), F.lit(" values are")))
    what = F.when(n <= 0, "No further value needed masking.").otherwise(F.concat(values, F.lit(" replaced by placeholders for the rest of this session.")))
    return F.concat(F.lit("[masked] "), what, F.lit(" Please repeat your last message."))


def has_pii(fs: Column) -> Column:
    return F.exists(fs, lambda f: F.startswith(f["category"], F.lit("pii")))


def has_secret(fs: Column) -> Column:
    """Any finding that is neither personal, an attachment nor an internal address."""
    return F.exists(fs, lambda f: ~F.startswith(f["category"], F.lit("pii")) & ~f["category"].isin("attachment", "internal-ip"))


#: What to do about the kinds of values found.
KEYS_HINT = "Revoke and replace every key or password above that is in use; let programs read them from their environment or a vault."
PEOPLE_HINT = "Details of real people are seldom needed here: made-up ones, or a description, serve as well."


def block_advice(fs: Column, offer_mask: Column, command: Column) -> Column:
    """What was found, one line per rule, and numbered ways to go on: masking (once or always) where offered, forgetting, a higher threshold."""
    firsts = F.transform(rule_list(fs), lambda r: F.element_at(F.filter(fs, lambda f: f["rule_id"] == r), 1))
    line = lambda f: F.concat(F.lit("- "), f["severity"], F.lit(" "), f["rule_id"], F.lit(" in "), f["category"], F.when(f["snippet"] == "", "").otherwise(F.concat(F.lit(": "), f["snippet"])))
    shown = F.get(F.filter(firsts, lambda f: (f["identity"] != "") & (f["snippet"] != "")), F.lit(0))
    demo = F.when(shown.isNotNull(), F.concat(F.lit(" ("), shown["snippet"], F.lit(" is sent as __"), placeholder_label(shown["rule_id"]), F.lit("_1__ and put back in the answer)"))).otherwise("")
    run = lambda option: F.concat(F.lit(f"{NAME} {option} "), command)
    masks = F.array(F.concat(F.lit("Answer `mask`: placeholders stand in for the values in this session"), demo, F.lit(".")), F.concat(F.lit("Have every session masked: `"), run("--on-finding=redact"), F.lit("`.")))
    others = F.array(F.lit("Start a new conversation without the values; the present one is sent whole with each turn and would be stopped again."), F.concat(F.lit("If the rule is wrong, block from a higher severity on: `"), run("--block-on=high"), F.lit("`.")))
    ways = F.concat(F.when(offer_mask, masks).otherwise(F.array().cast("array<string>")), others)
    numbered = F.transform(ways, lambda w, i: F.concat((i + 1).cast("string"), F.lit(") "), w))
    hints = F.array_compact(F.array(F.when(has_secret(fs), KEYS_HINT), F.when(has_pii(fs), PEOPLE_HINT)))
    return F.array_join(F.concat(F.array(F.lit(f"{NAME} kept this request back; no part of it was passed on. Found:")), F.transform(firsts, line), F.array(F.lit("Ways to go on:")), numbered, hints), "\n")


def redactable(fs: Column, body_bytes: Column, shift: Column, compressed: Column) -> Column:
    """Whether every finding lies in the body behind ``shift`` prefix bytes, and the body is no compressed one."""
    return ~compressed & F.forall(fs, lambda f: (f["off"] >= shift) & (f["end"] > f["off"]) & (f["end"] - shift <= body_bytes))


def decide(payloads: DataFrame, findings: DataFrame, id_col: str, text_col: str, threshold: str = "low", mode: str = "block", provider: str = "generic") -> DataFrame:
    """One row per payload: decision (FORWARD, BLOCKED or REDACTED), findings at the threshold, envelope of a block."""
    hit = findings_by_payload(at_least(findings, threshold), id_col).withColumnRenamed(id_col, "__id")
    j = payloads.select(F.col(id_col), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias("__n")).join(hit, F.col(id_col) == F.col("__id"), "left")
    fine = redactable(F.col("findings"), F.col("__n"), F.lit(0), F.lit(False))
    decision = F.when(F.col("findings").isNull(), "FORWARD").when(F.lit(mode == "redact") & fine, "REDACTED").otherwise("BLOCKED")
    j = j.withColumn("decision", decision)
    return j.select(id_col, "decision", F.coalesce(F.size("findings"), F.lit(0)).cast("long").alias("n_findings"), F.when(F.col("findings").isNotNull(), F.array_join(rule_list(F.col("findings")), ",")).alias("rules"), F.when(F.col("decision") == "BLOCKED", block_envelope(F.col("findings"), F.lit(provider))).alias("envelope"))
