"""Consent over a session's requests: blocked values become pending, a mask reply approves them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "struct<pending:array<string>,consented:array<string>,out:array<struct<turn:bigint,decision:string,n:int>>>"
AFFIRMATIONS = ("mask", "mask it", "yes", "y", "redact", "ok")


def is_affirmation(text: Column) -> Column:
    """A reply that asks for masking, in any case and with white space around."""
    return F.coalesce(F.lower(F.btrim(text, F.lit(" \t\r\n"))).isin(*AFFIRMATIONS), F.lit(False))


def fold(turns: Column) -> Column:
    """Decisions for turns struct(turn, text, ids, all_ids, redactable) in order.

    ``ids`` are the maskable identities of a turn's triggering findings,
    ``n_hits`` the number of these findings, ``bare`` those without identity.
    A mask reply with something pending is acknowledged before findings count;
    a turn without findings is forwarded; one whose findings are all consented
    and redactable is masked; any other is blocked and its values not yet
    consented become the pending ones.
    """
    init = F.struct(F.array().cast("array<string>").alias("pending"), F.array().cast("array<string>").alias("consented"), F.array().cast("array<struct<turn:bigint,decision:string,n:int>>").alias("out"))

    def step(s, t):
        ack = is_affirmation(t["text"]) & (F.size(s["pending"]) > 0)
        new = F.array_except(t["ids"], s["consented"])
        clear = t["n_hits"] == 0
        mask = (F.size(new) == 0) & (t["bare"] == 0) & t["redactable"]
        fresh = F.size(F.array_except(s["pending"], s["consented"]))
        decision = F.when(ack, "ACK").when(clear, "FORWARD").when(mask, "MASKED").otherwise("BLOCKED")
        pending = F.when(ack, F.array().cast("array<string>")).when(clear | mask, s["pending"]).otherwise(new)
        n = F.when(ack, fresh).otherwise(t["n_hits"])
        return F.struct(pending.alias("pending"), F.when(ack, F.array_union(s["consented"], s["pending"])).otherwise(s["consented"]).alias("consented"), F.concat(s["out"], F.array(F.struct(t["turn"].alias("turn"), decision.alias("decision"), n.cast("int").alias("n")))).alias("out"))

    return F.aggregate(turns, init, step)["out"]


def consent_decisions(requests: DataFrame, findings: DataFrame, id_col: str, session_col: str, turn_col: str, text_col: str) -> DataFrame:
    """(session, turn, decision, n) for every request; a session's requests are folded in order of turn."""
    f = findings.groupBy(F.col(id_col).alias("__id")).agg(F.array_distinct(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("off", "emit", "identity"))), lambda x: x["identity"]), lambda i: i != "")).alias("ids"), F.count(F.lit(1)).cast("int").alias("n_hits"), F.sum((F.col("identity") == "").cast("int")).cast("int").alias("bare"), F.min((F.col("end") > F.col("off")).cast("int")).cast("boolean").alias("redactable"))
    j = requests.join(f, F.col(id_col) == F.col("__id"), "left")
    t = F.struct(F.col(turn_col).cast("bigint").alias("turn"), F.col(text_col).alias("text"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("bare", F.lit(0)).alias("bare"), F.coalesce("redactable", F.lit(True)).alias("redactable"))
    folded = j.groupBy(session_col).agg(fold(F.sort_array(F.collect_list(t))).alias("o"))
    return folded.select(session_col, F.inline("o"))
