"""Chat formatting: a role automaton checks turn order, a declarative template emits segments with loss flags.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """How turns are marked.

    ``open`` before the role's label, ``colon`` after it, ``close`` after the
    text, ``between`` after that. Control strings inside a text are broken by a
    backslash after their first character, and backslashes are doubled, so
    neither ``close`` nor ``open`` occurs literally inside an escaped text and
    ``\\X -> X`` undoes it. ``loss`` names the roles whose text is trained on.
    """

    open: str = "### "
    colon: str = ": "
    close: str = "</turn>"
    between: str = "\n"
    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: tuple = ("assistant",)


@dataclass(frozen=True)
class RoleAutomaton:
    """Deterministic automaton over roles; a pair that is not listed is an error."""

    start: str = "start"
    moves: tuple = (("start", "system", "told"), ("start", "user", "asked"), ("told", "user", "asked"), ("asked", "assistant", "answered"), ("answered", "user", "asked"))
    final: tuple = ("answered",)


def _q(s: str) -> str:
    return "\\Q" + s + "\\E"


def escape_text(text: Column, t: ChatTemplate) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in (t.open, t.close):
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape_text(text: Column) -> Column:
    """Undo escape_text: every backslash introduces the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def role_check(roles: Column, a: RoleAutomaton = RoleAutomaton()) -> Column:
    """struct(valid, bad_turn): the 0-based index of the first illegal turn, -1 if it only ends too early, else null."""
    table = F.create_map(*[x for s, r, e in a.moves for x in (F.lit(s + "\x00" + r), F.lit(e))])
    init = F.struct(F.lit(a.start).alias("s"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("bad"))

    def step(acc, role):
        to = F.element_at(table, F.concat(acc["s"], F.lit("\x00"), F.coalesce(role, F.lit("\x00"))))
        return F.struct(F.when(acc["bad"].isNull(), F.coalesce(to, F.lit("error"))).otherwise(acc["s"]).alias("s"), (acc["i"] + 1).alias("i"), F.when(acc["bad"].isNull() & to.isNull(), acc["i"]).otherwise(acc["bad"]).alias("bad"))

    def end(acc):
        ok = acc["bad"].isNull() & acc["s"].isin(*a.final)
        return F.struct(ok.alias("valid"), F.when(ok, F.lit(None).cast("int")).otherwise(F.coalesce(acc["bad"], F.lit(-1))).alias("bad_turn"))

    return F.aggregate(roles, init, step, end)


def _label(role: Column, t: ChatTemplate) -> Column:
    """A known role's label; any other role is written out, escaped, behind an @ (null: a lone @)."""
    known = F.create_map(*[F.lit(x) for kv in t.labels.items() for x in kv])
    other = F.concat(F.lit("@"), F.replace(escape_text(F.coalesce(role, F.lit("")), t), F.lit(t.colon), F.lit(t.colon[0] + "\\" + t.colon[1:])))
    return F.coalesce(F.element_at(known, F.coalesce(role, F.lit("\x00"))), other)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: ChatTemplate = ChatTemplate(), automaton: RoleAutomaton = RoleAutomaton()) -> DataFrame:
    """One row per conversation: (conv_col, valid, bad_turn, segments, formatted).

    ``segments`` is an array of struct(text, loss) whose texts join to
    ``formatted``: marker and content segments alternate, and only the escaped
    content of a ``template.loss`` role has loss = true. Turns are ordered by
    (turn, role, text), nulls first. Null text counts as empty; null or unknown
    roles are illegal for the automaton but still formatted; repeated rows are
    repeated turns; rows without a conversation are conversations of one turn
    each (equal ones of several), so that they are no unbounded group. A
    conversation is one row of the result, so its turns meet in one task.
    """
    t = template
    own = F.when(F.col(conv_col).isNull(), F.xxhash64(turn_col, role_col, text_col)).alias("__own")
    rows = turns.groupBy(F.col(conv_col), own).agg(F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))).alias("turns"))
    checked = rows.select(F.col(conv_col), "turns", role_check(F.transform("turns", lambda x: x["role"]), automaton).alias("check"))

    def segs(x):
        mark = F.concat(F.lit(t.open), _label(x["role"], t), F.lit(t.colon))
        return F.array(
            F.struct(mark.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape_text(x["text"], t).alias("text"), F.coalesce(x["role"].isin(*t.loss), F.lit(False)).alias("loss")),
            F.struct(F.lit(t.close + t.between).alias("text"), F.lit(False).alias("loss")),
        )

    out = checked.select(F.col(conv_col), F.col("check.valid").alias("valid"), F.col("check.bad_turn").alias("bad_turn"), F.flatten(F.transform("turns", segs)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse_chats(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """array of struct(role, text) read back from a formatted conversation.

    The end mark cannot occur inside an escaped text and the colon not inside a
    label, so plain searches suffice.
    """
    t = template
    pieces = F.filter(F.split(formatted, _q(t.close + t.between)), lambda p: p != "")
    back = F.create_map(*[F.lit(x) for k, v in t.labels.items() for x in (v, k)])

    def one(p):
        body = F.substr(p, F.lit(len(t.open) + 1))
        at = F.instr(body, F.lit(t.colon))
        label = F.substr(body, F.lit(1), at - 1)
        role = F.coalesce(F.element_at(back, label), unescape_text(F.substr(label, F.lit(2))))
        return F.struct(role.alias("role"), unescape_text(F.substr(body, at + len(t.colon))).alias("text"))

    return F.transform(pieces, one)
