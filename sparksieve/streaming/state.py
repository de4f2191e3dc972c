"""Stateful streaming forms of restoring, placeholder assignment, consent and scene completion.

Each keeps a small JSON state per key with ``applyInPandasWithState``; the
batch forms in ``operators`` give the same results over complete data. With a
``ttl`` (like "2 hours") a key's state is dropped once nothing has come for it
for so long, as a proxy's mappings end with its process; without one it stays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import LABELS

STATE = "json string"


def _get(state) -> dict:
    return json.loads(state.get[0]) if state.exists else {}


def _stateful(df: DataFrame, keys: list[str], run, schema: str, ttl: str | None = None) -> DataFrame:
    if ttl is None:
        return df.groupBy(*keys).applyInPandasWithState(run, schema, STATE, "append", "NoTimeout")
    millis = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def timed(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        yield from run(k, batches, state)
        if state.exists:
            state.setTimeoutDuration(millis)

    return df.groupBy(*keys).applyInPandasWithState(timed, schema, STATE, "append", "ProcessingTimeTimeout")


def restore_chunk(tail: str, chunk: str, pairs: list[tuple[str, str]], last: bool) -> tuple[str, str]:
    """(text that can go out, text held back).

    Whole placeholders are replaced first; held back is only a suffix that is
    a proper prefix of a placeholder, so none is ever torn.
    """
    text = tail + chunk
    for mark, value in sorted(pairs, key=lambda p: -len(p[0])):
        text = text.replace(mark, value)
    if last:
        return text, ""
    hold = max((n for mark, _ in pairs for n in range(1, min(len(mark), len(text) + 1)) if text.endswith(mark[:n])), default=0)
    return text[: len(text) - hold], text[len(text) - hold :]


def restore_stream(chunks: DataFrame, names: dict[str, list[tuple[str, str]]], key: str = "response_id", session: str = "session_id", ttl: str | None = None) -> DataFrame:
    """(key, chunk_no, text) from a stream of (key, session, chunk_no, data, last): placeholders restored across chunks.

    ``names`` maps sessions to (placeholder, original) pairs. Chunks of a
    response must arrive in order across batches; within one they are sorted.
    """

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = _get(state)
        tail = held.get("tail", "")
        rows = []
        for r in pd.concat(list(batches)).sort_values("chunk_no").itertuples(index=False):
            out, tail = restore_chunk(tail, r.data, names.get(str(getattr(r, session)), []), bool(r.last))
            rows.append((k[0], r.chunk_no, out))
        state.update((json.dumps({"tail": tail}),))
        yield pd.DataFrame(rows, columns=[key, "chunk_no", "text"])

    kind = chunks.schema[key].dataType.simpleString()
    return _stateful(chunks, [key], run, f"{key} {kind}, chunk_no long, text string", ttl)


def placeholder_stream(findings: DataFrame, session: str = "session_id", ttl: str | None = None) -> DataFrame:
    """(session, identity, placeholder) for every finding of a stream (session, seq, rule_id, identity): one value keeps one placeholder for the session's life."""

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        memo = _get(state) or {"names": {}, "next": {}}
        rows = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            if not r.identity:
                continue
            if r.identity not in memo["names"]:
                label = LABELS.get(r.rule_id, "VAR")
                memo["next"][label] = memo["next"].get(label, 0) + 1
                memo["names"][r.identity] = f"__{label}_{memo['next'][label]}__"
            rows.append((k[0], r.seq, r.identity, memo["names"][r.identity]))
        state.update((json.dumps(memo),))
        yield pd.DataFrame(rows, columns=[session, "seq", "identity", "placeholder"])

    kind = findings.schema[session].dataType.simpleString()
    return _stateful(findings, [session], run, f"{session} {kind}, seq long, identity string, placeholder string", ttl)


def consent_step(state: dict, text: str, ids: list[str], n_hits: int, bare: int, redactable: bool) -> tuple[dict, str, int]:
    """One request's decision; see operators.session.fold for the rules."""
    pending, consented = state.get("pending", []), state.get("consented", [])
    if (text or "").strip(" \t\r\n").lower() in ("mask", "mask it", "yes", "y", "redact", "ok") and pending:
        new = [i for i in pending if i not in consented]
        return {"pending": [], "consented": consented + new}, "ACK", len(new)
    if not n_hits:
        return state, "FORWARD", 0
    new = [i for i in dict.fromkeys(ids) if i not in consented]
    if not new and not bare and redactable:
        return state, "MASKED", n_hits
    return {"pending": new, "consented": consented}, "BLOCKED", n_hits


def consent_stream(requests: DataFrame, session: str = "session_id", ttl: str | None = None) -> DataFrame:
    """(session, turn, decision, n) from a stream (session, turn, text, ids, n_hits, bare, redactable)."""

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s, rows = _get(state), []
        for r in pd.concat(list(batches)).sort_values("turn").itertuples(index=False):
            s, decision, n = consent_step(s, r.text, list(r.ids), int(r.n_hits), int(r.bare), bool(r.redactable))
            rows.append((k[0], r.turn, decision, n))
        state.update((json.dumps(s),))
        yield pd.DataFrame(rows, columns=[session, "turn", "decision", "n"])

    kind = requests.schema[session].dataType.simpleString()
    return _stateful(requests, [session], run, f"{session} {kind}, turn long, decision string, n int", ttl)


def scene_stream(events: DataFrame, ttl: str | None = None) -> DataFrame:
    """(id, outcome, n_alerts) once a request and its block or response have both been seen; a redaction alone ends nothing.

    ``events`` is a stream of (id, kind, n_alerts). A finished scene's state is
    removed.
    """

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s, rows = _get(state), []
        for r in pd.concat(list(batches)).itertuples(index=False):
            s[r.kind] = int(r.n_alerts)
            if "request" in s and ("blocked" in s or "response" in s):
                rows.append((k[0], "blocked" if "blocked" in s else "response", s["request"]))
                s = {}
        if s:
            state.update((json.dumps(s),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["id", "outcome", "n_alerts"])

    return _stateful(events, ["id"], run, "id long, outcome string, n_alerts int", ttl)


def windowed_counts(findings: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Findings per time window and severity, late rows within the watermark counted; a reporting extra."""
    return findings.withWatermark(ts, late).groupBy(F.window(ts, width), "severity").agg(F.count(F.lit(1)).alias("n"))


def rate_limited(events: DataFrame, key: str, ts: str = "ts", seconds: int = 30) -> DataFrame:
    """(key, ts, message) of a stream (key, ts, message): at most one message per key in so many seconds, the first.

    The state is the time of the last message let through. Within a batch
    events are taken in order of time; an event before that time is held back.
    """

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, rows = _get(state), []
        last = pd.Timestamp(held["last"]) if held else None
        for r in pd.concat(list(batches)).sort_values(ts, kind="stable").itertuples(index=False):
            at = getattr(r, ts)
            if last is None or at - last >= pd.Timedelta(seconds=seconds):
                last = at
                rows.append((k[0], at, r.message))
        if last is not None:
            state.update((json.dumps({"last": str(last)}),))
        yield pd.DataFrame(rows, columns=[key, ts, "message"])

    kind = events.schema[key].dataType.simpleString()
    return _stateful(events, [key], run, f"{key} {kind}, {ts} timestamp, message string")
