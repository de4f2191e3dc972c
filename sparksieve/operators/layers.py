"""Decode-and-rescan: encoded runs are decoded, rescanned, and findings re-anchored on the run.

The stage is a map over Arrow batches: decoders and byte offsets need Python.
Rows without any run to decode never leave the JVM (see ``may_hold_layers``).
Patterns run over bytes, so word boundaries are ASCII and offsets are bytes.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.parallel import spread
from ..rx import to_bytes
from ..schema import SEVERITIES
from . import rules as R
from .detect import AFTER, BEFORE, LAYER, finish

#: Layers peeled off a payload.
MAX_DEPTH = 5
#: Share of printable characters that a decoded text needs.
PRINTABLE = 0.85
_PRINT = frozenset(range(0x20, 0x7F)) | {9, 10, 13}


@dataclass(frozen=True)
class Layer:
    """A suffix for rule ids, a finder over bytes, and a decoder that gives None for what it cannot decode."""

    suffix: str
    finder: re.Pattern
    decode: Callable[[bytes], bytes | None]
    gate: Callable[[bytes], bool] | None = None


def _rune(n: int) -> bytes:
    return "�".encode() if n > 0x10FFFF or 0xD800 <= n < 0xE000 else chr(n).encode()


def from_base64(s: bytes) -> bytes | None:
    """Standard or url-safe alphabet, padded or not."""
    body = s.rstrip(b"=")
    pad = len(s) - len(body)
    if len(body) % 4 == 1 or (pad and (len(s) % 4 or pad > 2)):
        return None
    for alt in (None, b"-_"):
        try:
            return base64.b64decode(body + b"=" * (-len(body) % 4), altchars=alt, validate=True)
        except (binascii.Error, ValueError):
            continue
    return None


def from_unicode_escapes(s: bytes) -> bytes:
    return b"".join(_rune(int(h, 16)) for h in re.findall(rb"u([0-9A-Fa-f]{4})", s))


def from_hex(s: bytes) -> bytes | None:
    return bytes.fromhex(s.decode()) if len(s) % 2 == 0 else None


def from_base32(s: bytes) -> bytes | None:
    body = s.rstrip(b"=")
    try:
        return base64.b32decode(body + b"=" * (-len(body) % 8))
    except binascii.Error:
        return None


def from_percent(s: bytes) -> bytes:
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), s)


def from_html(s: bytes) -> bytes | None:
    out = []
    for h, d in re.findall(rb"&#(?:x([0-9A-Fa-f]+)|([0-9]+));", s):
        n = int(h, 16) if h else int(d)
        if n >= 1 << 31:
            return None
        out.append(_rune(n))
    return b"".join(out)


def from_gzip(s: bytes) -> bytes | None:
    raw = from_base64(s)
    if raw is None:
        return None
    try:
        return zlib.decompressobj(31).decompress(raw, R.SCAN_BYTES)
    except zlib.error:
        return None


def from_fullwidth(s: bytes) -> bytes:
    if b"\\u" in s:
        s = from_unicode_escapes(s)
    return s.decode("utf-8", "replace").translate({**{c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}, 0x3000: 0x20}).encode()


def from_quoted_printable(s: bytes) -> bytes:
    return bytes.fromhex(s.replace(b"=", b"").decode())


def _even_chunks(s: bytes) -> bool:
    parts = re.split(rb"[ \t]", s)
    return len(parts) >= 4 and len({len(p) for p in parts}) == 1


# Suffixes and finders, in the order in which layers are tried. The look-behind of the last
# one changes no match (a match from inside a word would have begun at its start) but keeps the search linear.
_B64 = rb"[A-Za-z0-9+/]{24,}={0,2}"
LAYERS = [
    Layer("/base64-decoded", re.compile(_B64), from_base64),
    Layer("/unicode-decoded", re.compile(rb"(?:\\{1,2}u[0-9A-Fa-f]{4}){4,}"), from_unicode_escapes),
    Layer("/hex-decoded", re.compile(rb"[0-9A-Fa-f]{16,}"), from_hex),
    Layer("/base32-decoded", re.compile(rb"[A-Z2-7]{16,}={0,6}"), from_base32),
    Layer("/url-decoded", re.compile(rb"(?:%[0-9A-Fa-f]{2}){8,}"), from_percent),
    Layer("/html-decoded", re.compile(rb"(?:&#(?:x[0-9A-Fa-f]+|[0-9]+);){8,}"), from_html),
    Layer("/gzip-decoded", re.compile(_B64), from_gzip),
    Layer("/percent-decoded", re.compile(rb"(?:%25[0-9A-Fa-f]{2}){8,}"), lambda s: s.replace(b"%25", b"%")),
    Layer("/fullwidth-decoded", re.compile(rb"(?:\\u[fF][fF][0-9A-Fa-f]{2}|\xef\xbc[\x81-\xbf]|\xef\xbd[\x80-\x9e]|\xe3\x80\x80){8,}"), from_fullwidth),
    Layer("/qp-decoded", re.compile(rb"(?:=[0-9A-Fa-f]{2}){8,}"), from_quoted_printable),
    Layer("/whitespace-decoded", re.compile(rb"(?:[0-9A-Za-z]{2,8}[ \t]){3,}[0-9A-Za-z]{2,8}"), lambda s: re.sub(rb"[ \t]", b"", s), _even_chunks),
    Layer("/continuation-decoded", re.compile(rb"(?<![0-9A-Za-z_])[0-9A-Za-z_]+(?:\\+(?:\r?\n|n)[0-9A-Za-z_]+)+"), lambda s: re.sub(rb"\\+(?:\r?\n|n)", b"", s)),
]


def register_layer(layer: Layer) -> None:
    """Try another decoder after the ones there are."""
    LAYERS.append(layer)


def mostly_printable(s: bytes) -> bool:
    return bool(s) and sum(map(_PRINT.__contains__, s)) / len(s) >= PRINTABLE


# Checks of the regex rules over bytes, for decoded texts.


def _digits(s: bytes) -> list[int]:
    return [c - 48 for c in s if 48 <= c <= 57]


def _luhn(d: list[int]) -> bool:
    return sum(x if k % 2 else (2 * x - 9 * (x > 4)) for k, x in enumerate(d, len(d) % 2)) % 10 == 0


def _card(s: bytes) -> bool:
    d = _digits(s)
    if len(d) == 14:
        t = "".join(map(str, d))
        if 1900 <= int(t[:4]) <= 2099 and 1 <= int(t[4:6]) <= 12 and 1 <= int(t[6:8]) <= 31 and int(t[8:10]) <= 23 and int(t[10:12]) <= 59 and int(t[12:]) <= 59:
            return False
    return 13 <= len(d) <= 19 and _luhn(d)


def _iban(s: bytes) -> bool:
    t = s.replace(b" ", b"").replace(b"\t", b"").decode("latin-1")
    if not 5 <= len(t) <= 34 or not re.fullmatch("[A-Z0-9]+", t):
        return False
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _ahv(s: bytes) -> bool:
    d = _digits(s)
    return len(d) == 13 and d[:3] == [7, 5, 6] and -sum(x * (1, 3)[k % 2] for k, x in enumerate(d[:12])) % 10 == d[12]


def _uid(s: bytes) -> bool:
    d = _digits(s)
    if len(d) != 9:
        return False
    c = 11 - sum(x * w for x, w in zip(d, (5, 4, 3, 2, 7, 6, 5, 4))) % 11
    return c != 10 and c % 11 == d[8]


def _fi_pic(s: bytes) -> bool:
    t = s.decode("latin-1")
    return 1 <= int(t[:2]) <= 31 and 1 <= int(t[2:4]) <= 12 and "0123456789ABCDEFHJKLMNPRSTUVWXY"[int(t[:6] + t[7:10]) % 31] == t[10]


def entropy(s: bytes) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def _blob(s: bytes) -> bool:
    if entropy(s) < (4.5 if len(s) >= 32 else 3.7):
        return False
    if s.count(b"/") >= 2 and not re.search(rb"[0-9+]", s):
        return False
    if not re.search(rb"[0-9+/]", s) and len(re.findall(rb"[A-Za-z]", s)) >= 10:
        turns = len(re.findall(rb"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])", s))
        return turns < 2 and len(re.findall(rb"[_-]", s)) < 2
    return True


CHECKS = {"card": _card, "iban": _iban, "ch_ahv": _ahv, "ch_uid": _uid, "fi_pic": _fi_pic, "base64_blob": _blob}


def _email(body: bytes, a: int, b: int) -> tuple[int, int] | None:
    if a and body[a - 1] == 0x5C and body[a] in b"nrtbfv":
        a += 1
        if body[a : a + 1] == b"@":
            return None
    span, before = body[a:b].lower(), body[max(0, a - 128) : a].lower()
    if span.startswith(b"noreply@") or span == b"vibe@mistral.ai" or any(m in before for m in (b"useremail", b"user's email", b"user email addr")):
        return None
    return a, b


def _de_vat(body: bytes, a: int, b: int) -> tuple[int, int] | None:
    word = a and re.match(rb"[0-9A-Za-z_]", body[a - 1 : a])
    return None if word and body[max(0, a - 2) : a] != b"\\n" else (a, b)


REFINERS = {"email": _email, "de_vat": _de_vat}


class ByteScanner:
    """The regex rules over bytes, with decode-and-rescan."""

    def __init__(self, rules=None, layers=None) -> None:
        self.rules = [(k, r, to_bytes(r.pattern), [w.lower().encode() for w in r.keywords]) for k, r in enumerate(rules or R.builtin_rules())]
        self.layers = list(LAYERS if layers is None else layers)

    def direct(self, body: bytes) -> list[tuple]:
        """(off, end, rule id, category, severity, rule index) of the rules themselves."""
        low, out = body.lower(), []
        for k, r, rx, words in self.rules:
            if words and not any(w in low for w in words):
                continue
            for m in rx.finditer(body):
                span = m.span()
                if r.refine:
                    span = REFINERS[r.refine](body, *span)
                    if span is None:
                        continue
                if r.check and r.check in CHECKS and not CHECKS[r.check](body[slice(*span)]):
                    continue
                out.append((*span, r.rule_id, r.category, r.severity, k))
        return out

    def layered(self, body: bytes, depth: int = 0) -> list[tuple]:
        """Findings inside encoded runs of ``body``, anchored on the runs."""
        out = []
        if depth >= MAX_DEPTH:
            return out
        for n, layer in enumerate(self.layers):
            for m in layer.finder.finditer(body):
                if layer.gate and not layer.gate(m[0]):
                    continue
                inner = layer.decode(m[0])
                if inner is None or not mostly_printable(inner):
                    continue
                inner = inner[: R.SCAN_BYTES]
                for off, end, rule, cat, sev, _ in self.scan(inner, depth + 1):
                    out.append((*m.span(), rule + layer.suffix, cat, sev, 1000 + n))
        return out

    def scan(self, body: bytes, depth: int = 0) -> list[tuple]:
        """Direct and layered findings, first of each (span, category, severity) in order of offset and severity."""
        body = body[: R.SCAN_BYTES]
        found = self.direct(body) + self.layered(body, depth)
        found.sort(key=lambda x: (x[0], -SEVERITIES.index(x[4])))
        seen, out = set(), []
        for x in found:
            key = (x[0], x[1], x[3], x[4])
            if key not in seen:
                seen.add(key)
                out.append(x)
        return out


def _even_runs() -> str:
    """A pattern for runs of four or more chunks of one width.

    A run reaches as far as chunks of any width do, so it has no further chunk
    before or behind it (but the rest of a long word that ended another run);
    chunks of eight may be parts of longer words.
    """
    c = "[0-9A-Za-z]"
    run = lambda n: rf"(?:{c}{{{n}}}[ \t]){{3,}}{c}{{{n}}}"
    narrow = "|".join(run(n) + rf"(?!{c})" for n in range(2, 8))
    return rf"(?:(?<!{c})(?:(?<!{c}{{2}}[ \t])|(?<={c}{{9}}[ \t]))|(?<={c}{{8}}))(?:{narrow})(?![ \t]{c}{{2}})|{run(8)}"


#: The least that each finder matches, but for chunks. All repeats are bounded, of one character or of a fixed width, so
#: no loop can recurse deeply.
_GATES = (
    r"[A-Za-z0-9+/]{24}",
    r"[0-9A-Fa-f]{16}",
    r"[A-Z2-7]{16}",
    r"(?:\\{1,2}u[0-9A-Fa-f]{4}){4}",
    r"(?:%[0-9A-Fa-f]{2}){8}",
    r"(?:%25[0-9A-Fa-f]{2}){8}",
    r"(?:&#(?:x[0-9A-Fa-f]+|[0-9]+);){8}",
    r"(?:\\u[fF][fF][0-9A-Fa-f]{2}|[\uFF01-\uFF5E\u3000]){8}",
    r"(?:=[0-9A-Fa-f]{2}){8}",
    r"[0-9A-Za-z_]\\+(?:\r?\n|n)[0-9A-Za-z_]",
)


def may_hold_layers(text: Column) -> Column:
    """True if any finder can match a run that some rule or further layer can match; other texts never reach Python.

    The join of a run of chunks needs a digit (all numbers, hex), two capitals
    (base32) or 24 characters in all (base64); a few plain words of one length
    have none of these.
    """
    out = F.lit(False)
    for p in _GATES:
        out = out | text.rlike(p)
    telling = lambda r: r.rlike("[0-9]|[A-Z]{2}") | (F.length(F.regexp_replace(r, "[ \t]", "")) >= 24)
    return out | F.exists(F.regexp_extract_all(text, F.lit(_even_runs()), F.lit(0)), telling)


def _peel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    scanner = ByteScanner()
    for pdf in batches:
        rows = []
        for i, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
            body = text.encode("utf-8", "surrogatepass")[: R.SCAN_BYTES]
            for n, (off, end, rule, cat, sev, k) in enumerate(scanner.layered(body)):
                lo = max(0, off - BEFORE)
                rows.append((i, rule, cat, sev, off, end, body[off:end].decode("utf-8", "replace"), LAYER, k * 100_000 + n, {"lo": lo, "bytes": body[lo : end + AFTER]}))
        yield pd.DataFrame(rows, columns=["id", "rule_id", "category", "severity", "off", "end", "raw", "source", "rule", "ctx"])


def detect_layers(payloads: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Findings inside encoded runs, as detect() returns them; identities are empty, as the raw value is not in the payload."""
    kind = payloads.schema[id_col].dataType.simpleString()
    src = spread(payloads.select(F.col(id_col), F.col(text_col).alias("text"))).where(F.col("text").isNotNull())
    # Tied to the partition, the costly predicate is not moved below the dealing out of rows.
    src = src.withColumn("__part", F.spark_partition_id()).where(may_hold_layers(F.col("text")) & (F.col("__part") >= 0)).select(id_col, "text")
    out = src.mapInPandas(_peel, f"id {kind}, rule_id string, category string, severity string, off long, end long, raw string, source int, rule long, ctx struct<lo:bigint,bytes:binary>")
    f = out.select(F.col("id").alias(id_col), "rule_id", "category", "severity", "off", "end", "raw", "source", "rule", "ctx")
    return finish(f, id_col).withColumn("identity", F.lit(""))
