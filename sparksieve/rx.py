"""Rule patterns for the regex engines in use.

Patterns are written in RE2's syntax. Java differs: its word boundary is
Unicode-aware, its white-space class has the vertical tab and its ``$`` also
matches before a last line feed, so these are spelled out for it. Python runs
them over bytes, where classes and boundaries are ASCII.
"""

from __future__ import annotations

import re

_W = "[0-9A-Za-z_]"
#: ASCII word boundary for Java.
BOUNDARY = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def _translate(pattern: str, boundary: str, end: str) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            if two == "\\b" and not in_class:
                out.append(boundary)
            elif two == "\\s":
                out.append(r"\t\n\f\r " if in_class else r"[\t\n\f\r ]")
            else:
                out.append(two)
            i += 2
            continue
        if in_class:
            in_class = c != "]"
            out.append("\\" + c if c in "[&" else c)
        else:
            in_class = c == "["
            out.append(end if c == "$" else c)
        i += 1
    return "".join(out)


#: Patterns whose leading boundary stands before a word character in every alternative.
_WORD_FIRST = re.compile(r"\\b(?:\(\?:)?(?:\\d|\[A-Z\]|\[13\]|\[A-Za-z0-9\]\[|[A-Za-z0-9])")


def to_java(pattern: str) -> str:
    """The pattern for Spark's expressions; a leading boundary before a word character is just a look-behind."""
    if _WORD_FIRST.match(pattern):
        return f"(?<!{_W})" + _translate(pattern[2:], BOUNDARY, r"\z")
    return _translate(pattern, BOUNDARY, r"\z")


def to_bytes(pattern: str) -> re.Pattern:
    """The pattern compiled for Python over UTF-8 bytes."""
    return re.compile(_translate(pattern, r"\b", r"\Z").encode())
