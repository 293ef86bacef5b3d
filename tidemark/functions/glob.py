"""Shell patterns as expressions.

``*`` is any text, a slash too; ``?`` any character; ``[..]`` and ``[!..]`` are
sets with ranges; there are no braces. A pattern matches the whole name, and
case counts. Patterns are translated once, on the driver; ``rlike`` does the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set(r"\.^$|?*+()[]{}&~#-")


def _quoted(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


def _set(body: str) -> str:
    """A regex class for what stands between brackets; ranges that run backwards are empty."""
    negated, body = body[0] == "!", body[body[0] == "!" :]
    parts, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            low, high = body[i], body[i + 2]
            if low <= high:
                parts.append(f"{_quoted(low)}-{_quoted(high)}")
            i += 3
        else:
            parts.append(_quoted(body[i]))
            i += 1
    if not parts:
        return "[\\s\\S]" if negated else "(?!)"
    return f"[{'^' * negated}{''.join(parts)}]"


def to_regex(pattern: str) -> str:
    """An anchored Java regex that matches what the pattern does."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            if not out or out[-1] != "[\\s\\S]*":
                out.append("[\\s\\S]*")
        elif c == "?":
            out.append("[\\s\\S]")
        elif c == "[":
            # A bracket right after the opening one (or its '!') is part of the set; without a closing one it is itself.
            first = i + (pattern[i : i + 1] == "!")
            close = pattern.find("]", first + 1 if pattern[first : first + 1] == "]" else first)
            if close < 0:
                out.append("\\[")
            else:
                out.append(_set(pattern[i:close]))
                i = close + 1
        else:
            out.append(_quoted(c))
    return "\\A" + "".join(out) + "\\z"


def matches_any(name: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Whether any pattern matches; of no patterns none does."""
    return reduce(lambda a, b: a | b, (name.rlike(to_regex(p)) for p in patterns), F.lit(False))


def passes(name: Column, include: list[str] | tuple[str, ...], exclude: list[str] | tuple[str, ...]) -> Column:
    """No exclude pattern matches, and some include pattern does if there are any."""
    out = ~matches_any(name, exclude)
    return out & matches_any(name, include) if include else out
