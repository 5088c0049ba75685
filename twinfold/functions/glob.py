"""Glob patterns as anchored regular expressions.

A pattern is a list of components. In a component `*` and `?` match any characters and one character but the
separator, `[...]` and `[^...]` a class, and a backslash takes the next character as it is. A component that is just
`**` matches any number of components, none included. A malformed pattern matches nothing.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

META = re.compile(r"[*?\[]")


class Malformed(ValueError):
    """The pattern has an open class, an empty class or range, or a backslash at its end."""


def _literal(char: str) -> str:
    return char if char.isalnum() or char == "_" or ord(char) > 127 else "\\" + char


def _class(part: str, at: int) -> tuple[str, int]:
    """The class that opens at part[at], and the place after it."""

    def char(i: int) -> tuple[str, int]:
        if i >= len(part) or part[i] in "-]":
            raise Malformed(part)
        if part[i] == "\\":
            i += 1
            if i >= len(part):
                raise Malformed(part)
        return part[i], i + 1

    at += 1
    negated = part[at : at + 1] == "^"
    at += negated
    ranges = []
    while True:
        if at < len(part) and part[at] == "]" and ranges:
            break
        low, at = char(at)
        high = low
        if part[at : at + 1] == "-":
            high, at = char(at + 1)
        if low <= high:  # a falling range holds no character
            ranges.append(f"{_literal(low)}-{_literal(high)}" if low != high else _literal(low))
        else:
            ranges.append("")
        if at >= len(part):
            raise Malformed(part)
    body = "".join(ranges)
    if not body:
        return ("[^/]" if negated else r"[^\x00-\x{10FFFF}]"), at + 1
    return (f"[^{body}/]" if negated else f"[{body}]"), at + 1


def component_regex(part: str) -> str:
    out, at = [], 0
    while at < len(part):
        c = part[at]
        if c == "*":
            while part[at : at + 1] == "*":
                at += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
            at += 1
        elif c == "[":
            text, at = _class(part, at)
            out.append(text)
        elif c == "\\":
            if at + 1 == len(part):
                raise Malformed(part)
            out.append(_literal(part[at + 1]))
            at += 2
        else:
            out.append(_literal(c))
            at += 1
    return "".join(out)


def compile_glob(pattern: str, case_insensitive: bool = False) -> str | None:
    """A regular expression for "/" + path, or None if the pattern is malformed. Runs of `**` are one."""
    parts: list[str] = []
    for part in pattern.split("/"):
        if part and not (part == "**" and parts and parts[-1] == "**"):
            parts.append(part)
    try:
        body = "".join("(?:/[^/]+)*" if p == "**" else "/" + component_regex(p) for p in parts)
    except Malformed:
        return None
    return ("(?i)" if case_insensitive else "") + f"^{body}$"


def matches(path: Column, pattern: str, case_insensitive: bool = False) -> Column:
    """Whether a relative path matches the pattern."""
    regex = compile_glob(pattern, case_insensitive)
    return F.lit(False) if regex is None else F.concat(F.lit("/"), path).rlike(regex)


def recursive(pattern: str) -> bool:
    """Whether files may lie at other depths than the pattern's own."""
    return "**" in pattern


def pattern_depth(pattern: str) -> int:
    return len([p for p in pattern.split("/") if p])


def path_depth(base: str, path: str) -> int:
    """Components of path below base; 0 if it is not below it."""
    base = base.rstrip("/")
    if not path.startswith(base + "/"):
        return 0
    return len([p for p in path[len(base) :].split("/") if p])


def split_base(pattern: str) -> tuple[str, str]:
    """(base, match): the directory to walk and the pattern below it.

    The last separator counts whose next component has a wildcard and before which a directory exists; else the last
    one before the first wildcard."""
    places = [i for i, c in enumerate(pattern) if c == "/"]
    for at in reversed(places):
        follows = pattern[at + 1 :].split("/", 1)[0]
        base = pattern[:at] or "/"
        if META.search(follows) and os.path.isdir(base):
            return base, pattern[at + 1 :]
    first = META.search(pattern)
    before = [i for i in places if not first or i < first.start()]
    if not before:
        return ".", pattern
    return pattern[: before[-1]] or "/", pattern[before[-1] + 1 :]
