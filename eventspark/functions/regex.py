"""Regular expressions: the reference dialect has no look-around and named groups `(?P<name>...)`."""

from __future__ import annotations

import re

_GROUP = re.compile(r"\(\?P?<([A-Za-z_][\w.\[\]@-]*)>")


def java(pattern: str) -> str:
    """The pattern for Java: Unicode classes as there, named groups as plain ones."""
    out = _GROUP.sub("(", _nested_brackets(pattern))
    return "(?U)" + out if re.search(r"\\[wdbsWDBS]", out) and not out.isascii() else out


def group_names(pattern: str) -> list[str | None]:
    """The name of each capturing group, in order."""
    names: list[str | None] = []
    at, in_class = 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 2
            continue
        if c == "[" and not in_class:
            in_class = True
            if pattern[at + 1 : at + 2] == "]":
                at += 1
        elif c == "]" and in_class:
            in_class = False
        elif c == "(" and not in_class:
            if m := _GROUP.match(pattern, at):
                names.append(m[1])
            elif pattern[at + 1 : at + 2] != "?":
                names.append(None)
        at += 1
    return names


def _nested_brackets(pattern: str) -> str:
    """Java reads a bare [ inside a class as a nested class, and && as an intersection."""
    out, at, in_class = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        if in_class and c == "[":
            out.append("\\[")
        elif in_class and c == "&" and pattern[at + 1 : at + 2] == "&":
            out.append("\\&")
        else:
            if c == "[":
                in_class = True
            elif c == "]":
                in_class = False
            out.append(c)
        at += 1
    return "".join(out)


def java_replacement(replacement: str) -> str:
    """`$1` and `${1}` references; other backslashes are literal."""
    return re.sub(r"\$\{(\d+)\}", r"$\1", replacement.replace("\\", "\\\\"))
