"""Regular expressions: from the language's syntax to Java's, and Python's for Arrow nodes."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass
class Pattern:
    java: str
    names: list[tuple[str, int]]  # named groups and their numbers
    groups: int


def translated(pattern: str) -> Pattern:
    """Names become plain groups, known by number; classes and boundaries are Unicode's."""
    from eventloom.lang.syntax import CompileError

    names: list[tuple[str, int]] = []
    out, i, n, in_class = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            if pattern[i + 1].isdigit() and pattern[i + 1] != "0" and not in_class:
                raise CompileError(101, "invalid regular expression: back-references aren't supported")
            out.append({"\\z": "\\z"}.get(pattern[i : i + 2], pattern[i : i + 2]))
            i += 2
            continue
        if in_class:
            in_class += (c == "[") - (c == "]")
        elif c == "[":
            in_class = 1
            if pattern[i + 1 : i + 2] == "]":
                out.append("[\\]")
                i += 2
                continue
            if pattern[i + 1 : i + 3] == "^]":
                out.append("[^\\]")
                i += 3
                continue
        elif c == "(":
            if m := re.match(r"\(\?P?<([A-Za-z_][A-Za-z0-9_.\[\]]*)>", pattern[i:]):
                n += 1
                names.append((m[1], n))
                out.append("(")
                i += len(m[0])
                continue
            if re.match(r"\(\?(<?[=!]|>)", pattern[i:]):
                raise CompileError(101, "invalid regular expression: look-around isn't supported")
            n += not pattern.startswith("(?", i)
        elif c == "$" and not re.match(r"\(\?[a-z]*m", pattern):
            out.append("\\z")
            i += 1
            continue
        out.append(c)
        i += 1
    try:
        python(pattern)
    except Exception as e:
        raise CompileError(101, f"invalid regular expression: {e}") from None
    return Pattern("(?U)" + "".join(out), names, n)


def python(pattern: str):
    """The pattern for the regex module."""
    import regex

    return regex.compile(regex.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", pattern), regex.V1)
