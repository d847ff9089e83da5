"""Patterns: SQL's SIMILAR TO on top of regular expressions."""

from __future__ import annotations

import re


def similar_to_regex(pattern: str) -> str:
    r"""The regular expression for a SIMILAR TO pattern: % and _ are wildcards, | * + ? {} () [] keep their meaning, a backslash escapes, all else is plain."""
    out, i, in_set = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif in_set:
            in_set = c != "]"
            out.append("\\\\" if c == "\\" else c)
        elif c in "%_":
            out.append(".*" if c == "%" else ".")
        elif c == "[":
            in_set = True
            out.append(c)
        else:
            out.append(c if c in "|*+?{}()" else re.escape(c))
        i += 1
    return f"^(?s:{''.join(out)})$"
