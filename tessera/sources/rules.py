"""Ignore patterns as one regular expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob(pattern: str) -> str:
    """A shell pattern as a regular expression; `*` crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 2 :]:
            j = pattern.index("]", i + 2)
            inner = pattern[i + 1 : j]
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def live(patterns: list[str]) -> list[str]:
    """Without blank lines, comments and negations."""
    return [p.strip() for p in patterns if p.strip() and p.strip()[0] not in "#!"]


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern meets the relative path, its last part, or one of its parts by name.

    A pattern that ends with a slash meets what lies in that folder; `**` may also stand for nothing.
    """
    out = F.lit(False)
    name = F.element_at(F.split(path, "/"), -1)
    for p in live(patterns):
        if p.endswith("/"):
            out = out | path.startswith(p) | F.contains(path, F.lit("/" + p))
            continue
        out = out | path.rlike(glob(p)) | name.rlike(glob(p)) | F.array_contains(F.split(path, "/"), p)
        if "**" in p:
            out = out | path.rlike(glob(p.replace("**/", "")))
    return out
