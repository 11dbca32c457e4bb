"""POSIX globs (``*``, ``?``, ``[seq]``, ``[!seq]``; case counts) as Spark predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """The anchored Java regular expression of a glob."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) >= 0:
            body = pattern[i:end]
            i = end + 1
            negated = body.startswith("!")
            body = body[1:] if negated else body
            out.append("[" + "^" * negated + "".join("\\" + x if x in "\\[]^&" else x for x in body) + "]")
        else:
            out.append(c if c.isalnum() or c in "_-/ " or ord(c) > 127 else "\\" + c)
    return "(?s)\\A" + "".join(out) + "\\z"


def glob_matches(name: Column, pattern: str) -> Column:
    return name.rlike(glob_regex(pattern)) if isinstance(name, Column) else F.col(name).rlike(glob_regex(pattern))
