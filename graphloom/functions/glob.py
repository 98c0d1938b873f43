"""Shell globs as anchored regular expressions, case-sensitive; ``*`` crosses slashes, ``[!x]`` negates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            if not out or out[-1] != ".*":
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 2 if pattern[i : i + 1] == "!" else i + 1)
            if end < 0:
                out.append(r"\[")
                continue
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            i = end + 1
            out.append("[^" + body[1:] + "]" if body.startswith("!") else "[" + ("\\" if body.startswith("^") else "") + body + "]")
        else:
            out.append(c if c.isalnum() or c in "_/ -:<>@%,'\"=" else "\\" + c)
    return "(?s)^" + "".join(out) + "$"


def matches_glob(value: Column, pattern: str) -> Column:
    """Null never matches."""
    return F.coalesce(value.rlike(glob_regex(pattern)), F.lit(False))


def matches_uri_glob(uri: Column, pattern: str) -> Column:
    """Leading slashes do not count on either side."""
    return matches_glob(F.regexp_replace(uri, "^/+", ""), pattern.lstrip("/"))
