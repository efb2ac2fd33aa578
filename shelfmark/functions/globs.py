"""Ignore globs as one regular expression per job.

A glob is anchored at the right end of the path and compared segment by segment; ``*`` stays
inside a segment. ``**`` equals ``*`` unless ``recursive`` is set, where it spans any number of
segments.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\*+|\?|\[(?P<neg>!?)(?P<set>\]?[^]]*)\]|(?P<char>.)", re.S)


def _segment(glob: str) -> str:
    if not glob.strip("*"):
        return "[^/]+"

    def translate(m: re.Match) -> str:
        text = m.group(0)
        if text.startswith("*"):
            return "[^/]*"
        if text == "?":
            return "[^/]"
        if m.group("set") is not None:
            chars = re.sub(r"([\\\[\]&^])", r"\\\1", m.group("set"))
            return f"[^/{chars}]" if m.group("neg") else f"[{chars}]"
        return re.sub(r"([^\w])", r"\\\1", text)

    return _TOKEN.sub(translate, glob)


def glob_regex(glob: str, recursive: bool = False) -> str | None:
    parts = [p for p in glob.split("/") if p not in ("", ".")]
    if not parts:
        return None
    regex = "^/" if glob.startswith("/") else "(^|/)"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if recursive and part == "**":
            regex += ".+" if last else "([^/]+/)*"
        else:
            regex += _segment(part) + ("" if last else "/")
    return regex + "$"


def matches_any(path: Column, globs: tuple[str, ...] | list[str], recursive: bool = False) -> Column:
    alternatives = [r for r in (glob_regex(g, recursive) for g in globs) if r]
    if not alternatives:
        return F.lit(False)
    return path.rlike("|".join(f"(?:{r})" for r in alternatives))
