"""Checks that a translated Markdown text keeps its source's structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Structures that must be equally many.
COUNTED = {"headings": r"(?md)^#{1,6}\s", "fence_markers": r"(?md)^[ \t]{0,3}(?:`{3,}|~{3,})", "list_markers": r"(?md)^\s*(?:[-*+]|\d+\.)\s"}
#: Pieces of the source that must occur in the translation as often as they are found in the source.
KEPT = {"fenced_code": r"```[\s\S]*?```", "inline_code": r"`[^`\r\n]+`", "urls": r"https?://[^\s)]+", "placeholders": r"\{\{?[^{}\r\n]+\}?\}"}


def _times(text: Column, piece: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, piece, F.lit("")))) / F.length(piece)


def _changed(found: Column, translated: Column) -> Column:
    """Does one of the ``found`` pieces stand in the translation more or less often than it was found."""
    return F.exists(F.array_distinct(found), lambda p: F.size(F.filter(found, lambda q: q == p)) != _times(translated, p))


def markdown_check(source: Column, translated: Column) -> Column:
    """The first failing check: a counted structure, then a kept piece; else ok."""
    out = None
    for name, pattern in COUNTED.items():
        bad = F.regexp_count(source, F.lit(pattern)) != F.regexp_count(translated, F.lit(pattern))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    for name, pattern in KEPT.items():
        out = out.when(_changed(F.regexp_extract_all(source, F.lit(pattern), F.lit(0)), translated), name)
    return out.otherwise("ok")
