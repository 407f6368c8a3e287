"""Positions, identifiers, snippets and fenced code of source texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical_hash, split_lines

SNIPPET_LINES = 12
# What stands in a snippet's place or at its end.
CHANGED = "(snapshot_changed - the file on disk no longer matches this hit's snapshot; run sync and search again)"
UNAVAILABLE = "(file changed since indexing - snippet unavailable)"
CUT = "\n    ..."
_NAME = r"[\p{L}\p{Nd}_$-]"
#: Fixed value: a block between fences of three or more signs, at the start of a line.
FENCED = r"(?ms)^(`{3,}|~{3,})[^\r\n]*\r?\n.*?^\1[ \t]*(?:\r?\n|$)"


def zero_based(position: Column) -> Column:
    """A position that counts from 1, counted from 0; less than 1 is an error."""
    return F.when(position >= 1, position - 1).otherwise(F.raise_error(F.lit("positions count from 1")).cast("int"))


def identifier_at(line: Column, column: Column) -> Column:
    """The identifier that holds a column (from 0) of a line, or ends there at the line's end; null if there is none."""
    n = F.length(line)
    at = F.when((column == n) & (n > 0), column - 1).otherwise(column)
    before, after = F.regexp_extract(F.left(line, at), _NAME + "*$", 0), F.regexp_extract(F.substr(line, at + 1), "^" + _NAME + "*", 0)
    return F.when((column >= 0) & (column <= n) & (after != ""), F.concat(before, after))


def snippet(text: Column, indexed_hash: Column, start: Column, end: Column, most: int = SNIPPET_LINES) -> Column:
    """Lines ``start`` to ``end`` (from 1) of a text, ``most`` of them, if the text is still the one that was indexed. A null hash isn't compared."""
    lines = split_lines(text)
    first = F.greatest(start - 1, F.lit(0))
    last = F.least(F.size(lines), end, first + most)
    body = F.array_join(F.slice(lines, first + 1, F.greatest(last - first, F.lit(0))), "\n")
    drifted = indexed_hash.isNotNull() & ~canonical_hash(text).eqNullSafe(indexed_hash)
    return F.when(drifted, CHANGED).when(text.isNull() | (start > F.size(lines)), UNAVAILABLE).otherwise(F.concat(body, F.when(last < end, CUT).otherwise("")))


def snippet_lines(text: Column) -> Column:
    """Source lines of a snippet, without the mark of a cut; the mark of a changed file counts as one."""
    own = F.when(text.endswith(CUT), F.left(text, F.length(text) - len(CUT))).otherwise(text)
    return F.when((text == "") | (text == UNAVAILABLE) | (own == ""), 0).otherwise(F.length(own) - F.length(F.replace(own, F.lit("\n"))) + 1)


def generated(text: Column) -> Column:
    return F.left(text, F.lit(500)).contains("<auto-generated")


def inferable(symbol: Column) -> Column:
    """Can a declaration of the symbol be given an extent though none was reported."""
    return symbol.startswith("scip-") & ~symbol.startswith("scip-local ") & (symbol.endswith(".") | symbol.endswith("#"))


def fenced_parts(text: Column) -> Column:
    """array of struct(text, translatable): the blocks of fenced code and what stands between them; put together they are the text."""
    between, blocks = F.split(text, FENCED, -1), F.regexp_extract_all(text, F.lit(FENCED), F.lit(0))
    part = lambda c, free: F.struct(c.alias("text"), F.lit(free).alias("translatable"))
    pairs = F.zip_with(between, blocks, lambda a, b: F.array(part(F.coalesce(a, F.lit("")), True), part(F.coalesce(b, F.lit("")), False)))
    return F.filter(F.flatten(pairs), lambda p: p["text"] != "")


def protected(text: Column, mark: str = "__PROTECTED_FENCE_") -> Column:
    """struct(text, blocks): a numbered mark in the place of each block of fenced code."""
    between, blocks = F.split(text, FENCED, -1), F.regexp_extract_all(text, F.lit(FENCED), F.lit(0))
    marks = F.transform(blocks, lambda b, k: F.concat(F.lit(mark), F.lpad(k.cast("string"), 4, "0"), F.lit("__")))
    return F.struct(F.array_join(F.flatten(F.zip_with(between, marks, lambda a, m: F.array(a, F.coalesce(m, F.lit(""))))), "").alias("text"), blocks.alias("blocks"))


def restored(translated: Column, blocks: Column, mark: str = "__PROTECTED_FENCE_") -> Column:
    """The blocks in the place of their marks; null if a mark doesn't stand exactly once."""
    token = lambda k: F.concat(F.lit(mark), F.lpad(k.cast("string"), 4, "0"), F.lit("__"))
    pairs = F.transform(blocks, lambda b, k: F.struct(b.alias("b"), token(k).alias("t")))
    once = lambda text, t: F.length(text) - F.length(F.replace(text, t, F.lit(""))) == F.length(t)
    return F.aggregate(pairs, translated, lambda text, p: F.when(once(text, p["t"]), F.replace(text, p["t"], p["b"])))


def boundary_breaks(text: Column) -> Column:
    """struct(leading, text, trailing): line breaks at both ends and what stands between."""
    pattern = r"(?s)^([\r\n]*)(.*?)([\r\n]*)$"
    return F.struct(*[F.regexp_extract(text, pattern.replace("$", r"\z"), k).alias(n) for k, n in ((1, "leading"), (2, "text"), (3, "trailing"))])
