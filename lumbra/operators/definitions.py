"""Chunks cut along definitions: extents, nesting, own lines, windows of large bodies and of what no definition covers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbra.functions.text import split_lines

from . import spans
from .chunks import MOST_CHARS, OVERLAP, WINDOW
from .tables import written

LEAST_LINES, SPLIT_OVERLAP, MOST_SIGNATURE = 20, 8, 200
#: How lines begin that belong to what follows them.
LEADS = ("//", "/*", "*", "#")
PIECES = "array<struct<path: string, first: int, last: int, within: string, outer: boolean, lines: array<string>, whole: string>>"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def trimmable(line: Column) -> Column:
    """Blank and comment lines, which belong to the next declaration."""
    return line.rlike(r"^\s*(?:" + "|".join(re.escape(x) for x in LEADS) + "|$)")


def inferred_extents(names: DataFrame, reported: DataFrame, lines: DataFrame) -> DataFrame:
    """``inferred`` for lines (doc, line, trimmable)."""
    ends = lines.groupBy("doc").agg((F.max("line") + 1).alias("line"))
    return inferred(names, reported, ends, lines.where(~F.col("trimmable")).select("doc", F.col("line").alias("first"), F.col("line").alias("last")))


def inferred(names: DataFrame, reported: DataFrame, ends: DataFrame, solid: DataFrame) -> DataFrame:
    """(doc, name, first, last) of declarations without a body.

    names (doc, line, column, name), reported spans (doc, first, last), ends (doc, line: the one behind the last), solid (doc, first, last): runs of lines that aren't trimmable. A declaration inside a reported span is left
    out, of several on a line the leftmost counts; it runs to the line before the next boundary, without trailing trimmable lines, and is
    left out if one line is all.
    """
    # Spans and declarations in one order of lines: a declaration is inside where a span that began has not ended.
    reach = reported.select("doc", F.col("first").alias("line"), "last", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("column"))
    both = reach.unionByName(names.select("doc", "line", F.lit(None).cast(reported.schema["last"].dataType).alias("last"), "name", "column"))
    upto = Window.partitionBy("doc").orderBy("line").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    free = both.withColumn("_end", F.max("last").over(upto)).where("name is not null and (_end is null or _end < line)")
    own = free.groupBy("doc", "line").agg(F.min_by("name", F.struct("column", "name")).alias("name"))
    bounds = own.select("doc", "line", "name").unionByName(reported.select("doc", F.col("first").alias("line"), F.lit(None).cast("string").alias("name"))).unionByName(ends.select("doc", "line", F.lit(None).cast("string").alias("name")))
    bounds = bounds.groupBy("doc", "line").agg(F.max("name").alias("name"))
    reach = bounds.withColumn("until", F.lead("line").over(Window.partitionBy("doc").orderBy("line")) - 1).where("name is not null and until > line")
    # The last solid line up to the end: the newest run before it, in the same order.
    number = solid.schema["last"].dataType
    marks = solid.select("doc", F.col("first").alias("at"), "last", F.lit(None).cast("string").alias("name"), F.lit(None).cast(reach.schema["line"].dataType).alias("first"))
    asked = reach.select("doc", F.col("until").alias("at"), F.lit(None).cast(number).alias("last"), "name", F.col("line").alias("first"))
    so_far = Window.partitionBy("doc").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    got = marks.unionByName(asked).withColumn("last", F.least(F.max("last").over(so_far), F.col("at").cast(number)))
    return got.where("name is not null and last > first").select("doc", "name", "first", "last")


def chains(nested: DataFrame) -> DataFrame:
    """(doc, id, chain) of spans (doc, id, name, first, last): the names of all spans that hold it, outermost first, and its own.

    Of spans with equal lines the smallest id counts as the outer one.
    """
    s, p = spans.meeting(nested)
    same = (F.col("p.first") == F.col("s.first")) & (F.col("p.last") == F.col("s.last"))
    holds = (F.col("p.first") <= F.col("s.first")) & (F.col("p.last") >= F.col("s.last")) & (~same | (F.col("p.id") <= F.col("s.id")))
    chain = F.sort_array(F.collect_list(F.struct(F.col("p.first").alias("first"), (-F.col("p.last")).alias("last"), F.col("p.id").alias("id"), F.col("p.name").alias("name"))))  # as deep as definitions nest
    got = s.join(p.hint("merge"), (F.col("s.doc") == F.col("p.doc")) & (F.col("s.stretch") == F.col("p.stretch")) & holds).groupBy(F.col("s.doc").alias("doc"), F.col("s.id").alias("id")).agg(chain.alias("chain"))
    return got.select("doc", "id", F.transform("chain", lambda x: x["name"]).alias("chain"))


def qualified(nested: DataFrame) -> DataFrame:
    """nested (doc, id, name, first, last) with ``path``: its ``chains`` with dots."""
    return nested.join(chains(nested).hint("merge"), ["doc", "id"]).select("doc", "id", "name", "first", "last", F.array_join("chain", ".").alias("path"))


def own_lines(nested: DataFrame) -> DataFrame:
    """(doc, id, line) of the lines that a span shows, see ``own_ranges``."""
    return own_ranges(nested).select("doc", "id", F.explode(F.sequence("from", "to")).alias("line"))


def own_ranges(nested: DataFrame) -> DataFrame:
    """(doc, id, from, to): runs of the lines that a span shows, those in none of its children (``spans.parents``), and each child's first."""
    child = nested.where("parent is not null").select("doc", F.col("parent").alias("id"), F.lit(1).alias("kind"), "first", "last")
    every = nested.select("doc", "id", F.lit(0).alias("kind"), "first", "last").unionByName(child)
    # A span and then its children by their first lines: what shows are the lines from where those before reach to a child's first, and behind the last child. Lines become rows at the end.
    order = Window.partitionBy("doc", "id").orderBy("kind", "first", "last")
    upto, reach = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), F.when(F.col("kind") == 0, F.col("first") - 1).otherwise(F.col("last"))
    before = F.max(reach).over(order.rowsBetween(Window.unboundedPreceding, -1))
    again = (F.lag("kind").over(order) == 1) & (F.lag("first").over(order) == F.col("first"))
    cut = every.select("doc", "id", "kind", "first", before.alias("_before"), F.max(reach).over(upto).alias("_reach"), F.first("last").over(upto).alias("_last"), F.coalesce(again, F.lit(False)).alias("_again"), F.lead("kind").over(order).isNull().alias("_end"))
    run = lambda a, b: F.struct(a.alias("from"), b.alias("to"))
    gap = F.when((F.col("kind") == 1) & ~F.col("_again"), run(F.least(F.col("_before") + 1, F.col("first")), F.col("first")))
    tail = F.when(F.col("_end") & (F.col("_reach") < F.col("_last")), run(F.col("_reach") + 1, F.col("_last")))
    return cut.select("doc", "id", F.explode(F.array_compact(F.array(gap, tail))).alias("r")).select("doc", "id", "r.from", "r.to")


def split_windows(bodies: DataFrame) -> DataFrame:
    """Windows of bodies (.., header, lines): columns of ``bodies`` with ``label``, ``offset``, ``shown`` (lines) and ``body`` (cut at the limit).

    A body that fits with its header stays whole, with an empty label. Else its average line decides how many lines fit; windows overlap, and
    the label counts as many parts as there are steps, also where the last one isn't reached.
    """
    n = F.size("lines")
    whole = F.length("header") + F.length(F.array_join("lines", "\n"))
    average = F.greatest(F.lit(1), F.floor(whole / F.greatest(n, F.lit(1))))
    wide = F.greatest(F.lit(LEAST_LINES), F.floor((MOST_CHARS - F.length("header")) / average)).cast("int")
    got = bodies.withColumn("_n", n).withColumn("_whole", whole <= MOST_CHARS).withColumn("_wide", wide).withColumn("_step", F.greatest(F.lit(1), F.col("_wide") - SPLIT_OVERLAP))
    starts = F.when(F.col("_whole") | (F.col("_n") == 0), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0)), F.col("_step")))
    got = got.withColumn("offset", F.explode(starts)).where((F.col("offset") == 0) | (F.col("offset") - F.col("_step") + F.col("_wide") < F.col("_n")))
    shown = F.when(F.col("_whole"), F.col("_n")).otherwise(F.least(F.col("_wide"), F.col("_n") - F.col("offset")))
    label = F.when(F.col("_whole"), "").otherwise(F.concat(F.lit(" ["), (F.col("offset") / F.col("_step") + 1).cast("int").cast("string"), F.lit("/"), F.ceil(F.col("_n") / F.col("_step")).cast("string"), F.lit("]")))
    got = got.withColumn("shown", shown).withColumn("label", label)
    body = F.left(F.concat("header", F.array_join(F.slice("lines", F.col("offset") + 1, F.col("shown")), "\n")), F.lit(MOST_CHARS))
    return got.withColumn("body", body).drop("_n", "_whole", "_wide", "_step")


def windows_of(first: Column, last: Column, lines: Column) -> Column:
    """Windows (first, last, label, body) of a run of a file's lines as an array; blank ones go before they are numbered."""
    step, many = WINDOW - OVERLAP, last - first + 1
    starts = F.filter(F.sequence(F.lit(0), many - 1, F.lit(step)), lambda at: (at == 0) | (at + OVERLAP < many))

    def window(at: Column) -> Column:
        start, end = first + at, F.least(last, first + at + WINDOW - 1)
        return F.struct(start.alias("first"), end.alias("last"), F.array_join(F.slice(lines, start, end - start + 1), "\n").alias("body"))

    solid = F.filter(F.transform(starts, window), lambda w: w["body"].rlike(r"\S"))

    def numbered(some: Column) -> Column:
        label = lambda k: F.when(F.size(some) > 1, F.concat(F.lit(" ["), (k + 1).cast("string"), F.lit("/"), F.size(some).cast("string"), F.lit("]"))).otherwise("")
        return F.transform(some, lambda w, k: F.struct(w["first"].alias("first"), w["last"].alias("last"), label(k).alias("label"), w["body"].alias("body")))

    return F.get(F.transform(F.array(solid), numbered), F.lit(0))


def region_windows(regions: DataFrame, files: DataFrame) -> DataFrame:
    """Windows (doc, first, last, label, body) of uncovered regions (doc, first, last) of files (doc, lines), see ``windows_of``."""
    got = regions.join(files.hint("merge"), "doc")
    return got.select("doc", F.explode(windows_of(F.col("first"), F.col("last"), F.col("lines"))).alias("w")).select("doc", "w.*")


def outlines(files: DataFrame) -> DataFrame:
    """(doc, n, solid) of files (doc, text): how many lines they have, and the runs (first, last) of those that aren't ``trimmable``."""
    # What sorts behind all leads, as most lines do, needs no regular expression.
    at = lambda x, k: F.when(x < "0", F.when(trimmable(x), k + 1))
    rows = files.select("doc", split_lines(F.col("text")).alias("lines")).select("doc", F.size("lines").alias("n"), F.array_compact(F.transform("lines", at)).alias("t"))
    rows = rows.select("doc", "n", F.concat(F.array(F.lit(0)), "t").alias("a"), F.concat("t", F.array(F.col("n") + 1)).alias("b"))
    between = F.zip_with("a", "b", lambda a, b: F.when(b - a > 1, F.struct((a + 1).alias("first"), (b - 1).alias("last"))))
    return rows.select("doc", "n", F.array_compact(between).alias("solid"))


def usable_spans(definitions: DataFrame, files: DataFrame) -> DataFrame:
    """Spans (doc, id, name, first, last) of definitions (doc, name, line, column, first, last; the last two null without a body) of files, given as their ``outlines``.

    Bodies outside the file are left out, and one over the whole file if there are other definitions; equal spans count once, by the first name in it.
    """
    many = definitions.groupBy("doc").agg(F.count("*").alias("definitions"))
    known = definitions.join(files.select("doc", "n").hint("merge"), "doc").join(many.hint("merge"), "doc")
    good = (F.col("first") >= 1) & (F.col("last") >= F.col("first")) & (F.col("last") <= F.col("n")) & ~((F.col("first") == 1) & (F.col("last") >= F.col("n")) & (F.col("definitions") > 1))
    reported = known.where(good & (F.col("name") != "")).groupBy("doc", "first", "last").agg(F.min_by("name", F.struct("line", "column", "name")).alias("name"))
    names = known.where(F.col("first").isNull() & (F.col("line") >= 1) & (F.col("line") <= F.col("n")) & (F.col("name") != "")).select("doc", "line", "column", "name")
    ends = files.select("doc", (F.col("n") + 1).alias("line"))
    solid = files.select("doc", F.explode("solid").alias("r")).select("doc", "r.first", "r.last")
    both = reported.select("doc", "name", "first", "last").unionByName(inferred(names, reported.select("doc", "first", "last"), ends, solid))
    return both.withColumn("id", F.col("first").cast("long") * 1_000_000_000 - F.col("last"))


def symbol_chunks(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """Chunks (doc, kind, symbol, signature, first, last, body) of files (doc, text) along their definitions; see ``usable_spans``.

    Each definition shows its own lines and one line of each nested one under a header; what no definition covers comes in windows. Files with a NUL
    give nothing; files without a usable definition give windows only.
    """
    # Lines never are rows: spans and runs are told from outlines, and meet their text once. No side of a join is left to be taken for a small one and sent through the driver.
    # A text that is computed is so once: a filter isn't pushed behind an explode.
    files = files.select("doc", F.explode(F.array("text")).alias("text")).where(~F.contains("text", F.char(F.lit(0))))
    known = written(outlines(files), "outlines")
    found = written(usable_spans(definitions, known), "spans")
    nested = written(spans.parents(found.select("doc", "id", "first", "last")), "nested")
    named = written(qualified(found).select("doc", "id", "path"), "named")
    shown = own_ranges(nested).groupBy("doc", "id").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))
    parents = nested.where("parent is not null").select("doc", F.col("parent").alias("id")).distinct().withColumn("_outer", F.lit(True))
    above = named.select("doc", F.col("id").alias("parent"), F.col("path").alias("within"))
    whole = nested.join(named.hint("merge"), ["doc", "id"]).join(shown.hint("merge"), ["doc", "id"]).join(parents.hint("merge"), ["doc", "id"], "left").join(above.hint("merge"), ["doc", "parent"], "left")
    of_file = whole.groupBy("doc").agg(F.collect_list(F.struct("path", "first", "last", "within", F.coalesce("_outer", F.lit(False)).alias("outer"), "runs")).alias("own"))
    rest = spans.uncovered(known.select("doc", F.col("n").alias("n_lines")), found.select("doc", "first", "last")).groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("rest"))
    rows = files.join(of_file.hint("merge"), "doc", "left").join(rest.hint("merge"), "doc", "left").select("doc", "own", "rest", split_lines(F.col("text")).alias("all"))

    def piece(path: Column, first: Column, last: Column, within: Column, outer: Column, lines: Column, body: Column) -> Column:
        return F.struct(path.alias("path"), first.cast("int").alias("first"), last.cast("int").alias("last"), within.alias("within"), outer.alias("outer"), lines.alias("lines"), body.alias("whole"))

    none, lines = F.lit(None).cast("string"), F.col("all")
    of_span = lambda x: piece(x["path"], x["first"], x["last"], x["within"], x["outer"], F.flatten(F.transform(x["runs"], lambda r: F.slice(lines, r["from"].cast("int"), (r["to"] - r["from"] + 1).cast("int")))), none)
    of_text = lambda w: piece(F.concat("doc", w["label"]), w["first"], w["last"], none, F.lit(False), F.array().cast("array<string>"), w["body"])
    windows = F.flatten(F.transform("rest", lambda x: F.transform(windows_of(x["first"].cast("int"), x["last"].cast("int"), lines), of_text)))
    pieces = F.concat(*[F.coalesce(x, F.array().cast(PIECES)) for x in (F.transform("own", of_span).cast(PIECES), windows.cast(PIECES))])
    rows = rows.select("doc", F.explode(pieces).alias("x")).select("doc", "x.*")
    is_text, folder = F.col("whole").isNotNull(), F.regexp_extract("doc", r"^(.*)/[^/]*$", 1)
    signature = F.when(is_text, "").otherwise(F.left(_bare(F.get("lines", F.lit(0))), F.lit(MOST_SIGNATURE)))
    header = F.concat(
        F.lit("File: "), "doc", F.lit("\n"), F.when(folder != "", F.concat(F.lit("Namespace: "), folder, F.lit("\n"))).otherwise(""),
        F.when(F.col("within").isNotNull(), F.concat(F.lit("Within: "), "within", F.lit("\n"))).otherwise(""),
    )
    kind = F.when(is_text, "Text").when(F.col("outer") | signature.rlike(r"\b(?:class|interface)\b"), "Type").otherwise("Method")
    cut = split_windows(rows.select("doc", kind.alias("kind"), "path", signature.alias("signature"), "first", "last", F.when(is_text, "").otherwise(header).alias("header"), "lines", "whole"))
    end = F.when(F.col("label") == "", F.col("last")).otherwise(F.least(F.col("last"), F.col("first") + F.col("offset") + F.col("shown") - 1))
    return cut.select("doc", "kind", F.concat("path", "label").alias("symbol"), "signature", (F.col("first") + F.col("offset")).alias("first"), end.alias("last"), F.coalesce("whole", "body").alias("body"))
