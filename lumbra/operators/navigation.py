"""Navigation by text alone: what stands at a position, and where else it stands, within bounds on files, bytes and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumbra.functions.source import identifier_at
from lumbra.functions.text import split_lines

from . import budgets
from .semantic import declares_before, tokens_of

#: Files that are scanned, bytes of a file, results of a question, characters of an identifier.
MOST_FILES, MOST_BYTES, MOST_RESULTS, MOST_NAME = 2000, 1 << 20, 200, 256


def scanned(files: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """files (doc, text) with ``state``: scanned, large (over ``most_bytes``; it counts as a file) or beyond (after the first ``most_files``, in the order of their names)."""
    placed = budgets.within(files.withColumn("at", F.lit(0).cast("long")).withColumn("name", F.col("doc")), {"files": (F.lit(1), most_files)})
    state = F.when(~F.col("taken"), "beyond").when(F.octet_length("text") > most_bytes, "large").otherwise("scanned")
    return placed.withColumn("state", state).drop("at", "name", "taken")


def names_at(files: DataFrame, points: DataFrame) -> DataFrame:
    """points (point_id, doc, line, col; from 0) with the ``name`` that stands there, of ``MOST_NAME`` characters at most; points without one are left out."""
    lines = files.join(points.select("doc").distinct(), "doc", "left_semi").select("doc", F.posexplode(split_lines(F.col("text"))).alias("line", "body"))
    return points.join(lines, ["doc", "line"]).withColumn("name", identifier_at(F.col("body"), F.col("col"))).where(F.length("name") <= MOST_NAME).drop("body")


def occurrences_by_text(files: DataFrame, points: DataFrame, definitions_only: bool = False, with_definitions: bool = True, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES, most_results: int = MOST_RESULTS) -> DataFrame:
    """(point_id, name, doc, line, col, declares, nth, found) of the places of each point's name: its first ``most_results`` in the order of files and places, numbered from 1, of all ``found``.

    Files are scanned as ``scanned`` says. Tokens meet names in one join, however many points there are, and a result is a place; the places of a name that every file has are cut to the
    first ones before they meet.
    """
    named = names_at(files, points)
    asked = named.select("name").distinct()
    lines = scanned(files, most_files, most_bytes).where("state = 'scanned'").select("doc", F.posexplode(split_lines(F.col("text"))).alias("line", "body"))
    pieces = tokens_of(lines).join(asked, F.col("piece") == F.col("name"))
    found = declares_before(pieces).select("name", "doc", "line", "col", "declares")
    if definitions_only:
        found = found.where("declares")
    if not with_definitions:
        found = found.where(~F.col("declares"))
    order = Window.partitionBy("name").orderBy("doc", "line", "col")
    first = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most_results)
    counts = found.groupBy("name").agg(F.count("*").alias("found"))
    return named.select("point_id", "name").join(first.join(counts, "name"), "name").select("point_id", "name", "doc", "line", "col", "declares", "nth", "found")
