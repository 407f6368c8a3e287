"""Line spans of definitions: nesting, and the lines that no span covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


STRETCH = 64


def meeting(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``spans`` twice: as s in the stretch of their first line, as p in all their stretches. A span that holds another is in the stretch of that one's first line."""
    of = lambda line: F.floor(F.col(line) / STRETCH).cast("int")
    every = F.when(F.col("last") >= F.col("first"), F.sequence(of("first"), of("last"))).otherwise(F.array(of("first")))
    return spans.withColumn("stretch", of("first")).alias("s"), spans.withColumn("stretch", F.explode(every)).alias("p")


def parents(spans: DataFrame) -> DataFrame:
    """spans (doc, id, first, last) with ``parent``: the id of the containing span that begins last, the shortest of these; null at the top.

    Of spans with equal lines the smallest id counts as the outer one. Spans meet where they share a stretch of ``STRETCH`` lines, so a file with many of them is split.
    """
    s, p = meeting(spans)
    same = (F.col("p.first") == F.col("s.first")) & (F.col("p.last") == F.col("s.last"))
    holds = (F.col("p.first") <= F.col("s.first")) & (F.col("p.last") >= F.col("s.last")) & (~same | (F.col("p.id") < F.col("s.id")))
    meet = (F.col("s.doc") == F.col("p.doc")) & (F.col("s.stretch") == F.col("p.stretch")) & holds
    own = [F.col(f"s.{c}").alias(c) for c in ("doc", "id", "first", "last")]
    return s.join(p.hint("merge"), meet, "left").groupBy(*own).agg(F.max_by("p.id", F.struct("p.first", -F.col("p.last"), "p.id")).alias("parent"))


def uncovered(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Maximal runs (doc, first, last) of lines 1..n_lines of docs (doc, n_lines) outside all spans (doc, first, last)."""
    ends = docs.select("doc", (F.col("n_lines") + 1).alias("first"), (F.col("n_lines") + 1).alias("last"))
    cut = spans.join(docs.hint("merge"), "doc").where(F.col("first") <= F.col("n_lines")).select("doc", F.greatest("first", F.lit(1)).alias("first"), F.least("last", "n_lines").alias("last"))
    before = Window.partitionBy("doc").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    reach = cut.unionByName(ends).select("doc", (F.coalesce(F.max("last").over(before), F.lit(0)) + 1).alias("from"), (F.col("first") - 1).alias("last"))
    return reach.where(F.col("from") <= F.col("last")).select("doc", F.col("from").alias("first"), "last")
