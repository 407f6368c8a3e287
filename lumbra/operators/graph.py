"""Symbol graph: definitions, references and implementations over occurrence and relationship tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .covering import best_covering

DEFINITION, REFERENCE = 1, 2


def _has(role: int):
    return F.col("roles").bitwiseAND(role) != 0


def at_position(occurrences: DataFrame, points: DataFrame) -> DataFrame:
    """For each point (point_id, doc, line): the narrowest occurrence of its document whose lines hold it."""
    zero = F.lit(0)
    ranges = occurrences.select("doc", F.col("start_line").alias("sl"), zero.alias("sc"), F.col("end_line").alias("el"), zero.alias("ec"), "symbol", F.struct(*occurrences.columns).alias("_o"))
    best = best_covering(ranges, points.select("point_id", "doc", "line", zero.alias("col")), [F.col("el") - F.col("sl"), F.col("sl")], F.col("_o"), "symbol")
    rest = [c for c in points.columns if c != "doc"]
    return best.join(points.select(*rest), "point_id").select(*[F.col(f"best.{c}").alias(c) for c in occurrences.columns], *rest)


def definitions(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    return occurrences.where(_has(DEFINITION)).join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def references(occurrences: DataFrame, symbols: DataFrame, with_definitions: bool) -> DataFrame:
    """References of the symbols; with definitions, an occurrence of both roles comes twice."""
    own = occurrences.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    got = own.where(_has(REFERENCE))
    return got.unionByName(own.where(_has(DEFINITION))) if with_definitions else got


def implementations(occurrences: DataFrame, relationships: DataFrame, symbols: DataFrame) -> DataFrame:
    """Definitions of the symbols that a relationship leads to the given ones, once each."""
    sources = relationships.join(symbols.select(F.col("symbol").alias("target")).distinct(), "target", "left_semi").select(F.col("source").alias("symbol")).distinct()
    return definitions(occurrences, sources).distinct()
