"""Orders over whole tables without one task for all rows: ranges of the order, with the sums of the ranges before each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbra.functions.times import micros

RANGES, SAMPLE, STEP = 256, 8192, 16  # of an order, the keys that choose their bounds, and the bounds that are counted at once
_SHIFT = 4_000_000_000_000_000_000


def bounds(keys: DataFrame) -> list[tuple[int, str]]:
    """Where the ranges of keys (at, name) after the first begin, so that they have about as many rows each; chosen from a fixed choice by hash."""
    chosen = sorted((r["at"], r["name"].encode()) for r in keys.orderBy(F.xxhash64("at", "name"), "at", "name").limit(SAMPLE).collect())
    return [(at, name.decode()) for at, name in sorted(set(chosen[:: max(1, len(chosen) // RANGES)][1:]))]


def ranged(rows: DataFrame) -> DataFrame:
    """rows (at, name, ..) with ``range``, which rises with (at, name): the bounds up to a row, counted in two steps of ``STEP`` bounds and fewer."""
    cuts = [F.struct(F.lit(at).cast("long").alias("at"), F.lit(name).alias("name")) for at, name in bounds(rows.select("at", "name"))]
    if not cuts:
        return rows.withColumn("range", F.lit(0))
    key = F.struct(F.col("at").cast("long").alias("at"), "name")
    upto = lambda some: F.size(F.filter(some, lambda b: b <= key))
    coarse = F.array(*cuts[STEP - 1 :: STEP]) if len(cuts) >= STEP else None
    steps = F.lit(0) if coarse is None else upto(coarse)
    return rows.withColumn("_steps", steps).withColumn("range", F.col("_steps") * STEP + upto(F.slice(F.array(*cuts), F.col("_steps") * STEP + 1, F.lit(STEP)))).drop("_steps")


def with_sums_before(rows: DataFrame, **sums: Column) -> DataFrame:
    """``rows`` of ``ranged`` with each aggregate's sum over all ranges before the row's own: RANGES rows and a few meet in one window, whatever the input."""
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.groupBy("range").agg(*[v.alias(n) for n, v in sums.items()])
    return rows.join(F.broadcast(own.select("range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])), "range")


def sortable(*columns: Column) -> Column:
    """One string that sorts like the (whole) numbers."""
    return F.concat(*[F.lpad((c.cast("long") + F.lit(_SHIFT)).cast("string"), 19, "0") for c in columns])


def bucketed(rows: DataFrame, time: str, seconds: int) -> DataFrame:
    """``rows`` with ``bucket``, the stretch of ``seconds`` that holds ``time``: a key's history is cut into pieces of its own."""
    return rows.withColumn("bucket", F.floor(micros(time) / (seconds * 1_000_000)))
