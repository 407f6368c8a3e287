"""Exact nearest-rank percentiles of keys of any size: histograms that are refined around the wanted rank, never a key's values in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

BINS = 1024


def nearest_ranks(rows: DataFrame, key: str, value: str, shares: dict[str, tuple[int, int]]) -> DataFrame:
    """(key, a column for each share): the value at place ceil(n a / b) of a key's n values (whole numbers, nulls left out), for shares name: (a, b).

    Each round counts the values of a key in at most ``BINS`` bins, by a sum before the shuffle, and keeps the bin with the wanted place; its width falls by ``BINS`` until it is one value. So the
    rounds follow the values' range (three up to 2^30), the rows of each are counts, and a hot key is as many rows as any other.
    """
    own = rows.select(F.col(key).alias("_key"), F.col(value).cast("long").alias("_value")).where("_value is not null")
    ends = own.groupBy("_key").agg(F.min("_value").alias("low"), F.max("_value").alias("high"), F.count("*").alias("n"))
    wanted = F.array(*[F.struct(F.lit(name).alias("share"), F.floor((F.col("n") * a + (b - 1)) / b).cast("long").alias("place")) for name, (a, b) in shares.items()])
    aims = written(ends.select("_key", "low", (F.col("high") - F.col("low") + 1).alias("width"), F.explode(wanted).alias("w")).select("_key", "low", "width", "w.*"), "aims")
    while aims.where("width > 1").limit(1).count():
        step = F.greatest(F.lit(1), F.ceil(F.col("width") / BINS)).cast("long")
        a, o = aims.withColumn("step", step).alias("a"), own.alias("o")
        met = o.join(a, F.col("o._key").eqNullSafe(F.col("a._key")) & (F.col("_value") >= F.col("low")) & (F.col("_value") < F.col("low") + F.col("width")))
        counts = met.groupBy(F.col("a._key").alias("_key"), "share", "low", "step", "place", F.floor((F.col("_value") - F.col("low")) / F.col("step")).alias("bin")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("_key", "share").orderBy("bin"))
        found = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place")))
        aims = written(found.select("_key", (F.col("low") + F.col("bin") * F.col("step")).alias("low"), F.col("step").alias("width"), "share", (F.col("place") - (F.col("upto") - F.col("n"))).alias("place")), "aims")
    return aims.groupBy(F.col("_key").alias(key)).agg(*[F.max(F.when(F.col("share") == name, F.col("low"))).alias(name) for name in shares])
