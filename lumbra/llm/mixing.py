"""Mixing sources to target weights: a time-varying curriculum, in DataFrame functions only.

Sources are numbered by code point (null last) and take the weights of ``WEIGHTS`` in turn. The mix has ``SHARE`` times all words. A
source's target is its share by weight, at most ``REPEAT`` times its own words; what is above goes to the other sources by weight
(water-filling, in closed form over the sources sorted by the ratio of their limit to their weight).

Each source's weight changes over the training time t from 0 to 1: its schedule is a straight line from ``a`` to ``2 - a`` (times
the weight), whose integral over [0, t] is ``a t + (1 - a) t^2`` and 1 at the end, so schedules move documents in time and leave totals
alone. The cumulative demand of a source at t is its target times that integral. A document stands at its place in the source's order
(by md5 of its id); pass k of the source is the same order again. A copy is taken if its middle lies below the target, and its
training position is the t at which the cumulative demand reaches its middle: the inverse of the integral. Copies are
range-sorted by position.

Places are prefix sums in two steps: sums over ranges of the order within each source, as many as leave a range about ``RANGE_ROWS`` rows,
then running sums inside a range, so no source is sorted or summed in one task.

Defined results: null texts have size 0; documents of size 0 are never taken; a null source is a source of its own; rows with a null
id stand in the order of a hash of their text; rows with the same id in that of size and text; repeated rows count as often as they come; an empty
table gives an empty table; the text is only read for its size and that hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEAT = 2
STARTS = (1.5, 1.0, 0.5)  # the schedules' first value, in turn like the weights
RANGE_ROWS = 100_000
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _in_turn(values: tuple, n: Column) -> Column:
    pick = F.lit(values[-1])
    for k, v in enumerate(values[:-1]):
        pick = F.when(n % len(values) == k, F.lit(v)).otherwise(pick)
    return pick


def targets(sizes: DataFrame) -> DataFrame:
    """From (source, size): number, weight, words and target of each source. One row per source passes through one window."""
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "number")
    got = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    got = got.withColumn("number", F.row_number().over(by_name) - 1).withColumn("weight", _in_turn(WEIGHTS, F.col("number")).cast("double"))
    got = got.withColumn("limit", (F.col("source_size") * REPEAT).cast("double")).withColumn("ratio", F.col("limit") / F.col("weight"))
    got = got.withColumn("full", F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1))).withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * SHARE - F.coalesce("full", F.lit(0.0))) / F.col("rest")
    got = got.withColumn("level", F.max(F.when(level <= F.col("ratio"), level)).over(everything))
    return got.select("source", "number", "weight", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def place(documents: DataFrame, id_column: str = "doc_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """Each row's source, size, target, place in its source, copies, taken words and first training position."""
    digits, rows = 3, documents.count()
    while 16**digits * RANGE_ROWS < rows:  # of the md5: 16 ** digits ranges in each source
        digits += 1
    sized = documents.select(*carried, F.col(id_column).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"))
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.col("_text").cast("string")))
    got = sized.withColumn("_h", F.md5(named.cast("binary"))).withColumn("_range", F.substring("_h", 1, digits)).withColumn("_of", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sums = got.groupBy("source", "_of", "_range").agg(F.sum("size").alias("_words"))
    source = targets(sums.select("source", F.col("_words").alias("size")))
    # Prefix sums over the ranges of a source: for each source one row to about RANGE_ROWS of the input, 4,096 at least.
    before = Window.partitionBy("_of").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_of", "_range", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_base"))
    own = source.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_of"), "number", "source_size", "target")
    # Rows move once: the running sums and the join with the ranges use the same exchange.
    inside = Window.partitionBy("_of", "_range").orderBy("_h", "doc_id", "size", "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = got.withColumn("_sum", F.sum("size").over(inside)).join(base.join(own, "_of"), ["_of", "_range"])
    got = got.withColumn("place", F.col("_base") + F.col("_sum") - F.col("size"))
    middle = F.col("place") + F.col("size") / 2
    copies = F.when(F.col("size") == 0, 0)
    for k in range(REPEAT, 0, -1):
        copies = copies.when(middle + F.col("source_size") * (k - 1) < F.col("target"), k)
    got = got.withColumn("copies", copies.otherwise(0))
    return got.select(
        *carried, "doc_id", "source", "size", "source_size", "target", "place", "number", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        F.when(F.col("copies") > 0, position(middle)).alias("position"),
    )


def position(demand: Column) -> Column:
    """The t at which a source's cumulative demand, target * (a t + (1 - a) t^2), reaches ``demand``."""
    a = _in_turn(STARTS, F.col("number"))
    part = F.least(demand / F.col("target"), F.lit(1.0))
    root = F.sqrt(F.greatest(a * a + 4 * (1 - a) * part, F.lit(0.0)))
    return F.when(a == 1, part).otherwise(2 * part / (a + root))  # the stable form of the quadratic's root


def mix(documents: DataFrame) -> DataFrame:
    """The rows of the mix, copies included, with the columns of ``documents``, range-sorted by training position (ties by id, size and text).

    Whole rows are shuffled to their places, and copies to their positions.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_all")
    got = place(documents.select(whole, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").alias("text")), "doc_id", ("_all",))
    again = got.where("copies > 0").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = position(F.col("place") + F.col("size") / 2 + F.col("source_size") * F.col("_k"))
    order = ("_at", "doc_id", "size", "_t")
    return again.select("_all", "doc_id", "size", F.xxhash64("_all.text").alias("_t"), at.alias("_at")).repartitionByRange(*order).sortWithinPartitions(*order).select("_all.*")
