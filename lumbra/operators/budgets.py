"""Budgets over an order: how far a scan goes until its files, bytes or results are used up, and what it leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import ranged, with_sums_before

#: Bounds of one request's texts and images.
MOST_FILES, MOST_CHARS, BREAK = 64, 720_000, 2
IMAGES, IMAGE_BYTES, ALL_IMAGE_BYTES, ALL_PIXELS = 8, 30 << 20, 60 << 20, 80_000_000


def within(rows: DataFrame, budgets: dict[str, tuple[Column, int]]) -> DataFrame:
    """rows (at, name, ..) with ``taken``: false from the first row, by (at, name), with which the running sum of any of ``budgets`` (size, most) passes its bound.

    Sizes are not negative. The order is cut into ranges, whose sums are taken first; rows with the same (at, name) are taken or left together.
    """
    sized = rows.withColumns({f"_{k}": F.coalesce(size.cast("long"), F.lit(0)) for k, (size, _) in budgets.items()})
    placed = with_sums_before(ranged(sized), **{f"_{k}_before": F.sum(f"_{k}") for k in budgets})
    upto = Window.partitionBy("range").orderBy("at", "name").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = F.lit(True)
    for k, (_, most) in budgets.items():
        taken = taken & (F.col(f"_{k}_before") + F.sum(f"_{k}").over(upto) <= most)
    return placed.withColumn("taken", taken).drop("range", *[f"_{k}" for k in budgets], *[f"_{k}_before" for k in budgets])


def left_out(rows: DataFrame, sizes: dict[str, Column]) -> DataFrame:
    """One row for ``within``: rows taken and omitted, and the sums of ``sizes`` taken and omitted."""
    n = [F.count_if("taken").alias("taken"), F.count_if(~F.col("taken")).alias("omitted")]
    for k, size in sizes.items():
        for name, when in (("taken", F.col("taken")), ("omitted", ~F.col("taken"))):
            n.append(F.coalesce(F.sum(F.when(when, size)), F.lit(0)).cast("long").alias(f"{k}_{name}"))
    return rows.agg(*n)


def bundles(files: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """(bundle, nth, shown, omitted, truncated) of files (bundle, nth, header, chars), in order under one budget of characters.

    A file whose header (and a line end) doesn't fit is omitted and costs nothing; else its text is read as far as the budget goes, and a text that is cut uses it up. Each shown file
    costs ``BREAK`` characters more after its header and after its text. Bundles of more than ``MOST_FILES`` files are refused and left out.
    """
    kind = "struct<left:bigint,out:array<struct<nth:bigint,shown:bigint,omitted:boolean,truncated:boolean>>>"
    own = files.select("bundle", F.struct(F.col("nth").cast("long").alias("nth"), F.col("header").cast("long").alias("header"), F.coalesce("chars", F.lit(0)).cast("long").alias("chars")).alias("f"))
    lists = own.groupBy("bundle").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("f")).alias("files")).where(F.col("n") <= MOST_FILES)

    def step(state: Column, f: Column) -> Column:
        skip = state["left"] <= f["header"] + BREAK
        room = state["left"] - f["header"] - BREAK
        cut = ~skip & (f["chars"] > room)
        left = F.when(skip, state["left"]).when(cut, 0).otherwise(F.greatest(F.lit(0), room - f["chars"] - BREAK))
        told = F.struct(f["nth"].alias("nth"), F.when(skip, 0).otherwise(F.least(f["chars"], room)).alias("shown"), skip.alias("omitted"), cut.alias("truncated"))
        return F.struct(left.cast("long").alias("left"), F.concat(state["out"], F.array(told)).alias("out")).cast(kind)

    start = F.struct(F.lit(most).cast("long").alias("left"), F.array().alias("out")).cast(kind)
    got = lists.select("bundle", F.explode(F.aggregate("files", start, step)["out"]).alias("o"))
    return got.select("bundle", "o.*")


def image_problems(images: DataFrame) -> DataFrame:
    """(request, problem) of images (request, bytes, pixels): the first bound that a request breaks, or null: too many, one too large, all together too large, or too many pixels."""
    got = images.groupBy("request").agg(F.count("*").alias("n"), F.max("bytes").alias("top"), F.sum("bytes").alias("bytes"), F.sum("pixels").alias("pixels"))
    problem = F.when(F.col("n") > IMAGES, "too_many_images").when(F.col("top") > IMAGE_BYTES, "image_too_large").when(F.col("bytes") > ALL_IMAGE_BYTES, "images_too_large").when(F.col("pixels") > ALL_PIXELS, "too_many_pixels")
    return got.select("request", problem.alias("problem"))
