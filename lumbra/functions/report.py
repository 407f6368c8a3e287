"""Numbers of reports as Column expressions: buckets, ranges, durations, receipts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import token_estimate

PIXELS_PER_TOKEN = 750


def _bucket(n: Column, names: tuple[str, ...], limits: tuple[int, ...]) -> Column:
    out = F.when(n <= limits[0], names[0])
    for name, limit in zip(names[1:], limits[1:], strict=False):
        out = out.when(n <= limit, name)
    return out.otherwise(names[-1])


def size_bucket(characters: Column) -> Column:
    return _bucket(characters, ("empty", "small", "medium", "large"), (0, 4_000, 16_000))


def count_bucket(n: Column) -> Column:
    return _bucket(n, ("none", "one", "few", "many"), (0, 1, 4))


def pixel_bucket(pixels: Column) -> Column:
    return _bucket(pixels, ("none", "small", "medium", "large"), (0, 1_048_576, 4_194_304))


def image_tokens(width: Column, height: Column) -> Column:
    return F.ceil(width.cast("double") * height / PIXELS_PER_TOKEN).cast("long")


def saved_tokens(would: Column, answer: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), would - token_estimate(answer))


def translation_tokens(source: Column, translated: Column) -> Column:
    """struct(input, output, local, generation_saved, net_saved)."""
    a, b = token_estimate(source), token_estimate(translated)
    return F.struct(a.alias("input"), b.alias("output"), (a + b).alias("local"), b.alias("generation_saved"), F.greatest(F.lit(0).cast("long"), a - b).alias("net_saved"))


def _rounded(thousands: Column) -> Column:
    return F.when(thousands >= 10, F.bround(thousands, 0).cast("long").cast("string")).otherwise(F.regexp_replace(F.bround(thousands, 1).cast("string"), r"\.0$", ""))


def described_range(saved: Column) -> Column:
    """A coarse band around a number of tokens: 15 per cent up to 100,000, 20 above; in thousands or millions."""
    band = F.when(saved < 100_000, F.lit(0.15)).otherwise(F.lit(0.2))
    low, high = saved * (1 - band), saved * (1 + band)
    text = lambda unit, by: F.concat(F.lit("~"), _rounded(low / by), F.lit("–"), _rounded(high / by), F.lit(unit))
    return F.when(saved <= 0, "0").when(high >= 1_000_000, text("M", 1e6)).otherwise(text("K", 1e3))


def duration(us: Column) -> Column:
    """Microseconds as whole milliseconds, seconds with one place, or minutes and seconds."""
    tenths = F.floor((us + 50_000) / 100_000)
    seconds = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s"))
    whole = F.floor(us / 1_000_000)
    minutes = F.concat(F.floor(whole / 60).cast("string"), F.lit("m"), F.lpad((whole % 60).cast("string"), 2, "0"), F.lit("s"))
    return F.when(us < 1_000_000, F.concat(F.floor((us + 500) / 1000).cast("string"), F.lit("ms"))).when(us < 60_000_000, seconds).otherwise(minutes)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, "0%").otherwise(F.concat(F.floor((200 * part + whole) / (2 * whole)).cast("string"), F.lit("%")))


def receipt_tokens(characters: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.floor((characters + 3) / 4)


def no_less_than_zero(us: Column) -> Column:
    return F.greatest(us, F.lit(0).cast("long"))
