"""Retention plans as windows over prefix conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumbra.functions.times import micros

from .ranges import ranged, with_sums_before


def quarantine_plan(entries: DataFrame, now: str, grace_days: int, retention_days: int, limit: int, budget: int) -> DataFrame:
    """(directory, reason) of entries (directory, quarantined_at, bytes) to delete, oldest first: by age, then over the number, then over the bytes. Entries inside the grace never pay.

    The bounds are about the order of all entries: it is taken in ranges, with the sums of the ranges before each.
    """
    age = micros(F.lit(now)) - micros("quarantined_at")
    day = 86_400_000_000
    got = entries.withColumn("free", age >= grace_days * day).withColumn("aged", age >= retention_days * day)
    totals = got.agg(F.count("*").alias("n"), F.sum("bytes").alias("all_bytes"), F.count_if(F.col("aged") & F.col("free")).alias("n_aged"), F.sum(F.when(F.col("aged") & F.col("free"), F.col("bytes")).otherwise(0)).alias("aged_bytes"))
    rest = got.where(F.col("free") & ~F.col("aged")).select("directory", "quarantined_at", "bytes", micros("quarantined_at").alias("at"), F.coalesce("directory", F.lit("")).alias("name"))
    rest = with_sums_before(ranged(rest), rows_before=F.count("*"), bytes_before=F.sum("bytes"))
    old = Window.partitionBy("range").orderBy("quarantined_at", "directory")
    rest = rest.crossJoin(F.broadcast(totals))  # one row
    over = F.col("rows_before") + F.row_number().over(old) <= F.col("n") - F.col("n_aged") - limit
    before = F.col("bytes_before") + F.coalesce(F.sum("bytes").over(old.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # those over the number are the oldest
    rest = rest.withColumn("over", over).withColumn("left_bytes", F.col("all_bytes") - F.col("aged_bytes") - before)
    reason = F.when(F.col("over"), "count").when(F.col("left_bytes") > budget, "bytes")
    paid = rest.select("directory", reason.alias("reason")).where("reason is not null")
    return got.where(F.col("aged") & F.col("free")).select("directory", F.lit("age").alias("reason")).unionByName(paid)


def newest(generations: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The ``keep`` newest generations of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc("published_at"), F.desc("id"))
    return generations.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep)


def archive_plan(entries: DataFrame, now: str, grace_days: int, retention_days: int, body_days: int, limit: int, budget: int, most: int = 256) -> DataFrame:
    """(directory, action) of entries (directory, terminal_at, response_bytes): what to ``delete`` and whose response to ``drop``, ``most`` actions in all.

    Entries inside the grace are safe. The oldest are deleted while they are past the retention or more than ``limit`` are kept; of the rest, the
    oldest with a response lose it while it is past ``body_days`` or the kept responses exceed ``budget``. Ties go by directory. Only the
    ``most`` oldest rows of each step meet in one task, everything else is a sum.
    """
    age = micros(F.lit(now)) - micros("terminal_at")
    day = 86_400_000_000
    order = Window.orderBy("terminal_at", "directory")
    got = entries.withColumn("free", age >= grace_days * day)
    totals = got.agg(F.count("*").alias("n"), F.sum("response_bytes").alias("all_bytes"), F.count_if(F.col("free") & (age >= retention_days * day)).alias("expired"))
    oldest = got.where("free").orderBy("terminal_at", "directory").limit(most).withColumn("nth", F.row_number().over(order))
    deleted = oldest.crossJoin(F.broadcast(totals)).where(F.col("nth") <= F.greatest("expired", F.col("n") - limit))  # totals are one row
    gone = deleted.agg(F.count("*").alias("deleted"), F.coalesce(F.sum("response_bytes"), F.lit(0)).alias("gone_bytes"))
    rest = got.where("free and response_bytes is not null").join(F.broadcast(deleted.select("directory")), "directory", "left_anti")
    rest = rest.orderBy("terminal_at", "directory").limit(most).withColumn("nth", F.row_number().over(order))
    before = F.coalesce(F.sum("response_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = F.col("all_bytes") - F.col("gone_bytes") - F.col("before")
    rest = rest.withColumn("before", before).crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(gone))
    dropped = rest.where((F.col("nth") <= most - F.col("deleted")) & ((age >= body_days * day) | (held > budget)))
    return deleted.select("directory", F.lit("delete").alias("action")).unionByName(dropped.select("directory", F.lit("drop").alias("action")))
