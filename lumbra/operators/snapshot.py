"""Snapshots: what changed, what is deleted, what is visible through an overlay, what is cached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbra.functions.paths import escapes, resolved

from .tables import written


def partition_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, hash) of ``current`` with ``state`` reused or changed, by path without case and hash."""
    old = previous.select(F.lower("path").alias("_key"), F.col("hash").alias("_old")).dropDuplicates(["_key"])
    got = current.join(old, F.lower(F.col("path")) == F.col("_key"), "left")
    return got.select("path", "hash", F.when(F.col("hash").eqNullSafe(F.col("_old")) & F.col("_key").isNotNull(), "reused").otherwise("changed").alias("state"))


def deleted_paths(base: DataFrame, current: DataFrame) -> DataFrame:
    return base.join(current.select(F.lower("path").alias("_key")), F.lower(base["path"]) == F.col("_key"), "left_anti").select("path").distinct()


def visible(base: DataFrame, overlay: DataFrame, deleted: DataFrame) -> DataFrame:
    """Overlay rows, then base rows that neither the overlay nor a tombstone shadows. Spark picks the join; both sides may be large."""
    shadow = overlay.select(F.lower("path").alias("_key")).union(deleted.select(F.lower("path"))).distinct()
    kept = base.join(shadow, F.lower(base["path"]) == F.col("_key"), "left_anti")
    return overlay.withColumn("layer", F.lit("overlay")).unionByName(kept.withColumn("layer", F.lit("base")))


def cached_vectors(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks with the vector that the cache has for their text's fingerprint, or null."""
    return chunks.withColumn("fingerprint", F.sha2("body", 256)).join(cache, "fingerprint", "left")


def confined(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """asked (.., path) with ``state``: outside (it leaves its root), else the first of its folders and itself that is missing, unavailable or a link; missing too if it is a folder; else ok.

    entries (path, kind) are what the root holds: kind is file, folder, link or unavailable. Each path meets its own folders by equality.
    """
    own = asked.withColumn("_id", F.monotonically_increasing_id()).withColumn("_outside", escapes(F.col("path"))).withColumn("_parts", resolved(F.col("path")))
    own = written(own, "asked")  # the numbers stay
    steps = own.where("not _outside and size(_parts) > 0").select("_id", F.size("_parts").alias("_n"), F.posexplode(F.transform("_parts", lambda x, i: F.array_join(F.slice("_parts", F.lit(1), i + 1), "/"))).alias("_k", "_at"))
    met = steps.join(entries.select(F.col("path").alias("_at"), "kind"), "_at", "left")
    last = F.col("_k") == F.col("_n") - 1
    bad = F.when(F.col("kind").isNull(), "missing").when(F.col("kind").isin("link", "unavailable"), F.col("kind")).when(last & (F.col("kind") != "file"), "missing")
    found = met.withColumn("_bad", bad).groupBy("_id").agg(F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.col("_k"))).alias("_bad"))
    state = F.when(F.col("_outside"), "outside").when(F.size("_parts") == 0, "missing").otherwise(F.coalesce("_bad", F.lit("ok")))
    return own.join(found, "_id", "left").select(*asked.columns, state.alias("state"))
