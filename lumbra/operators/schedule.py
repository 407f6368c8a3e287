"""Scheduling decisions on a snapshot of the queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumbra.functions.times import micros

from .ranges import ranged, sortable, with_sums_before


def schedule(candidates: DataFrame, now: str, resident: str | None, starved_minutes: int = 15) -> DataFrame:
    """The order in which the chosen model's ready jobs run.

    Maintenance waits while inference is queued. The model is the longest starved job's; without one it is the resident model's if
    it has a job, else that of the shortest predicted job; ties by age, priority and sequence.
    """
    inference = candidates.where(~F.col("maintenance")).limit(1).select(F.lit(True).alias("busy"))
    ready = candidates.where("dependency_ready").join(F.broadcast(inference), how="left").where(~(F.col("maintenance") & F.coalesce("busy", F.lit(False)))).drop("busy")
    age = micros(F.lit(now)) - micros("created_at")
    starved = ready.where(age >= starved_minutes * 60_000_000).orderBy("created_at", "priority", "sequence").limit(1).select("model", F.lit(0).alias("stage"))
    groups = ready.groupBy("model").agg(F.min("predicted_us").alias("p"), F.min("created_at").alias("c"), F.min("priority").alias("r"), F.min("sequence").alias("s"))
    groups = groups.orderBy(F.desc(F.col("model").eqNullSafe(F.lit(resident))), "p", "c", "r", "s").limit(1).select("model", F.lit(1).alias("stage"))
    chosen = starved.unionByName(groups).orderBy("stage").limit(1).select("model")
    own = ready.join(F.broadcast(chosen), "model", "left_semi").withColumn("at", F.col("predicted_us").cast("long")).withColumn("name", sortable(micros("created_at"), F.col("priority"), F.col("sequence")))
    own = with_sums_before(ranged(own), before=F.count("*"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("at", "name"))
    return own.select("job_id", "model", place.cast("int").alias("place"))


def first_enqueued(requests: DataFrame, key: str) -> DataFrame:
    """Each request with the job that it joins: the queued or running one with its key that came first, else itself."""
    live = requests.where(F.col("state").isin("queued", "running")).groupBy(key).agg(F.min("sequence").alias("_first"))
    got = requests.join(live, key, "left")
    joins = F.col("state").isin("queued", "running")
    return got.select("sequence", key, F.when(joins, F.col("_first")).otherwise(F.col("sequence")).alias("job_sequence"))
