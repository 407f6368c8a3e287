"""Which model takes a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frontiers(routes: DataFrame) -> DataFrame:
    """(profile, frontier) from routes (profile, rank, most_context, most_pixels): in the order of rank, the ways that hold what none before them holds.

    The first of them that can take a job is the best of all that can. Of ways that hold the same the best one is found before the shuffle, and the frontier is no longer than a profile has
    different bounds, however many models there are.
    """
    best = routes.groupBy("profile", "most_context", "most_pixels").agg(F.min("rank").alias("rank"))
    ways = F.sort_array(F.collect_list(F.struct("rank", "most_context", "most_pixels")))

    def add(held, x):
        no_less = F.exists(held, lambda h: (h["most_context"] >= x["most_context"]) & (x["most_pixels"].isNull() | F.coalesce(h["most_pixels"] >= x["most_pixels"], F.lit(False))))
        return F.when(no_less, held).otherwise(F.concat(held, F.array(x)))

    return best.groupBy("profile").agg(ways.alias("ways")).select("profile", F.aggregate("ways", F.slice("ways", 1, 0), add).alias("frontier"))


def route(jobs: DataFrame, catalogue: DataFrame, models: DataFrame) -> DataFrame:
    """(job_id, model, stage, problem) from jobs (job_id, profile, context, pixels, override), catalogue (profile, model, place, kind) and models (model, installed, most_context, most_pixels, disabled, resident, lifecycle).

    A job with an override takes that model; if it isn't on the profile's route or can't take the job, the job has the problem ``invalid_override`` and no other model.
    Other jobs go by stages: 1 an active experiment, 2 candidates, resident ones first, 3 fallbacks; then by the catalogue's order. Models that aren't
    installed, are disabled (by themselves or their lifecycle), hold too little context or too few pixels (null: no images) are passed over; a job that none can take has the problem ``unavailable``.
    """
    able = models.where(F.col("installed") & ~F.col("disabled") & (F.col("lifecycle") != "disabled") & F.col("most_context").isNotNull())
    routes = catalogue.join(able, "model").select("profile", "model", "place", "kind", "most_context", "most_pixels", "resident")
    later = (F.col("stage") != 2) | ~F.col("resident")
    holds = (F.col("context") <= F.col("most_context")) & (F.col("pixels").isNull() | (F.col("pixels") <= F.col("most_pixels")))
    staged = routes.withColumn("stage", F.when(F.col("kind") == "experiment", 1).when(F.col("kind") == "candidate", 2).otherwise(3))
    rank = F.struct("stage", later.alias("later"), "place", "model")
    free = jobs.where("override is null").join(F.broadcast(frontiers(staged.withColumn("rank", rank))), "profile", "left")
    first = F.get(F.filter("frontier", lambda x: (F.col("context") <= x["most_context"]) & (F.col("pixels").isNull() | (F.col("pixels") <= x["most_pixels"]))), F.lit(0))["rank"]
    free = free.select("job_id", first.alias("best")).select("job_id", "best.model", "best.stage", F.when(F.col("best").isNull(), "unavailable").alias("problem"))
    # An override meets the rows of its own profile and model alone.
    fixed = jobs.where("override is not null")
    asked = fixed.withColumnRenamed("override", "model").join(routes, ["profile", "model"]).where(holds).select("job_id", "model").distinct()
    fixed = fixed.select("job_id").join(asked, "job_id", "left").select("job_id", "model", F.when(F.col("model").isNotNull(), 0).alias("stage"), F.when(F.col("model").isNull(), "invalid_override").alias("problem"))
    return free.unionByName(fixed)
