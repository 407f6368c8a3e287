"""Summaries of job telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumbra.functions.times import micros

from .quantiles import nearest_ranks
from .ranges import bucketed

SAMPLES = 101
#: Median and 90th percentile of a kind of job without samples, in seconds.
DEFAULTS = {"short": (5, 10), "medium": (15, 30), "long": (60, 120)}
BUCKET_SECONDS = 86_400  # of a piece of a key's history


def summary(jobs: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("outcome") == "succeeded")
    return jobs.agg(F.count("*").alias("jobs"), F.min("recorded_at").alias("first_at"), F.max("recorded_at").alias("last_at"), ok.alias("succeeded"), F.count_if("was_cold").alias("cold"), F.count_if("used_fallback").alias("fallbacks"), F.sum("net_tokens").alias("net_tokens"))


def breakdown(jobs: DataFrame, key: str) -> DataFrame:
    """Jobs, successes, cold starts, fallbacks, nearest-rank median and 90th percentile of the execution, longest execution and tokens for each key."""
    sums = jobs.groupBy(key).agg(
        F.count("*").alias("jobs"), F.count_if(F.col("outcome") == "succeeded").alias("succeeded"), F.count_if("was_cold").alias("cold"), F.count_if("used_fallback").alias("fallbacks"),
        F.max("execution_us").alias("longest_us"), F.sum("net_tokens").alias("net_tokens"),
    )
    ranks = nearest_ranks(jobs, key, "execution_us", {"median_us": (1, 2), "p90_us": (9, 10)}).withColumnRenamed(key, "_key")
    return sums.join(ranks, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").select(key, "jobs", "succeeded", "cold", "fallbacks", "median_us", "p90_us", "longest_us", "net_tokens")


def outliers(jobs: DataFrame, least: int = 10) -> DataFrame:
    """Models with at least ``least`` jobs that fail in a quarter of their jobs and account for half of all failures."""
    by = jobs.groupBy("model").agg(F.count("*").alias("jobs"), F.count_if(F.col("outcome") != "succeeded").alias("failures"))
    by = by.withColumn("every", F.sum("failures").over(Window.partitionBy()))  # one row per model
    return by.where((F.col("jobs") >= least) & (F.col("failures") > 0) & (F.col("failures") * 4 >= F.col("jobs")) & (F.col("failures") * 2 >= F.col("every"))).select("model", "jobs", "failures")


def predicted(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Median (mean of the middle two) and nearest-rank 90th percentile of each key's last 101 executions."""
    last = Window.partitionBy(*keys).orderBy(F.desc("recorded_at"), F.desc("job_id"))
    recent = jobs.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= SAMPLES)
    return recent.groupBy(*keys).agg(F.count("*").alias("samples"), F.expr("percentile(execution_us, 0.5)").alias("median_us"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY execution_us)").cast("long").alias("p90_us"))


def with_defaults(requests: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """requests (keys, .., duration_class) with median_us and p90_us of their keys' ``predicted``, or the defaults of their class."""
    pick = lambda k: F.when(F.col("duration_class") == "short", DEFAULTS["short"][k]).when(F.col("duration_class") == "medium", DEFAULTS["medium"][k]).otherwise(DEFAULTS["long"][k]) * 1_000_000
    got = requests.join(predictions.drop("samples"), keys, "left")
    return got.withColumn("median_us", F.coalesce("median_us", pick(0).cast("double"))).withColumn("p90_us", F.coalesce("p90_us", pick(1).cast("long")))


def circuit_opens(jobs: DataFrame, key: str, consecutive: int = 2, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """For each key the first job that is the n-th technical failure in a row.

    A key's history is cut by time. A piece hands on the failures at its end, or all it has and what it was handed if it holds nothing else; only these edges
    pass through one window per key.
    """
    own = bucketed(jobs, "recorded_at", seconds).withColumn("_bad", F.col("outcome").eqNullSafe("technical_failure"))
    order = Window.partitionBy(key, "bucket").orderBy("recorded_at", "job_id")
    own = own.withColumn("_run", F.sum(F.when(~F.col("_bad"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = own.groupBy(key, "bucket", "_run").agg(F.count_if("_bad").alias("_n"))
    edges = runs.groupBy(key, "bucket").agg(F.max_by("_n", "_run").alias("_end"), F.max("_run").alias("_good"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # The failures handed on: the end of the last piece with a success, and all pieces after it.
    whole = F.sum(F.when(F.col("_good") == 0, F.col("_end")).otherwise(0)).over(Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    edges = edges.withColumn("_whole", whole)
    last = F.last(F.when(F.col("_good") > 0, F.col("_end") - F.col("_whole")), ignorenulls=True).over(before)
    edges = edges.withColumn("_carried", F.coalesce(F.last("_whole").over(before), F.lit(0)) + F.coalesce(last, F.lit(0))).select(key, "bucket", "_carried")
    nth = F.row_number().over(Window.partitionBy(key, "bucket", "_run").orderBy("recorded_at", "job_id")) + F.when(F.col("_run") == 0, F.col("_carried")).otherwise(0)
    hits = own.where("_bad").join(edges, [key, "bucket"]).withColumn("_nth", nth).where(F.col("_nth") == consecutive)
    return hits.groupBy(key).agg(F.min(F.struct("recorded_at", "job_id")).alias("_f")).select(key, F.col("_f.job_id").alias("job_id"))


def silences(beats: DataFrame, key: str, seconds: int, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Gaps of more than ``seconds`` between one beat of a key and the next. A key's history is cut by time; the last beat of a piece looks for the first of the next one."""
    own = bucketed(beats, "recorded_at", bucket_seconds)
    first = own.groupBy(key, "bucket").agg(F.min("recorded_at").alias("_first"))
    first = first.select(key, "bucket", F.lead("_first").over(Window.partitionBy(key).orderBy("bucket")).alias("_later"))
    following = F.lead("recorded_at").over(Window.partitionBy(key, "bucket").orderBy("recorded_at", "job_id"))
    got = own.withColumn("_next", following).join(first, [key, "bucket"]).withColumn("_next", F.coalesce("_next", "_later"))
    gap = micros("_next") - micros("recorded_at")
    return got.where(gap > seconds * 1_000_000).select(key, "job_id", gap.alias("gap_us"))
