"""Trials of models: their state from a log of attempts and owner actions, reports, benchmark results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import nearest_ranks

BATCH = 10  # attempts after which a trial pauses
OTHERS = {"structural_failures": "structural_failure", "context_failures": "context_failure", "cpu_offloads": "cpu_offload"}  # outcomes that are counted and end a run of technical failures
CONSECUTIVE = 2  # technical failures in a row that open the circuit


def trial_states(log: DataFrame) -> DataFrame:
    """The state of each (profile, model) after its log (profile, model, sequence, workflow, outcome, action).

    A row is an attempt (its workflow counts once in a round, by its first row) or an owner's action: promote, continue, fallback or disable.
    ``continue`` begins a new round with all counts at zero. The circuit is open while the last attempts are technical failures, ``promote`` closes
    it; a round of ``BATCH`` attempts pauses. Actions are joined as sums before each row, so a hot pair is one window by sequence.
    """
    pair = ["profile", "model"]
    order = Window.partitionBy(*pair).orderBy("sequence")
    rounds = log.withColumn("round", F.sum(F.when(F.col("action") == "continue", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = rounds.groupBy(*pair).agg(F.max("round").alias("round"))
    now = rounds.join(last, [*pair, "round"])
    tries = now.where("action is null").groupBy(*pair, "workflow").agg(F.min_by(F.struct("sequence", "outcome"), "sequence").alias("t")).select(*pair, "t.*")
    bad = F.col("outcome") == "technical_failure"
    acts = now.where("action is not null").groupBy(*pair).agg(F.max_by("action", "sequence").alias("action"), F.max(F.when(F.col("action") == "promote", F.col("sequence"))).alias("promoted_at"), F.max("sequence").alias("acted_at"))
    tries = tries.join(acts.select(*pair, "promoted_at"), pair, "left")
    good_at = F.max(F.when(~bad, F.col("sequence")))
    counts = tries.groupBy(*pair).agg(
        F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "succeeded").alias("successes"), F.count_if(bad).alias("technical_failures"), *[F.count_if(F.col("outcome") == o).alias(c) for c, o in OTHERS.items()],
        F.greatest(good_at, F.max("promoted_at")).alias("calm_at"), F.max("sequence").alias("tried_at"),
    )
    run = tries.join(counts.select(*pair, "calm_at"), pair).where(bad & (F.col("calm_at").isNull() | (F.col("sequence") > F.col("calm_at")))).groupBy(*pair).agg(F.count("*").alias("consecutive"))
    got = last.select(*pair).join(counts, pair, "left").join(run, pair, "left").join(acts, pair, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    after = F.col("tried_at").isNotNull() & (F.col("acted_at").isNull() | (F.col("tried_at") > F.col("acted_at")))
    full = F.coalesce(F.col("attempts"), F.lit(0)) >= BATCH
    stopped = F.coalesce(F.col("action").isin("fallback", "disable"), F.lit(False))
    opened = F.coalesce(F.col("consecutive"), F.lit(0)) >= CONSECUTIVE
    return got.select(
        *pair, n("attempts"), n("successes"), n("technical_failures"), *map(n, OTHERS), n("consecutive"),
        F.when(after, full).otherwise(stopped).alias("paused"), F.when(after, opened).otherwise(F.coalesce(F.col("action") == "disable", F.lit(False))).alias("open"),
        F.coalesce(F.col("promoted_at").isNotNull() & ~stopped, F.lit(False)).alias("promoted"),
    )


def trial_report(states: DataFrame, workflows: DataFrame, records: DataFrame) -> DataFrame:
    """States (profile, model, attempts, successes, errors) with what the surviving records of their workflows (profile, model, workflow) measured.

    records: profile, model, workflow, total_us, cold, used_fallback, saved. Percentiles are of the nearest rank.
    """
    pair = ["profile", "model"]
    own = records.join(workflows, [*pair, "workflow"], "left_semi")
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY total_us)").cast("long")
    got = own.groupBy(*pair).agg(
        F.count("*").alias("observed"), F.count_if("used_fallback").alias("fallbacks"), F.avg("total_us").alias("mean_us"), disc(0.5).alias("median_us"), disc(0.9).alias("p90_us"),
        F.count_if("cold").alias("cold"), F.sum("saved").alias("saved"),
    )
    return states.join(got, pair, "left").select(*states.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("observed", "fallbacks", "mean_us", "median_us", "p90_us", "cold", "saved")])


def benchmark(cases: DataFrame, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(case_id, passed, expected, actual, missing) of cases (case_id, allow_additional): passed if nothing expected is missing and, unless more is allowed, as much was found. expected and actual: case_id, place."""
    want, have = expected.distinct(), actual.distinct()
    missing = want.join(have, ["case_id", "place"], "left_anti").groupBy("case_id").agg(F.count("*").alias("missing"))
    sizes = [d.groupBy("case_id").agg(F.count("*").alias(n)) for d, n in ((want, "expected"), (have, "actual"))]
    got = cases.join(sizes[0], "case_id", "left").join(sizes[1], "case_id", "left").join(missing, "case_id", "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("expected", "actual", "missing")}
    passed = (n["missing"] == 0) & (F.col("allow_additional") | (n["actual"] == n["expected"]))
    return got.select("case_id", passed.alias("passed"), *[v.alias(c) for c, v in n.items()])


def benchmark_summary(results: DataFrame, latencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``benchmark`` results and latencies (case_id, us): one row (passed, total, correctness), and for each case its nearest-rank median and 95th percentile and its longest latency."""
    whole = results.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total")).withColumn("correctness", F.when(F.col("total") > 0, F.col("passed") / F.col("total")))
    ranks = nearest_ranks(latencies, "case_id", "us", {"p50_us": (1, 2), "p95_us": (19, 20)})
    return whole, ranks.join(latencies.groupBy("case_id").agg(F.max("us").alias("longest_us")), "case_id")
