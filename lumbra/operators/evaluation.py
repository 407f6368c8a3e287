"""Retrieval quality: hits of evaluation cases against their relevant targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbra.functions.text import slashes


def evaluate(cases: DataFrame, hits: DataFrame, targets: DataFrame) -> DataFrame:
    """One row of macro averages from cases (case_id, no_answer), hits (case_id, rank, path, symbol) and targets (case_id, path, symbol).

    A hit meets a target of the same path, without case, whose symbol is equal or blank. Precision counts met targets in the first 5
    hits, recall in the first 10; the first relevant rank is 11 if there is none. A class of cases that is empty gives null.
    """
    key = lambda c: F.lower(slashes(F.col(c)))
    wanted = targets.select("case_id", key("path").alias("place"), F.coalesce("symbol", F.lit("")).alias("wanted")).distinct()
    found = hits.where("rank <= 10").select("case_id", "rank", key("path").alias("place"), "symbol")
    met = found.join(wanted, ["case_id", "place"]).where((F.col("wanted") == "") | (F.col("wanted") == F.col("symbol")))
    met = met.groupBy("case_id", "place", "wanted").agg(F.min("rank").alias("rank")).groupBy("case_id").agg(
        F.count_if(F.col("rank") <= 5).alias("top5"), F.count("*").alias("top10"), F.min("rank").alias("first")
    )
    sizes = wanted.groupBy("case_id").agg(F.count("*").alias("targets"))
    shown = hits.groupBy("case_id").agg(F.count("*").alias("hits"))
    every = cases.join(sizes, "case_id", "left").join(met, "case_id", "left").join(shown, "case_id", "left")
    answered = lambda c: F.when(~F.col("no_answer"), c)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return every.agg(
        F.count("*").alias("cases"),
        F.avg(answered(zero("top5") / 5)).alias("precision_5"),
        F.avg(answered(zero("top10") / F.col("targets"))).alias("recall_10"),
        F.avg(answered(F.coalesce("first", F.lit(11)))).alias("first_rank"),
        F.avg(F.when(F.col("no_answer"), (zero("hits") > 0).cast("int"))).alias("false_positives"),
    )
