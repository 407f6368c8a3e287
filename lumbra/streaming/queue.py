"""The job queue as streams: enqueues that join a live job, and each job's latest progress."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumbra.operators.tables import shared_folder


def _folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, tag: str, mode: str, folder: str | None = None) -> DataFrame:
    """All that ``stream`` gives for what there is now, with the ``batch`` that gave it; each batch has its own folder, so a repeated one replaces itself. With ``folder``, a later call on
    the same folder goes on where this one ended."""
    spark, out = stream.sparkSession, folder or _folder(stream.sparkSession, tag)
    schema = stream.schema.add("batch", "long")

    def put(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/rows/b{number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows")


def joined_jobs(actions: DataFrame) -> DataFrame:
    """Stream (key, sequence, action) to (sequence, key, job_sequence): an enqueue joins its key's live job, else begins one; a finish ends it. A finished key may come again.

    A key's actions are taken in their sequence inside a batch; the state of a key is one number.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("sequence")
        out = []
        for sequence, action in zip(rows["sequence"], rows["action"], strict=True):
            if action == "finish":
                live = None
            else:
                live = int(sequence) if live is None else live
                out.append((int(sequence), key[0], live))
        if live is not None:
            state.update((live,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["sequence", "key", "job_sequence"])

    return actions.groupBy("key").applyInPandasWithState(step, "sequence long, key long, job_sequence long", "live long", "append", GroupStateTimeout.NoTimeout)


def latest_progress(reports: DataFrame) -> DataFrame:
    """Stream (key, at, sequence, progress) to the last progress of each key that changed; the state is one row a key."""
    return reports.groupBy("key").agg(F.max(F.struct("at", "sequence", "progress")).alias("last")).select("key", F.col("last.sequence").alias("sequence"), F.col("last.progress").alias("progress"))


def newest_batch(rows: DataFrame, key: str) -> DataFrame:
    """Of the drained updates, the last of each key."""
    names = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("last")).select(key, *[f"last.{c}" for c in names])
