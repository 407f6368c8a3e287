"""Job telemetry as streams: rolling durations of each kind of job, silences of what should report, and a sink that keeps the first record of each workflow."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumbra.functions.times import micros
from lumbra.operators.telemetry import SAMPLES
from lumbra.sources.telemetry import content_members

#: Unhealthy probes in a row that fail a job, seconds between probes, and days that task records are kept.
UNHEALTHY, PROBE_SECONDS, TASK_DAYS = 2, 60, 7
#: Groups of keys that share a state and a timer: a call of Python costs far more than a key's rows, so calls must not grow with the keys.
KEY_GROUPS = 4096


def rolling_durations(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Stream (keys, recorded_at, job_id, execution_us) to (keys, samples, median_us, p90_us) of the keys that changed, for update mode.

    A key's state is its last ``SAMPLES`` executions by time and id, in whatever order they come; it equals ``telemetry.predicted`` of all that was read so far.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for frame in frames:
            held = sorted(held + list(zip(frame["at"], frame["job_id"], frame["execution_us"], strict=True)))[-SAMPLES:]
        state.update(tuple([int(h[k]) for h in held] for k in range(3)))
        us = sorted(int(h[2]) for h in held)
        n = len(us)
        yield pd.DataFrame([(*key, n, (us[(n - 1) // 2] + us[n // 2]) / 2, us[max(0, math.ceil(n * 9 / 10) - 1)])], columns=[*keys, "samples", "median_us", "p90_us"])

    own = jobs.select(*keys, micros("recorded_at").alias("at"), F.col("job_id").cast("long").alias("job_id"), F.col("execution_us").cast("long").alias("execution_us")).where("execution_us is not null")
    kinds = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in keys)
    return own.groupBy(*keys).applyInPandasWithState(step, f"{kinds}, samples long, median_us double, p90_us long", "at array<long>, job_id array<long>, us array<long>", "update", GroupStateTimeout.NoTimeout)


def silences(reports: DataFrame, key: str, seconds: int, delay: str) -> DataFrame:
    """Stream (key, at, job_id, kind) to (key, job_id, event, gap_us), for append mode.

    kind is beat, or the outcome of a probe: healthy, unhealthy or inconclusive. event is ``gap`` when a beat comes more than ``seconds`` after the one before it; ``silent``, with no gap yet, when
    event time passes ``seconds`` after a beat and none has come (a timer fires, no row is needed); ``failed`` at the ``UNHEALTHY``-th unhealthy probe in a row of a silent
    job. Probes inside ``PROBE_SECONDS`` of the last one don't count. Reports older than ``delay`` behind the newest are late and left out.

    Keys are dealt into ``KEY_GROUPS`` groups. A key's state is five numbers; a group has those of its keys and one timer, that of the key that falls silent next.
    """
    quiet, between = seconds * 1_000_000, PROBE_SECONDS * 1_000_000

    def step(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        null = own[0] < 0  # in pandas a null may turn other keys into floats, so it has its own group
        held = {k: rest for k, *rest in zip([None] if null else state.get[0], *state.get[1:], strict=True)} if state.exists else {}
        out = []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["us", "job_id"])
            keys = [None] * len(rows) if null else rows["key"].tolist()
            for k, us, number, kind in zip(keys, rows["us"].tolist(), rows["job_id"].tolist(), rows["kind"].tolist(), strict=True):
                last, job, probed, bad, told = held.get(k, (None, None, None, 0, False))
                if kind == "beat":
                    if last is not None and us - last > quiet:
                        out.append((k, job, "gap", us - last))
                    last, job, probed, bad, told = us, int(number), None, 0, False
                elif last is not None and us - last >= quiet and (probed is None or us - probed >= between):
                    probed, bad = us, bad + 1 if kind == "unhealthy" else 0
                    if bad == UNHEALTHY:
                        out.append((k, job, "failed", None))
                held[k] = (last, job, probed, bad, told)
        now, due = state.getCurrentWatermarkMs(), []
        for k, (last, job, probed, bad, told) in held.items():
            if last is not None and not told:
                ends = (last + quiet) // 1000
                if ends <= now:
                    out.append((k, job, "silent", None))
                    held[k] = (last, job, probed, bad, True)
                else:
                    due.append(ends)
        state.update(([None if null else k for k in held], *([h[n] for h in held.values()] for n in range(5))))
        if due:
            state.setTimeoutTimestamp(min(due))
        if out:
            yield pd.DataFrame({name: pd.Series(list(c), dtype=kind) for name, kind, c in zip(("key", "job_id", "event", "gap_us"), (object, "Int64", object, "Int64"), zip(*out, strict=True), strict=True)})

    own = reports.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay).select(F.col(key).alias("key"), "at", micros("at").alias("us"), F.col("job_id").cast("long").alias("job_id"), "kind")
    group = F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(KEY_GROUPS))).cast("int")
    kind = own.schema["key"].dataType.simpleString()
    kept = f"key array<{kind}>, last array<long>, job array<long>, probed array<long>, bad array<int>, told array<boolean>"
    return own.withColumn("key_group", group).groupBy("key_group").applyInPandasWithState(step, f"key {kind}, job_id long, event string, gap_us long", kept, "append", GroupStateTimeout.EventTimeTimeout)


def first_records(records: DataFrame, workflow: str, delay: str) -> DataFrame:
    """Stream of records (``workflow``, recorded_at, ..) to the first one of each workflow, by time and then by all columns among those that come together.

    A workflow is known for ``TASK_DAYS`` and ``delay`` of event time, so the state doesn't grow with the history.
    """
    records = records.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    names, kinds = records.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))
        if not state.exists:
            yield rows.sort_values(["recorded_at", *[n for n in names if n != "recorded_at"]]).head(1)[names]
        state.update((True,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["recorded_at"].max().timestamp() * 1000)) + TASK_DAYS * 86_400_000)

    return records.withWatermark("recorded_at", delay).groupBy(workflow).applyInPandasWithState(step, kinds, "known boolean", "append", GroupStateTimeout.EventTimeTimeout)


def keep_tasks(stream: DataFrame, path: str, days: int = TASK_DAYS) -> None:
    """Drains the stream of ``first_records`` into ``path``/batch=../day=..; a batch that comes again replaces itself. Then whole days that are over before the newest record less
    ``days`` are removed: the append prunes, readers never do. Progress is kept in ``path``/_progress, so a later call goes on where this one ended."""
    held = content_members(stream.schema)
    if held:
        raise ValueError(f"telemetry must not hold content: {', '.join(held)}")

    def put(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.withColumn("day", F.to_date("recorded_at").cast("string")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={number}")
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/day=*")
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        folders = [s.getPath() for s in store.globStatus(place)]
        stands = [p.getName().removeprefix("day=") for p in folders]
        if stands:
            oldest = (pd.Timestamp(max(stands)) - pd.Timedelta(days=days)).strftime("%Y-%m-%d")
            for folder, day in zip(folders, stands, strict=True):
                if day < oldest:
                    store.delete(folder, True)

    stream.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True).start().awaitTermination()


def kept_tasks(spark, path: str, schema) -> DataFrame:
    """What ``keep_tasks`` has kept."""
    return spark.read.schema(schema).parquet(f"{path}/batch=*/day=*")
