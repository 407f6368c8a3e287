"""Telemetry streams over several batches and a restart, against what the batch operators give."""

import os
import random
from collections import Counter
from datetime import datetime, timedelta

from lumbra.operators import telemetry as batch
from lumbra.streaming import queue, telemetry
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)
JOBS = "job_id bigint, model string, recorded_at timestamp, execution_us bigint"


def _put(spark, folder, rows, schema, name):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    df.write.mode("append").parquet(str(folder / name))
    return df


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_rolling_durations_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, f"m{k % 3}", T0 + timedelta(seconds=rng.randrange(5000)), rng.randrange(10_000)) for k in range(700)]
    own = tmp_path / "in"
    for k, part in enumerate((rows[:200], rows[200:450], rows[450:])):
        _put(spark, own, part, JOBS, f"p{k}")
        got = queue.drained(telemetry.rolling_durations(_stream(spark, own, JOBS), ["model"]), "durations", "update", str(tmp_path / "out"))
        so_far = spark.createDataFrame(rows[: (200, 450, 700)[k]], JOBS)
        want = sorted(tuple(r) for r in batch.predicted(so_far, ["model"]).collect())
        assert sorted(tuple(r) for r in queue.newest_batch(got, "model").collect()) == want
    assert got.select("batch").distinct().count() == 3 and {r.samples for r in got.where("batch = 2").collect()} == {101}


def test_silences_fire_without_a_row(spark, tmp_path):
    minute = lambda m: T0 + timedelta(minutes=m)
    schema = "key string, at timestamp, job_id bigint, kind string"
    parts = [
        [("a", minute(0), 1, "beat"), ("b", minute(1), 2, "beat"), ("c", minute(2), 3, "beat"), ("a", minute(5), 4, "beat")],
        [("a", minute(20), 5, "beat"), ("b", minute(12), 6, "unhealthy"), ("b", minute(12.5), 7, "unhealthy"), ("b", minute(14), 8, "healthy"), ("b", minute(15), 9, "unhealthy"), ("b", minute(16), 10, "unhealthy")],
        [("d", minute(60), 11, "beat")],
    ]
    own, found = tmp_path / "in", []
    for k, part in enumerate(parts):
        _put(spark, own, part, schema, f"p{k}")
        got = queue.drained(telemetry.silences(_stream(spark, own, schema), "key", 600, "2 minutes"), "silences", "append", str(tmp_path / "out"))
        found.append({(r.key, r.job_id, r.event, r.gap_us) for r in got.collect()})
    assert found[0] == set()
    assert ("a", 4, "gap", 15 * 60_000_000) in found[1] and ("b", 2, "failed", None) in found[1] and ("b", 2, "silent", None) in found[1] and ("c", 3, "silent", None) in found[1]
    assert found[2] - found[1] == {("a", 5, "silent", None)}  # d is not silent yet, and nobody is told twice
    beats = spark.createDataFrame([r for p in parts for r in p if r[3] == "beat"], schema).withColumnRenamed("at", "recorded_at")
    assert {tuple(r) for r in batch.silences(beats, "key", 600).collect()} == {(k, j, g) for k, j, e, g in found[2] if e == "gap"}


def test_first_task_records_survive_replays_and_are_pruned(spark, tmp_path):
    schema = "workflow bigint, recorded_at timestamp, job_id bigint"
    day = lambda d, h=0: T0 + timedelta(days=d, hours=h)
    parts = [[(1, day(0, 5), 1), (1, day(0, 2), 2), (2, day(1), 3)], [(1, day(2), 4), (3, day(7, 1), 5)], [(4, day(12), 6), (2, day(12, 1), 7)]]
    own, out = tmp_path / "in", str(tmp_path / "out")
    seen = []
    for k, part in enumerate(parts):
        _put(spark, own, part, schema, f"p{k}")
        for _ in range(2):  # the second call has nothing new
            first = telemetry.first_records(_stream(spark, own, schema), "workflow", "1 hour")
            telemetry.keep_tasks(first, out)
        seen.append(sorted((r.workflow, r.job_id) for r in telemetry.kept_tasks(spark, out, first.schema).collect()))
    assert seen[:2] == [[(1, 2), (2, 3)], [(1, 2), (2, 3), (3, 5)]]
    assert [r for r in seen[2] if r[0] != 2] == [(3, 5), (4, 6)] and not any("day=2024-01-01" in d for d, _, _ in os.walk(out))
    # The last batch comes again where its end wasn't noted.
    before = sorted(tuple(r) for r in telemetry.kept_tasks(spark, out, first.schema).collect())
    noted = sorted((int(n) for n in os.listdir(f"{out}/_progress/commits") if n.isdigit()))
    for name in (f"{noted[-1]}", f".{noted[-1]}.crc"):
        if os.path.exists(f"{out}/_progress/commits/{name}"):
            os.remove(f"{out}/_progress/commits/{name}")
    telemetry.keep_tasks(telemetry.first_records(_stream(spark, own, schema), "workflow", "1 hour"), out)
    assert sorted(tuple(r) for r in telemetry.kept_tasks(spark, out, first.schema).collect()) == before


def _told_alone(beats, seconds):
    """Gaps and failures of each key by a plain loop over its reports."""
    out, held = Counter(), {}
    for key, at, job, kind in sorted(beats, key=lambda r: (r[1], r[2])):
        last, of, probed, bad = held.get(key, (None, None, None, 0))
        if kind == "beat":
            if last and (at - last).total_seconds() > seconds:
                out[key, of, "gap", int((at - last).total_seconds()) * 1_000_000] += 1
            last, of, probed, bad = at, job, None, 0
        elif last and (at - last).total_seconds() >= seconds and (probed is None or (at - probed).total_seconds() >= telemetry.PROBE_SECONDS):
            probed, bad = at, bad + 1 if kind == "unhealthy" else 0
            if bad == telemetry.UNHEALTHY:
                out[key, of, "failed", None] += 1  # again, where a healthy probe came between
        held[key] = (last, of, probed, bad)
    return out, {(k, of, last) for k, (last, of, _, _) in held.items() if last}


def test_silences_of_many_keys_in_few_groups(spark, tmp_path, monkeypatch):
    """Far more keys than groups, null and large keys among them, over several batches: states and timers of a group's keys stay apart, and states are as many as groups, not as keys."""
    monkeypatch.setattr(telemetry, "KEY_GROUPS", 3)
    rng = random.Random(9)
    keys = [None, 2**62 + 1, *range(60)]
    rows = [(rng.choice(keys), T0 + timedelta(seconds=k * 5 + rng.randrange(60)), k, rng.choice(["beat", "unhealthy", "unhealthy", "healthy", "inconclusive"])) for k in range(2400)]
    rows.sort(key=lambda r: (r[1], r[2]))  # no batch has what belongs before the one before it
    own, schema = tmp_path / "in", "key bigint, at timestamp, job_id bigint, kind string"
    for k in range(3):
        _put(spark, own, rows[k * 800 : (k + 1) * 800], schema, f"p{k}")
        got = queue.drained(telemetry.silences(_stream(spark, own, schema), "key", 600, "2 minutes"), "silences", "append", str(tmp_path / "out"))
    found = [(r.key, r.job_id, r.event, r.gap_us) for r in got.collect()]
    loud, last = _told_alone(rows, 600)
    silent = [f for f in found if f[2] == "silent"]
    assert Counter(f for f in found if f[2] != "silent") == loud and {None, 2**62 + 1} <= {f[0] for f in loud} and len(silent) == len(set(silent))
    over = max(r[1] for r in rows) - timedelta(seconds=120 + 600)
    assert {(k, of, "silent", None) for k, of, at in last if at < over} <= set(silent) and not {(k, of, "silent", None) for k, of, at in last if at > over} & set(silent)
    states = spark.read.format("statestore").load(str(tmp_path / "out" / "checkpoint"))
    assert states.count() <= 4
