"""Scans of one order over many tasks: an order is cut into blocks, each block is summed up as a step from the state before it to the state after it, steps are composed in a
tree, and every block gets the state that it starts with."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

FAN = 256  # blocks that are composed at once


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` written in the order of ``key`` and ``order``, with ``nth``: 0, 1, 2, .. for each key.

    Rows are dealt out by ranges of the whole order, so a key of any size is in many tasks. Of each range only the counts of the keys that go on in the next one are
    broadcast: one at most for a range.
    """
    place = Window.partitionBy("part", key).orderBy(*order)
    dealt = written(rows.repartitionByRange(F.col(key).asc_nulls_first(), *order).withColumn("part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy(key, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.sum("n").over(before)).where("before is not null").select(F.col(key).alias("_key"), F.col("part").alias("_part"), "before")
    own = dealt.withColumn("nth", F.row_number().over(place) - 1)
    got = own.join(F.broadcast(offsets), F.col(key).eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part")), "left")
    return got.withColumn("nth", F.col("nth") + F.coalesce("before", F.lit(0))).drop("_key", "_part", "before", "part")


def entry_states(steps: DataFrame, key: str, compose: Callable[[bytes, bytes], bytes], enter: Callable[[bytes, bytes], bytes], start: bytes) -> DataFrame:
    """(key, block, state): what each block of steps (key, block, step) starts with, if its key starts with ``start``.

    ``compose(a, b)`` is the step of a and then b, ``enter(state, step)`` the state after it. Blocks are numbered from 0 for each key; no task has more than ``FAN`` of them.
    """
    kind = steps.schema[key].dataType.simpleString()
    up: Column = F.floor(F.col("block") / FAN)

    def composed(group: pa.Table) -> pa.Table:
        rows = group.sort_by("block")
        whole = None
        for step in rows["step"].to_pylist():
            whole = step if whole is None else compose(whole, step)
        return pa.table({key: rows[key][:1], "block": rows["above"][:1], "step": pa.array([whole], pa.binary())})

    def entered(group: pa.Table) -> pa.Table:
        rows = group.sort_by("block")
        state, out = rows["state"][0].as_py(), []
        for step in rows["step"].to_pylist():
            out.append(state)
            state = enter(state, step)
        return pa.table({key: rows[key], "block": rows["block"], "state": pa.array(out, pa.binary())})

    levels = [steps]
    while levels[-1].where("block > 0").limit(1).count():
        above = levels[-1].withColumn("above", up.cast("long")).groupBy(key, "above").applyInArrow(composed, f"{key} {kind}, block bigint, step binary")
        levels.append(written(above, "steps"))
    states = levels[-1].select(key, "block", F.lit(bytearray(start)).alias("state"))
    for lower in reversed(levels[:-1]):
        own = lower.withColumn("above", up.cast("long")).alias("o")
        met = own.join(states.alias("s"), F.col(f"o.{key}").eqNullSafe(F.col(f"s.{key}")) & (F.col("o.above") == F.col("s.block"))).select("o.*", "s.state")
        states = met.groupBy(key, "above").applyInArrow(entered, f"{key} {kind}, block bigint, state binary")
    return states
