"""Points in ranges: for each point the best range that holds it, by one sweep over the ranges' starts and the points.

Ranges and points meet in stretches of lines, so a document of any size is in many tasks; within a stretch both are swept in one order, and a heap holds the ranges that have begun. A range
that has ended is dropped when it comes to the top, once, so the work follows the number of ranges and points, however they overlap.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import STRETCH


def best_covering(ranges: DataFrame, points: DataFrame, order: list[Column], carry: Column, tie: str) -> DataFrame:
    """(point_id, best): ``carry`` of the first range by ``order`` (whole numbers) and column ``tie``, of those with start <= point < end.

    ranges have doc, sl, sc, el, ec (lines and columns); points have point_id, doc, line, col. Points that no range holds are left out.
    """
    stretch = lambda line: F.floor(line / STRETCH).cast("long")
    key = F.array(*[o.cast("long") for o in order])
    there = (F.col("el") > F.col("sl")) | ((F.col("el") == F.col("sl")) & (F.col("ec") > F.col("sc")))
    r = ranges.where(there).select("doc", F.explode(F.sequence(stretch(F.col("sl")), stretch(F.col("el")))).alias("stretch"), F.col("sl").cast("long").alias("line"), F.col("sc").cast("long").alias("col"), F.lit(0).alias("kind"), F.col("el").cast("long").alias("el"), F.col("ec").cast("long").alias("ec"), key.alias("key"), F.col(tie).alias("tie"), carry.alias("best"))
    p = points.select("doc", stretch(F.col("line")).alias("stretch"), F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), F.lit(1).alias("kind"), "point_id")
    rows = r.unionByName(p, allowMissingColumns=True).repartition("doc", "stretch").sortWithinPartitions("doc", "stretch", "line", "col", "kind")
    rows = rows.select("doc", "stretch", "line", "col", "kind", "el", "ec", *[F.get("key", F.lit(k)).alias(f"k{k}") for k in range(len(order))], "tie", "best", "point_id")
    many = len(order)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("point_id", "best")}

    def sweep(batches):
        at, heap, n, pool = None, [], 0, None  # the heap's ranges have their results in the pool, at their last place
        for batch in batches:
            held = 0 if pool is None else len(pool)
            pool = batch.column("best") if not held else pa.concat_arrays([pool, batch.column("best")])
            ids, out = [], []
            whole = lambda c: batch.column(c).fill_null(0).to_numpy().tolist()
            keys = zip(*[whole(f"k{k}") for k in range(many)], batch.column("tie").to_pylist(), strict=True)
            rows = zip(batch.column("doc").to_pylist(), *[whole(c) for c in ("stretch", "line", "col", "kind", "el", "ec")], keys, strict=True)
            for k, (doc, stretch, line, col, is_point, el, ec, key) in enumerate(rows):
                if at != (doc, stretch):
                    at, heap = (doc, stretch), []
                if not is_point:
                    n += 1
                    heapq.heappush(heap, (*key, n, el, ec, held + k))
                    continue
                while heap and (heap[0][-3], heap[0][-2]) <= (line, col):
                    heapq.heappop(heap)
                if heap:
                    ids.append(k)
                    out.append(heap[0][-1])
            yield pa.RecordBatch.from_arrays([batch.column("point_id").take(pa.array(ids, pa.int64())), pool.take(pa.array(out, pa.int64()))], names=["point_id", "best"])
            pool = pool.take(pa.array([h[-1] for h in heap], pa.int64()))
            heap = [(*h[:-1], k) for k, h in enumerate(heap)]

    return rows.mapInArrow(sweep, f"point_id {kinds['point_id']}, best {kinds['best']}")
