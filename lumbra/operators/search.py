"""Exact vector search, lexical search and their fusion by reciprocal ranks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF, PER_SIGNAL = 60, 250
QUERY_BLOCK, ROW_BLOCK, LEAST_BLOCK, ROW_STEP = 4096, 65_536, 1024, 512  # of queries and of rows that meet in one task, and rows that are scored at once


def best(scored: DataFrame, score: str, most: int, rank: str) -> DataFrame:
    """The ``most`` best rows with their rank; ties by ordinal. The limit comes before the window, so only ``most`` rows meet in one task."""
    top = scored.orderBy(F.desc(score), "ordinal").limit(most)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(score), "ordinal")))


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six places, halves away from zero."""
    scaled = np.abs(x) * 1e6
    whole = np.floor(scaled)
    return np.copysign(whole + (scaled - whole >= 0.5), x) / 1e6


def _scored_in_blocks(queries: DataFrame, rows: DataFrame, keep, floor: float | None = None) -> DataFrame:
    """(query, ordinal, score) of what ``keep`` leaves of the scores, for rows (ordinal, vector) and queries (query, vector), by dot product to six places.

    Queries and rows are dealt out by hash to a grid of blocks of bounded size; each side is read once, and the plan is the same for any number of queries. A task multiplies one
    block of queries and one of rows, ``ROW_STEP`` rows at once. ``keep(ids, ordinals, scores, held)`` gets the scores of some rows and what it held before; it returns
    (what is held on, finished columns or None). With ``floor``, rows are taken in the order of their projection on the block's mean, and rows too far from
    every query for that score (by their centre and radius) are skipped.
    """
    n_queries, n_rows, tasks = queries.count(), rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    high = max(1, -(-n_queries // QUERY_BLOCK))
    wide = max(1, -(-n_rows // max(LEAST_BLOCK, min(ROW_BLOCK, -(-n_rows * high // tasks)))))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")  # noqa: E731; of one type with ``every``: numbers of different types go to different tasks
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col("query").cast("long").alias("query"), "vector", block("query", high).alias("i"), every(wide).alias("j"))
    r = rows.select(F.col("ordinal").cast("long").alias("ordinal"), "vector", block("ordinal", wide).alias("j"), every(high).alias("i"))

    def multiplied(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = [pa.table({"query": pa.array([], pa.int64()), "ordinal": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        if len(mine) and len(theirs):
            ids, ordinals = np.asarray(mine["query"]), np.asarray(theirs["ordinal"])
            vectors, own = (np.stack(t["vector"].to_numpy()).astype(np.float64) for t in (mine, theirs))
            if floor is not None:
                order = np.argsort(own @ own.mean(0), kind="stable")
                ordinals, own, size = ordinals[order], own[order], np.linalg.norm(vectors, axis=1)
            held = None
            for at in [*range(0, len(own), ROW_STEP), None]:
                if at is None:
                    held, done = keep(ids, None, None, held)
                else:
                    part = own[at : at + ROW_STEP]
                    if floor is not None:
                        centre = part.mean(0)
                        if (vectors @ centre + size * np.linalg.norm(part - centre, axis=1).max() < floor - 2e-6).all():
                            continue
                    dots = np.zeros((len(ids), len(part)))
                    for k in range(part.shape[1]):  # in the order in which a plain sum adds
                        dots += vectors[:, k, None] * part[None, :, k]
                    held, done = keep(ids, ordinals[at : at + ROW_STEP], _rounded(dots), held)
                if done is not None:
                    out.append(pa.table({"query": done[0], "ordinal": done[1], "score": done[2]}))
        return pa.concat_tables(out)

    return q.groupBy("i", "j").cogroup(r.groupBy("i", "j")).applyInArrow(lambda a, b: multiplied(a, b), "query bigint, ordinal bigint, score double")


def best_of_each(queries: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """(query, ordinal, score, rank) of the ``most`` best rows for each query; ties by ordinal. Only the ``most`` best of each task for each query are rows."""

    def keep(ids, ordinals, scores, held):
        if ordinals is None:
            return None, held and (np.repeat(ids, held[0].shape[1]), held[1].ravel(), held[0].ravel())
        new = np.broadcast_to(ordinals, scores.shape)
        score, ordinal = (scores, new) if held is None else (np.hstack([held[0], scores]), np.hstack([held[1], new]))
        by = np.lexsort((ordinal, -score))[:, :most]
        return (np.take_along_axis(score, by, 1), np.take_along_axis(ordinal, by, 1)), None

    order = Window.partitionBy("query").orderBy(F.desc("score"), "ordinal")
    return _scored_in_blocks(queries, rows, keep).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def above(queries: DataFrame, rows: DataFrame, floor: float) -> DataFrame:
    """(query, ordinal, score) of all rows that reach ``floor`` for a query."""

    def keep(ids, ordinals, scores, held):
        if ordinals is None:
            return None, None
        q, r = np.nonzero(scores >= floor)
        return None, (ids[q], ordinals[r], scores[q, r])

    return _scored_in_blocks(queries, rows, keep, floor)


def hybrid(scored: DataFrame, floor: float | None = None) -> DataFrame:
    """Fuses columns ``vector`` and ``lexical`` of candidates (ordinal, path): reciprocal ranks, position and reported score. The floor removes a row from the vector ranking alone.

    Each ranking carries its candidates' columns, so candidates are scored once for each and not again for the result.
    """
    eligible = scored if floor is None else scored.where(F.col("vector") >= floor)
    rest = [c for c in scored.columns if c != "ordinal"]
    all_ = F.struct(*rest)
    by_vector = best(eligible, "vector", PER_SIGNAL, "vrank").select("ordinal", "vrank", all_.alias("_v"))
    by_words = best(scored.where(F.col("lexical") > 0), "lexical", PER_SIGNAL, "lrank").select("ordinal", "lrank", all_.alias("_l"))
    fused = by_vector.join(by_words, "ordinal", "full_outer")
    fused = fused.withColumn("rrf", F.coalesce(1.0 / (RRF + F.col("vrank")), F.lit(0.0)) + F.coalesce(1.0 / (RRF + F.col("lrank")), F.lit(0.0)))
    order = Window.orderBy(F.desc("rrf"), F.desc(F.coalesce("_v.vector", F.lit(0.0))), F.asc_nulls_last("vrank"), F.asc_nulls_last("lrank"))
    fused = fused.withColumn("position", F.row_number().over(order))  # 2 * PER_SIGNAL rows at most
    own = F.coalesce("_v", "_l")
    return fused.select("ordinal", *[own[c].alias(c) for c in rest], "position", "rrf").withColumn("score", 1.0 / (RRF + F.col("position")))


def capped(fused: DataFrame, per_file: int, k: int) -> DataFrame:
    """The first ``per_file`` hits of each path (0: all) and then the first ``k``."""
    if per_file:
        place = Window.partitionBy(F.lower("path")).orderBy("position")
        fused = fused.withColumn("_nth", F.row_number().over(place)).where(F.col("_nth") <= per_file).drop("_nth")
    return fused.orderBy("position").limit(k)
