"""Exact dedup: tree-merge of sorted digest runs.

Every partition turns its texts into sorted runs of (key, best row, copies). Runs are then exchanged in binomial rounds:
nodes are numbered with ``fan`` digits, and in round r the nodes that differ in digit r alone exchange slices of their runs,
each keeping the slice whose digests carry its own digit there. Each node merges the sorted slices that reach it (a stable sort finds
the runs and merges them, it doesn't sort again) and keeps one entry per key at every level, so a group of any size is one entry per run
and copies are never gathered. After the last round a node holds one range of digests, wholly merged; its size follows from the
number of nodes, which grows with the input.

The key is SHA-256 of the normalised text (A-Z lower-cased, UTF-8, null as empty), a second digest and the text's length: entries are
verified at each level, as they merge only where all three agree.

Defined results: null and empty texts are equal; null identifiers come after all others; of repeated rows with the
same text and identifier exactly one stays; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import dropped, numbered, raw, stored, without

FAN = 8
NODE_ROWS = 500_000  # entries that a node is meant to hold
RUN_ROWS = 200_000  # entries of a run that a partition starts with
HOT_COPIES, HOT_TEXTS = 1000, 1000  # a group of more copies than both allow is told by a broadcast
_ENTRY = np.dtype([("key", "S48"), ("known", "i1"), ("id", "<i8"), ("row", "<i8"), ("copies", "<i8")])  # key: digest, second digest, length


@F.arrow_udf(StructType([StructField("digest", BinaryType()), StructField("second", LongType()), StructField("bytes", LongType())]))
def fingerprint(text: pa.Array) -> pa.Array:
    raw = [(x or "").encode("utf-8", "replace").lower() for x in text.to_pylist()]  # bytes.lower() changes A-Z only
    second = [int.from_bytes(blake2b(x, digest_size=8).digest(), "little", signed=True) for x in raw]
    return pa.StructArray.from_arrays(
        [pa.array([sha256(x).digest() for x in raw], pa.binary()), pa.array(second, pa.int64()), pa.array([len(x) for x in raw], pa.int64())],
        names=["digest", "second", "bytes"],
    )


def _merged(runs: list[np.ndarray], largest: bool) -> np.ndarray:
    """One sorted run from sorted runs: for each key the best (id, row) and the number of copies."""
    got = runs[0] if len(runs) == 1 else np.concatenate(runs)
    got = got[np.argsort(got["key"], kind="stable")]
    if not len(got):
        return got
    edge = np.append(True, got["key"][1:] != got["key"][:-1])
    start = np.flatnonzero(edge)
    order = np.lexsort((got["row"], ~got["id"] if largest else got["id"], -got["known"], np.cumsum(edge)))
    out = got[order[start]]
    out["copies"] = np.add.reduceat(got["copies"], start)
    return out


def levels(rows: int) -> int:
    """Rounds for so many rows: as many as leave a node ``NODE_ROWS`` entries, one at least."""
    k = 1
    while FAN**k * NODE_ROWS < rows:
        k += 1
    return k


def _slices(run: np.ndarray, node: int, r: int):
    """A run's way in round r: (node, slice) for each digit."""
    lead = np.frombuffer(run["key"].tobytes(), np.uint8).reshape(len(run), 48)
    number = np.zeros(len(run), np.int64)
    for k in range(6):
        number = number * 256 + lead[:, k]
    digit, here = number // FAN**r % FAN, node // FAN**r % FAN
    for d in range(FAN):
        own = run[digit == d]
        if len(own):
            yield node + (d - here) * FAN**r, own.tobytes()


_MOVED = "node int, entries binary"


def merged_groups(prints: DataFrame, rows: int, largest: bool) -> DataFrame:
    """One row per text of ``prints`` (digest, second, bytes, id, row): the best id and row, and the copies."""
    k = levels(rows)
    nodes = FAN**k

    def moved(run: np.ndarray, node: int, r: int) -> pa.RecordBatch:
        ways = list(_slices(run, node, r))
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in ways], pa.int32()), pa.array([x for _, x in ways], pa.binary())], names=["node", "entries"])

    def first(batches):
        from pyspark import TaskContext

        node, held, n = TaskContext.get().partitionId() % nodes, [], 0  # it only decides the way of an entry through the tree, never the result
        for batch in batches:
            digest, second, size, ids, row = (batch.column(c) for c in range(5))
            run = np.zeros(batch.num_rows, _ENTRY)
            raw_key = np.zeros((batch.num_rows, 48), np.uint8)
            raw_key[:, :32] = np.frombuffer(b"".join(digest.to_pylist()), np.uint8).reshape(-1, 32)
            raw_key[:, 32:40] = np.asarray(second).astype(">i8").view(np.uint8).reshape(-1, 8)
            raw_key[:, 40:] = np.asarray(size).astype(">i8").view(np.uint8).reshape(-1, 8)
            run["key"] = raw_key.view("S48").ravel()
            run["known"], run["id"] = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0))
            run["row"], run["copies"] = np.asarray(row), 1
            held.append(run)
            n += len(run)
            if n >= RUN_ROWS:
                yield moved(_merged(held, largest), node, 0)
                held, n = [], 0
        if held:
            yield moved(_merged(held, largest), node, 0)

    def collected(batches):
        runs: dict[int, list] = {}
        for batch in batches:
            for node, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                runs.setdefault(node, []).append(np.frombuffer(blob, _ENTRY))
        return ((node, _merged(own, largest)) for node, own in runs.items())

    def onward(r: int):
        return lambda batches: (moved(run, node, r) for node, run in collected(batches))

    def last(batches):
        for _, run in collected(batches):
            for at in range(0, len(run), 20_000):
                part = run[at : at + 20_000]
                key = np.frombuffer(part["key"].tobytes(), np.uint8).reshape(-1, 48)
                numbers = [np.ascontiguousarray(key[:, a:b]).view(">i8").ravel().astype(np.int64) for a, b in ((32, 40), (40, 48))]
                digest = pa.array([x.tobytes() for x in key[:, :32]], pa.binary())
                yield pa.RecordBatch.from_arrays([digest, *map(pa.array, numbers), pa.array(part["id"], mask=part["known"] == 0), pa.array(part["row"]), pa.array(part["copies"])], names=["digest", "second", "bytes", "id", "row", "copies"])

    runs = prints.select("digest", "second", "bytes", "id", "row").mapInArrow(first, _MOVED)
    for r in range(1, k):
        runs = runs.repartitionById(nodes, F.col("node")).mapInArrow(onward(r), _MOVED)
    return runs.repartitionById(nodes, F.col("node")).mapInArrow(last, "digest binary, second bigint, bytes bigint, id bigint, row bigint, copies bigint")


def fingerprints(documents: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row with ``row`` (a number of its own), ``digest``, ``second`` and ``bytes``; the caller stores it."""
    return documents.select(*columns, F.monotonically_increasing_id().alias("row"), fingerprint("text").alias("_f")).select(*columns, "row", "_f.*")


def decisions(prints: DataFrame, id_column: str = "doc_id", largest: bool = False) -> DataFrame:
    """For each row of stored ``fingerprints``: id, row, digest, keep_id, group_size and kept."""
    got = prints.select(F.col(id_column).cast("long").alias("id"), "row", "digest", "second", "bytes")
    groups = merged_groups(got, prints.count(), largest).where("copies > 1")
    groups = stored(groups.select("digest", "second", "bytes", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), "copies"), "dedup-groups")
    # A text with many copies is told by a broadcast, so its rows don't meet in one task: at most ``HOT_TEXTS`` groups can be that large.
    key, hot = ["digest", "second", "bytes"], F.col("copies") > F.greatest(F.lit(HOT_COPIES), F.lit(prints.count() // HOT_TEXTS))
    told = got.join(F.broadcast(groups.where(hot)), key, "left")
    rest = told.where(F.col("copies").isNull()).select(got.columns).join(groups.where(~hot), key, "left")
    return told.where(F.col("copies").isNotNull()).unionByName(rest).select(
        "id", "row", "digest",
        F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
    )


def deduplicate(documents: DataFrame, id_column: str = "doc_id", largest: bool = False, files: bool = False) -> DataFrame:
    """The rows of ``documents`` that stay, with their columns; ``files`` as in ``numbered``."""
    rows = numbered(documents, F.col(f"`{id_column}`").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"), files=files)
    prints = stored(rows.select(F.col("_id").alias("id"), F.col("_row").alias("row"), fingerprint("_text").alias("_f")).select("id", "row", "_f.*"), "dedup-prints")
    gone = stored(decisions(prints, "id", largest).where(~F.col("kept")).select(F.col("row").alias("_row")), "dedup-gone")
    dropped(prints)
    return raw(without(rows, "_row", gone))
