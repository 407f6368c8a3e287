"""Sequential packing: greedy batches, budgets that follow the measured speed, soft breaks, levels of summaries.

Where a batch begins depends on the one before it. A queue is cut into blocks; the start of the batch after each item follows from the sums of sizes alone, so a block is a table from
each place where a batch may begin near its start to the place where one begins behind its end, found by pointer doubling. These tables are composed in a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .tables import written

#: Sizes of batches and of inputs, and where a text may be cut.
MOST_ITEMS = 512
FIRST_BUDGET, LEAST_BUDGET, MOST_BUDGET, TARGET_SECONDS = 48_000, 8_000, 400_000, 15
MOST_INPUT = 48_000
LEAST_PIECE = 256
BREAKS = ("\r\n\r\n", "\n\n", "\r\n", "\n", " ")
BLOCK = 65_536  # items


def following(chars: np.ndarray, own: int, budget: int, most: int) -> np.ndarray:
    """For each of the first ``own`` items, where the batch after the one that begins with it begins; ``chars`` go on behind them for ``most`` items, or to the queue's end."""
    upto = np.append(0, np.cumsum(chars))
    at = np.arange(own)
    full = np.searchsorted(upto[1:], upto[:own] + budget, side="right")
    return np.minimum(np.maximum(np.minimum(full, at + most), at + 1), len(chars))


def block_step(after: np.ndarray, most: int) -> bytes:
    """A block as a step: for each offset below ``most`` at which a batch may begin, the offset of the first one behind the block and the batches between."""
    n = len(after)
    jump, count = np.append(after, np.arange(n, n + most + 1)), np.append(np.ones(n, np.int64), np.zeros(most + 1, np.int64))
    while (jump[:n] < n).any():
        count = count + count[jump]
        jump = jump[jump]
    return np.stack([jump[:most] - n, count[:most]]).astype(np.int64).tobytes()


def _table(step: bytes) -> np.ndarray:
    return np.frombuffer(step, np.int64).reshape(2, -1)


def _composed(a: bytes, b: bytes) -> bytes:
    x, y = _table(a), _table(b)
    return np.stack([y[0][x[0]], x[1] + y[1][x[0]]]).tobytes()


def _entered(state: bytes, step: bytes) -> bytes:
    (offset, batch), table = np.frombuffer(state, np.int64), _table(step)
    return np.array([table[0][offset], batch + table[1][offset]], np.int64).tobytes()


def greedy_batches(items: DataFrame, budget: int, most: int = MOST_ITEMS, order: tuple[str, ...] = ("position",), block: int = BLOCK) -> DataFrame:
    """(queue, nth, ``order``, batch) of items (queue, ``order``, chars): a batch takes items in order up to ``most`` and ``budget`` characters, one at least. ``nth`` numbers a queue's items."""
    block = max(block, most)
    own = items.select(F.col("queue").cast("string").alias("queue"), *order, F.coalesce("chars", F.lit(0)).cast("long").alias("chars"))
    placed = written(scan.numbered(own, "queue", list(order)), "placed")
    number = F.floor(F.col("nth") / block).cast("long")
    # A block also sees the first ``most`` items of the next one.
    shown = placed.select("queue", "nth", "chars", F.explode(F.when((F.col("nth") % block < most) & (number > 0), F.array(number, number - 1)).otherwise(F.array(number))).alias("block"))

    def packed(group: pa.Table) -> pa.Table:
        rows = group.sort_by("nth")
        n = min(len(rows), block)
        after = following(np.asarray(rows["chars"]), n, budget, most)
        return pa.table({"queue": rows["queue"][:1], "block": rows["block"][:1], "after": pa.array([after.astype(np.int32).tobytes()], pa.binary()), "step": pa.array([block_step(after, most)], pa.binary())})

    blocks = written(shown.groupBy("queue", "block").applyInArrow(packed, "queue string, block bigint, after binary, step binary"), "blocks")
    states = scan.entry_states(blocks.select("queue", "block", "step"), "queue", _composed, _entered, np.array([0, 0], np.int64).tobytes())
    b, s = blocks.alias("b"), states.alias("s")
    met = b.join(s, F.col("b.queue").eqNullSafe(F.col("s.queue")) & (F.col("b.block") == F.col("s.block"))).select("b.queue", "b.block", "b.after", "s.state")

    def marked(batches):
        for part in batches:
            for r in part.to_pylist():
                after, (at, batch) = np.frombuffer(r["after"], np.int32).tolist(), np.frombuffer(r["state"], np.int64).tolist()
                begins = np.zeros(len(after), np.int64)
                while at < len(after):
                    begins[at] = 1
                    at = after[at]
                nth = r["block"] * block + np.arange(len(after))
                yield pa.RecordBatch.from_arrays([pa.array([r["queue"]] * len(after), pa.string()), pa.array(nth), pa.array(batch - 1 + np.cumsum(begins))], names=["queue", "nth", "batch"])

    found = met.mapInArrow(marked, "queue string, nth bigint, batch bigint").alias("f")
    p = placed.alias("p")
    return p.join(found, F.col("p.queue").eqNullSafe(F.col("f.queue")) & (F.col("p.nth") == F.col("f.nth"))).select("p.queue", "p.nth", *[f"p.{c}" for c in order], "f.batch")


def next_budget(budget: Column, chars: Column, seconds: Column) -> Column:
    """The next batch's characters: as many as take ``TARGET_SECONDS`` at the measured speed, at most twice and at least half the last budget, inside the fixed bounds."""
    target = chars / seconds * TARGET_SECONDS
    bounded = F.greatest(F.least(target, budget * 2.0), budget / 2.0)
    return F.when((chars <= 0) | (seconds <= 0), budget).otherwise(F.floor(F.greatest(F.least(bounded, F.lit(float(MOST_BUDGET))), F.lit(float(LEAST_BUDGET))))).cast("long")


def soft_breaks(text: str, most: int = MOST_INPUT) -> Iterator[str]:
    """Pieces of at most ``most`` characters that end after the last break in their second half, if there is one; together they are the text."""
    at = 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            half = at + (end - at) // 2
            found = max((k + len(b) for b in BREAKS if (k := text.rfind(b, at, end)) >= half), default=0)
            end = found or end
        yield text[at:end]
        at = end


def soft_chunks(texts: DataFrame, key: str, text: str, most: int = MOST_INPUT) -> DataFrame:
    """(key, part, chunk) of each text's ``soft_breaks``."""

    def run(batches):
        for batch in batches:
            for k, value in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                pieces = list(soft_breaks(value or "", most))
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(pieces), batch.schema.field(0).type), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.string())], names=[key, "part", "chunk"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, part int, chunk string")


def reduced(summaries: DataFrame, budget: int, reduce: Callable[[Column], Column], block: int = BLOCK) -> DataFrame:
    """(queue, summary): the summaries (queue, position, summary) of each queue, reduced level by level under a budget of characters.

    Summaries are cut into pieces of half the budget (``LEAST_PIECE`` at least); empty ones are left out. A level's pieces are packed into batches by ``greedy_batches``, and ``reduce``
    makes one text of a batch's array of texts; a last batch of one piece goes on as it is. What a level leaves is the next level, until a queue has one batch: that is
    reduced if it has several pieces, and is the queue's summary. ``reduce`` must return less than it gets.
    """
    wide = max(LEAST_PIECE, budget // 2)
    n = F.length("summary")
    own = summaries.select(F.col("queue").cast("string").alias("queue"), F.col("position").cast("long").alias("position"), F.coalesce(F.col("summary").cast("string"), F.lit("")).alias("summary"))
    own = written(own, "summaries")
    cut = own.where(n > 0).select("queue", "position", "summary", F.posexplode(F.sequence(F.lit(1), n, F.lit(wide))).alias("piece", "at"))
    level = written(cut.select("queue", "position", "piece", F.substring(F.col("summary"), F.col("at"), F.lit(wide)).alias("text")), "level")
    order, done = ["position", "piece"], None
    size = level.agg(F.count("*"), F.sum(F.length("text"))).first()
    while size[0]:
        batch = greedy_batches(level.select("queue", *order, F.length("text").alias("chars")), budget, budget + 1, tuple(order), block)  # a piece has a character at least
        l, b = level.alias("l"), batch.alias("b")  # noqa: E741
        same = F.col("l.queue").eqNullSafe(F.col("b.queue"))
        for c in order:
            same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}"))
        groups = l.join(b, same).groupBy(F.col("l.queue").alias("queue"), F.col("b.batch").alias("position")).agg(F.sort_array(F.collect_list(F.struct("b.nth", "l.text"))).alias("t"))
        groups = groups.withColumn("t", F.transform("t", lambda x: x["text"]))  # as many characters as the budget
        last = groups.groupBy(F.col("queue").alias("q")).agg(F.max("position").alias("last"))
        groups = groups.join(last, F.col("queue").eqNullSafe(F.col("q")))
        alone = (F.size("t") == 1) & (F.col("position") == F.col("last"))
        got = written(groups.select("queue", "position", F.lit(0).alias("piece"), F.when(alone, F.get("t", F.lit(0))).otherwise(reduce(F.col("t"))).alias("text"), (F.col("last") == 0).alias("whole")), "level")
        whole = got.where("whole").select("queue", F.col("text").alias("summary"))
        done = whole if done is None else done.unionByName(whole)
        level = got.where(~F.col("whole") & (F.length("text") > 0)).drop("whole")
        before, size = size, level.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        if size[0] >= before[0] and size[1] >= before[1]:
            raise ValueError("reduce must return less than it gets")
    queues = own.select("queue").distinct()
    if done is None:
        return queues.withColumn("summary", F.lit(""))
    q, d = queues.alias("q"), done.alias("d")
    return q.join(d, F.col("q.queue").eqNullSafe(F.col("d.queue")), "left").select("q.queue", F.coalesce("d.summary", F.lit("")).alias("summary"))


def content_hashes(files: DataFrame) -> DataFrame:
    """(corpus, hash) of files (corpus, path, content; a null content is a deleted file): SHA-256 over ``path NUL content NUL`` in the order of the lower-cased paths.

    A digest is sequential, so a corpus streams through one task; of its files one is in memory.
    """

    def run(batches):
        import hashlib

        corpus, digest = None, None
        for part in batches:
            out = []
            for c, path, content in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                if digest is None or c != corpus:
                    if digest is not None:
                        out.append((corpus, digest.hexdigest()))
                    corpus, digest = c, hashlib.sha256()
                digest.update(path.encode() + b"\0" + (b"<deleted>" if content is None else content.encode("utf-8", "replace")) + b"\0")
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.string()), pa.array([h for _, h in out], pa.string())], names=["corpus", "hash"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([corpus], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["corpus", "hash"])

    from lumbra.functions.text import canonical_text, slashes

    own = files.select(F.col("corpus").cast("string"), slashes(F.col("path")).alias("path"), canonical_text(F.col("content")).alias("content"))
    return own.repartition("corpus").sortWithinPartitions("corpus", F.lower("path"), "path").mapInArrow(run, "corpus string, hash string")
