"""Runs of word bytes in batches of texts, found with numpy, and sums of arrays over all tasks.

Texts are handled in parts of about ``PART`` bytes: several whole texts, or a piece of one long text that ends at a gap. So memory is bounded for texts of any
length; only a single word longer than a part is held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z only


def gaps(*places: int | range) -> np.ndarray:
    """A table of the bytes that are in no word."""
    out = np.zeros(256, bool)
    for p in places:
        out[[p] if isinstance(p, int) else [*p]] = True
    return out


#: Bytes outside ASCII letters and digits; every byte of a character outside ASCII belongs to a word.
TERM_GAPS = gaps(range(0x30), range(0x3A, 0x61), range(0x7B, 0x80))


@dataclass
class Part:
    raw: np.ndarray  # A-Z lower-cased
    inside: np.ndarray  # is a byte of ``raw`` in a word
    start: np.ndarray  # of each word in ``raw``
    end: np.ndarray
    texts: np.ndarray  # number of each text that it holds
    begins: np.ndarray  # where each of them begins in ``raw``
    again: int  # leading words that the part before has shown already

    def of_text(self) -> np.ndarray:
        """The text of each word."""
        return self.texts[np.searchsorted(self.begins, self.start, side="right") - 1]

    def words(self) -> pa.Array:
        """All words, as they follow each other."""
        size = self.end - self.start
        offset = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=offset[1:])
        return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offset), pa.py_buffer(self.raw[self.inside])])


def _part(data: bytes, gap: np.ndarray, texts: np.ndarray, begins: np.ndarray, again: int) -> Part:
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = ~gap[raw]
    step = np.diff(word)
    return Part(raw, word[1:-1].view(bool), np.flatnonzero(step == 1), np.flatnonzero(step == -1), texts, begins, again)


def _long(data: bytes, number: int, gap: np.ndarray, keep: int) -> Iterator[Part]:
    is_gap = gap.astype(np.uint8).tobytes()
    begin = at = again = 0
    while at < len(data):
        end = at + PART
        while end < len(data):  # the part ends at a gap
            found = data[end : end + 65536].translate(is_gap).find(1)
            end = end + 65536 if found < 0 else end + found
            if found >= 0:
                break
        end = min(end, len(data))
        part = _part(data[begin:end], gap, np.array([number]), np.array([0]), again)
        yield part
        at, again = end, min(keep, len(part.start))
        begin = begin + int(part.start[-again]) if again else at


def parts(texts: list[str | None], gap: np.ndarray, keep: int = 0) -> Iterator[Part]:
    """The words of all texts. A later part of a long text repeats the ``keep`` words before it."""
    held, numbers, size = [], [], 0

    def together() -> Part:
        begins = np.zeros(len(held), np.int64)
        np.cumsum([len(h) + 1 for h in held[:-1]], out=begins[1:])
        return _part(b"\n".join(held), gap, np.array(numbers), begins, 0)

    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        if held and size + len(data) > PART:
            yield together()
            held, numbers, size = [], [], 0
        if len(data) > PART:
            yield from _long(data, k, gap, keep)
        else:
            held.append(data)
            numbers.append(k)
            size += len(data) + 1
    if held:
        yield together()


SLICE = 1 << 16


def array_sum(rows: DataFrame, length: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """The sum over all tasks of an int64 array of ``length``, which ``add(array, batch)`` fills in place; slices are summed apart, and ``length`` must be bounded."""
    k = -(-length // SLICE)
    kind = "slice int, sums binary"

    def count(batches):
        total = np.zeros(k * SLICE, np.int64)
        for batch in batches:
            add(total, batch)
        some = [i for i in range(k) if total[i * SLICE : (i + 1) * SLICE].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([total[i * SLICE : (i + 1) * SLICE].tobytes() for i in some], pa.binary())], names=["slice", "sums"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(blob, np.int64)
                sums[i] = sums[i] + got if i in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["slice", "sums"])

    out = np.zeros(k * SLICE, np.int64)
    for r in rows.mapInArrow(count, kind).repartitionById(min(k, 64), F.col("slice") % min(k, 64)).mapInArrow(merge, kind).toLocalIterator():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["sums"], np.int64)
    return out[:length]
