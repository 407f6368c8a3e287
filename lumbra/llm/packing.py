"""Packing: sum-of-squares online packing of token sequences.

A document's ids are cut into whole windows and a rest. Whole windows are sequences of their own. A rest goes, as it comes,
to the fill level where the sum of the squared numbers of partially filled windows at each level becomes least (a new window
is level 0; of equal levels the fullest). The numbers stand in a level array, so placing a rest is one numpy pass over it.
Every rest of a partition is placed so. At its end the windows that are still open are settled: the emptiest are cut
to fill the fullest, which leaves one partial window at most; what is held until then is the ids of rests, four bytes each, of one partition. Every partition of the input packs on its own, without a
shuffle; a sequence's number carries its partition.

Ids are those of a byte-level BPE vocabulary file for the ``tokenizers`` library, then an end id. The same vocabulary as ranks
gives the same ids three times faster with ``tiktoken``, which is used for ordinary texts; texts with very long runs
without a break go through ``tokenizers`` itself.

Defined results: null and empty texts have the end id alone; repeated rows are packed as often as they come; an empty
table gives an empty table; columns other than the identifier and the text are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
END_ID = 0
STEP_CHARS = 1_000_000
_BREAK = re.compile(r"(?<=\S) (?=\S)")  # tokens never span such a place: a token may only begin with the blank
_LONG = re.compile(r"\S{4000}|\s{4000}")
PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


class Encoder:
    """Ids of whole texts by a vocabulary file; ``ranks`` is the same vocabulary for tiktoken, or None."""

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        self.marks = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces whose ids, one after the other, are the ids of the text."""
        at = 0
        while len(text) - at > STEP_CHARS:
            cut = _BREAK.search(text, at + STEP_CHARS)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def ids(self, text: str | None) -> np.ndarray:
        out = []
        for piece in self.pieces(text or ""):
            if self.fast is None or any(m in piece for m in self.marks) or _LONG.search(piece):
                got = self.slow.encode(piece, add_special_tokens=False).ids
            else:
                got = self.fast.encode_ordinary(piece)
            out.append(np.array(got, np.uint32))
        return np.concatenate(out)


class Levels:
    """Open windows by fill level, and the level array with their numbers."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.sequence = 0

    def place(self, piece: tuple, size: int) -> list[list] | None:
        """Puts a piece of ``size`` < window; the window's pieces if it is now full."""
        room = self.window - size
        n = self.count
        # Change of the sum of squares if the piece goes to level h: -2 n[h] + 1 there and +2 n[h + size] + 1 at its new level.
        change = np.zeros(room + 1, np.int64)
        change[1:] = 1 - 2 * n[1 : room + 1] if room < self.window else 0
        change[:room] += 2 * n[size : size + room] + 1
        change[1 : room + 1][n[1 : room + 1] == 0] = 1 << 60  # no window there
        best = room - int(np.argmin(change[::-1]))
        if best:
            got = self.open[best].pop()
            n[best] -= 1
        else:
            got = []
        got.append(piece)
        if best + size == self.window:
            return got
        self.open[best + size].append(got)
        n[best + size] += 1
        return None

    def settle(self) -> Iterator[list]:
        """All open windows: the emptiest are cut to fill the fullest."""
        flat = [(h, w) for h in range(self.window - 1, 0, -1) for w in self.open[h]]
        self.count[:] = 0
        self.open = [[] for _ in range(self.window)]
        i, j, spare = 0, len(flat) - 1, []
        while i < j or (i == j and spare):
            fill, window = flat[i]
            i += 1
            while fill < self.window and (spare or i <= j):
                if not spare:
                    spare = flat[j][1][::-1]
                    j -= 1
                doc, start, ids, total = spare.pop()
                take = min(len(ids), self.window - fill)
                window.append((doc, start, ids[:take], total))
                fill += take
                if take < len(ids):
                    spare.append((doc, start + take, ids[take:], total))
            if fill == self.window:
                yield window
            else:
                flat = [(fill, window)]
                i, j, spare = 0, 0, []
                break
        if spare:
            flat, i, j = [(sum(len(p[2]) for p in spare), spare[::-1])], 0, 0
        for _, window in flat[i : j + 1]:
            yield window


def pack(documents: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str = "", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: its document, place there, sequence, offset in the sequence and its ids (32-bit, little-endian)."""

    def run(batches):
        encoder, levels = Encoder(vocabulary, ranks, pattern), Levels(window)
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def emit(pieces: list) -> None:
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), total, first + levels.sequence, offset, ids.tobytes()))
                offset += len(ids)
            levels.sequence += 1

        def flush():
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            rows.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                whole = len(ids) // window * window
                for start in range(0, whole, window):
                    emit([(doc, start, ids[start : start + window], len(ids))])
                if whole < len(ids):
                    full = levels.place((doc, whole, ids[whole:].copy(), len(ids)), len(ids) - whole)
                    if full:
                        emit(full)
                if len(rows) >= 2000:
                    yield flush()
        for full in levels.settle():
            emit(full)
        yield flush()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)
