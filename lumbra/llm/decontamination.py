"""Benchmark decontamination: Wu-Manber multi-pattern search for windows of benchmark words.

A text is reduced to its words, A-Z lower-cased, with one blank before and after each; a window of an item is such a string too, so an occurrence is a plain
substring. Windows are searched in classes of similar length. For a class with shortest window of ``m`` bytes, a table gives for each hashed block of ``B`` bytes
how far the search may move on, because no window has that block nearer to its ``m``-th byte. Where it may not move, the block is at that place in some windows:
they stand in the bucket of its hash and are compared directly. All stretches of a part of the texts are searched at once, a cursor in each.

A benchmark is searched in blocks of at most ``BLOCK_CHARS`` characters of its items, each one a broadcast of bounded size; texts pass through the blocks one after
the other in the same tasks, so nothing is shuffled. A single longer item is a block of its own.

Defined results: null texts have no words; null and wordless items have no windows; an item of fewer words than a window is one window; rows with the same item_id
are one item, and items without an id are the item ''; repeated documents are searched alike; an empty benchmark hits nothing; an empty table gives an
empty table; results take the place of columns of the same name, others are only passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TERM_GAPS, Part, parts

WORDS = 10  # of a window
BLOCK_CHARS = 1 << 24
STRETCH = 2048  # bytes that a cursor searches
PAIRS = 1 << 20  # places and windows that are compared at once
_PAD = 8


def item_windows(text: str | None, n: int = WORDS) -> set[bytes]:
    """The windows of an item as searched for."""
    words = [w for part in parts([text], TERM_GAPS, 0) for w in part.words().to_pylist()]
    return {b" " + b" ".join(words[k : k + n]) + b" " for k in range(max(1, len(words) - n + 1))} if words else set()


@dataclass
class LengthClass:
    """Windows of similar length, sorted by the hash of the block that ends at their ``m``-th byte."""

    m: int
    block: int  # bytes
    bits: int
    shift: np.ndarray
    slots: np.ndarray  # of each window, ascending
    windows: np.ndarray  # number of each window, in that order


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _slot(block: np.ndarray, bits: int) -> np.ndarray:
    return ((block * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def _last_bytes(padded: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` (at most 8) bytes before each place of a text that follows ``_PAD`` bytes, as a number."""
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    return eight[ends + _PAD - 8] >> np.uint64(8 * (8 - n))


class Windows:
    """What is broadcast: the windows, the items that have them, and the tables of each length class."""

    def __init__(self, items: list[tuple[str, str | None]], n: int = WORDS):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in item_windows(text, n):
                owners.setdefault(w, set()).add(item)
        order = sorted(owners, key=lambda w: (len(w), w))
        self.words = n
        self.items = [sorted(owners[w]) for w in order]
        self.length = np.array([w.count(b" ") - 1 for w in order], np.int64)
        self.size = np.array([len(w) for w in order], np.int64)
        self.begin = np.zeros(len(order), np.int64)
        np.cumsum(self.size[:-1], out=self.begin[1:])
        self.text = np.frombuffer(b"\0" * _PAD + b"".join(order), np.uint8)
        self.classes = []
        at = 0
        while at < len(order):  # a class holds windows up to half as long again as its shortest, so short items don't spoil the shifts of long ones
            m = int(self.size[at])
            end = int(np.searchsorted(self.size, m + max(2, m // 2), side="right"))
            self.classes.append(self._class(at, end, m))
            at = end

    def _class(self, at: int, end: int, m: int) -> LengthClass:
        block = next(b for b in (8, 5, 3) if m >= 2 * b or b == 3)
        places = (end - at) * (m - block + 1)
        bits = min(24, max(12, (8 * places).bit_length()))
        shift = np.full(1 << bits, m - block + 1, np.uint16)
        begin = self.begin[at:end]
        for last in range(block, m + 1):  # the nearest place counts, so later ones overwrite
            slots = _slot(_last_bytes(self.text, begin + last, block), bits)
            shift[slots] = m - last
        order = np.argsort(slots, kind="stable")
        return LengthClass(m, block, bits, shift, slots[order], np.arange(at, end)[order])

    def found(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of all occurrences in ``text``, which follows ``_PAD`` bytes."""
        got = [self._found(c, text) for c in self.classes]
        return (np.concatenate([p for p, _ in got]), np.concatenate([w for _, w in got])) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _found(self, c: LengthClass, padded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(padded) - _PAD
        ends = np.arange(c.m, n + 1, STRETCH)  # a cursor stands behind the m-th byte of a window that may be there
        until = np.minimum(ends + STRETCH, n + 1)
        hits: list[np.ndarray] = []
        while len(ends):
            slots = _slot(_last_bytes(padded, ends, c.block), c.bits)
            step = c.shift[slots].astype(np.int64)
            stay = step == 0
            if stay.any():
                hits.append(np.stack([ends[stay], slots[stay]]))
                step[stay] = 1
            ends = ends + step
            on = ends < until
            if not on.all():
                ends, until = ends[on], until[on]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends, slots = np.concatenate(hits, axis=1)
        first, last = np.searchsorted(c.slots, slots, side="left"), np.searchsorted(c.slots, slots, side="right")
        out = [self._compared(c, padded, ends[a:b] - c.m, first[a:b], last[a:b]) for a, b in _slices(last - first)]
        return np.concatenate([p for p, _ in out]), np.concatenate([w for _, w in out])

    def _compared(self, c: LengthClass, padded: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and windows of a bucket that are equal, byte by byte: eight at a time, those left after each step."""
        many = last - first
        place = np.repeat(place, many)
        window = c.windows[np.repeat(last - np.cumsum(many), many) + np.arange(len(place))]
        fits = place + self.size[window] <= len(padded) - _PAD
        place, window = place[fits], window[fits]
        done, out = 0, []
        while len(place):
            left = np.minimum(self.size[window] - done, 8)
            drop = (8 * (8 - left)).astype(np.uint64)
            same = _last_bytes(padded, place + done + left, 8) >> drop == _last_bytes(self.text, self.begin[window] + done + left, 8) >> drop
            place, window = place[same], window[same]
            done += 8
            whole = self.size[window] <= done
            out.append((place[whole], window[whole]))
            place, window = place[~whole], window[~whole]
        return (np.concatenate([p for p, _ in out]), np.concatenate([w for _, w in out])) if out else (place, window)


def _slices(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``PAIRS`` pairs each."""
    total, at = np.cumsum(counts), 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        yield at, end
        at = end


def spaced(part: Part) -> tuple[np.ndarray, np.ndarray]:
    """The part's texts as searched (each `` w w w `` and a NUL, behind ``_PAD`` bytes), and where each word begins there."""
    size = part.end - part.start
    text = np.searchsorted(part.begins, part.start, side="right") - 1
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    # Before each word stands a blank; after the last of a text a blank and a NUL.
    begin = _PAD + 1 + np.append(0, np.cumsum(size + 1 + 2 * last)[:-1]) if len(size) else size
    out = np.full(_PAD + int((size + 1 + 2 * last).sum()), 0x20, np.uint8)
    out[:_PAD] = 0
    mask = np.zeros(len(out) + 1, np.int8)
    mask[begin] += 1
    mask[begin + size] -= 1
    out[np.cumsum(mask[:-1], dtype=np.int8).view(bool)] = part.raw[part.inside]
    out[(begin + size + 1)[last]] = 0
    return out, begin - _PAD


def _joined(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans (first, last word) in order, from any; spans that touch are one."""
    if len(spans) < 2:
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1] + 1)
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.stack([spans[new, 0], reach[ends]], 1)


def search(texts: list[str | None], windows: Windows) -> list[tuple[int, np.ndarray, list[str]]]:
    """For each text: the number of its words, the spans (first, last word) that occurrences cover, and the items that occur."""
    words, spans, items = np.zeros(len(texts), np.int64), [[] for _ in texts], [set() for _ in texts]
    for part in parts(texts, TERM_GAPS, keep=windows.words - 1):
        text, begin = spaced(part)
        own = part.of_text()
        numbers, first = np.unique(own, return_index=True)
        before = words[numbers] - part.again  # words of each text before this part; only a part of one text repeats any
        place, window = windows.found(text)
        if len(place):
            at = np.searchsorted(begin, place + 1)  # the word that an occurrence begins with
            inside = np.searchsorted(numbers, own[at])
            start = at - first[inside] + before[inside]
            for t in np.unique(own[at]):
                mine = own[at] == t
                spans[t].append(np.stack([start[mine], start[mine] + windows.length[window[mine]] - 1], 1))
                items[t].update(i for w in np.unique(window[mine]) for i in windows.items[w])
        words[numbers] += np.diff(np.append(first, len(own))) - part.again
    return [(int(n), _joined(np.concatenate(s)) if s else np.zeros((0, 2), np.int64), sorted(i)) for n, s, i in zip(words, spans, items, strict=True)]


def item_blocks(benchmark: DataFrame, n: int = WORDS, chars: int = BLOCK_CHARS) -> Iterator[tuple[Windows, bool]]:
    """The windows of benchmark (item_id, text), block by block, each of about ``chars`` characters at most, and whether a block is the last."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // chars))
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield Windows([(r["item"], r["text"]) for r in own.collect()], n), k == blocks - 1  # about half of ``chars``


FOUND = ("n_words", "spans", "items")


def find_passages(documents: DataFrame, benchmark: DataFrame, columns: list[str], n: int = WORDS, chars: int = BLOCK_CHARS) -> DataFrame:
    """``columns`` of every document with ``n_words``, ``spans`` (first and last word, from 0, of each run of words that windows of ``benchmark`` cover) and ``items`` (their item_ids as
    strings, sorted)."""
    kept = [c for c in columns if c not in FOUND]
    whole = F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias("_")).alias("_all")
    rows = documents.select(whole, F.col("text").cast("string").alias("_text"), F.lit(0).cast("long").alias("_n"), F.array().cast("array<bigint>").alias("_spans"), F.array().cast("array<string>").alias("_items"))
    kind = f"_all {rows.schema['_all'].dataType.simpleString()}, _text string, _n bigint, _spans array<bigint>, _items array<string>"
    for windows, last in item_blocks(benchmark, n, chars):
        shared = documents.sparkSession.sparkContext.broadcast(windows)

        def steps(batches, shared=shared, last=last):
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    got = search(part.column(1).to_pylist(), shared.value)
                    spans = [_joined(np.concatenate([np.array(old, np.int64).reshape(-1, 2), new])) if old else new for old, (_, new, _) in zip(part.column(3).to_pylist(), got, strict=True)]
                    items = [sorted({*old, *new}) if old else new for old, (_, _, new) in zip(part.column(4).to_pylist(), got, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.nulls(len(part), pa.string()) if last else part.column(1), pa.array([x for x, _, _ in got], pa.int64()), pa.array([x.ravel() for x in spans], pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                        names=["_all", "_text", "_n", "_spans", "_items"],
                    )

        rows = rows.mapInArrow(steps, kind)
    pairs = F.transform(F.sequence(F.lit(1), F.size("_spans"), F.lit(2)), lambda k: F.struct(F.element_at("_spans", k).alias("first"), F.element_at("_spans", k + 1).alias("last")))
    spans = F.when(F.size("_spans") > 0, pairs).otherwise(F.array().cast("array<struct<first:bigint,last:bigint>>"))
    return rows.select(*[F.col(f"_all.`{c}`").alias(c) for c in kept], F.col("_n").alias("n_words"), spans.alias("spans"), F.col("_items").alias("items"))


def without_benchmark(documents: DataFrame, benchmark: DataFrame, n: int = WORDS) -> DataFrame:
    """The documents in which no window of ``benchmark`` occurs, with their columns."""
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), F.col("text").cast("string").alias("text"))
    return find_passages(whole, benchmark, ["_row"], n).where(F.size("items") == 0).select("_row.*")
