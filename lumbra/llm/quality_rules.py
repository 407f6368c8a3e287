"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Hashed unigrams and bigrams of words are counted in ``BUCKETS`` buckets: for the raw multinomial over all texts, for the target over all
trusted documents (quality label 1), these in ``FOLDS`` folds by a hash of their text. A document's score is the sum of
log p_target - log p_raw over its n-grams divided by their number. The threshold is fixed by trusted documents that the table has not
seen: each fold is scored with the counts of the others (also taken out of the raw counts), and the threshold is the score
that all but ``LOSS`` of them reach. Every document is thresholded; no draw is made.

Each task of the counting job sums its batches in one array per multinomial and emits it in slices; slices are summed per range of
buckets, so what reaches the driver is ``BUCKETS`` numbers for each multinomial, whatever the input.

Beside the score every document has base measures and base rules (too few words, too many words in repeated 3-word windows).

Defined results: null texts have no words and fail the base rules; without trusted documents the score is 0 and the
threshold lets everything pass; repeated rows are measured alike; an empty table gives an empty table; results take the place of columns
of the same name, others are only passed on.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flagged, judged
from .words import grams, word_hashes

BUCKETS = 1 << 16
SLICE = 1 << 12
FOLDS = 5
LOSS = 0.002
BINS = 20_000  # of the histogram of the trusted scores
MIN_WORDS, REPEAT_SHARE = 50, 50
_SIGNS = re.compile(r"[#*$%&|<>]")
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def buckets(words: np.ndarray) -> np.ndarray:
    """Bucket of each unigram and bigram."""
    h = np.concatenate([words, grams(words, 2)]) if len(words) > 1 else words
    return (h >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


def base_measures(text: str | None, raw: bytes, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not raw:
        return 0, 0, 0, 0, 0
    chars = len(text) - int(_GAP[np.frombuffer(raw, np.uint8)].sum())
    lines = [x for x in raw.split(b"\n") if x and x.strip(b" \t\n\v\f\r")]
    n, repeated = len(words), 0
    if n >= 3:
        windows = grams(words, 3)
        order = np.argsort(windows)
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(n, bool)
            at = order[np.append(same, False) | np.append(False, same)]
            twice[at] = twice[at + 1] = twice[at + 2] = True
            repeated = int(twice.sum())
    return n, chars, len(_SIGNS.findall(text)), len(lines) - len(set(lines)), repeated


@dataclass
class Ratio:
    table: np.ndarray  # log p_target - log p_raw of each bucket
    threshold: float = -np.inf

    def score(self, words: np.ndarray) -> float:
        return float(self.table[buckets(words)].mean()) if len(words) else 0.0


def _chunked(batches, size: int = 512):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            raw = [(t or "").encode("utf-8", "replace") for t in texts]
            yield part, texts, raw


def _count(marked: DataFrame) -> np.ndarray:
    """Bucket counts of the n-grams of all texts, then those of the trusted ones for each fold, from (text, trusted)."""
    rows = 1 + FOLDS

    def count(batches):
        total = np.zeros((rows, BUCKETS), np.int64)
        for part, _, raw in _chunked(batches):
            hashes = word_hashes(raw)
            of = [1 + zlib.crc32(r) % FOLDS if t else 0 for r, t in zip(raw, part.column(1).to_pylist(), strict=True)]
            for k in range(rows):
                got = [buckets(h) for h, f in zip(hashes, of, strict=True) if f == k and len(h)]
                if got:
                    total[k] += np.bincount(np.concatenate(got), minlength=BUCKETS)
        if total.any():
            total[0] = total.sum(0)
            k = BUCKETS // SLICE
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([total[:, i * SLICE : (i + 1) * SLICE].tobytes() for i in range(k)], pa.binary())], names=["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(blob, np.int64).reshape(rows, SLICE)
                sums[k] = sums[k] + got if k in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["slice", "counts"])

    kind, total = "slice int, counts binary", np.zeros((rows, BUCKETS), np.float64)
    for r in marked.select("text", "trusted").mapInArrow(count, kind).repartitionById(BUCKETS // SLICE, F.col("slice")).mapInArrow(add, kind).collect():
        total[:, r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64).reshape(rows, SLICE)
    return total


def ratio_table(target: np.ndarray, raw: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """log p_target - log p_raw of each bucket."""
    logs = [np.log((c + smooth) / (c.sum() + smooth * BUCKETS)) for c in (target, raw)]
    return logs[0] - logs[1]


def fit_ratio(documents: DataFrame, labels: DataFrame, keep: Column | None = None, loss: float = LOSS) -> Ratio:
    """``keep`` is a condition on the labels' doc_id."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (F.lit(True) if keep is None else keep)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    marked = flagged(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", good, "trusted")
    counts = _count(marked)
    target, raw = counts[1:], counts[0]
    if not target.any():
        return Ratio(np.zeros(BUCKETS))
    model = Ratio(ratio_table(target.sum(0), raw))
    unseen = [Ratio(ratio_table(target.sum(0) - t, raw - t)) for t in target]
    lo, hi = float(min(m.table.min() for m in unseen)), float(max(m.table.max() for m in unseen)) + 1e-9
    shared = documents.sparkSession.sparkContext.broadcast(unseen)

    def spread(batches):
        got = np.zeros(BINS, np.int64)
        own = shared.value
        for _, _, raw in _chunked(batches):
            scores = [own[zlib.crc32(r) % FOLDS].score(h) for r, h in zip(raw, word_hashes(raw), strict=True) if len(h)]
            got += np.histogram(scores, BINS, (lo, hi))[0]
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(got[at], pa.int64())], names=["bin", "n"])

    bins = np.zeros(BINS, np.int64)
    for r in marked.where("trusted").select("text").mapInArrow(spread, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        bins[r["bin"]] = r["n"]
    below = int(np.searchsorted(np.cumsum(bins), max(1, loss * bins.sum()), side="left"))
    model.threshold = lo + (hi - lo) * below / BINS if bins.sum() else -np.inf
    return model


def judge_quality(documents: DataFrame, model: Ratio, columns: list[str]) -> DataFrame:
    """``columns`` of every document with the base measures, the score, base_failed and kept."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> list:
        own, raw = shared.value, [(t or "").encode("utf-8", "replace") for t in texts]
        hashes = word_hashes(raw)
        got = np.array([base_measures(t, r, h) for t, r, h in zip(texts, raw, hashes, strict=True)], np.int64).reshape(len(texts), 5)
        score = np.array([own.score(h) for h in hashes], np.float64)
        failed = (got[:, 0] < MIN_WORDS) | (100 * got[:, 4] > REPEAT_SHARE * got[:, 0])
        return [*(pa.array(got[:, k]) for k in range(5)), pa.array(score), pa.array(failed), pa.array(~failed & (score >= own.threshold))]

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged(documents, columns, ["text"], run, ", ".join(f"{n} bigint" for n in names) + ", llr double, base_failed boolean, kept boolean")
