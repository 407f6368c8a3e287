"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. A passage is encoded from the mean of its words' hashed embeddings
(the plain word and its shape) and a few measured shares; a gated attention layer, learned from document labels alone,
weighs the passages, and the weighted passage representation is scored by a logistic layer with Platt calibration.

Training uses a bounded sample of labelled rows (``SAMPLE_ROWS`` rows, texts up to ``SAMPLE_CHARS``); scoring reads every
passage of every text. The attention's softmax is summed up piece by piece, so memory stays bounded for any text.

Defined results: null, empty and blank texts are one empty passage; without labels of both classes every score is the share
of label 1 (0 without labels); repeated rows are scored alike; an empty table gives an empty table; ``quality_score`` takes the place of a
column of the same name, others than the text are only passed on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import STEP_WORDS, WordCodes, judged, labelled_sample, plain_word, platt, segments, sigmoid

SAMPLE_ROWS = 5000
SAMPLE_CHARS = 200_000
PASSAGE = 64
WORDS, SHAPES, DIM, SHARES, HIDDEN, GATE = 1 << 14, 1 << 10, 12, 9, 16, 8
_SIGNS = frozenset("#*$%&|<>{}\\^~=")


def word_code(word: bytes) -> int:
    """Packed: hash of the plain word (14 bits), of its shape (10 bits), upper, sign, digit, ends a sentence, length (6 bits), 32 more bits for repeats."""
    text = word.decode("utf-8", "replace")
    shape, last = [], ""
    for ch in text[:40]:
        kind = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        if kind != last:
            shape.append(kind)
            last = kind
    letters = [ch for ch in text if ch.isalpha()]
    upper = len(letters) > 1 and all(ch.isupper() for ch in letters)
    h = zlib.crc32(word)
    return (
        zlib.crc32(plain_word(word).encode()) % WORDS | (zlib.crc32("".join(shape).encode()) % SHAPES) << 14
        | upper << 24 | any(ch in _SIGNS for ch in text) << 25 | any(ch.isdigit() for ch in text) << 26 | (text[-1:] in ".!?:") << 27 | min(len(text), 15) << 28 | (h & 0x7FFFFFFF) << 32
    )


def passages(pieces: list[list[int]]):
    """Words of all pieces in one row, where each passage starts, and the piece of each passage. An empty piece is one empty passage (a zero word)."""
    lengths = np.fromiter((max(1, len(p)) for p in pieces), np.int64, len(pieces))
    codes = np.zeros(int(lengths.sum()), np.int64)
    starts = np.cumsum(lengths) - lengths
    for s, p in zip(starts, pieces, strict=True):
        codes[s : s + len(p)] = p
    per = (lengths + PASSAGE - 1) // PASSAGE
    piece_of = np.repeat(np.arange(len(pieces)), per)
    nth = np.arange(len(piece_of)) - np.repeat(np.cumsum(per) - per, per)
    return codes, np.repeat(starts, per) + nth * PASSAGE, piece_of, lengths


def repeats(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: does it come again in its document, does the trigram that it begins."""
    n = len(codes)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    word = (codes >> 32).astype(np.uint64)

    def repeated(key: np.ndarray) -> np.ndarray:
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        return count[back] > 1

    mixed = (word + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    second, third = np.append(word[1:], np.uint64(0)), np.append(word[2:], np.zeros(min(2, n), np.uint64))[:n]
    gram = mixed ^ ((second + np.uint64(7)) * np.uint64(0x165667B19E3779F9)) ^ ((third + np.uint64(3)) * np.uint64(0x27D4EB2F165667C5))
    last = np.cumsum(lengths)
    for back in (1, 2):  # windows that leave the document never repeat
        ends = last - back
        ends = ends[ends >= 0]
        gram[ends] = np.arange(len(ends), dtype=np.uint64) * np.uint64(2) + np.uint64(back)
    return repeated(mixed), repeated(gram)


def measured(codes: np.ndarray, at: np.ndarray, again: tuple[np.ndarray, np.ndarray], whole: np.ndarray) -> np.ndarray:
    """Per passage: shares of upper-case, sign, digit, sentence-ending and repeated words, of words in repeated trigrams, mean word length, fill, log document length (of ``whole`` words)."""
    size = np.diff(np.append(at, len(codes))).astype(np.float64)
    columns = [(codes >> b) & 1 for b in (24, 25, 26, 27)] + [*again, (codes >> 28) & 15]
    sums = [np.add.reduceat(c.astype(np.float64), at) / size for c in columns]
    sums[6] /= 8
    return np.column_stack([*sums, size / PASSAGE, np.log1p(whole) / 8]).astype(np.float32)


@dataclass
class AttentionMil:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0
    prior: float | None = None

    @classmethod
    def fresh(cls, seed: int) -> AttentionMil:
        rng = np.random.default_rng(seed)
        normal = lambda s, *shape: rng.normal(0, s, shape).astype(np.float32)
        wide = DIM + SHARES
        return cls({
            "words": normal(0.05, WORDS, DIM), "shapes": normal(0.3, SHAPES, DIM), "enc": normal(wide**-0.5, wide, HIDDEN), "enc_b": np.zeros(HIDDEN, np.float32),
            "v": normal(HIDDEN**-0.5, HIDDEN, GATE), "u": normal(HIDDEN**-0.5, HIDDEN, GATE), "att": normal(GATE**-0.5, GATE), "out": normal(0.3, HIDDEN), "out_b": np.zeros(1, np.float32),
        })

    def encode(self, pieces: list[list[int]], again: tuple[np.ndarray, np.ndarray] | None = None, words: int | None = None):
        """``again`` and ``words`` are those of the whole document where a piece is a part of one."""
        codes, at, piece_of, lengths = passages(pieces)
        again = repeats(codes, lengths) if again is None else again
        whole = lengths[piece_of] if words is None else np.full(len(piece_of), words)
        word, shape = codes & (WORDS - 1), (codes >> 14) & (SHAPES - 1)
        size = np.diff(np.append(at, len(codes)))[:, None]
        mean = np.add.reduceat(self.p["words"][word] + self.p["shapes"][shape], at, axis=0) / size
        z = np.hstack([mean, measured(codes, at, again, whole)]).astype(np.float32)
        h = np.tanh(z @ self.p["enc"] + self.p["enc_b"])
        tv, su = np.tanh(h @ self.p["v"]), sigmoid(h @ self.p["u"])
        return h, (tv * su) @ self.p["att"], piece_of, (word, shape, at, size, z, tv, su)

    def logits(self, codes: list[list[int]]) -> np.ndarray:
        weight, total = np.zeros(len(codes)), np.zeros((len(codes), HIDDEN))

        def add(h, e, doc):
            a = np.exp(np.clip(e, -30, 30))
            np.add.at(weight, doc, a)
            np.add.at(total, doc, a[:, None] * h)

        long = [i for i, words in enumerate(codes) if len(words) > STEP_WORDS]
        for part in segments([[] if i in long else words for i, words in enumerate(codes)], 0):
            part = [(i, p) for i, p in part if i not in long]
            if part:
                h, e, piece_of, _ = self.encode([p for _, p in part])
                add(h, e, np.array([i for i, _ in part])[piece_of])
        for i in long:  # whole passages in each piece, measured against the whole document
            words = np.array(codes[i], np.int64)
            again = repeats(words, np.array([len(words)]))
            for at in range(0, len(words), STEP_WORDS // PASSAGE * PASSAGE):
                piece = slice(at, at + STEP_WORDS // PASSAGE * PASSAGE)
                h, e, piece_of, _ = self.encode([words[piece]], (again[0][piece], again[1][piece]), len(words))
                add(h, e, np.full(len(piece_of), i))
        return total / np.maximum(weight, 1e-30)[:, None] @ self.p["out"] + self.p["out_b"][0]

    def score(self, codes: list[list[int]]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(codes), self.prior)
        return np.round(sigmoid(self.scale * self.logits(codes) + self.shift), 6)  # the same in any batch

    def learn(self, pieces: list[list[int]], y: np.ndarray, weight: np.ndarray, rate: float, state: dict) -> None:
        """One Adagrad step on a batch of documents."""
        p = self.p
        h, e, bag, (word, shape, at, size, z, tv, su) = self.encode(pieces)
        starts = np.flatnonzero(np.append(True, bag[1:] != bag[:-1]))
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        doc = np.add.reduceat(a[:, None] * h, starts, axis=0)
        err = ((sigmoid(doc @ p["out"] + p["out_b"]) - y) * weight / len(y)).astype(np.float32)
        g_doc = err[:, None] * p["out"]
        toward = (g_doc[bag] * h).sum(1)
        g_e = a * (toward - np.add.reduceat(a * toward, starts)[bag])
        g_gate = g_e[:, None] * p["att"]
        g_tv, g_su = g_gate * su * (1 - tv * tv), g_gate * tv * su * (1 - su)
        g_h = a[:, None] * g_doc[bag] + g_tv @ p["v"].T + g_su @ p["u"].T
        g_pre = (g_h * (1 - h * h)).astype(np.float32)
        grads = {"out": doc.T @ err, "out_b": err.sum(keepdims=True), "att": (tv * su).T @ g_e, "v": h.T @ g_tv, "u": h.T @ g_su, "enc": z.T @ g_pre, "enc_b": g_pre.sum(0)}
        g_mean = (g_pre @ p["enc"][:DIM].T / size).astype(np.float32)
        g_word = np.repeat(g_mean, np.diff(np.append(at, len(word))), axis=0)
        for name, g in grads.items():
            seen = state.setdefault(name, np.full_like(p[name], 1e-6))
            g = (g + 1e-5 * p[name]).astype(np.float32)
            seen += g * g
            p[name] -= rate * g / np.sqrt(seen)
        for name, ids in (("words", word), ("shapes", shape)):
            order = np.argsort(ids, kind="stable")
            own, first = np.unique(ids[order], return_index=True)
            g = np.add.reduceat(g_word[order], first, axis=0)
            seen = state.setdefault(name, np.full_like(p[name], 1e-6))
            seen[own] += g * g
            p[name][own] -= rate * g / np.sqrt(seen[own])


def train(sample: Iterable[tuple[str, int]], epochs: int = 5, batch: int = 32, seed: int = 5) -> AttentionMil:
    """A calibrated classifier from (text, label); every fifth row is kept for the calibration."""
    ids, codes, y = WordCodes(word_code), [], []
    for text, label in sample:
        codes.append(ids.packed(text, np.int64))
        y.append(label)
    y = np.array(y, np.float32)
    if len(codes) < 10 or y.min() == y.max():
        return AttentionMil(prior=float(y.mean()) if len(y) else 0.0)
    model, state, rng = AttentionMil.fresh(seed), {}, np.random.default_rng(seed)
    fit, held = [i for i in range(len(codes)) if i % 5], [i for i in range(len(codes)) if i % 5 == 0]
    if y[held].min() == y[held].max():
        held = fit
    share = float(y[fit].mean())
    weight = np.where(y == 1, min(4.0, 0.5 / max(share, 1e-3)), min(4.0, 0.5 / max(1 - share, 1e-3))).astype(np.float32)
    epochs = max(epochs, min(40, 400 * batch // max(1, len(fit))))
    for e in range(epochs):
        order = rng.permutation(fit)
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            model.learn([codes[i] for i in part], y[part], weight[part], 0.05 / (1 + 0.5 * e), state)
    model.scale, model.shift = platt(model.logits([codes[i] for i in held]), y[held])
    return model


def fit_quality(documents: DataFrame, labels: DataFrame, keep: Column, rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> AttentionMil:
    return train((r["text"], r["y"]) for r in labelled_sample(documents, labels, "quality", keep, rows, max_chars))


def score_quality(documents: DataFrame, model: AttentionMil, columns: list[str]) -> DataFrame:
    """``columns`` of every document with ``quality_score``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    words = WordCodes(word_code)
    return judged(documents, columns, ["text"], lambda texts: [pa.array(shared.value.score([words.of(t) for t in texts]))], "quality_score double")
