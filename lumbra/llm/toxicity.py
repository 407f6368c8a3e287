"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of two hashed embeddings (two independent halves of one 32-bit hash, so that two words share both
only by a rare accident). Filters of several widths slide over the words, the maximum of each filter over the whole text is
taken, and a logistic layer scores the document. The raw score is calibrated (Platt) on rows kept out of training, and a
threshold is calibrated for each language on the same rows, drawn towards that of all rows.

Training uses a bounded sample of labelled rows (``SAMPLE_ROWS`` rows, texts up to ``SAMPLE_CHARS``); scoring reads every
whole text, in pieces of bounded size whose maxima are combined.

Defined results: null, empty and blank texts are scored like a text without words; without labels of both classes every
score is the share of label 1 (0 without labels); repeated rows are scored alike; an empty table gives an empty table; results take the
place of columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordCodes, judged, labelled_sample, platt, segments, sigmoid, word_hash

SAMPLE_ROWS = 10_000
SAMPLE_CHARS = 200_000
PRIOR_ROWS = 50  # what all languages together weigh in a language's threshold
HALF, DIM, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 12
PAD = HALF  # a zero row at the end of each embedding table


@dataclass
class TextCnn:
    tables: list[np.ndarray] = field(default_factory=list)
    filters: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS), np.float32))
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    prior: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.3

    @classmethod
    def fresh(cls, seed: int) -> TextCnn:
        rng = np.random.default_rng(seed)
        tables = [np.vstack([rng.normal(0, 0.1, (HALF, DIM)), np.zeros((1, DIM))]).astype(np.float32) for _ in range(2)]
        filters = [rng.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(tables, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32))

    @staticmethod
    def flat(pieces: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both hash halves of all words, each piece followed by pads, where pieces start, and which places are words."""
        pads = max(WIDTHS) - 1 or 1
        lengths = np.fromiter((len(p) + pads for p in pieces), np.int64, len(pieces))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        codes = np.zeros(int(lengths.sum()), np.uint32)
        real = np.zeros(len(codes), bool)
        for s, p in zip(starts, pieces, strict=True):
            codes[s : s + len(p)] = p
            real[s : s + len(p)] = True
        low, high = (codes & (HALF - 1)).astype(np.int64), (codes >> 16).astype(np.int64)
        low[~real] = high[~real] = PAD
        return low, high, starts, real

    def convolve(self, pieces: list[list[int]]):
        """Maxima of each filter over each piece, with the words' vectors and the winning places for training."""
        low, high, starts, real = self.flat(pieces)
        x = self.tables[0][low] + self.tables[1][high]
        n = len(x)
        padded = np.vstack([x, np.zeros((max(WIDTHS) - 1, DIM), np.float32)])
        maxima, acts = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            act = padded[:n] @ f[:DIM]
            for k in range(1, w):
                act += padded[k : k + n] @ f[k * DIM : (k + 1) * DIM]
            act[~real] = 0  # a window that begins after the piece is empty, whatever comes next
            act += b
            maxima.append(np.maximum.reduceat(act, starts, axis=0))
            acts.append(act)
        return np.hstack(maxima), (low, high, starts, real, padded, acts)

    def logits(self, codes: list[list[int]]) -> np.ndarray:
        best = np.full((len(codes), len(self.out)), -np.inf, np.float32)
        for part in segments(codes, max(WIDTHS) - 1):
            got, _ = self.convolve([p for _, p in part])
            np.maximum.at(best, [i for i, _ in part], got)
        return np.maximum(best, 0) @ self.out + self.bias

    def score(self, codes: list[list[int]]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(codes), self.prior)
        return np.round(sigmoid(self.scale * self.logits(codes).astype(np.float64) + self.shift), 6)  # the same in any batch

    def learn(self, pieces: list[list[int]], y: np.ndarray, weight: np.ndarray, rate: float, state: dict) -> None:
        """One Adagrad step on a batch of documents."""
        pooled, (low, high, starts, real, padded, acts) = self.convolve(pieces)
        relu = np.maximum(pooled, 0)
        p = sigmoid(relu @ self.out + self.bias)
        err = ((p - y) * weight / len(y)).astype(np.float32)

        def step(name: str, value: np.ndarray, grad: np.ndarray) -> None:
            seen = state.setdefault(name, np.full_like(value, 1e-6))
            seen += grad * grad
            value -= rate * grad / np.sqrt(seen)

        grad_pool = err[:, None] * self.out[None, :] * (pooled > 0)
        step("out", self.out, relu.T @ err + 1e-4 * self.out)
        bias = np.array([self.bias], np.float32)
        step("bias", bias, np.array([err.sum()], np.float32))
        self.bias = float(bias[0])
        rows, grads = [], []
        ends = np.append(starts[1:], len(low))
        piece_of = np.repeat(np.arange(len(starts)), ends - starts)
        for k, (w, f, b, act) in enumerate(zip(WIDTHS, self.filters, self.biases, acts, strict=True)):
            g = grad_pool[:, k * FILTERS : (k + 1) * FILTERS]
            top = pooled[:, k * FILTERS : (k + 1) * FILTERS]
            at = np.empty(g.shape, np.int64)
            for j in range(FILTERS):  # the first place of each maximum
                hit = np.flatnonzero(act[:, j] == top[piece_of, j])
                _, first = np.unique(piece_of[hit], return_index=True)
                at[:, j] = hit[first]
            grad_f = np.zeros_like(f)
            for off in range(w):
                at_off = np.minimum(at + off, len(padded) - 1)
                inside = at_off < len(low)
                vec = padded[at_off] * real[at][..., None]
                grad_f[off * DIM : (off + 1) * DIM] = np.einsum("bfd,bf->df", vec, g)
                live = (g != 0) & inside & real[at]
                rows.append(at_off[live])
                grads.append(g[live][:, None] * f[off * DIM : (off + 1) * DIM].T[np.nonzero(live)[1]])
            step(f"f{w}", f, grad_f + 1e-5 * f)
            step(f"b{w}", b, g.sum(0))
        rows, grads = np.concatenate(rows), np.concatenate(grads)
        for name, table, ids in (("low", self.tables[0], low), ("high", self.tables[1], high)):
            own, back = np.unique(ids[rows], return_inverse=True)
            total = np.zeros((len(own), DIM), np.float32)
            np.add.at(total, back, grads)
            total[own == PAD] = 0
            seen = state.setdefault(name, np.full((HALF + 1, DIM), 1e-6, np.float32))
            seen[own] += total * total
            table[own] -= rate * total / np.sqrt(seen[own])


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray, default: float) -> float:
    """The threshold with the least weight of errors; of equals, the middle of the gap nearest to ``default``."""
    if len(set(y.tolist())) < 2:
        return default
    cuts = np.unique(np.concatenate([p, [0.0, 1.0]]))
    mids = np.append((cuts[1:] + cuts[:-1]) / 2, default)
    errors = np.array([weight[(p >= m) != (y == 1)].sum() for m in mids])
    best = mids[errors <= errors.min() + 1e-9]
    return float(best[np.abs(best - default).argmin()])


def train(sample: Iterable[tuple[str, int, str | None]], epochs: int = 10, batch: int = 32, seed: int = 7, default: float = 0.3) -> TextCnn:
    """A calibrated classifier from (text, label, language); every fifth row is kept for the calibration."""
    ids, codes, y, langs = WordCodes(word_hash), [], [], []
    for text, label, lang in sample:
        codes.append(ids.packed(text, np.uint32))
        y.append(label)
        langs.append(lang or "")
    y = np.array(y, np.float32)
    if len(codes) < 10 or y.min() == y.max():
        return TextCnn(prior=float(y.mean()) if len(y) else 0.0, threshold=default)
    model, state, rng = TextCnn.fresh(seed), {}, np.random.default_rng(seed)
    fit, held = [i for i in range(len(codes)) if i % 5], [i for i in range(len(codes)) if i % 5 == 0]
    if y[held].min() == y[held].max():
        held = fit
    share = y[fit].mean()
    model.bias = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    weight = np.where(y == 1, min(4.0, 0.5 / max(share, 1e-3)), 1.0).astype(np.float32)
    epochs = max(epochs, min(60, 1200 * batch // max(1, len(fit))))
    for e in range(epochs):
        order = rng.permutation(fit)
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            model.learn([codes[i] for i in part], y[part], weight[part], 0.08 / (1 + 0.15 * e * 10 / epochs), state)
    logit = model.logits([codes[i] for i in held]).astype(np.float64)
    model.scale, model.shift = platt(logit, y[held])
    p = sigmoid(model.scale * logit + model.shift)
    model.threshold = best_threshold(p, y[held], np.ones(len(held)), default)
    langs = np.array(langs)[held]
    for lang in sorted(set(langs.tolist())):  # all rows together count as PRIOR_ROWS of the language
        model.thresholds[lang] = best_threshold(p, y[held], (langs == lang) + PRIOR_ROWS / len(held), model.threshold)
    return model


def fit_toxicity(documents: DataFrame, labels: DataFrame, keep: Column, rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> TextCnn:
    """The language of a sampled row is only used for the thresholds."""
    own = documents.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    return train((r["text"], r["y"], r["lang"]) for r in labelled_sample(own, labels, "toxic", keep, rows, max_chars, ("lang",)))


def score_toxicity(documents: DataFrame, model: TextCnn, columns: list[str]) -> DataFrame:
    """``columns`` of every document with ``tox_score``, its language's calibrated ``tox_threshold`` and ``toxic_found``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    words = WordCodes(word_hash)

    def run(texts: list, langs: list) -> list:
        own = shared.value
        score = own.score([words.of(t) for t in texts])
        cut = np.array([own.thresholds.get(x or "", own.threshold) for x in langs], np.float64)
        return [pa.array(score), pa.array(cut), pa.array(score >= cut)]

    return judged(documents, columns, ["text", "lang"], run, "tox_score double, tox_threshold double, toxic_found boolean")


def without_toxic(documents: DataFrame, model: TextCnn) -> DataFrame:
    """The documents under their language's threshold, with their columns."""
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("whole"), "text", "lang")
    return score_toxicity(whole, model, ["whole"]).where(~F.col("toxic_found")).select("whole.*")
