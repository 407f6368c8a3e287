"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

A text's subwords are the character n-grams (``NGRAMS``) of its lower-cased letter runs with a mark at both ends; other
characters separate words. Their hashed embeddings are averaged and a linear softmax gives the languages' probabilities,
made honest by a temperature fitted on rows kept out of training. ``lang_rejected`` is the calibrated rejection: the
probability is under the level down to which the kept rows are right in a share of ``TRUST``, or under that of all but ``LOSS`` of the
kept rows that are right.

Training uses a bounded sample of labelled rows (``SAMPLE_ROWS`` rows, texts up to ``SAMPLE_CHARS``); prediction averages over
all subwords of every text, piece by piece; pieces end between letter runs, so memory is bounded but for a single run (a text in a script without gaps is one piece).

Defined results: a text that is null or has no letter is ``und`` with score 0; with no language to learn from every text is
``und``; ties go to the language that sorts first; repeated rows are judged alike; an empty table gives an empty table; results take the place
of columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import judged, sampled

SAMPLE_ROWS = 3000
SAMPLE_CHARS = 60_000
NGRAMS = (1, 2, 3, 4)
BUCKETS, DIM = 1 << 15, 16
STEP_CHARS = 400_000
TRUST, LOSS = 0.9, 0.005
_LETTER = regex.compile(r"\p{L}")
_GAP = regex.compile(r"[^\p{L}\p{M}]+")
_MIX = [np.uint32(x) for x in (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)]  # fixed values: odd multipliers of the rolling hash


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def pieces(text: str) -> list[str]:
    """The letter runs of a text, lower-cased, with one blank around each, in pieces of about ``STEP_CHARS`` that end between runs."""
    out, at = [], 0
    while at < len(text):
        gap = _GAP.search(text, at + STEP_CHARS)
        end = gap.end() if gap else len(text)
        out.append(" " + _GAP.sub(" ", text[at:end].lower()).strip() + " ")
        at = end
    return out


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of each text, and the text's index."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    n = len(points)
    gap = points == 32
    ids, who = [], []
    h = np.zeros(n, np.uint32)
    whole = np.ones(n, bool)
    for k in range(max(NGRAMS)):
        m = n - k
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) ^ points[k:] * _MIX[k]
        inner = ~gap[k : k + m] if k else np.ones(m, bool)
        if k >= 1:  # a blank may only be the first or the last character
            whole = whole[:m] & (~gap[k - 1 : k - 1 + m] if k >= 2 else True)
        ok = whole[:m] & (inner | ((k >= 1) & ~gap[:m]))
        if k == 0:
            ok = ok & ~gap
        if k + 1 in NGRAMS:
            mixed = h ^ (h >> np.uint32(15)) ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)
            ids.append((mixed[ok] * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 15)).astype(np.int32))
            who.append(owner[:m][ok])
    return np.concatenate(ids), np.concatenate(who)


@dataclass
class SubwordSoftmax:
    langs: list[str] = field(default_factory=list)
    table: np.ndarray | None = None  # embeddings
    out: np.ndarray | None = None
    bias: np.ndarray | None = None
    heat: float = 1.0
    reject_below: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        """Mean over all subwords of each text; embedding and linear layer are one table here, as both are linear."""
        both = (self.table @ self.out).astype(np.float32)
        parts = [(i, p) for i, t in enumerate(texts) for p in pieces(t)]
        total, count, at = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts)), 0
        while at < len(parts):
            end, chars = at, 0
            while end < len(parts) and (end == at or chars + len(parts[end][1]) <= STEP_CHARS):
                chars += len(parts[end][1])
                end += 1
            doc = np.array([i for i, _ in parts[at:end]])
            ids, who = subwords([p for _, p in parts[at:end]])
            for c in range(len(self.langs)):
                np.add.at(total[:, c], doc, np.bincount(who, both[ids, c], len(doc)))
            np.add.at(count, doc, np.bincount(who, minlength=len(doc)))
            at = end
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        good = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if good:
            p = softmax(self.logits([texts[i] for i in good]) * self.heat)
            for i, k, s in zip(good, p.argmax(1), p.max(1), strict=True):
                names[i], score[i] = self.langs[k], min(1.0, s)
        return names, score


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(sample: list[tuple[str, str]], epochs: int = 6, batch: int = 32, rate: float = 6.0, seed: int = 3) -> SubwordSoftmax:
    """From (text, language); every fifth row is kept for the temperature and the rejection level."""
    sample = [r for r in sample if has_letter(r[0])]
    langs = sorted({r[1] for r in sample})
    rng = np.random.default_rng(seed)
    model = SubwordSoftmax(langs, rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    if len(langs) < 2:
        return model
    y = np.array([langs.index(r[1]) for r in sample])
    docs = []
    for text, _ in sample:
        ids = np.concatenate([subwords([p])[0] for p in pieces(text)])
        own, count = np.unique(ids, return_counts=True)
        docs.append((own, (count / count.sum()).astype(np.float32)))
    fit, held = [i for i in range(len(sample)) if i % 5], [i for i in range(len(sample)) if i % 5 == 0]
    epochs = max(epochs, min(60, 400 * batch // max(1, len(fit))))
    for e in range(epochs):
        order = rng.permutation(fit)
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            ids = np.concatenate([docs[i][0] for i in part])
            share = np.concatenate([docs[i][1] for i in part])[:, None]
            starts = np.cumsum([0] + [len(docs[i][0]) for i in part[:-1]])
            mean = np.add.reduceat(model.table[ids] * share, starts, axis=0)
            p = softmax(mean @ model.out + model.bias)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            g_mean = p @ model.out.T
            step = rate * (1 - 0.9 * e / epochs)
            model.out -= step * 0.1 * (mean.T @ p).astype(np.float32)
            model.bias -= step * 0.02 * p.sum(0).astype(np.float32)
            g = (np.repeat(g_mean, np.diff(np.append(starts, len(ids))), axis=0) * share).astype(np.float32)
            np.subtract.at(model.table, ids, step * 20 * g)
    held = held or fit
    logit = model.logits([sample[i][0] for i in held])
    heats = np.geomspace(0.05, 50, 61)
    loss = [-np.log(np.maximum(softmax(logit * t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in heats]
    model.heat = float(heats[int(np.argmin(loss))])
    p = softmax(logit * model.heat)
    top, right = p.max(1), p.argmax(1) == y[held]
    order = np.argsort(-top)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    below = np.flatnonzero(good < TRUST)
    model.reject_below = max(float(top[order][below[0]]) if len(below) else 0.0, float(np.quantile(top[right], LOSS)) if right.any() else 0.0)
    return model


def language_sample(documents: DataFrame, keep: Column, rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    known = documents.where(F.col("lang").isNotNull() & keep).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    return [(r["text"], r["lang"]) for r in sampled(known, ["lang"], rows, max_chars)]  # at most SAMPLE_ROWS of SAMPLE_CHARS, SAMPLE_TOTAL in all


def predict_language(documents: DataFrame, model: SubwordSoftmax, columns: list[str]) -> DataFrame:
    """``columns`` of every document with ``lang_pred``, ``lang_score`` and ``lang_rejected``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> list:
        own = shared.value
        names, score = own.predict(texts)
        rejected = (score < own.reject_below) | np.array([x == "und" for x in names], bool)
        return [pa.array(names, pa.string()), pa.array(score), pa.array(rejected)]

    return judged(documents, columns, ["text"], run, "lang_pred string, lang_score double, lang_rejected boolean")
