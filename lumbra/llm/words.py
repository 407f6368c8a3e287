"""64-bit hashes of words and word n-grams, computed for whole batches of texts with numpy.

A word is a run without ASCII white space. Texts are hashed in chunks of ``CHUNK`` bytes, so memory stays bounded for
texts of any length; a word longer than ``LONG`` bytes is hashed alone.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

CHUNK = 1 << 19
LONG = 1024
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256).astype(np.uint64)
_MIX = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]  # fixed values: odd multipliers of a 64-bit finaliser
_power: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _power:
        for m in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(CHUNK + 1, m, np.uint64)
            p[0] = 1
            _power.append(np.cumprod(p, dtype=np.uint64))
    return _power


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX[0]
    h = (h ^ (h >> np.uint64(33))) * _MIX[1]
    return h ^ (h >> np.uint64(33))


def _long(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


def _chunk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of at most ``CHUNK`` bytes."""
    raw = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], _SPACE[raw], [True]])
    start = np.flatnonzero(gap[:-2] & ~gap[1:-1])
    end = np.flatnonzero(gap[2:] & ~gap[1:-1]) + 1
    up, down = _powers()
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up[: len(raw)], out=total[1:])
    h = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    for k in np.flatnonzero(end - start > LONG):
        h[k] = _long(data[start[k] : end[k]])
    return h, start


def _alone(data: bytes) -> np.ndarray:
    """Word hashes of a text of any length."""
    out, at = [], 0
    while at < len(data):
        piece = data[at : at + CHUNK]
        if len(piece) == CHUNK:
            gaps = np.flatnonzero(_SPACE[np.frombuffer(piece, np.uint8)])
            if len(gaps):
                piece = piece[: gaps[-1] + 1]
            else:  # one word fills the chunk
                end = at + CHUNK
                while end < len(data):
                    gaps = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, min(CHUNK, len(data) - end), end)])
                    if len(gaps):
                        end += int(gaps[0])
                        break
                    end = min(len(data), end + CHUNK)
                out.append(np.array([_long(data[at:end])], np.uint64))
                at = end
                continue
        out.append(_chunk(piece)[0])
        at += len(piece)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The word hashes of each text, in order."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        if len(texts[at]) >= CHUNK:
            out.append(_alone(texts[at]))
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) + 1 <= CHUNK:
            size += len(texts[end]) + 1
            end += 1
        h, start = _chunk(b"\n".join(texts[at:end]))
        edges = np.cumsum([len(t) + 1 for t in texts[at:end]])
        out += np.split(h, np.searchsorted(start, edges[:-1]))
        at = end
    return out


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; of the whole sequence if it has fewer words; of none if it has no words."""
    k = min(n, len(words))
    if k == 0:
        return words
    m = len(words) - k + 1
    h = np.full(m, k, np.uint64)
    for j in range(k):
        h = mixed(h * np.uint64(_BASE) + words[j : j + m])
    return h


def gram_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of ``grams``."""
    h = grams(words, n)
    if len(h) < 2:
        return h
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]
