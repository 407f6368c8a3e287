"""Small tables for the tests of the training-data operators, and plain versions to compare with."""

import re

import numpy as np

SCHEMA = "doc_id bigint, text string, lang string, source string, row string, id bigint, digest string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [None, "", "  ", "one", "one two", "É é", "A b C d e f", "a B c D e f", "x" * 5000, "<|endoftext|> 'll a   b\n\n c"]
    texts += [" ".join(rng.choice(vocabulary, 40)) for _ in range(30)]
    for t in texts[10:22]:
        w = t.split(" ")
        w[int(rng.integers(40))] = "edited"
        texts.append(" ".join(w))
    texts += [texts[11]] * 3 + ["line one here\nline one here\nother"]
    rows = [(k, t, "en", f"s{k % 3}" if k % 5 else None, "r", 1, "d") for k, t in enumerate(texts)]
    return rows + [rows[12], (None, "one two", None, None, None, None, None)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def linked(rows, n, num, den):
    """The least id that links reach, for each id, by comparing all pairs."""
    sets = []
    for i, text in rows:
        w = words((text or "").translate(LOWER))
        sets.append((i, {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}
