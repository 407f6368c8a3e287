"""Ranked lexical search: a blocked sparse matrix product of items by terms and terms by documents.

Texts become blocks of at most ``BLOCK_DOCS`` documents: for the terms that any item has, the counts of each (term, document), sorted by term, so that a term is a row
of a sparse matrix. Documents with a term, all terms, and the documents that hold each term are summed over all blocks. Then counts become
int64 impacts, and the product with the item-term matrix is formed block by block as Gustavson does: the rows of an item's terms are merged into one accumulator over the block's
documents. Of a block's product only the ``k`` best of each item are kept, then of a task's blocks, then of all.

Items are taken in groups of at most ``MOST_CHARS`` characters, so the broadcast terms and impacts have a bounded size; each group is a product of its own.

Defined results: null texts and texts without a term are in no result and count neither for N nor for L; items without terms give no rows; rows with the same
item_id (also a null one) are one item with the terms of all; each term counts once, or as often as the item has it with ``repeats``; equal scores are ordered by doc_id, null
ids last; documents with the same id are ranked each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import TERM_GAPS, array_sum, parts

BEST = 10
BLOCK_DOCS, BLOCK_ENTRIES = 4096, 1_000_000
MOST_CHARS = 1 << 25
#: The scale of weights and impacts and the share of the length in a document's m, in hundredths.
WEIGHT, IMPACT, SCALE, LENGTH = 1000, 1_000_000_000, 1000, 90


@dataclass
class Terms:
    """The terms of a group of items, and the item-term matrix: for item i the terms ``term[begin[i]:begin[i + 1]]``, each ``times`` over."""

    names: pa.Array
    items: list
    begin: np.ndarray
    term: np.ndarray
    times: np.ndarray


def item_terms(rows: list[tuple[object, str | None]], repeats: bool) -> Terms:
    counts: dict[object, dict[bytes, int]] = {}
    for item, text in rows:
        own = counts.setdefault(item, {})
        for part in parts([text], TERM_GAPS):
            for w in part.words().to_pylist():
                own[w] = own.get(w, 0) + 1 if repeats else 1
    names = sorted({w for own in counts.values() for w in own})
    number = {w: k for k, w in enumerate(names)}
    items = [i for i, own in counts.items() if own]
    begin = np.append(0, np.cumsum([len(counts[i]) for i in items])).astype(np.int64)
    term = np.array([number[w] for i in items for w in counts[i]], np.int64)
    return Terms(pa.array(names, pa.large_binary()), items, begin, term, np.array([n for i in items for n in counts[i].values()], np.int64))


def _runs(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts (1 each without)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[edge], np.diff(np.append(edge, len(keys))) if counts is None else np.add.reduceat(counts, edge)


def counted(texts: list[str | None], names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of terms of each text, and (text, term, count) for the terms among ``names``."""
    n, keys, times, wide = np.zeros(len(texts), np.int64), [], [], max(1, len(names))
    for part in parts(texts, TERM_GAPS):
        own = part.of_text()
        n += np.bincount(own, minlength=len(texts))
        found = pc.index_in(part.words(), value_set=names)
        known = np.asarray(found.is_valid())
        k, c = _runs(own[known] * wide + np.asarray(found.drop_null(), np.int64))
        keys.append(k)
        times.append(c)
    k, c = _runs(np.concatenate(keys), np.concatenate(times)) if keys else (n[:0], n[:0])
    return n, k // wide, k % wide, c


BLOCK = "docs binary, known binary, n binary, term binary, doc binary, tf binary, with_terms bigint, terms bigint"


def _packed(ids: list[pa.Array], n: list, doc: list, term: list, tf: list) -> pa.RecordBatch:
    """One block from what batches gave: documents in the order of their ids, entries in that of their terms and then documents."""
    known = np.concatenate([np.asarray(i.is_valid()) for i in ids])
    number = np.concatenate([np.asarray(i.fill_null(0)) for i in ids])
    order = np.lexsort((number, ~known))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    size, doc, term, tf = np.concatenate(n), place[np.concatenate(doc)], np.concatenate(term), np.concatenate(tf)
    by = np.lexsort((doc, term))
    blobs = [number[order], known[order], size[order], term[by].astype(np.int32), doc[by].astype(np.int32), tf[by].astype(np.int32)]
    return pa.RecordBatch.from_arrays([*(pa.array([b.tobytes()], pa.binary()) for b in blobs), pa.array([int((size > 0).sum())]), pa.array([int(size.sum())])], names=[f.split()[0] for f in BLOCK.split(", ")])


def term_blocks(documents: DataFrame, names: pa.Array) -> DataFrame:
    """Blocks of the term-document matrix of all documents (doc_id, text); the caller stores it."""
    shared = documents.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        held, docs, entries = [[] for _ in range(5)], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, doc, term, tf = counted(part.column(1).to_pylist(), shared.value)
                for own, x in zip(held, (part.column(0), n, doc + docs, term, tf), strict=True):
                    own.append(x)
                docs, entries = docs + len(part), entries + len(term)
                if docs + 512 > BLOCK_DOCS or entries > BLOCK_ENTRIES:
                    yield _packed(*held)
                    held, docs, entries = [[] for _ in range(5)], 0, 0
        if docs:
            yield _packed(*held)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCK)


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.floor(WEIGHT * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


def lengths(size: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents with so many terms."""
    return np.array([100 - LENGTH + LENGTH * int(x) * n // total if x else 0 for x in size], np.int64)  # Python's integers: the product may pass 64 bits


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a count in a document is worth, before the term's weight."""
    return IMPACT * tf // (SCALE * tf + 8 * m)


def top(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores above 0, highest first, equal ones in order."""
    at = np.flatnonzero(score > 0)
    if len(at) > k:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= least]
    return at[np.lexsort((at, -score[at]))][:k]


def product(terms: Terms, weight: np.ndarray, block: dict, n: int, total: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, documents, scores) of the ``k`` best documents of a block for each item."""
    doc, term = block["doc"], block["term"]
    value = weight[term] * impacts(block["tf"].astype(np.int64), lengths(block["n"], n, total)[doc])
    row = np.searchsorted(term, np.arange(len(weight) + 1))
    for i in range(len(terms.items)):
        merged = np.zeros(len(block["n"]), np.int64)
        for j in range(terms.begin[i], terms.begin[i + 1]):
            a, b = row[terms.term[j]], row[terms.term[j] + 1]
            merged[doc[a:b]] += terms.times[j] * value[a:b]
        best = top(merged, k)
        if len(best):
            yield i, best, merged[best]


def _search(documents: DataFrame, terms: Terms, k: int) -> DataFrame:
    blocks = stored(term_blocks(documents, terms.names), "term-blocks")
    totals = blocks.agg(F.sum("with_terms"), F.sum("terms")).first()
    n, total = totals[0] or 0, totals[1] or 0

    def holding(sums: np.ndarray, batch: pa.RecordBatch) -> None:
        for blob in batch.column(0).to_pylist():
            own = np.frombuffer(blob, np.int32)
            sums[: own.max() + 1 if len(own) else 0] += np.bincount(own)

    weight = weights(array_sum(blocks.select("term"), max(1, len(terms.names)), holding), n)
    shared = documents.sparkSession.sparkContext.broadcast((terms, weight))
    kinds = {"docs": np.int64, "known": bool, "n": np.int64, "term": np.int32, "doc": np.int32, "tf": np.int32}

    def run(batches):
        terms, weight = shared.value
        held: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                block = {c: np.frombuffer(r[c], kind) for c, kind in kinds.items()}
                for i, best, score in product(terms, weight, block, n, total, k):
                    ids = [int(x) if known else None for x, known in zip(block["docs"][best], block["known"][best], strict=True)]
                    own = held.get(i, []) + [(-int(s), d is None, d or 0) for s, d in zip(score, ids, strict=True)]
                    held[i] = sorted(own)[:k]
        rows = [(i, d if not no else None, -s) for i, own in held.items() for s, no, d in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64()))], names=["item", "doc_id", "score"])

    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = blocks.select(*kinds).mapInArrow(run, "item int, doc_id bigint, score bigint").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = documents.sparkSession.createDataFrame(list(enumerate(terms.items)), "item int, item_id bigint")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def best_documents(documents: DataFrame, benchmark: DataFrame, k: int = BEST, repeats: bool = False, chars: int = MOST_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents for each item of benchmark (item_id, text)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    groups, out = max(1, -(-2 * size // chars)), None
    for g in range(groups):
        own = items if groups == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g)
        terms = item_terms([(r["item"], r["text"]) for r in own.collect()], repeats)  # about half of ``chars``
        if terms.items:
            found = _search(documents, terms, k)
            out = found if out is None else out.unionByName(found)
    return documents.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if out is None else out
