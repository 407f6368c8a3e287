"""Phrase collocations: generalised suffix automata per shard, reduced to global counts.

1. Texts are cut at punctuation and line ends into pieces of words and gathered, language by language, in shards of about ``SHARD_WORDS`` words, which are stored with words as numbers.
2. A shard's automaton is that of all its pieces, cut off at ``DEPTH`` words: its states are the sets of end positions that a word sequence has, so all sequences that end at the
   same places are one state, and a state's suffix link leads to the state of its longest shorter suffix with more end positions. These states are the runs of end
   positions with the same words before them, so they are found by sorting the end positions by the words that lead to them, last word first: two sorts of numbers by
   doubling. The size of a run is the state's endpos count, and the run one word shorter that holds it is its suffix link.
3. Counts are reduced level by level. First one and two words are counted in hashed slots over all shards; a slot is a bit: may its phrases reach ``least``? Then phrases of three and
   four words all of whose pairs may. At last the shards enumerate, with their words, only the phrases that may reach ``least``; these are counted exactly. The bitmaps have a
   bounded size (``MOST_BITS``); on more texts than they tell apart more phrases are counted exactly, and the result is the same.
4. A phrase one word longer holds a phrase as its suffix (the phrase its suffix link leads to) or as its beginning. A longer candidate that subsumes a phrase is reached
   by such steps, and counts only fall on the way, so the largest count one step up decides.

Words and phrases are compared as texts, never by their hashes; counts are 64-bit and products decimals.

Defined results: null texts have no words; a null language is ``und``; a piece never reaches over a text's end; repeated rows count as often as they come; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import gaps, parts
from .words import mixed, word_hashes

DEPTH = 4
LEAST, BEST, COVER = 30, 2000, 80  # occurrences of a candidate, phrases of a language, and the hundredths of them that a longer one must have to subsume it
SHARD_WORDS = 1_000_000
MOST_BITS = 27  # 2 ** MOST_BITS slots for each length: a bitmap of 16 MB
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAPS = gaps(0x09, 0x20, *b".,;:!?", range(0x0A, 0x0E))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes(), "zstd", asbytes=True)


def _restored(blob: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


SHARD = "lang string, vocabulary binary, ids binary, length bigint, first bigint, words bigint"


def _shard(lang: str, words: list[pa.Array], breaks: list[np.ndarray], context: int) -> pa.RecordBatch:
    """One row: the distinct words, and all words as their numbers from 1 with a 0 before each piece; counting begins at place ``first``."""
    coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
    cut = np.concatenate(breaks)
    cut[0] = True
    ids = np.insert(np.asarray(coded.indices).astype(np.uint32) + 1, np.flatnonzero(cut), 0)
    first = context + int(cut[: context + 1].sum())
    columns = [lang, b"\n".join(coded.dictionary.to_pylist()), _squeezed(ids), len(ids), first, len(cut) - context]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[f.split()[0] for f in SHARD.split(", ")])


def shards(documents: DataFrame, size: int = SHARD_WORDS) -> DataFrame:
    """All texts of documents (lang, text) as shards; the caller stores it. A text that is longer than a shard goes on in the next with the words before it."""

    def run(batches):
        held: dict[str, tuple[list, list, int]] = {}
        total = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                by: dict[str, list] = {}
                for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    for part in parts(texts, _GAPS, DEPTH - 1):
                        known = part.again if lang in held else 0  # the words before are in the shard, or go along
                        if len(part.start) == known:
                            continue
                        of, seen = part.of_text(), np.append(0, np.cumsum(_BREAKS[part.raw]))
                        cut = np.append(True, (seen[part.start[1:]] > seen[part.end[:-1]]) | (of[1:] != of[:-1]))
                        words, cuts, _ = held.setdefault(lang, ([], [], part.again))
                        words.append(part.words()[known:])
                        cuts.append(cut[known:])
                        total += len(cut) - known
                        if total >= size:
                            yield from (_shard(*(k, *v)) for k, v in held.items())
                            held, total = {}, 0
        yield from (_shard(*(k, *v)) for k, v in held.items())

    return documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(run, SHARD)


class Automaton:
    """The states of a shard's suffix automaton by depth: for depth d the words of each run (column j: the j-th word from the end), its endpos count, and the place of its suffix link
    among the runs of depth d - 1."""

    def __init__(self, ids: np.ndarray, first: int, depth: int = DEPTH):
        last = ids.astype(np.uint64)
        pair = last << np.uint64(32)
        pair[1:] |= np.where(last[1:] > 0, last[:-1], 0).astype(np.uint64)
        counted = np.flatnonzero(last > 0)
        counted = counted[np.searchsorted(counted, first) :]
        if depth <= 2:
            key = np.sort(pair[counted])
            columns = [key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)][:depth]
        else:  # pairs of words as numbers in their order; the first place is a break, so 0 is no pair
            names, rank = np.unique(pair, return_inverse=True)
            rank = rank.astype(np.uint64)
            before = np.zeros(len(rank), np.uint64)
            before[2:] = np.where(pair[2:] & np.uint64(0xFFFFFFFF), rank[:-2], 0)
            key = np.sort((rank << np.uint64(32) | before)[counted])
            near, far = names[(key >> np.uint64(32)).astype(np.int64)], names[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            columns = [near >> np.uint64(32), near & np.uint64(0xFFFFFFFF), far >> np.uint64(32), far & np.uint64(0xFFFFFFFF)][:depth]
        self.words, self.count, self.link = [], [], []
        edge, runs_above = np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        edge[:1] = True
        for d, column in enumerate(columns):
            edge = edge | np.append(True, column[1:] != column[:-1])[: len(key)]
            start = np.flatnonzero(edge)
            count = np.diff(np.append(start, len(key)))
            there = column[start] > 0
            self.words.append(np.stack([c[start[there]] for c in columns[: d + 1]], 1).astype(np.int64))
            self.count.append(count[there])
            self.link.append(runs_above[start[there]])
            number = np.full(len(start), -1, np.int64)
            number[there] = np.arange(there.sum())
            runs_above = number[np.cumsum(edge) - 1]


def phrase_hashes(word: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A hash for each row of word numbers, the last word first; ``word`` has those of the words."""
    h = np.full(len(words), words.shape[1], np.uint64)
    for j in range(words.shape[1] - 1, -1, -1):
        h = mixed(h * _BASE + word[words[:, j]])
    return h


class Frequent:
    """Bitmaps of hashed slots by the number of words: may a phrase be frequent?"""

    def __init__(self):
        self.bits: dict[int, tuple[int, np.ndarray]] = {}

    def may(self, hashes: np.ndarray, n: int) -> np.ndarray:
        if n not in self.bits:
            return np.ones(len(hashes), bool)
        bits, flags = self.bits[n]
        slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        return (flags[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def enumerated(row: dict, lengths: tuple[int, ...], known: Frequent) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, word numbers, hashes, counts) of a shard's phrases of ``lengths`` words that may be frequent, as may their pairs."""
    ids = _restored(row["ids"], row["length"], np.uint32)
    salt = word_hashes([b"\n" + row["lang"].encode() + b"\n"])
    word = np.append(np.uint64(0), mixed(word_hashes([row["vocabulary"]])[0] ^ (salt[0][0] if len(salt[0]) else np.uint64(0))))
    automaton = Automaton(ids, row["first"], max(lengths))
    for n in lengths:
        words, count = automaton.words[n - 1], automaton.count[n - 1]
        if n > 2:
            fine = np.ones(len(words), bool)
            for j in range(n - 1):
                at = np.flatnonzero(fine)
                fine[at] = known.may(phrase_hashes(word, words[at, j : j + 2]), 2)
            words, count = words[fine], count[fine]
        hashes = phrase_hashes(word, words)
        may = known.may(hashes, n)
        yield n, words[may], hashes[may], count[may]


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


RANGES = 64  # of hashes, that are summed apart
HELD = 4_000_000  # counts that a task holds before it sends them on
_SLOTS = "n int, range int, size bigint, slots binary, counts binary"
_NAMES = "range int, lang string, size bigint, phrases binary, counts binary"


def _batch(kind: str, *columns: list) -> pa.RecordBatch:
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in kind.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def count_level(stored_shards: DataFrame, lengths: tuple[int, ...], known: Frequent, least: int, bits: int) -> None:
    """Adds the bitmaps of phrases of ``lengths`` words to ``known``. A task sums its shards before it sends counts."""
    shared = stored_shards.sparkSession.sparkContext.broadcast(known)
    width = (1 << bits) // RANGES

    def sent(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for n, own in held.items():
            key = np.sort(np.concatenate(own))
            slot = (key >> np.uint64(8)).astype(np.uint32)
            first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else slot.astype(np.int64)
            many = np.minimum(np.add.reduceat(key & np.uint64(255), first), least).astype(np.uint8) if len(slot) else slot.astype(np.uint8)
            slot = slot[first]
            edge = np.searchsorted(slot, np.arange(RANGES + 1, dtype=np.uint64) * np.uint64(width))
            for r in np.flatnonzero(np.diff(edge)).tolist():
                part = slice(edge[r], edge[r + 1])
                yield _batch(_SLOTS, [n], [r], [edge[r + 1] - edge[r]], [_squeezed(np.diff(slot[part], prepend=np.uint32(r * width)))], [_squeezed(many[part])])

    def count(batches):
        held, size = {}, 0
        for row in _rows(batches):
            for n, _, hashes, many in enumerated(row, lengths, shared.value):
                held.setdefault(n, []).append(hashes >> np.uint64(64 - bits) << np.uint64(8) | np.minimum(many, least).astype(np.uint64))  # more than ``least`` tells nothing more
                size += len(hashes)
            if size >= HELD:
                yield from sent(held)
                held, size = {}, 0
        yield from sent(held)

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for row in _rows(batches):
            at = (row["n"], row["range"])
            if at not in sums:
                sums[at] = np.zeros(width, np.int32)
            slot = np.cumsum(_restored(row["slots"], row["size"], np.uint32), dtype=np.int64)
            own = sums[at]
            own[slot] = np.minimum(own[slot] + _restored(row["counts"], row["size"], np.uint8), least)  # a slot is once in a row
        yield _batch("n int, range int, flags binary", [n for n, _ in sums], [r for _, r in sums], [np.packbits(s >= least).tobytes() for s in sums.values()])

    n = len(lengths) * RANGES
    moved = stored_shards.mapInArrow(count, _SLOTS).repartitionById(n, F.pmod(F.col("n") * RANGES + F.col("range"), F.lit(n)))
    flags = {n: np.zeros((1 << bits) // 8, np.uint8) for n in lengths}
    for r in moved.mapInArrow(add, "n int, range int, flags binary").collect():  # at most 2 ** bits / 8 bytes for each length
        flags[r["n"]][r["range"] * width // 8 : (r["range"] + 1) * width // 8] = np.frombuffer(r["flags"], np.uint8)
    for n, own in flags.items():
        known.bits[n] = (bits, own)


def _summed(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables)
    return whole.group_by([c for c in whole.column_names if c != "f"], use_threads=False).aggregate([("f", "sum")]).rename_columns([*(c for c in whole.column_names if c != "f"), "f"]) if len(tables) > 1 else whole


def named_counts(stored_shards: DataFrame, known: Frequent, least: int, ranges: int) -> DataFrame:
    """(lang, phrase, words, f) of the phrases that occur ``least`` times. A task sums its shards and sends phrases in their order, compressed, for each range of hashes."""
    shared = stored_shards.sparkSession.sparkContext.broadcast(known)

    def sent(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if held:
            whole = _summed(held).sort_by([("range", "ascending"), ("lang", "ascending"), ("phrase", "ascending")])
            key = pa.compute.run_end_encode(pa.compute.binary_join_element_wise(whole["range"].cast(pa.string()), whole["lang"], " ").combine_chunks())
            start = 0
            for end in key.run_ends.to_pylist():
                own = whole.slice(start, end - start)
                text = "\n".join(own["phrase"].to_pylist()).encode()
                yield _batch(_NAMES, [own["range"][0].as_py()], [own["lang"][0].as_py()], [len(own)], [len(text).to_bytes(8, "little") + pa.compress(text, "zstd", asbytes=True)], [_squeezed(np.asarray(own["f"]))])
                start = end

    def name(batches):
        held, size = [], 0
        for row in _rows(batches):
            names = pa.array([b"", *row["vocabulary"].split(b"\n")], pa.binary()).cast(pa.string())
            for n, words, hashes, count in enumerated(row, tuple(range(1, DEPTH + 1)), shared.value):
                columns = [names.take(pa.array(words[:, j])) for j in range(n - 1, -1, -1)]
                phrase = pa.compute.binary_join_element_wise(*columns, " ") if n > 1 else columns[0]
                part = (hashes >> np.uint64(32)).astype(np.int64) * ranges >> 32
                held.append(pa.table({"range": pa.array(part, pa.int32()), "lang": pa.array([row["lang"]]).take(pa.array(np.zeros(len(part), np.int32))), "phrase": phrase, "f": pa.array(count, pa.int64())}))
                size += len(part)
            if size >= HELD // 4:
                yield from sent(held)
                held, size = [], 0
        yield from sent(held)

    def add(batches):
        held, size = [], 0
        for row in _rows(batches):
            blob = row["phrases"]
            text = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True).decode()
            held.append(pa.table({"lang": pa.array([row["lang"]]).take(pa.array(np.zeros(row["size"], np.int32))), "phrase": pa.array(text.split("\n")), "f": pa.array(_restored(row["counts"], row["size"], np.int64))}))
            size += row["size"]
            if size >= HELD // 4:
                held = [_summed(held)]
                size = len(held[0])
        if held:
            whole = _summed(held)
            whole = whole.filter(pa.compute.greater_equal(whole["f"], least))
            words = pa.compute.add(pa.compute.count_substring(whole["phrase"], " "), 1).cast(pa.int32())
            yield from pa.table({"lang": whole["lang"], "phrase": whole["phrase"], "words": words, "f": whole["f"]}).to_batches(max_chunksize=20_000)

    return stored_shards.mapInArrow(name, _NAMES).repartitionById(ranges, F.col("range")).mapInArrow(add, "lang string, phrase string, words int, f bigint")


def phrase_counts(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Stored (lang, phrase, words, f) of all phrases of up to ``DEPTH`` words that occur ``least`` times or more, and (lang, n): a language's words."""
    own = stored(shards(documents), "phrase-shards")
    totals = own.groupBy("lang").agg(F.sum("words").alias("n"))
    size = own.agg(F.sum("words")).first()[0] or 0
    bits = min(MOST_BITS, max(16, 3 + size.bit_length()))
    known = Frequent()
    for lengths in ((1, 2), tuple(range(3, DEPTH + 1))):
        count_level(own, lengths, known, min(least, 255), bits)
    return stored(named_counts(own, known, least, min(4096, max(RANGES, size >> 23))), "phrase-counts"), totals


def collocations(documents: DataFrame, least: int = LEAST, best: int = BEST, cover: int = COVER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``best`` phrases of 2 to ``DEPTH`` words, without those that a longer one subsumes.

    a: occurrences of the phrase; l and r: those of the two sides of its lowest-scoring cut; n: words of the language; score: floor(2000000 a / (l + r)).
    """
    counts, totals = phrase_counts(documents, least)
    longer = counts.where("words > 2")
    one_less = lambda start: longer.select("lang", F.array_join(F.slice(F.split("phrase", " "), start, F.col("words") - 1), " ").alias("phrase"), "f")
    held = one_less(2).unionByName(one_less(1)).groupBy("lang", "phrase").agg(F.max("f").alias("above"))  # its suffix link, and its beginning
    own = counts.where("words > 1").join(held, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("above") < cover * F.col("f"), F.lit(True)))
    parts_ = F.split("phrase", " ")
    cuts = own.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.array_join(F.slice(parts_, 1, F.col("k")), " ")).withColumn("right", F.array_join(F.slice(parts_, F.col("k") + 1, F.col("words") - F.col("k")), " "))
    side = lambda name, of: counts.select("lang", F.col("phrase").alias(of), F.col("f").alias(name))
    cuts = cuts.join(side("l", "left"), ["lang", "left"]).join(side("r", "right"), ["lang", "right"])
    score = F.expr("(2000000BD * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long")
    least_cut = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("c")).select("lang", "phrase", "c.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = least_cut.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
