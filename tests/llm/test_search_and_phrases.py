"""Phrases, ranked search and decontamination against plain loops, with nulls, repeats, long texts, clashing names and empty tables; long texts and hot keys of the older operators."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from lumbra.llm import chat_windows, common, decontamination, exact_dedup, language_id, lexical_search, near_join, packing, phrases, queries, toxicity, tokens, words
from llm_data import LOWER, SCHEMA, base
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VOCABULARY = ["a", "B", "É", "foo", "bar9", "x-x", "longword", "q", "ß", "日本"]


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def made(rng, n, seps=(" ", "  ", "\n", "\0", "-", ". ", "!!")):
    return "".join(rng.choice(VOCABULARY) + rng.choice(seps) for _ in range(n))


@pytest.mark.parametrize("part", [60, 1 << 20])
def test_parts(monkeypatch, part):
    """All words of all texts, in order, whatever the parts; a later part of a long text repeats the words before it."""
    monkeypatch.setattr(tokens, "PART", part)
    rng = random.Random(1)
    texts = [None, "", "!!", "x" * 500, " " * 300, *[made(rng, n) for n in (1, 7, 40, 400)], "y" * 70 + " " + "z" * 70_000 + " end"]
    got, again = [[] for _ in texts], 0
    for p in tokens.parts(texts, tokens.TERM_GAPS, 3):
        own = p.words().to_pylist()
        again += p.again
        for k, w in list(zip(p.of_text().tolist(), own, strict=True))[p.again :]:
            got[k].append(w.decode())
    assert got == [terms(t) for t in texts] and (again > 0) == (part == 60)


@pytest.mark.parametrize("part", [150, 1 << 20])
def test_windows_by_brute_force(monkeypatch, part):
    """Hit words and items of every text: every window at every place, also over the parts of a long text; nulls, ties, items with the same words and short items."""
    monkeypatch.setattr(tokens, "PART", part)
    monkeypatch.setattr(decontamination, "PAIRS", 50)
    rng = random.Random(2)
    for trial in range(25):
        items = [(str(i), made(rng, rng.choice([0, 1, 2, 3, 9, 10, 11, 14, 30]))) for i in range(rng.choice([0, 1, 6]))] + [("z", None), ("0", made(rng, 12)), ("9", "foo foo")]
        texts = [None, "", "!!", *[made(rng, rng.choice([1, 5, 12, 40, 300])) for _ in range(8)], "x" * 400, "foo " * 200, *[made(rng, 20) + items[-2][1] + " " + made(rng, 30) for _ in range(4)]]
        windows = [(i, tuple(w[k : k + 10])) for i, t in items for w in [terms(t)] for k in range(max(1, len(w) - 9) if w else 0)]
        for text, (n, spans, own) in zip(texts, decontamination.search(texts, decontamination.Windows(items)), strict=True):
            w, hit, there = terms(text), set(), set()
            for i, win in windows:
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        there.add(i)
            assert n == len(w) and own == sorted(there) and [k for a, b in spans.tolist() for k in range(a, b + 1)] == sorted(hit), trial


def test_find_passages_edges(spark):
    """Blocks of the benchmark one after the other give what one block gives; clashing names, repeated rows and empty tables."""
    rng = random.Random(3)
    bench = [(k, made(rng, rng.choice([3, 12, 20]))) for k in range(9)] + [(None, "foo  BAR9 foo"), (3, "q q q q"), (99, None), (98, "..")]
    rows = [(k, made(rng, 10) + (bench[k % 9][1] if k % 2 else "") + made(rng, 10), "own", "own", "own") for k in range(30)] + [(None, None, None, None, None), (7, "", "x", "x", "x"), (8, "foo-bar9 FOO", "x", "x", "x"), (8, "foo-bar9 FOO", "x", "x", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, items string, _text string, n_words string")
    items = spark.createDataFrame(bench, "item_id bigint, text string")
    columns = ["doc_id", "text", "items", "_text", "n_words"]
    one, many = (sorted((r.asDict(recursive=True) for r in decontamination.find_passages(docs, items, columns, chars=c).collect()), key=repr) for c in (1 << 24, 60))
    assert one == many and len(one) == len(rows) and sum(r["items"] == [""] for r in one) >= 2 and {r["_text"] for r in one} == {"own", "x", None}
    assert decontamination.find_passages(docs.limit(0), items, columns).count() == 0
    assert all(r["items"] == [] for r in decontamination.find_passages(docs, items.limit(0), columns).collect())
    clean = decontamination.without_benchmark(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(not r["items"] for r in one)


@pytest.mark.parametrize("chars", [1 << 25, 40])
def test_best_documents(spark, monkeypatch, chars):
    """All documents scored for all items: nulls, ties by doc_id with null ids last, repeated ids, items of one id; one group of items or many."""
    rng = random.Random(4)
    docs = [(i if i != 7 else None, made(rng, rng.choice([0, 1, 5, 30]))) for i in range(60)] + [(3, "foo foo"), (61, None), (62, "foo A"), (62, "foo A")]
    items = [(i, made(rng, rng.choice([1, 3, 8]))) for i in range(6)] + [(0, "ZZ nothere"), (None, "foo"), (99, None), (98, "!!")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(items, "item_id bigint, text string")
    for repeats in (False, True):
        got = sorted(map(tuple, lexical_search.best_documents(d, b, repeats=repeats, chars=chars).collect()), key=repr)
        all_terms = [terms(t) for _, t in docs]
        n, total = sum(1 for w in all_terms if w), sum(map(len, all_terms))
        asked = {}
        for i, t in items:
            asked.setdefault(i, Counter()).update(terms(t))
        want = []
        for i, own in asked.items():
            scored = []
            for (doc, _), w in zip(docs, all_terms, strict=True):
                score = 0
                for term, times in own.items():
                    tf, df = w.count(term), sum(term in x for x in all_terms)
                    if tf:
                        score += (times if repeats else 1) * math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((10**9 * tf) // (1000 * tf + 8 * (10 + 90 * len(w) * n // total)))
                if score > 0:
                    scored.append((-score, doc is None, doc or 0))
            want += [(i, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:10], 1)]
        assert got == sorted(want, key=repr)
    assert lexical_search.best_documents(d.limit(0), b).count() == lexical_search.best_documents(d, b.limit(0)).count() == 0


def test_term_blocks(spark, monkeypatch):
    """Entries of small blocks over long texts are those of whole texts."""
    monkeypatch.setattr(tokens, "PART", 50)
    texts = ["foo " * 100 + "a b", None, "b b", ""]
    names = lexical_search.item_terms([(1, "foo b zz")], False).names
    n, doc, term, tf = lexical_search.counted(texts, names)
    assert n.tolist() == [102, 0, 2, 0] and sorted(zip(doc.tolist(), [names[int(t)].as_py() for t in term], tf.tolist(), strict=True)) == [(0, b"b", 1), (0, b"foo", 100), (2, b"b", 2)]
    assert lexical_search.top(np.array([5, 0, 7, 5, 7, 1]), 3).tolist() == [2, 4, 0]


def plain_collocations(docs, least, best, cover):
    counts, total = {}, Counter()
    for lang, text in docs:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in range(1, 5):
                own.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, _, left, right = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, x, y, total[lang], -s) for rank, (s, a, p, x, y) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "best", "size"), [(3, 50, 10**6), (5, 2000, 150), (2, 2000, 1000)])
def test_collocations(spark, monkeypatch, least, best, size):
    """All phrases counted one by one: null languages and texts, ties, repeats, texts over many shards, and one that is longer than a part."""
    rng = random.Random(5)
    seps = [" "] * 12 + ["  ", "\n", ". ", "\t", "?!", "\0"]
    docs = [(rng.choice(["en", "fr", None, "und"]), made(rng, rng.choice([0, 1, 5, 30, 700]), seps)) for _ in range(60)] + [("en", None), ("en", " .. ")] + [("xx", "New York City hall. ")] * 5
    if size == 150:
        docs.append(("en", made(rng, 260_000, seps)))  # more than a part's bytes
    own = phrases.shards
    monkeypatch.setattr(phrases, "shards", lambda d: own(d, size))
    monkeypatch.setattr(phrases, "HELD", 400)
    df = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(df, least, best).collect())) == plain_collocations(docs, least, best, 80)
    assert phrases.collocations(df.limit(0), least).count() == 0


def test_automaton():
    """States by depth are the distinct word sequences with their end positions, and links lead to the sequence without its first word."""
    rng = np.random.default_rng(6)
    ids = np.where(rng.random(500) < 0.1, 0, rng.integers(1, 5, 500)).astype(np.uint32)
    ids[0] = 0
    for first in (1, 40):
        got = phrases.Automaton(ids, first)
        below = {}
        for d in range(1, 5):
            want = Counter(tuple(ids[k - d + 1 : k + 1][::-1].tolist()) for k in range(max(first, d), 500) if ids[k - d + 1 : k + 1].all())
            names = [tuple(w) for w in got.words[d - 1].tolist()]
            assert dict(zip(names, got.count[d - 1].tolist(), strict=True)) == want and names == sorted(names)
            if d > 1:
                assert all(below[int(link)] == name[:-1] for link, name in zip(got.link[d - 1], names, strict=True))
            below = dict(enumerate(names))


def test_saturated_bitmaps_change_nothing(spark, monkeypatch):
    """Where every slot may be frequent, more is counted exactly and the result is the same."""
    rng = random.Random(7)
    docs = [("en", made(rng, 80, [" "] * 9 + [". "])) for _ in range(40)]
    df = spark.createDataFrame(docs, "lang string, text string")
    want = sorted(map(tuple, phrases.collocations(df, 4).collect()))
    monkeypatch.setattr(phrases.Frequent, "may", lambda self, hashes, n: np.ones(len(hashes), bool))
    assert sorted(map(tuple, phrases.collocations(df, 4).collect())) == want


# Older operators: hot keys, long texts, plain loops.


def test_exact_dedup_hot_text(spark, monkeypatch):
    """A text with most of the rows, told by a broadcast, beside small groups and single texts."""
    monkeypatch.setattr(exact_dedup, "HOT_COPIES", 100)
    rows = [(k, "The Same") for k in range(3000)] + [(5000 + k, f"t{k // 2}") for k in range(400)] + [(None, "the same"), (9000, None), (9001, "")]
    prints = common.stored(exact_dedup.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7), ["doc_id"]), "test-hot")
    got = exact_dedup.decisions(prints, "doc_id", largest=True).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").lower(), []).append(i)
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    of = {i: own for own in groups.values() for i in own}
    assert all(r.group_size == len(of[r.id]) and r.keep_id == max(x for x in of[r.id] if x is not None) for r in got)


@pytest.mark.parametrize("bits", [1 << 27, 1 << 18])
def test_flagged_by_hashes(spark, monkeypatch, bits):
    """Ids over the whole range: bitmaps of hashes alone decide, however full they are."""
    monkeypatch.setattr(common, "MOST_PAGES", 0)
    monkeypatch.setattr(common, "HINT_BITS", bits)
    rng = random.Random(8)
    ids = [rng.getrandbits(62) - 2**61 for _ in range(30_000)]
    rows = spark.createDataFrame([(i, "t") for i in [*ids, None]], "id bigint, text string")
    for keys in ([], ids[:3], ids[:20_000]):
        got = common.flagged(rows, "id", spark.createDataFrame([(i,) for i in [*keys, None]], "id bigint"), "there").collect()
        assert len(got) == len(ids) + 1 and all(r.there == (r.id in set(keys)) for r in got[:2000] + got[-2000:])


def test_chat_system_turn_gives_way(spark):
    """A window never exceeds the budget unless its one turn does; a system turn isn't repeated beside a turn that fits only without it, nor if it is over the budget itself."""
    files = queries.vocabulary()
    encoder = packing.Encoder(**files)
    rows = [(1, 0, "system", "rule " * 290)] + [(1, k, "user" if k % 2 else "assistant", "word " * n) for k, n in enumerate((390, 390, 20, 700, 10, 390), 1)] + [(2, 0, "system", "rule " * 900), (2, 1, "user", "hi"), (2, 2, "assistant", "there")]
    got = chat_windows.windows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), lambda: packing.Encoder(**files), budget=512).collect()
    assert all(len(encoder.ids(r.text)) == r.tokens for r in got)
    for r in got:
        own = chat_windows.parse(r.text)[r.context_turns :]
        assert r.tokens <= 512 or (len(own) == 1 and len(encoder.ids(chat_windows.format_turn(*own[0])[0])) > 512)
    assert sum(r.text.count("rule " * 290) for r in got if r.conv_id == 1) >= 2 and sum("rule" in r.text for r in got if r.conv_id == 2) == 1
    back = {r.conv_id: r.n_turns for r in chat_windows.read_back(chat_windows.windows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), lambda: packing.Encoder(**files), budget=512)).collect()}
    assert back == {1: 7, 2: 3}


def test_language_by_plain_loops():
    """Subwords, logits, prediction, ties and rejection one n-gram at a time."""
    rng = random.Random(9)
    sample = [(" ".join(rng.choice(["the", "house", "and"]) for _ in range(9)), "en") for _ in range(60)] + [(" ".join(rng.choice(["das", "haus", "und"]) for _ in range(9)), "de") for _ in range(60)]
    model = language_id.train(sample)
    assert model.langs == ["de", "en"]

    def grams(text):
        out = Counter()
        for run in re.findall(r"[^\W\d_]+", text.lower()):
            own = f" {run} "
            for n in language_id.NGRAMS:
                for k in range(len(own) - n + 1):
                    gram = own[k : k + n]
                    if not (gram[0] == gram[-1] == " "):  # one end of the run at most
                        out[gram] += 1
        return out

    def bucket(gram):
        h = 0
        for k, c in enumerate(gram):
            h = (h * 0x01000193 & 0xFFFFFFFF) ^ (ord(c) * int(language_id._MIX[k]) & 0xFFFFFFFF)
        k = len(gram) - 1
        h = h ^ (h >> 15) ^ (k * 0x9E3779B1 & 0xFFFFFFFF)
        return (h * 0x2C1B3C6D & 0xFFFFFFFF) >> 17

    for text in ("the haus", "Und, das! x", "é house-house 42", "a"):
        own = grams(text)
        mean = sum(model.table[bucket(g)].astype(np.float64) * n for g, n in own.items()) / sum(own.values())
        want = mean @ model.out + model.bias
        assert np.abs(model.logits([text])[0] - want).max() < 1e-3
        p = np.exp(want * model.heat - (want * model.heat).max())
        names, score = model.predict([text])
        assert names == [model.langs[int(p.argmax())]] and abs(score[0] - p.max() / p.sum()) < 1e-3
    even = language_id.SubwordSoftmax(["a", "b"], np.zeros_like(model.table), np.zeros_like(model.out), np.zeros_like(model.bias))
    assert even.predict(["word"])[0] == ["a"]  # ties go to the first


def test_long_texts_in_pieces(monkeypatch):
    """Pieces of long texts: hashes of words, windows of the convolution, and sets of the join as of the whole text."""
    rng = random.Random(10)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "x" * 1500, "é"]) for _ in range(4000))
    whole = words.word_hashes([text.encode()])[0]
    monkeypatch.setattr(words, "CHUNK", 2000)
    monkeypatch.setattr(words, "_power", [])
    assert (words.word_hashes([text.encode()])[0] == whole).all() and len(whole) == len(text.split())
    model = toxicity.TextCnn.fresh(1)
    codes = common.WordCodes(common.word_hash).of(text[:20_000])
    want = model.logits([codes])
    monkeypatch.setattr(common, "STEP_WORDS", 50)
    real = common.segments
    monkeypatch.setattr(toxicity, "segments", lambda c, overlap, most=50: real(c, overlap, most))
    assert np.abs(model.logits([codes]) - want).max() < 1e-5


def test_near_join_text_over_a_cell(spark, monkeypatch):
    """One text with more grams than a cell is meant to hold, and its near copy."""
    monkeypatch.setattr(near_join, "CELL_GRAMS", 100)
    long = [f"w{k}" for k in range(900)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-5] + ["end"] * 5)), (3, " ".join(long[:300])), (4, "short text of a few words"), (5, "short text of a few words")]
    got = {r.id: r.component_id for r in near_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", 4, 85, 100).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_edges_of_all_three(spark):
    """The small table of the other tests, with clashing names, through the three operators."""
    docs = spark.createDataFrame(base(), SCHEMA)
    bench = spark.createDataFrame([(1, base()[12][1])], "item_id bigint, text string")
    got = decontamination.find_passages(docs, bench, docs.columns)
    assert {r.doc_id for r in got.where(F.size("items") > 0).collect()} >= {12}
    assert lexical_search.best_documents(docs, bench).first().doc_id == 12
    assert phrases.collocations(docs, 2).count() > 0
