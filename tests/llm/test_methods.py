"""The methods of the training-data operators against plain loops, and tables with nulls, repeats, clashing names and no rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from lumbra.llm import chat_windows, common, exact_dedup, language_id, mixing, near_join, packing, quality_mil, quality_rules, queries, toxicity, url_filter
from pyspark.sql import functions as F

from llm_data import LOWER, SCHEMA, base, linked, words

DATA = "/root/testdata/sf0.001"
CLASH = "doc_id bigint, text string, lang string, tox_score string, toxic_found string, quality_score string, lang_pred string, kept string, n_words string, host string, url string, _all string"


def clashing(spark):
    rows = [(k, t, "en", *["own"] * 9) for k, t in enumerate([None, "", " \n", "one word", "ab " * 400, "ab " * 400, "² ½ ③ 12"])]
    return spark.createDataFrame([*rows, rows[3], (None, "x", None, *[None] * 9)], CLASH)


@pytest.mark.parametrize("name", ["toxicity", "quality", "rules", "language"])
def test_edges(spark, name):
    """Nulls, empty texts, repeated rows, names that clash with results or helpers, and an empty table."""
    docs = clashing(spark)
    tox = toxicity.train([("bad words here" if k % 2 else "fine talk", k % 2, "en") for k in range(40)])
    mil = quality_mil.train([("bad $$ ##" if k % 2 else "A fine sentence.", k % 2) for k in range(40)])
    lang = language_id.train([("the house of the", "en") if k % 2 else ("das haus und der", "de") for k in range(40)])
    ratio = quality_rules.Ratio(np.zeros(quality_rules.BUCKETS))
    run, results = {
        "toxicity": (lambda d: toxicity.score_toxicity(d, tox, d.columns), {"tox_score", "tox_threshold", "toxic_found"}),
        "quality": (lambda d: quality_mil.score_quality(d, mil, d.columns), {"quality_score"}),
        "rules": (lambda d: quality_rules.judge_quality(d, ratio, d.columns), {"n_words", "kept", "llr"}),
        "language": (lambda d: language_id.predict_language(d, lang, d.columns), {"lang_pred", "lang_score"}),
    }[name]
    got = run(docs)
    assert len(set(got.columns)) == len(got.columns) and set(got.columns) >= set(docs.columns) | results
    rows = got.collect()
    assert len(rows) == docs.count() and all(r[c] == "own" for r in rows for c in set(docs.columns) - {"doc_id", "text", "lang"} - set(results) - {"kept", "n_words"} if r.doc_id is not None)
    assert rows[3].asDict() == [r for r in rows if r.doc_id == 3][1].asDict()
    assert run(docs.limit(0)).count() == 0
    if name == "language":
        assert [r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 6)] == ["und"] * 4
    if name == "toxicity":
        assert toxicity.without_toxic(docs, tox).columns == docs.columns


def test_cnn_forward():
    model = toxicity.TextCnn.fresh(1)
    for text in ("", "one", "some words of a text that is longer", "w " * 300 + "end"):
        codes = common.WordCodes(common.word_hash).of(text)
        vectors = [model.tables[0][c & 0xFFFF] + model.tables[1][c >> 16] for c in codes] + [np.zeros(toxicity.DIM)] * 2
        pooled = []
        for w, f, b in zip(toxicity.WIDTHS, model.filters, model.biases, strict=True):
            acts = [np.concatenate((vectors + [np.zeros(toxicity.DIM)] * 2)[k : k + w]) @ f + b for k in range(len(vectors))]
            pooled += list(np.maximum(np.max(acts, axis=0), 0))
        assert abs(model.logits([codes])[0] - (np.array(pooled) @ model.out + model.bias)) < 1e-4


def test_language_thresholds():
    """Every language has its own threshold, drawn towards that of all rows; no number of rows switches it on."""
    rng = np.random.default_rng(2)
    sample = [(" ".join(rng.choice(["awful", "bad"] if k % 3 == 0 else ["good", "fine", "well"], 12)), int(k % 3 == 0), "de" if k % 10 == 0 else "en") for k in range(200)]
    model = toxicity.train(sample)
    assert set(model.thresholds) == {"de", "en"}
    p, y = np.array([0.1, 0.2, 0.6, 0.7]), np.array([0, 0, 1, 1])
    assert toxicity.best_threshold(p, y, np.ones(4), 0.3) == 0.3
    assert 0.2 < toxicity.best_threshold(p, y, np.ones(4), 0.05) <= 0.6


def test_mil_forward_and_long_texts(monkeypatch):
    model, ids = quality_mil.AttentionMil.fresh(2), common.WordCodes(quality_mil.word_code)
    rng = np.random.default_rng(0)
    texts = ["", "A few words.", " ".join(rng.choice(["One", "two,", "3", "$$"], 700)), "same again " * 200]
    codes = [ids.of(t) for t in texts]
    for words_, got in zip(codes, model.logits(codes), strict=True):
        own = words_ or [0]
        again, grams = Counter(c >> 32 for c in own), Counter(tuple(c >> 32 for c in own[k : k + 3]) for k in range(len(own) - 2))
        hs, es = [], []
        for at in range(0, len(own), quality_mil.PASSAGE):
            part = own[at : at + quality_mil.PASSAGE]
            mean = np.mean([model.p["words"][c & (quality_mil.WORDS - 1)] + model.p["shapes"][c >> 14 & (quality_mil.SHAPES - 1)] for c in part], axis=0)
            share = [np.mean([c >> b & 1 for c in part]) for b in (24, 25, 26, 27)] + [np.mean([again[c >> 32] > 1 for c in part])]
            share.append(np.mean([k + 2 < len(own) and grams[tuple(x >> 32 for x in own[k : k + 3])] > 1 for k in range(at, at + len(part))]))
            share += [np.mean([c >> 28 & 15 for c in part]) / 8, len(part) / quality_mil.PASSAGE, np.log1p(len(own)) / 8]
            h = np.tanh(np.concatenate([mean, share]) @ model.p["enc"] + model.p["enc_b"])
            hs.append(h)
            es.append((np.tanh(h @ model.p["v"]) / (1 + np.exp(-(h @ model.p["u"])))) @ model.p["att"])
        a = np.exp(es) / np.exp(es).sum()
        assert abs((a[:, None] * hs).sum(0) @ model.p["out"] + model.p["out_b"][0] - got) < 1e-3
    whole = model.logits(codes)
    monkeypatch.setattr(quality_mil, "STEP_WORDS", 128)
    assert np.abs(model.logits(codes) - whole).max() < 1e-4


def test_language_pieces(monkeypatch):
    text = "haus und hof, " * 60 + "x" * 500 + " ende"
    whole = language_id.subwords(language_id.pieces(text))[0]
    monkeypatch.setattr(language_id, "STEP_CHARS", 37)
    parts = language_id.pieces(text)
    assert len(parts) > 5 and Counter(language_id.subwords(parts)[0].tolist()) == Counter(whole.tolist())


def test_ratio_and_threshold(spark):
    """The table, the folds' threshold and the verdict, recomputed; documents that the fit has not seen stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    model = quality_rules.fit_ratio(docs, labels, half == 0)
    good = {r.doc_id for r in labels.where(half == 0).where("quality = 1").collect()}
    raw, folds = np.zeros(quality_rules.BUCKETS), np.zeros((quality_rules.FOLDS, quality_rules.BUCKETS))
    hashed = {}
    for r in docs.collect():
        data = (r.text or "").encode()
        h = quality_rules.word_hashes([data])[0]
        got = np.bincount(quality_rules.buckets(h), minlength=quality_rules.BUCKETS)
        raw += got
        if r.doc_id in good:
            hashed[r.doc_id] = (zlib.crc32(data) % quality_rules.FOLDS, h)
            folds[zlib.crc32(data) % quality_rules.FOLDS] += got
    assert np.allclose(model.table, quality_rules.ratio_table(folds.sum(0), raw))
    tables = [quality_rules.Ratio(quality_rules.ratio_table(folds.sum(0) - t, raw - t)) for t in folds]
    held = sorted(tables[k].score(h) for k, h in hashed.values() if len(h))
    assert abs(model.threshold - held[0]) < 0.01
    judged = quality_rules.judge_quality(docs, model, ["doc_id"]).collect()
    assert all(r.kept == (not r.base_failed and r.llr >= model.threshold) for r in judged)
    unseen = {r.doc_id for r in labels.where(half == 1).where("quality = 1").collect()}
    own = [r for r in judged if r.doc_id in unseen and not r.base_failed]
    assert len(own) > 50 and np.mean([r.kept for r in own]) > 0.9


def test_url_trees(spark):
    """The SQL expression gives what the trees give; suffix rates leave a url's own fold out; unruled urls of one suffix get both verdicts."""
    rng = np.random.default_rng(4)
    urls = [f"https://{'-'.join(['spam'] * int(b * 3 + 1))}{k}.{rng.choice(['com', 'info', 'dev'])}/{'a' * int(b * 30)}?x={k}" for k, b in enumerate(rng.integers(0, 2, 400))]
    labels = [(u, int("spam-spam" in u)) for u in urls]
    pages = spark.createDataFrame([(k, u, "own") for k, u in enumerate(urls)], "page_id bigint, url string, host string")
    model = url_filter.fit_urls(pages, spark.createDataFrame(labels, "url string, block int"))
    assert set(model.rates) == {"com", "info", "dev"}
    got = url_filter.judge(pages, model, ["page_id", "url", "host"])
    assert got.columns.count("host") == 1 and got.columns.count("url") == 1
    parts = pages.select(*(c.alias(n) for n, c in url_filter.features(F.col("url"), url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).items()), "page_id").collect()
    host = {r.page_id: r.host for r in got.collect()}

    def walk(tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    want = {r.page_id: model.base + sum(walk(t, [*(r[n] for n in url_filter.NAMES), model.rates[host[r.page_id].rsplit(".", 1)[-1]]]) for t in model.trees) for r in parts}
    for r in got.collect():
        assert abs(r.block_score - 1 / (1 + np.exp(-want[r.page_id]))) < 1e-9
    assert np.mean([(r.verdict == "block") == bool(labels[r.page_id][1]) for r in got.collect()]) > 0.95
    assert {(r.host.rsplit(".", 1)[-1], r.verdict) for r in got.collect()} == {(s, v) for s in ("com", "info", "dev") for v in ("block", "allow")}
    assert url_filter.judge(pages.limit(0), model, ["page_id"]).count() == 0 and url_filter.fit_urls(pages.limit(0)).trees == []


def test_merge_levels(spark, monkeypatch):
    """Several rounds of exchanges give what one round gives."""
    rows = [(k, f"T{k % 700}" if k % 3 else f"t{k % 50}") for k in range(3000)]
    docs = spark.createDataFrame([*rows, *rows[:5], (None, None), (None, "")], "doc_id bigint, text string").repartition(7)
    want = {}
    for i, t in [*rows, *rows[:5], (None, None), (None, "")]:
        want.setdefault((t or "").translate(LOWER), []).append(i)
    monkeypatch.setattr(exact_dedup, "NODE_ROWS", 50)
    assert exact_dedup.levels(3000) == 2
    prints = common.stored(exact_dedup.fingerprints(docs, ["doc_id"]), "test-prints")
    for largest in (True, False):
        got = exact_dedup.merged_groups(prints.select(F.col("doc_id").alias("id"), "row", "digest", "second", "bytes"), 3000, largest).collect()
        best = max if largest else min
        assert {bytes(r.digest): (r.id, r.copies) for r in got} == {hashlib.sha256(t.encode()).digest(): (best((i for i in v if i is not None), default=None), len(v)) for t, v in want.items()}


def test_sum_of_squares_is_least():
    rng = np.random.default_rng(8)
    levels, window = packing.Levels(16), 16
    for size in rng.integers(1, 16, 300):
        before = levels.count.copy()
        levels.place((0, 0, np.zeros(size, np.uint32), size), int(size))
        after = int((levels.count**2).sum())
        options = []
        for h in [0, *np.flatnonzero(before)]:
            if h + size <= window:
                n = before.copy()
                if h:
                    n[h] -= 1
                if h + size < window:
                    n[h + size] += 1
                options.append(int((n**2).sum()))
        assert after == min(options)


def test_packing_pieces(monkeypatch):
    encoder = packing.Encoder(**queries.vocabulary())
    text = "Ein langer Text, with words  and\n\nlines. " * 400
    want = encoder.slow.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "STEP_CHARS", 97)
    assert len(list(encoder.pieces(text))) > 50 and encoder.ids(text).tolist() == want


def test_chat_budget(spark):
    """Windows hold no more than the budget by the written turns, unless one turn alone is larger."""
    files = queries.vocabulary()
    encoder = packing.Encoder(**files)
    rows = spark.read.parquet(f"{DATA}/conversations.parquet")
    got = chat_windows.windows(rows, lambda: packing.Encoder(**files), budget=120).collect()
    assert len(got) > 20
    for r in got:
        n = len(encoder.ids(r.text))
        assert r.tokens == n and (n <= 120 or r.turns - r.context_turns == 1)


@pytest.mark.parametrize("heavy", [20_000, 3])
def test_near_join_cells(spark, monkeypatch, heavy):
    """Families in many cells and blocks, also with grams that count as heavy."""
    monkeypatch.setattr(near_join, "CELL_SETS", 16)
    rng = np.random.default_rng(9)
    rows = []
    for family, (size, length, edits) in enumerate([(260, 60, 2), (120, 80, 9), (60, 14, 1), (300, 9, 1)]):
        stem = [f"f{family}v{k}" for k in range(length)]
        for _ in range(size):
            w = list(stem)
            for k in rng.integers(0, length, rng.integers(0, edits + 1)):
                w[k] = f"e{rng.integers(40)}"
            rows.append((len(rows), " ".join(w)))
    got = {r.id: r.component_id for r in near_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", 4, 80, 100, heavy).collect()}
    assert got == linked(rows, 4, 80, 100)


def test_near_join_same_prefix(spark):
    """A group of many classes with the same prefix and size."""
    stem = [f"v{k}" for k in range(100)]
    rows = [(k, " ".join([*stem, *[f"t{k}w{j}" for j in range(4)]])) for k in range(30)] + [(99, "")]
    got = {r.id: r.component_id for r in near_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", 4, 85, 100).collect()}
    assert got == linked(rows, 4, 85, 100)


def test_mixing_repeats(spark):
    rows = [(1, f"some words {k} " * (k % 3 + 1), "a") for k in range(40)] + [(None, f"t{k}", None) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    first, second = ([tuple(r) for r in mixing.mix(docs.repartition(n, F.col("text"))).collect()] for n in (3, 5))
    assert first == second


def test_bitmap(spark):
    rows, keys = spark.range(2000).withColumnRenamed("id", "k"), spark.range(0, 2000, 7).withColumnRenamed("id", "k")
    told = common.may_hold(rows, "k", keys)
    assert told.where("k % 7 = 0 and not _hit").count() == 0 and told.where("_hit").count() < 400
    assert common.among(rows, "k", keys).count() == keys.count() == rows.count() - common.without(rows, "k", keys).count()
    assert common.without(rows, "k", keys.limit(0)).count() == 2000
    low = common.lowest(rows, [F.xxhash64("k"), F.col("k")], 50)
    assert [r.k for r in low.collect()] == [r.k for r in rows.orderBy(F.xxhash64("k"), "k").limit(50).collect()]


def test_toxicity_beats_majority(spark):
    """Held-out ranking of toxic before other documents, and accuracy against the larger class."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r.score, labels[r.doc_id]) for r in queries.op1_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    yes, no = [s for s, y in got if y], [s for s, y in got if not y]
    assert np.mean([a > b for a in yes for b in no]) > 0.75


def test_pipeline_stages(spark):
    """Each stage against a plain version, on tables with nulls, repeats and clashing columns."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame([r for r in base() for _ in range(1)], SCHEMA)
    stored = common.stored(docs, "test-docs")
    near = stages["n-gram Jaccard join"](spark, stored, DATA)
    rows = [(k, r[1]) for k, r in enumerate(base())]
    parts = linked(rows, 5, 80, 100)
    assert near.columns == docs.columns and near.count() == len({parts[k] for k, _ in rows})
    exact = stages["exact dedup"](spark, stored, DATA)
    assert exact.count() == len({(r[1] or "").translate(LOWER) for r in base()})
    mixed = stages["mixing sources to target weights"](spark, stored, DATA)
    total = sum(len(words(r.text)) for r in mixed.collect())
    assert mixed.columns == docs.columns and abs(total - 1.5 * sum(len(words(r[1])) for r in base())) < 600
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, common.stored(docs.limit(0), "test-none"), DATA).count() == 0, name
    toxic = stages["toxicity"](spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    assert 0 < toxic.count() < 200


@pytest.mark.parametrize("most", [4096, 0])
def test_flagged(spark, monkeypatch, most):
    """Membership by pages and by a join, also of nulls and of ids at the edges of pages and below zero."""
    monkeypatch.setattr(common, "MOST_PAGES", most)
    ids = [None, -40_000, -32_768, -1, 0, 1, 32_767, 32_768, 32_769, 65_536, 70_000, 2**40]
    rows = spark.createDataFrame([(i, "t") for i in ids + [5, 5]], "doc_id bigint, text string")
    keys = spark.createDataFrame([(i,) for i in ids[::2] + [5]], "doc_id bigint")
    got = sorted((str(r.doc_id), r.trusted) for r in common.flagged(rows, "doc_id", keys, "trusted").collect())
    wanted = {i for i in ids[::2] if i is not None} | {5}
    assert got == sorted((str(i), i in wanted) for i in ids + [5, 5])
