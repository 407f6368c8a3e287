"""The ten operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from lumbra.llm import chat_windows, exact_dedup, mixing, near_join, packing, quality_rules, queries, url_filter
from pyspark.sql import functions as F

from llm_data import LOWER, SCHEMA, base, words

DATA = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(base(), SCHEMA)


def test_exact_dedup(spark, docs):
    got = exact_dedup.deduplicate(docs, largest=True)
    assert got.columns == docs.columns
    groups = {}
    for r in base():
        groups.setdefault((r[1] or "").translate(LOWER), []).append(r)
    assert got.count() == len(groups)
    kept = {(r.text or "").translate(LOWER): r.doc_id for r in got.collect()}
    assert kept == {k: max(r[0] for r in v if r[0] is not None) for k, v in groups.items()}
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


def test_near_join(spark, docs):
    for n, num, den in ((4, 85, 100), (5, 80, 100)):
        rows = [(r[0], words((r[1] or "").translate(LOWER))) for r in base() if r[0] is not None]
        sets = [(i, {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()) for i, w in rows]
        parent = {i: i for i, _ in sets}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in sets:
            for j, b in sets:
                if i < j and a and b and den * len(a & b) >= num * len(a | b):
                    parent[max(find(i), find(j))] = min(find(i), find(j))
        got = near_join.jaccard_components(docs, "doc_id", n, num, den).collect()
        assert len(got) == len(base())
        for r in got:
            if r.id is not None:
                assert (r.component_id, r.n_shingles) == (find(r.id), len(dict(sets)[r.id]))
    assert near_join.jaccard_components(docs.limit(0), "doc_id").count() == 0
    assert near_join.drop_near_duplicates(docs).columns == docs.columns


def test_near_join_large_family(spark):
    """A family of near copies, more than a gram's few groups."""
    rng = np.random.default_rng(5)
    stem = [f"v{k}" for k in range(60)]
    rows = []
    for i in range(60):
        w = list(stem)
        for k in rng.integers(0, 60, 2 + i % 2):
            w[k] = f"e{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    got = {r.id: r.component_id for r in near_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", 4, 85, 100).collect()}
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, t in rows for w in [t.split()]}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in sets}


def test_near_join_short_families(spark):
    """Families of short texts with trimmed and changed ends: groups whose classes are in several components."""
    rng = np.random.default_rng(6)
    rows = []
    for family in range(40):
        stem = [f"f{family}v{k}" for k in range(int(rng.integers(12, 25)))]
        for _ in range(60):
            w = stem[int(rng.integers(0, 4)) : len(stem) - int(rng.integers(0, 4))]
            for end in (0, -1):
                if rng.random() < 0.4:
                    w[end] = f"e{rng.integers(6)}"
            rows.append((len(rows), " ".join(w)))
    got = {r.id: r.component_id for r in near_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", 4, 80, 100).collect()}
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, t in rows for w in [t.split()]}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i + 1, min(len(rows), i // 60 * 60 + 60)):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in sets}


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    files = queries.vocabulary()
    plain = Tokenizer.from_file(files["vocabulary"])
    long = "word ärger 123 " * 30_000
    rows = [r for r in base() if r[0] is not None and r[0] != 2] + [(1000, long, None, None, None, None, None)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).dropDuplicates(["doc_id"]), **files).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    texts = {r[0]: r[1] for r in rows}
    for i, text in texts.items():
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in pieces), "<u4")
        want = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        assert ids.tolist() == want and all(r.doc_tokens == len(want) for r in pieces)
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert sum(r.length for r in pieces) <= 1024
    assert packing.pack(docs.limit(0), **files).count() == 0


def test_encoder_fuzz():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    files = queries.vocabulary()
    encoder = packing.Encoder(**files)

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60))
    def same(text):
        assert encoder.ids(text).tolist() == encoder.slow.encode(text, add_special_tokens=False).ids

    same()


def test_sum_of_squares():
    levels, full = packing.Levels(8), []
    for size in (5, 5, 3, 3, 4, 4, 7, 1):
        got = levels.place((0, 0, np.zeros(size, np.uint32), size), size)
        full += [got] if got else []
    rest = list(levels.settle())
    assert sum(len(p[2]) for w in full + rest for p in w) == 32 and sum(sum(len(p[2]) for p in w) == 8 for w in full + rest) == 4


def test_chat(spark):
    nasty = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", nasty), (1, 2, "assistant", nasty * 30), (1, 3, "user", None), (1, 4, "assistant", "#### \\\\### x"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (3, None, None, "a:b"), (None, 1, "ro:le", "x" * 9000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, window string")
    files = queries.vocabulary()
    written = chat_windows.windows(df, lambda: packing.Encoder(**files), budget=200)
    got = {r.conv_id: r for r in chat_windows.read_back(written).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    later = [r for r in written.collect() if r.conv_id == 1 and r.window]
    assert later and all(chat_windows.parse(r.text)[0] == ("system", "Be kind.") for r in later)
    assert chat_windows.read_back(chat_windows.windows(df.limit(0), lambda: packing.Encoder(**files))).count() == 0


def test_mixing(spark, docs):
    got = mixing.place(docs).collect()
    assert len(got) == len(base())
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
    total = sum(r.size for r in got)
    assert abs(sum({r.source: r.target for r in got}.values()) - 1.5 * total) < 1e-6 * total
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, "http://A.example.NET/en/x"), (2, "https://example.net"), (3, None), (4, "no scheme/en/"), (5, "http://x.org/fr/?q=1#f"), (6, "http://example.com/de/"), (7, "ftp://u@h.net:80/x"), (8, "http://a.net?x://b.org/fr/"), (8, "http://a.net?x://b.org/fr/")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id bigint, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df, url_filter.fit_urls(df), ["page_id", "url", "host"]).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert [got[k].rule for k in (2, 3, 4, 5, 6, 7, 8)] == [None, None, None, "org/fr/", "example.com/de/", None, None]
    assert (got[8].host, got[8].path, got[4].host) == ("a.net", "", "")
    assert {r.verdict for r in got.values()} <= {"allow", "block"}


def test_quality_rules(spark, docs):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(10, 30)], "doc_id bigint, quality int, toxic int")
    model = quality_rules.fit_ratio(docs, labels)
    raw = Counter(b for r in base() for b in quality_rules.buckets(quality_rules.word_hashes([(r[1] or "").encode()])[0]).tolist())
    assert sum(raw.values()) == sum(2 * len(words(r[1])) - 1 for r in base() if words(r[1]))
    for r in quality_rules.judge_quality(docs, model, ["doc_id", "text"]).collect():
        text, w = r.text or "", words(r.text)
        lines = [x for x in text.split("\n") if words(x)]
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = Counter(windows)
        repeated = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge_quality(docs.limit(0), model, ["doc_id"]).count() == 0


def test_classifiers(spark):
    """Held-out accuracy on the driver's smallest tables, and texts without words."""
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for name, label, least in (("op4_quality_classifier", "quality", 0.85), ("op1_toxicity", "toxic", 0.6)):
        got = [r for r in queries.queries()[name](spark, DATA).collect() if r.held_out and r.doc_id in labels]
        assert all(0 <= r.score <= 1 for r in got)
        assert np.mean([r.predicted == labels[r.doc_id][label] for r in got]) >= least
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = [r for r in queries.op6_language_id(spark, DATA).collect() if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in got]) >= 0.9


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, DATA)
    tidy = lambda names, rows: sorted((tuple(round(v, 5) if isinstance(v, float) else v for _, v in sorted(zip(names, r, strict=True))) for r in rows), key=repr)
    assert tidy(df.columns, [tuple(r) for r in df.collect()]) == tidy(want.columns, want.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    docs, kept = spark.read.parquet(f"{DATA}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, DATA)
        if name == "exact dedup":
            assert kept.count() == len({(r.text or "").translate(LOWER) for r in docs.collect()})
        if name == "packing":
            assert kept.agg(F.sum("length")).first()[0] == kept.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n")).first()[0]
            assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in kept.limit(20).collect())
            break
        assert kept.columns == docs.columns
        docs = exact_dedup.stored(kept, "test")
