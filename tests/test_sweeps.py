"""Sweeps, grids, refined histograms and budgets against plain loops, on one hot document or key; cuts in UTF-16 units."""

import random

import numpy as np
import pytest
from lumbra.functions import identity
from lumbra.functions import text as T
from lumbra.operators import budgets, chunks, covering, graph, navigation, quantiles, ranges, search, semantic, snapshot
from pyspark.sql import functions as F


def one(spark, column, **values):
    return spark.range(1).select(column(**{k: F.lit(v) for k, v in values.items()}).alias("x")).first().x


def test_points_in_ranges_of_one_document(spark):
    """Overlapping, nested, equal and empty ranges over many stretches, and many on one line."""
    rng = random.Random(1)
    rows = []
    for k in range(700):
        sl, sc = (rng.randrange(300), rng.randrange(9)) if k % 3 else (17, rng.randrange(200))
        el = sl + rng.choice([0, 0, 1, 2, 40, 200]) if k % 3 else sl
        rows.append(("d", sl, sc, el, rng.randrange(12) if el > sl else sc + rng.randrange(40), k))
    points = [(k, rng.choice("de"), rng.choice([17, rng.randrange(300)]), rng.randrange(60)) for k in range(600)]
    r = spark.createDataFrame(rows, "doc string, sl int, sc int, el int, ec int, symbol int")
    p = spark.createDataFrame(points, "point_id int, doc string, line int, col int")
    got = {x.point_id: x.best.symbol for x in covering.best_covering(r, p, [-F.col("sl"), -F.col("sc"), F.col("el"), F.col("ec")], F.struct("symbol"), "symbol").collect()}
    want = {}
    for i, doc, line, col in points:
        held = [(-sl, -sc, el, ec, s) for d, sl, sc, el, ec, s in rows if d == doc and (sl, sc) <= (line, col) < (el, ec)]
        if held:
            want[i] = min(held)[-1]
    assert got == want
    o = spark.createDataFrame([(d, sl, el + 1, s) for d, sl, _, el, _, s in rows], "doc string, start_line int, end_line int, symbol int")
    got = {x.point_id: x.symbol for x in graph.at_position(o, p.select("point_id", "doc", "line")).collect()}
    assert got == {i: min((el + 1 - sl, sl, s) for _, sl, _, el, _, s in rows if sl <= line <= el)[-1] for i, doc, line, _ in points if doc == "d" and any(sl <= line <= el for _, sl, _, el, _, s in rows)}


def test_sole_declaration_of_a_crowded_line(spark):
    enclosing = "struct<sl:int,sc:int,el:int,ec:int>"
    rows = [("d", 5, k, 5, k + 1, f"s{k:03}", 1, None) for k in range(1, 200)] + [("d", 5, 0, 5, 300, "whole", 1, (5, 0, 9, 9))]
    o = spark.createDataFrame(rows, f"doc string, sl int, sc int, el int, ec int, symbol string, roles int, enclosing {enclosing}")
    p = spark.createDataFrame([(1, "d", 5, 400), (2, "d", 6, 0)], "point_id int, doc string, line int, col int")
    assert [tuple(r) for r in semantic.resolved(o, p).collect()] == [(1, "whole", False)]
    assert semantic.resolved(o.where("symbol != 'whole'"), p).count() == 0


@pytest.mark.parametrize("blocks", [(4096, 1024), (7, 16)])
def test_vector_grid(spark, monkeypatch, blocks):
    monkeypatch.setattr(search, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(search, "ROW_BLOCK", blocks[1])
    monkeypatch.setattr(search, "LEAST_BLOCK", min(1024, blocks[1]))
    monkeypatch.setattr(search, "ROW_STEP", 5)
    rng = np.random.default_rng(2)
    rows, asked = rng.normal(size=(150, 8)).round(2), rng.normal(size=(20, 8)).round(2)
    rows[70:80] = rows[3]  # ties
    r = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "ordinal bigint, vector array<double>")
    q = spark.createDataFrame([(k + 500, v.tolist()) for k, v in enumerate(asked)], "query bigint, vector array<double>")
    score = {(i + 500, j): float(search._rounded(np.array([sum(a * b for a, b in zip(x, y, strict=True))]))[0]) for i, x in enumerate(asked) for j, y in enumerate(rows)}
    best = {(i + 500, o): n for i in range(20) for n, (_, o) in enumerate(sorted((-score[i + 500, j], j) for j in range(150))[:12], 1)}
    assert {(x.query, x.ordinal): x["rank"] for x in search.best_of_each(q, r, 12).collect()} == best
    for floor in (2.5, 6.0, 1e9):
        assert {(x.query, x.ordinal): x.score for x in search.above(q, r, floor).collect()} == {k: s for k, s in score.items() if s >= floor}
    assert search.best_of_each(q.limit(0), r, 3).count() == search.best_of_each(q, r.limit(0), 3).count() == 0


def test_nearest_ranks_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", 8)
    rng = random.Random(3)
    rows = [("hot", rng.choice([rng.randrange(-50, 50), rng.randrange(10**9), 7])) for _ in range(3000)] + [("one", 5), (None, 2), (None, 9), ("none", None), ("same", 4), ("same", 4)]
    got = {r["k"]: (r.low, r.mid, r.high) for r in quantiles.nearest_ranks(spark.createDataFrame(rows, "k string, v bigint"), "k", "v", {"low": (1, 100), "mid": (1, 2), "high": (19, 20)}).collect()}
    want = {}
    for key in {k for k, v in rows if v is not None}:
        own = sorted(v for k, v in rows if k == key and v is not None)
        want[key] = tuple(own[max(0, -(-len(own) * a // b) - 1)] for a, b in ((1, 100), (1, 2), (19, 20)))
    assert got == want


def test_ranges(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.randrange(40), rng.choice("abc")) for _ in range(900)]
    df = spark.createDataFrame(rows, "at bigint, name string")
    for n, step in ((256, 16), (9, 4), (1, 16)):
        monkeypatch.setattr(ranges, "RANGES", n)
        monkeypatch.setattr(ranges, "STEP", step)
        cuts = ranges.bounds(df)
        assert all(r["range"] == sum((a, m) <= (r["at"], r["name"]) for a, m in cuts) for r in ranges.ranged(df).collect())


def test_budgets(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(30), f"f{k:03}", rng.choice([0, 1, 5, None])) for k in range(300)]
    df = spark.createDataFrame(rows, "at bigint, name string, size bigint")
    got = {r["name"]: r.taken for r in budgets.within(df, {"rows": (F.lit(1), 120), "size": (F.col("size"), 200)}).collect()}
    n = size = 0
    for _, name, own in sorted(rows):
        n, size = n + 1, size + (own or 0)
        assert got[name] == (n <= 120 and size <= 200)
    told = budgets.left_out(budgets.within(df, {"rows": (F.lit(1), 120), "size": (F.col("size"), 200)}), {"size": F.col("size")}).first()
    assert told.taken + told.omitted == 300 and told.size_taken <= 200
    files = spark.createDataFrame([("a", 1, 10, 100), ("a", 2, 50, 30), ("a", 3, 10, 500), ("a", 4, 1, 5), ("b", 1, 10, None), *[("c", k, 1, 1) for k in range(65)]], "bundle string, nth int, header int, chars int")
    assert sorted(tuple(r) for r in budgets.bundles(files, 160).collect()) == [("a", 1, 100, False, False), ("a", 2, 0, True, False), ("a", 3, 34, False, True), ("a", 4, 0, True, False), ("b", 1, 0, False, False)]


def test_navigation_bounds(spark):
    files = spark.createDataFrame([("a.ts", "class Foo { }\nFoo x = new Foo();"), ("b.ts", "Foo; Foo.bar FooBar my-Foo $Foo"), ("c.ts", "Foo " + "y" * 60), ("d.json", '"Foo": 1'), ("e.ts", "Foo")], "doc string, text string")
    points = spark.createDataFrame([(1, "a.ts", 0, 7), (2, "a.ts", 0, 12), (3, "zz.ts", 0, 0)], "point_id int, doc string, line int, col int")
    run = lambda **k: sorted((r.doc, r.line, r.col, r.declares) for r in navigation.occurrences_by_text(files, points, **k).collect())
    whole = [("a.ts", 0, 6, True), ("a.ts", 1, 0, False), ("a.ts", 1, 12, False), ("b.ts", 0, 0, False), ("b.ts", 0, 5, False), ("c.ts", 0, 0, False), ("d.json", 0, 1, True), ("e.ts", 0, 0, False)]
    assert run() == whole and run(definitions_only=True) == [x for x in whole if x[3]] and run(with_definitions=False) == [x for x in whole if not x[3]]
    assert run(most_results=3) == whole[:3] and run(most_files=4, most_bytes=50) == [x for x in whole if x[0] in ("a.ts", "b.ts", "d.json")]


def test_cuts_in_units(spark):
    cut = lambda t, n: one(spark, lambda t, n: T.left_units(t, n), t=t, n=n)
    text = "a😀b𝒳é"
    assert [cut(text, n) for n in range(8)] == ["", "a", "a", "a😀", "a😀b", "a😀b", "a😀b𝒳", text] and cut("plain é", 3) == "pla"
    assert one(spark, lambda t: T.collapse(t, 4), t=" x😀 \n\n y ") == "x😀 " and one(spark, lambda t: T.units(t), t=text) == 7
    df = spark.createDataFrame([(1, "😀" * 7 + "end of it"), (2, "plain text of no pairs"), (3, ""), (4, None)], "k int, t string")
    rows = chunks.text_fragments(df, "k", "t", 6, 3).orderBy("k", "part").collect()
    for k, text in ((1, "😀" * 7 + "end of it"), (2, "plain text of no pairs")):
        own = [r for r in rows if r.k == k]
        assert "".join(r.fresh for r in own) == text and all("�" not in r.fragment and r.fragment.endswith(r.fresh) for r in own)
        assert all(len(r.fragment.encode("utf-16-le")) <= 14 for r in own)
    assert [r.fragment for r in rows if r.k == 1][:3] == ["😀" * 3, "😀" * 3, "😀" * 3] and [(r.part, r.fragment) for r in rows if r.k == 3] == [(0, "")]


def test_blank_is_white_space(spark):
    assert [one(spark, lambda t: T.blank(t), t=t) for t in ("", " ", "\t", "\n \r", "x", " x\n")] == [True] * 4 + [False] * 2
    assert one(spark, lambda t: T.plain_check(F.lit("source"), t, ()), t="\t\n") == "empty"
    assert one(spark, lambda t: identity.chunk_id(F.lit("r"), F.lit("g"), t, F.lit(None).cast("string"), F.lit(1)), t="\t") is None


def test_confined(spark):
    entries = spark.createDataFrame([("a", "folder"), ("a/b", "file"), ("l", "link"), ("l/x", "file"), ("u", "unavailable"), ("a/d", "folder")], "path string, kind string")
    asked = ["a/b", "a/../a/./b", "a/c", "../a/b", "/a/b", "l/x", "u/x", "a/d", "a", "", ".", "nowhere/x"]
    got = {r.path: r.state for r in snapshot.confined(spark.createDataFrame([(a,) for a in asked], "path string"), entries).collect()}
    assert [got[a] for a in asked] == ["ok", "ok", "missing", "outside", "outside", "link", "unavailable", "missing", "missing", "missing", "missing", "missing"]
