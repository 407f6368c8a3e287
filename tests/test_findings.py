"""Cases of the third round's findings: what went wrong over larger tables, at small size."""

import itertools
import os
import random

import numpy as np
import pytest
from lumbra.operators import definitions, routing, search, semantic, spans, states, syntax, tables
from pyspark.sql import functions as F


@pytest.fixture
def spread(spark):
    """Shuffles keep all their partitions, as they do over large tables."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _vectors(spark, monkeypatch):
    """Vectors of eighths, so that products are exact in any order, over a grid of several blocks of queries and rows."""
    for name, size in (("LEAST_BLOCK", 8), ("ROW_BLOCK", 8), ("QUERY_BLOCK", 4), ("ROW_STEP", 3)):
        monkeypatch.setattr(search, name, size)
    x = np.random.default_rng(5).integers(-8, 9, (90, 6)) / 8
    rows = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(len(x))], "ordinal long, vector array<float>")
    return x, rows.where("ordinal % 10 = 0").withColumnRenamed("ordinal", "query"), rows


def test_floor_over_a_grid(spread, monkeypatch):
    x, queries, rows = _vectors(spread, monkeypatch)
    got = sorted(tuple(r) for r in search.above(queries, rows, 0.5).collect())
    assert got == sorted((q, k, round(float(x[q] @ x[k]), 6)) for q, k in itertools.product(range(0, 90, 10), range(90)) if x[q] @ x[k] >= 0.5)


def test_best_over_a_grid(spread, monkeypatch):
    x, queries, rows = _vectors(spread, monkeypatch)
    got = sorted((r["query"], r["rank"], r["ordinal"]) for r in search.best_of_each(queries, rows, 7).collect())
    assert got == sorted((q, n + 1, k) for q in range(0, 90, 10) for n, k in enumerate(sorted(range(90), key=lambda k: (-(x[q] @ x[k]), k))[:7]))


def _routed(job, catalogue, models):
    """A plain loop over all models of a job's profile."""
    _, profile, context, pixels, override = job
    best = None
    for p, model, place, kind in catalogue:
        m = models[model]
        if p != profile or not m[0] or m[3] or m[5] == "disabled" or context is None or m[1] is None or context > m[1] or (pixels is not None and (m[2] is None or pixels > m[2])) or (override is not None and override != model):
            continue
        stage = 0 if override is not None else {"experiment": 1, "candidate": 2}.get(kind, 3)
        best = min(filter(None, [best, (stage, stage != 2 or not m[4], place, model)]))
    return best and (best[3], best[0], None) or (None, None, "unavailable" if override is None else "invalid_override")


def test_routes_without_all_pairs(spark):
    """Many models with few bounds, bounds that are null, jobs with and without a profile; no join may pair all jobs of a profile with all its models."""
    rng = random.Random(3)
    models = {k: (rng.random() < 0.9, rng.choice([None, 128, 256, 512]), rng.choice([None, 5, 20, 40]), rng.random() < 0.1, rng.random() < 0.4, rng.choice(["stable", "stable", "disabled"])) for k in range(120)}
    catalogue = [(rng.randrange(3), k, rng.randrange(50), rng.choice(["experiment", "candidate", "candidate", "fallback"])) for k in models]
    jobs = [(k, rng.choice([0, 1, 2, 9, None]), rng.choice([None, 1, 128, 200, 512, 600]), rng.choice([None, None, 3, 5, 30, 50]), rng.choice([None, None, rng.randrange(130)])) for k in range(600)]
    got = routing.route(
        spark.createDataFrame(jobs, "job_id int, profile int, context int, pixels int, override int"), spark.createDataFrame(catalogue, "profile int, model int, place int, kind string"),
        spark.createDataFrame([(k, *v) for k, v in models.items()], "model int, installed boolean, most_context int, most_pixels int, disabled boolean, resident boolean, lifecycle string"),
    )
    assert sorted(tuple(r) for r in got.collect()) == sorted((j[0], *_routed(j, catalogue, models)) for j in jobs)
    ways = spark.createDataFrame([(0, k, 128 * (k % 3), 10 * (k % 2)) for k in range(1000)], "profile int, rank int, most_context int, most_pixels int")
    assert [len(r.frontier) for r in routing.frontiers(ways).collect()] == [4]


def test_overlay_plan_in_bounded_tasks(spark, monkeypatch):
    """Tasks follow the rows, and one pass gives the layers of connected histories and the collapsed ones of others."""
    monkeypatch.setattr(tables, "TASK_ROWS", 40)
    history = [(g, -n, f"c{n}", f"t{n}", "x" if g % 5 == 0 and n == 2 else f"c{n - 1}", f"t{n - 1}" if n % 3 else None) for g in range(100) for n in range(1, 1 + g % 7)]
    got = states.overlay_plan(spark.createDataFrame(history, "generation int, age int, commit string, tree string, parent string, parent_tree string"), spark.createDataFrame([(g, "c0", "t0") for g in range(100)], "generation int, base_commit string, base_tree string"))
    want = []
    for g in range(100):
        own = [h for h in history if h[0] == g]
        if all(h[4] == (own[k - 1][2] if k else "c0") for k, h in enumerate(own)):
            want += [(g, h[5] or "t0", h[3], h[2], "Commit", k) for k, h in enumerate(own)]
        else:
            want.append((g, "t0", own[-1][3], own[-1][2], "Collapsed", 0))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert got.rdd.getNumPartitions() >= len(history) // 40


def test_retained_generations_by_one_dealing(spark):
    """One shuffle and no join, whatever is current, young or neither."""
    rng = random.Random(11)
    rows = [(r, k, f"2024-01-{rng.randrange(1, 29):02d} 00:00:00", k % 4 == 0 and r % 3 != 0) for k in range(300) for r in [rng.randrange(40)]]
    rows = [(r, k, at, c and k == max(x[1] for x in rows if x[0] == r and x[3])) for r, k, at, c in rows]
    df = spark.createDataFrame(rows, "repository int, id int, at string, is_current boolean").selectExpr("repository", "id", "timestamp(at) AS published_at", "1L AS bytes", "is_current")
    got = states.retained_generations(df, "2024-01-28 12:00:00", 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    want = []
    for repo in {r for r, *_ in rows}:
        own = [x for x in rows if x[0] == repo]
        now = max([at for _, _, at, c in own if c], default="")
        held = {k for _, k, at, c in own if c or (at > "2024-01-27 12:00:00" and at >= now)}
        rest = sorted(((at, k) for _, k, at, _ in own if k not in held), reverse=True)[: max(0, 2 - len(held))]
        want += [(repo, k, 1, k in held or k in {x for _, x in rest}) for _, k, *_ in own]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_own_lines_without_rows_of_lines(spark):
    """Spans that nest, cross, touch and share a first line, against sets of lines; no row of a line is shuffled."""
    rng = random.Random(9)
    ranges = sorted({(d, a, a + rng.choice([0, 1, 5, 30, 70])) for d in range(12) for a in [rng.randrange(1, 60) for _ in range(25)]})
    df = spark.createDataFrame([(d, a * 1000 + z, a, z) for d, a, z in ranges], "doc int, id int, first int, last int")
    nested = spans.parents(df)
    of = {(r.doc, r.id): (r.first, r.last, r.parent) for r in nested.collect()}
    assert len(of) == len(ranges)
    want = []
    for (doc, i), (a, z, _) in of.items():
        inside = [(x, p) for d, x, p in ranges if d == doc and x <= a and p >= z and (x, p) != (a, z)]
        assert of[doc, i][2] == (max(inside, key=lambda s: (s[0], -s[1]))[0] * 1000 + max(inside, key=lambda s: (s[0], -s[1]))[1] if inside else None)
        child = [(x, y) for (d, _), (x, y, p) in of.items() if d == doc and p == i]
        want += [(doc, i, n) for n in range(a, z + 1) if not any(x <= n <= y for x, y in child) or n in {x for x, _ in child}]
    got = definitions.own_lines(nested)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    plan = definitions.own_lines(df.selectExpr("*", "CAST(NULL AS int) AS parent"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_overlay_occurrences_in_bounded_tasks(spark, monkeypatch):
    """Documents and occurrences that are gone, new, changed, doubled and null on either side, in tasks that follow the rows."""
    monkeypatch.setattr(tables, "TASK_ROWS", 40)
    rng = random.Random(7)
    index = lambda skip, new: {
        "docs": spark.createDataFrame([(k, f"{new}" if k % 23 == 1 else None if k % 9 == 0 else "h") for k in range(200) if k % skip != 3], "doc int, hash string"),
        "occurrences": spark.createDataFrame([(k, n // 2, 4, None if n == 3 else 7 * new if k % 29 == 2 and n == 1 else n) for k in range(200) if k % skip != 3 for n in range(k % 7)], "doc int, sl int, sc int, symbol int"),
        "symbols": spark.createDataFrame([(k, f"s{k}") for k in range(10)], "symbol int, name string"), "edges": spark.createDataFrame([(1, 2, "k")], "source int, target int, kind string"),
    }
    base, current = index(19, 0), index(17, 1)
    layer = semantic.overlay(base, current, spark.createDataFrame([(rng.randrange(250),) for _ in range(9)], "doc int"))
    got = semantic.materialised(base, layer)["occurrences"]
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert key(got.collect()) == key(current["occurrences"].collect())
    left, right = ({tuple(r) for r in x["occurrences"].collect()} for x in (base, current))
    assert key(semantic.differences(base["occurrences"], current["occurrences"]).collect()) == key([(*r, "missing") for r in left - right] + [(*r, "extra") for r in right - left])
    assert got.rdd.getNumPartitions() >= base["occurrences"].count() // 40


def test_positions_are_swept_once(spark):
    """The sweep isn't part of the result's plan, where each use would run it again; batches end inside a document."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(10)
        rows = [(d, a, b, a + rng.choice([0, 1, 9]), b + rng.randrange(1, 9), s, 1, None) for s in range(200) for d, a, b in [(rng.choice("de"), rng.randrange(90), rng.randrange(9))]]
        o = spark.createDataFrame(rows, "doc string, sl int, sc int, el int, ec int, symbol int, roles int, enclosing struct<sl:int,sc:int,el:int,ec:int>")
        points = [(k, rng.choice("de"), rng.randrange(99), rng.randrange(12)) for k in range(300)]
        got = semantic.resolved(o, spark.createDataFrame(points, "point_id int, doc string, line int, col int"))
        assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
        want = {i: min(h)[-1] for i, doc, line, col in points if (h := [(-a, -b, y, z, s) for d, a, b, y, z, s, *_ in rows if d == doc and (a, b) <= (line, col) < (y, z)])}
        assert {r.point_id: r.symbol for r in got.where("exact").collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_symbol_chunks_send_nothing_through_the_driver(spark):
    """Lines of spans are rows that no estimate sees, so no join may be a broadcast."""
    files = spark.createDataFrame([(f"a/{k}.ts", "\n".join(f"w{n}" for n in range(90))) for k in range(20)], "doc string, text string")
    fixed = [("Outer", 2, 0, 2, 60), ("inner", 4, 2, 4, 9), ("loose", 70, 3, None, None)]
    found = files.select("doc").crossJoin(spark.createDataFrame(fixed, "name string, line int, column int, first int, last int"))
    got = definitions.symbol_chunks(files, found)
    assert got.where("kind != 'Text'").count() == 60
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_syntax_is_told_without_shuffles_or_tables(spark):
    """What a text declares comes out of its own row: nothing is written, and no exchange stands in the plan of either query's operator."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = sorted(os.listdir(folder)) if os.path.isdir(folder) else []
    nest = "namespace N;\n" + "".join(f"class C{k} {{ int V{k} => {k}; void M{k}() {{ if (a) {{ f(); }} }} " for k in range(40)) + "int[] A = { 1 }; int B { get; } " + "}" * 40
    df = spark.createDataFrame([("x/a.cs", nest), ("x/b.cs", "namespace N { enum E { A = 1, B } } class { "), ("x/c.cs", "f();")], "doc string, text string")
    chunks, found = syntax.syntax_chunks(df), syntax.definitions_of(df)
    for got in (chunks, found):
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    path = lambda k: ".".join(f"C{n}" for n in range(k + 1))
    symbols = {(r.doc, r.symbol, r.namespace) for r in chunks.collect()}
    assert symbols == {("x/a.cs", s, "N") for k in range(40) for s in (path(k), f"{path(k)}.M{k}")} | {("x/b.cs", "E", "N"), ("x/c.cs", "c.cs", "")}
    assert sorted(r.name for r in found.collect() if r.doc == "x/a.cs") == sorted(f"{c}{k}" for k in range(40) for c in "CM")
    last = next(r for r in chunks.collect() if r.symbol == path(39)).body.split("\n")
    assert last[-4:] == ["    void M39()", "    int[] A = { 1 };", "    int B { get; }", ""]
    assert before == (sorted(os.listdir(folder)) if os.path.isdir(folder) else [])


def test_bodies_stay_where_they_are_cut(spark):
    """What stands in the bodies of methods declares nothing and is no part of a row; accessors are, and members of types inside of bodies."""
    body = "".join(f"if (a{k}) {{ f({k}); }}\n" for k in range(300))
    long = f"namespace N;\nclass C\n{{\n    int P {{ get {{ return 1; }} }}\n    void M()\n    {{\n{body}    }}\n    void L() {{ g(); class In {{ int Q() => 1; }} }}\n    int Z() => 2;\n}}\n"
    df = spark.createDataFrame([("x/a.cs", long), ("x/b.cs", "f();\r\rg();")], "doc string, text string")
    told = {r.doc: [(s.head, s.end) for s in r.statements] for r in syntax.statements(df).collect()}
    assert len(told["x/b.cs"]) == 2 and len(told["x/a.cs"]) < 20 and ("get {", "{") in told["x/a.cs"] and not any("if" in h for h, _ in told["x/a.cs"])
    got = {(r.doc, r.symbol, r.first, r.last) for r in syntax.syntax_chunks(df).collect()}
    assert got == {("x/a.cs", s, a, b) for s, a, b in (("C", 2, 310), ("C.P", 4, 4), ("C.M [1/2]", 5, 288), ("C.M [2/2]", 281, 307), ("C.L", 308, 308), ("C.In.Q", 308, 308), ("C.Z", 309, 309))} | {("x/b.cs", "b.cs", 1, 3)}


def test_only_asked_tokens_become_rows(spark):
    """A line's other tokens give no rows, each of which would hold the whole line."""
    body = "class the x the: " + "y " * 500 + "the-the the"
    df = spark.createDataFrame([("a.json", body + "\nother\nthe"), ("b.ts", "theatre breathe")], "doc string, text string")
    got = semantic.token_positions(df, "the")
    assert sorted(tuple(r) for r in got.collect()) == [("a.json", 0, 6, True), ("a.json", 0, 12, True), ("a.json", 0, len(body) - 3, False), ("a.json", 2, 0, False)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(filter(") == 1 and "posexplode(regexp_extract_all" not in plan and "posexplode(all" not in plan


def test_far_signs_still_declare(spark):
    """Only the end of what stands before a token is read, but all of it where that is signs and blanks."""
    cases = [("class" + " " * 300 + "the", True), ("z " * 400 + "class the", True), ("z" * 400 + "class the", False), ("z " * 400 + "class" + "\x0b" * 250 + "the", False), ("q " * 400 + 'x:Name="' + "\x0b" * 250 + "the", True), ("class(" + "(" * 170 + "the", True), ("z " * 300 + "the", False)]
    got = semantic.token_positions(spark.createDataFrame([(f"{k}.ts", c) for k, (c, _) in enumerate(cases)], "doc string, text string"), "the")
    assert {r.doc: (r.col, r.declares) for r in got.collect()} == {f"{k}.ts": (len(c) - 3, d) for k, (c, d) in enumerate(cases)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "{0,150}" in plan


def test_symbol_chunks_make_no_rows_of_lines(spark, tmp_path):
    """Lines are told by runs and cut out of their text where it meets its spans: no text is written, it is shuffled once and computed once for each use."""
    text = F.regexp_replace("raw", "[ ]+", "\n")
    raw = spark.createDataFrame([(f"a/{k}.ts", " ".join("#" if n % 7 == 3 else f"w{n}{'x' * k}" for n in range(600))) for k in range(6)], "doc string, raw string")
    files = raw.select("doc", text.alias("text"))
    fixed = [("Outer", 2, 0, 2, 60), ("inner", 4, 2, 4, 9), ("loose", 70, 3, None, None), ("late", 500, 0, 500, 520)]
    found = raw.select("doc").crossJoin(spark.createDataFrame(fixed, "name string, line int, column int, first int, last int"))
    got = definitions.symbol_chunks(files, found)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("regexp_replace(raw") == 1
    assert {(r.first, r.last) for r in definitions.outlines(files.limit(1)).selectExpr("inline(solid)").collect()} == {(a, min(a + 5, 600)) for a in range(5, 601, 7)} | {(1, 3)}
    every = got.collect()
    rows = {(r.doc, r.symbol): r for r in every}
    for k in range(6):
        lines = raw.where(F.col("doc") == f"a/{k}.ts").first().raw.split(" ")
        assert rows[f"a/{k}.ts", "Outer"].body.split("\n")[2:] == lines[1:4] + lines[9:60] and rows[f"a/{k}.ts", "loose"].last == 499
        windows = sorted((r.first, r.last, r.body) for r in every if r.doc == f"a/{k}.ts" and r.kind == "Text")
        assert [w[:2] for w in windows] == [(1, 1), (61, 69), (521, 580), (569, 600)] and all(b == "\n".join(lines[a - 1 : z]) for a, z, b in windows)


ODD = """namespace N;
#if X {
/// <summary>C {</summary>
class C
{
    char A = '\u00e9', B = '{'; /* # } */
    string R = $$\"\"\"raw } \"\"\", V = @"a""}";
    int[] F = { 1, 2 };
    int P { get { return "}".Length; } }
    void M(int a, (int, int) b) { class In { int Q() => 1; } }
    [A(1)] enum E { X = 1, Y(2, 3) }
}
"""


@pytest.mark.parametrize("size", [1, 200, 1_000_000])
def test_syntax_makes_no_row_of_tokens(spark, monkeypatch, size):
    """Tokens never are values of a row; steps of any size tell the same."""
    monkeypatch.setattr(syntax, "STEP_BYTES", size)
    df = spark.createDataFrame([(f"x/{k}.cs", ODD.replace("\n", "\r\n") if k % 2 else ODD) for k in range(5)] + [("x/e.cs", ""), ("x/f.cs", "f() {")], "doc string, text string").coalesce(1)
    got = syntax.syntax_chunks(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    rows = {(r.doc, r.symbol): r for r in got.collect()}
    assert {(s, r.first, r.last) for (d, s), r in rows.items() if d == "x/1.cs"} == {("C", 4, 12), ("C.P", 9, 9), ("C.M", 10, 10), ("C.In.Q", 10, 10), ("C.E", 11, 11)}
    assert len(rows) == 26 and rows["x/f.cs", "f.cs"].body == "File: x/f.cs\nf() {"
    for k in range(5):
        body = rows[f"x/{k}.cs", "C"].body.split("\n")
        assert body[:3] == [f"File: x/{k}.cs", "Namespace: N", "/// <summary>C {</summary>"] and body[4:] == ["    char A = '\u00e9', B = '{';", '    string R = $$\"\"\"raw } \"\"\", V = @"a""}";', "    int[] F = { 1, 2 };", "    int P { get; }", "    void M(int a, (int, int) b)", "    [A(1)] enum E { X = 1, Y(2, 3) }", ""]
        assert rows[f"x/{k}.cs", "C.E"].body.endswith("\n    X = 1\n    Y(2, 3)\n")


def test_definitions_carry_no_texts(spark):
    """Where definitions alone are asked for, neither texts, notes nor tokens leave the task's batch, and a head's regular expressions are told once."""
    df = spark.createDataFrame([("x/a.cs", ODD), ("x/b.cs", "/** one */ class B { event E Z; int P => 1; A(int k) => k; this[int k] { get; } }")], "doc string, text string")
    got = syntax.definitions_of(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    cut = next(line for line in plan.split("\n") if "MapInArrow" in line)
    assert "regexp_extract_all" not in plan and "note#" not in cut and "statements#" not in cut and plan.count("(~?@?") == 1
    assert {(r.doc[2], r.name, r.first, r.last) for r in got.collect()} == {("a", "C", 4, 12), ("a", "P", 9, 9), ("a", "M", 10, 10), ("a", "Q", 10, 10), ("a", "E", 11, 11), ("b", "B", 1, 1), ("b", "A", 1, 1), ("b", "this[]", 1, 1)}
