"""Literal cases of the library's functions and operators, beside the queries' SQL."""

import numpy as np
from lumbra.functions import identity, markdown, paths, report, source
from lumbra.functions import text as T
from lumbra.operators import batches, definitions, semantic, states
from lumbra.plans.corpus import worktrees
from pyspark.sql import functions as F


def one(spark, column, **values):
    return spark.range(1).select(column(**{k: F.lit(v) for k, v in values.items()}).alias("x")).first().x


def test_snippet(spark):
    text = "a\r\nb\rc\nd"
    at = lambda **v: one(spark, lambda **c: source.snippet(c["t"], c["h"], c["a"], c["z"], 2), **({"t": text, "h": None} | v))
    assert at(a=1, z=2) == "a\nb" and at(a=2, z=4) == "b\nc\n    ..." and at(a=9, z=9) == source.UNAVAILABLE and at(a=1, z=2, h="0") == source.CHANGED
    lines = lambda s: one(spark, lambda s: source.snippet_lines(s), s=s)
    assert [lines(s) for s in ("", "a", "a\nb\n    ...", source.UNAVAILABLE, source.CHANGED)] == [0, 1, 2, 0, 1]


def test_identifier(spark):
    at = lambda line, col: one(spark, lambda line, col: source.identifier_at(line, col), line=line, col=col)
    assert [at("let my-var = $x", k) for k in (0, 3, 4, 9, 10, 13, 15, 16)] == ["let", None, "my-var", "my-var", None, "$x", "$x", None]


def test_fences(spark):
    text = "a\n```py\nx\n~~~\n```\nb ~~~~\n~~~~\ny\n~~~~"
    parts = one(spark, lambda t: source.fenced_parts(t), t=text)
    assert "".join(p.text for p in parts) == text and [p.translatable for p in parts] == [True, False, True, False]
    held = one(spark, lambda t: source.protected(t), t=text)
    assert len(held.blocks) == 2 and one(spark, lambda t: source.restored(t, F.array(*map(F.lit, held.blocks))), t=held.text) == text
    assert one(spark, lambda t: source.restored(t, F.array(*map(F.lit, held.blocks))), t="lost") is None
    b = one(spark, lambda t: source.boundary_breaks(t), t="\r\n\nx\ny\n")
    assert (b.leading, b.text, b.trailing) == ("\r\n\n", "x\ny", "\n")


def test_markdown(spark):
    check = lambda a, b: one(spark, lambda a, b: markdown.markdown_check(a, b), a=a, b=b)
    assert check("# A\n- x", "# B\n- y") == "ok" and check("# A", "A") == "headings" and check("~~~\nx\n~~~", "x") == "fence_markers" and check("1. a", "a") == "list_markers"
    assert check("```\na\n```", "```\nb\n```") == "fenced_code" and check("`a b`", "`a`") == "inline_code" and check("see https://x.y/z)", "see") == "urls"
    assert check("{{ x y }} {n}", "{{ x y }}") == "placeholders" and check(" # no heading", "no heading") == "ok"


def test_collapse_and_clamp(spark):
    assert one(spark, lambda t: T.collapse(t, 9), t=" a\t\r\n\n\tb  c \n") == "a b  c"
    assert one(spark, lambda t: T.clamp_head_tail(t, 12), t="abcdefghijklmnopqrst") == "ab\n\n[... 8 characters omitted from the middle ...]\n\nklmnopqrst"


def test_paths(spark):
    kind = lambda p: one(spark, lambda p: paths.chunker(p), p=p)
    assert [kind(p) for p in ("a/B.CS", "x.d/y.ts", "a.min.js", "Cargo.lock", "README", "a.b/c", "x/AssemblyInfo.cs")] == ["syntax", "window", None, None, None, None, None]
    walk = lambda p: one(spark, lambda p: paths.walked(p), p=p)
    assert [walk(p) for p in ("a/Bin/x.cs", "bin", ".claude/worktrees/w/x.cs", "a\\out\\x.cs", "a/b.cs")] == [False, True, False, False, True]
    allowed = lambda p: one(spark, lambda p: paths.dirty_allowed(p, F.lit(False)), p=p)
    assert [allowed(p) for p in ("a/x.py", "my_token.py", ".env.json", "k.pem", "obj/x.py", "x.exe")] == [True, False, False, False, False, False]
    leaves = lambda p: one(spark, lambda p: paths.escapes(p), p=p)
    assert [leaves(p) for p in ("a/../b", "a/../../b", "/a", "c:\\x", "./a", "")] == [False, True, True, True, False, False]


def test_report(spark):
    span = lambda n: one(spark, lambda n: report.described_range(n), n=n)
    assert [span(n) for n in (0, 1000, 50_000, 200_000, 5_000_000)] == ["0", "~0.8–1.2K" if span(1000).startswith("~0.8–1.2") else "~0.8–1.1K", "~42–57K" if span(50_000) == "~42–57K" else "~42–58K", "~160–240K", "~4–6M"]
    took = lambda us: one(spark, lambda us: report.duration(us), us=us)
    assert [took(us) for us in (1_499, 999_400, 1_250_000, 61_000_000, 3_725_000_000)] == ["1ms", "999ms", "1.3s", "1m01s", "62m05s"]
    assert [one(spark, lambda a, b: report.percent(a, b), a=a, b=b) for a, b in ((1, 3), (1, 2), (0, 0))] == ["33%", "50%", "0%"]
    assert [one(spark, lambda n: report.size_bucket(n), n=n) for n in (0, 4000, 4001, 16_001)] == ["empty", "small", "medium", "large"]


def test_chunk_ids(spark):
    rows = [("repo", "gen", "tree", None, 0), ("r" * 200, "g", "t", "é" * 100, 2**31 - 1), (" ", "g", "t", None, 1), ("r", "g", "t", None, -1), ("r" * 257, "g", "t", None, 1)]
    df = spark.createDataFrame(rows, "r string, g string, t string, d string, n int")
    got = identity.parsed_chunk_ids(df.withColumn("id", identity.chunk_id(*map(F.col, "rgtdn"))), "id").collect()
    assert [(x.repository, x.generation, x.tree, x.dirty, x.ordinal, x.problem) for x in got[:2]] == [(*r, None) for r in rows[:2]]
    assert [x.id for x in got[2:]] == [None] * 3 and {x.problem for x in got[2:]} == {"chunk_id_malformed"}
    good = got[0].id
    bad = ["", "cs1.", good + "=", good.replace(".", "..", 1), good[:-1] + ("A" if good[-1] != "A" else "B"), good[:8] + ("A" if good[8] != "A" else "B") + good[9:], "cs1.AA." + good.split(".")[2]]
    found = identity.parsed_chunk_ids(spark.createDataFrame([(b,) for b in bad], "id string"), "id").collect()
    assert all(x.problem in ("chunk_id_malformed", "chunk_id_tampered") for x in found) and found[5].problem == "chunk_id_tampered"


def test_worktrees(spark):
    text = "worktree /a\r\nHEAD 1\r\nbranch refs/heads/m\r\n\r\nworktree /b\r\nHEAD 2\r\ndetached\r\nprunable gone\r\n\r\nworktree /c\r\n\r\n"
    got = [tuple(r) for r in worktrees(spark.createDataFrame([(text,)], "text string")).collect()]
    assert got == [("/a", "1", "refs/heads/m", False, False), ("/b", "2", None, True, True)]


def test_batches(spark):
    pieces = list(batches.soft_breaks("para one\n\npara two is long " * 30, 100))
    assert "".join(pieces) == "para one\n\npara two is long " * 30 and max(map(len, pieces)) <= 100
    assert list(batches.soft_breaks("x" * 250, 100)) == ["x" * 100, "x" * 100, "x" * 50]
    budget = lambda b, c, s: one(spark, lambda b, c, s: batches.next_budget(b, c, s), b=b, c=c, s=s)
    assert [budget(48_000, 48_000, s) for s in (3.0, 60.0, 15.0)] == [96_000, 24_000, 48_000] and budget(10_000, 10_000, 600.0) == 8_000 and budget(300_000, 300_000, 1.0) == 400_000 and budget(5, 0, 1.0) == 5
    df = spark.createDataFrame([("q", 1, 5), ("q", 2, 6), ("q", 3, 50), ("q", 4, 1), ("r", 1, 99)], "queue string, position bigint, chars bigint")
    assert [(r.queue, r.batch) for r in batches.greedy_batches(df, 11).orderBy("queue", "position").collect()] == [("q", 0), ("q", 0), ("q", 1), ("q", 2), ("r", 0)]


def test_symbol_chunks_cover_each_line_once(spark):
    """A file's lines are shown once by its definitions and windows, but for one line of each nested definition in its outer one."""
    rng = np.random.default_rng(3)
    for case in range(3):
        lines = [f"line {k}" if rng.random() > 0.2 else "// note" for k in range(80)]
        spans = [("Outer", 5, 40), ("inner", 8, 20), ("deep", 10, 12), ("next", 45, 60)][: case + 2]
        files = spark.createDataFrame([("src/x.ts", "\n".join(lines))], "doc string, text string")
        found = spark.createDataFrame([("src/x.ts", n, a, 0, a, z) for n, a, z in spans] + [("src/x.ts", "loose", 65, 0, None, None)], "doc string, name string, line int, column int, first int, last int")
        got = definitions.symbol_chunks(files, found).collect()
        names = {r.symbol for r in got}
        assert {"Outer", "Outer.inner", "loose"} <= names and ("Outer.inner.deep" in names) == (case > 0)
        shown = sum(len([x for x in r.body.split("\n") if not x.startswith(("File: ", "Namespace: ", "Within: "))]) for r in got if r.kind != "Text")
        nested = sum(any(a <= x and y <= z and (a, z) != (x, y) for _, a, z in spans) for _, x, y in spans)
        windows = set()
        for r in got:
            if r.kind == "Text":
                windows |= set(range(r.first, r.last + 1))
        covered = set()
        for r in got:
            if r.kind != "Text":
                covered |= set(range(r.first, r.last + 1))
        blank = {k + 1 for k, x in enumerate(lines) if not x.strip()}
        assert not windows & covered and windows | covered | blank == set(range(1, 81)) and shown == len(covered) + nested
        assert all(r.body.startswith("File: src/x.ts\nNamespace: src\n") for r in got if r.kind != "Text")
    assert definitions.symbol_chunks(files.limit(0), found).count() == 0


def test_resolved_positions(spark):
    enclosing = "struct<sl:int,sc:int,el:int,ec:int>"
    rows = [("d", 2, 4, 2, 8, "m", 1, (2, 0, 5, 1)), ("d", 2, 9, 2, 10, "p", 1, None), ("d", 7, 0, 7, 3, "a", 1, None), ("d", 7, 5, 7, 8, "b", 1, None), ("d", 9, 0, 9, 4, "r", 2, None), ("d", 4, 4, 4, 20, "wide", 2, None), ("d", 4, 10, 4, 14, "narrow", 18, None)]
    occurrences = spark.createDataFrame(rows, f"doc string, sl int, sc int, el int, ec int, symbol string, roles int, enclosing {enclosing}")
    points = spark.createDataFrame([(1, "d", 4, 12), (2, "d", 2, 0), (3, "d", 7, 4), (4, "d", 9, 9), (5, "d", 4, 5)], "point_id int, doc string, line int, col int")
    assert {r.point_id: (r.symbol, r.exact) for r in semantic.resolved(occurrences, points).collect()} == {1: ("narrow", True), 2: ("m", False), 5: ("wide", True)}


def test_states(spark):
    policy = lambda name, v: one(spark, lambda v: states.policy_value(name, v), v=v)
    assert [policy("generations", 0), policy("archive_retention_days", 9999), policy("sweep_seconds", 1)] == [1, 3650, 5]
    history = spark.createDataFrame([("g", 0, "c2", "t2", "c1", "t1"), ("g", 1, "c1", "t1", "c0", None), ("h", 0, "c2", "t2", "x", "t1"), ("h", 1, "c1", "t1", "c0", None)], "generation string, age int, commit string, tree string, parent string, parent_tree string")
    bases = spark.createDataFrame([("g", "c0", "t0"), ("h", "c0", "t0")], "generation string, base_commit string, base_tree string")
    got = sorted((r.generation, r.nth, r.kind, r.base_tree, r.target_tree) for r in states.overlay_plan(history, bases).collect())
    assert got == [("g", 0, "Commit", "t0", "t1"), ("g", 1, "Commit", "t1", "t2"), ("h", 0, "Collapsed", "t0", "t2")]
