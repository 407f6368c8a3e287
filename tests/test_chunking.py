"""Syntactic chunks on literal sources, and packing over many tasks against plain loops."""

import random

import pytest
from lumbra import plans
from lumbra.operators import batches, scan, syntax
from pyspark.sql import functions as F

SOURCE = """using System;
namespace Shop.Orders;

/// <summary>Closes { orders }.</summary>
[Serializable]
public sealed class Closer<T> : ICloser, IDisposable where T : class
{
    private readonly IClock _clock = new Clock { Zone = "}" };
    private static readonly Func<int, int> Twice = x => x * 2;
    public event EventHandler Closed;
    public delegate void Done(int n);

    public int Count { get; private set; } = 5;

    public int Short => _clock.Now();

    public string Logic
    {
        get { return "{"; }
        set { _x = value; }
    }

    public Closer(IClock clock) => _clock = clock;

    ~Closer() { }

    /// <summary>Closes the order.</summary>
    // plain note
    public async Task<bool> CloseAsync(Guid id, CancellationToken ct = default(CancellationToken))
    {
        if (id == null) { return false; } /* } */
#region { not a block
        for (int i = 0; i < 3; i++) { }
        return '{' == c || @"a""}" != null;
    }

    public static Closer<T> operator +(Closer<T> a, Closer<T> b) => a;
    public static implicit operator int(Closer<T> c) { return 1; }
    public int this[int k] { get { return k; } }

    public enum Mode
    {
        Fast = 1,
        Slow,
    }

    private struct Inner
    {
        public void Go() { }
        abstract int None(string s);
    }
}

public record Point(int X, int Y);

interface IThing { void Run(); }
"""
FILES = [
    ("src/a.cs", SOURCE.replace("\n", "\r\n")), ("src/b.cs", "Console.WriteLine(1);\n"), ("src/c.cs", "// <auto-generated/>\nclass X { }"), ("src/d.cs", "namespace A { namespace B { class C { void M() {} } } class D { } }\nclass E { }"),
    ("e.cs", ""), ("f.cs", " \n"), ("g.cs", "class Broken { void M() { if (x) {"), ("n.cs", None),
]


def test_syntax_chunks(spark):
    got = syntax.syntax_chunks(spark.createDataFrame(FILES, "doc string, text string")).collect()
    of = {d: sorted((r.kind, r.symbol, r.first, r.last) for r in got if r.doc == d) for d, _ in FILES}
    line = {t: k + 1 for k, t in enumerate(SOURCE.split("\n"))}
    at = lambda start: next(k for t, k in line.items() if t.startswith(start))
    assert of["src/a.cs"] == sorted([
        ("Type", "Closer", 5, at("public record") - 2), ("Method", "Closer.Logic", 17, 21), ("Method", "Closer.Closer", 23, 23), ("Method", "Closer.~Closer", 25, 25), ("Method", "Closer.CloseAsync", 29, 35),
        ("Method", "Closer.operator +", 37, 37), ("Method", "Closer.operator int", 38, 38), ("Method", "Closer.this[]", 39, 39), ("Type", "Closer.Mode", 41, 45), ("Type", "Closer.Inner", 47, 51),
        ("Method", "Closer.Inner.Go", 49, 49), ("Method", "Closer.Inner.None", 50, 50), ("Type", "Point", 54, 54), ("Type", "IThing", 56, 56), ("Method", "IThing.Run", 56, 56),
    ])
    by = {r.symbol: r for r in got if r.doc == "src/a.cs"}
    members = by["Closer"].body.split("\n")
    assert members[:4] == ["File: src/a.cs", "Namespace: Shop.Orders", "/// <summary>Closes { orders }.</summary>", "public sealed class Closer<T>: ICloser, IDisposable"]
    assert '    private readonly IClock _clock = new Clock { Zone = "}" };' in members and "    public int Count { get; set; }" in members and "    public enum Mode { Fast = 1, Slow, }" in members
    assert by["Closer.CloseAsync"].signature == "public async Task<bool> CloseAsync(Guid id, CancellationToken ct = default(CancellationToken))"
    assert by["Closer.CloseAsync"].body.startswith("File: src/a.cs\nNamespace: Shop.Orders\nType: Closer\n/// <summary>Closes the order.</summary>\npublic async Task<bool> CloseAsync(") and by["Closer.CloseAsync"].body.endswith("!= null;\n    }")
    assert by["Closer.Mode"].body.endswith("public enum Mode\n    Fast = 1\n    Slow\n")
    assert of["src/b.cs"] == [("File", "b.cs", 1, 2)] and not of["src/c.cs"] and not of["e.cs"] and not of["f.cs"] and not of["n.cs"]
    assert {(r.symbol, r.namespace) for r in got if r.doc == "src/d.cs"} == {("C", "B"), ("C.M", "B"), ("D", "A"), ("E", "A")}
    assert of["g.cs"] == [("Method", "Broken.M", 1, 1), ("Type", "Broken", 1, 1)]


def test_syntax_chunks_over_blocks(spark, monkeypatch):
    """Texts one at a time give what many at once give, also for a long member in parts."""
    body = "\n".join(f'        Say("line {k} }}}}", \'{{\'); // }} note' for k in range(400))
    text = "class Big\n{\n    void Long()\n    {\n" + body + "\n    }\n    void Next() { }\n}\n"
    df = spark.createDataFrame([("x/big.cs", text), ("x/none.cs", None), ("x/empty.cs", ""), ("x/end.cs", "// only a comment"), ("x/one.cs", "class A { int B() => 1; }")], "doc string, text string").coalesce(1)
    want = sorted(tuple(r) for r in syntax.syntax_chunks(df).collect())
    monkeypatch.setattr(syntax, "STEP", 1)
    assert sorted(tuple(r) for r in syntax.syntax_chunks(df).collect()) == want
    long = sorted((r[5], r[6], r[2]) for r in want if r[2].startswith("Big.Long"))
    assert len(long) > 2 and long[0][:2] == (3, long[0][1]) and long[-1][1] == 405 and all(b[0] == a[1] - 7 for a, b in zip(long, long[1:], strict=False))
    assert [r[5:7] for r in want if r[2] == "Big.Next"] == [(406, 406)]


def _greedy(rows, budget, most):
    out = {}
    for q in {r[0] for r in rows}:
        batch = n = chars = 0
        for _, position, size in sorted((r for r in rows if r[0] == q), key=lambda r: r[1]):
            if n and (n == most or chars + (size or 0) > budget):
                batch, n, chars = batch + 1, 0, 0
            n, chars = n + 1, chars + (size or 0)
            out[q, position] = batch
    return out


@pytest.mark.parametrize(("budget", "most", "block"), [(100, 6, 16), (30, 50, 64), (5, 3, 65536)])
def test_greedy_batches_over_blocks(spark, monkeypatch, budget, most, block):
    monkeypatch.setattr(scan, "FAN", 4)
    rng = random.Random(1)
    rows = [(q, p, rng.choice([None, 0, 1, 5, 9, 30, 99])) for q, n in (("a", 1500), (None, 40), ("b", 1)) for p in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "queue string, position bigint, chars bigint").repartition(7)
    assert {(r.queue, r.position): r.batch for r in batches.greedy_batches(df, budget, most, block=block).collect()} == _greedy(rows, budget, most)
    assert batches.greedy_batches(df.limit(0), budget, most, block=block).count() == 0


def cascade(texts, budget, reduce):
    """One summary after the other into level 0; a level that a piece would overflow is reduced into the next."""
    levels = [[]]

    def put(level, piece):
        if level == len(levels):
            levels.append([])
        if levels[level] and sum(map(len, levels[level])) + len(piece) > budget:
            full, levels[level] = levels[level], []
            summary = reduce(full)
            if summary:
                put(level + 1, summary)
        levels[level].append(piece)

    wide = max(256, budget // 2)
    for t in texts:
        for k in range(0, len(t), wide):
            put(0, t[k : k + wide])
    for level in range(100):
        own, last = levels[level], level == len(levels) - 1
        one = "" if not own else own[0] if len(own) == 1 else reduce(own)
        if last:
            return one
        levels[level] = []
        if one:
            put(level + 1, one)


def test_reduced_levels(spark):
    rng = random.Random(2)
    texts = [("q", i, "".join(rng.choice("abcdef ") for _ in range(rng.choice([0, 3, 50, 700, 2000])))) for i in range(300)] + [("r", 1, "short"), ("s", 1, None), ("t", 1, "x" * 300), ("t", 2, "y" * 300)]
    reduce = lambda t: F.array_join(F.transform(t, lambda p: F.left(p, F.lit(20))), "|")
    got = {r.queue: r.summary for r in batches.reduced(spark.createDataFrame(texts, "queue string, position bigint, summary string"), 1000, reduce, block=64).collect()}
    assert got == {q: cascade([t or "" for a, _, t in texts if a == q], 1000, lambda ps: "|".join(p[:20] for p in ps)) for q in "qrst"}
    assert got["r"] == "short" and got["s"] == "" and got["t"] == "x" * 20 + "|" + "y" * 20
    with pytest.raises(ValueError, match="less than it gets"):
        batches.reduced(spark.createDataFrame([("q", k, "z" * 600) for k in range(4)], "queue string, position bigint, summary string"), 700, lambda t: F.array_join(t, ""))


def test_reduced_logs(spark):
    """The query over whole documents against the cascade."""
    data = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{data}/documents.parquet").select("lang", "doc_id", "text").orderBy("doc_id").collect()
    want = {q: cascade([r.text or "" for r in rows if r.lang == q], 1000, lambda ps: "|".join(p[:20] for p in ps)) for q in {r.lang for r in rows}}
    assert {r.queue: r.summary for r in plans.queries()["reduced_logs"](spark, data).collect()} == want
