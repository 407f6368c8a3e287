"""Small fixtures for operators and sources that the driver's tables do not exercise."""

import json

import pytest
from lumbra.functions.markdown import markdown_check
from lumbra.operators import evaluation, spans
from lumbra.sources.telemetry import append_telemetry, content_members, read_telemetry, readable
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def test_metrics(spark):
    """Three cases: one target in second place, two targets at ranks 1 and 3, and one without an answer that shows a hit."""
    cases = spark.createDataFrame([("one", False), ("two", False), ("none", True)], "case_id string, no_answer boolean")
    targets = spark.createDataFrame([("one", "A.cs", "A"), ("two", "B.cs", "B"), ("two", "C.cs", "C")], "case_id string, path string, symbol string")
    hits = spark.createDataFrame([("one", 1, "x.cs", "X"), ("one", 2, "a.cs", "A"), ("two", 1, "B.cs", "B"), ("two", 2, "y.cs", "Y"), ("two", 3, "c.cs", "C"), ("none", 1, "n.cs", "Noise")], "case_id string, rank int, path string, symbol string")
    got = evaluation.evaluate(cases, hits, targets).first()
    assert (got.cases, round(got.precision_5, 6), got.recall_10, got.first_rank, got.false_positives) == (3, 0.3, 1.0, 1.5, 1.0)
    assert evaluation.evaluate(cases.where("not no_answer"), hits, targets).first().false_positives is None
    assert evaluation.evaluate(cases.where("false"), hits, targets).first().cases == 0


def test_equal_spans_nest_once(spark):
    rows = spark.createDataFrame([("d", 1, 1, 9), ("d", 2, 1, 9), ("d", 3, 2, 4), ("d", 4, 8, 12), ("e", 5, 2, 4)], "doc string, id int, first int, last int")
    assert {r.id: r.parent for r in spans.parents(rows).collect()} == {1: None, 2: 1, 3: 2, 4: None, 5: None}


def test_uncovered(spark):
    docs = spark.createDataFrame([("d", 10), ("e", 3), ("f", 0)], "doc string, n_lines int")
    rows = spark.createDataFrame([("d", 2, 3), ("d", 2, 6), ("d", 9, 20), ("d", 30, 31)], "doc string, first int, last int")
    assert sorted(map(tuple, spans.uncovered(docs, rows).collect())) == [("d", 1, 1), ("d", 7, 8), ("e", 1, 3)]


@pytest.mark.parametrize(
    ("source", "translated", "want"),
    [("# A\n", "A\n", "headings"), ("```\nx\n```\n", "x", "fence_markers"), ("- a\n- b", "- a", "list_markers"), ("`x` y", "x y", "inline_code"), ("see http://a.b/c", "see http://a.b/", "urls"), ("{n} of", "of", "placeholders"), ("# `x` {n}", "# {n} `x`", "ok"), ("", "", "ok")],
)
def test_markdown(spark, source, translated, want):
    row = spark.createDataFrame([(source, translated)], "a string, b string")
    assert row.select(markdown_check(F.col("a"), F.col("b"))).first()[0] == want


def test_telemetry(spark, tmp_path):
    schema = StructType.fromDDL("job_id string, queue_us bigint")
    (tmp_path / "a.json").write_text(json.dumps({"job_id": "1", "queue_us": 5}) + "\n{broken\n")
    good, bad = readable(read_telemetry(spark, str(tmp_path), schema, strict=False).cache())
    assert [tuple(r) for r in good.collect()] == [("1", 5)] and bad.first()[0] == 1
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        read_telemetry(spark, str(tmp_path), schema).collect()
    out = str(tmp_path / "out")
    append_telemetry(good, out)
    append_telemetry(good, out)
    assert read_telemetry(spark, out, schema).count() == 2
    nested = StructType.fromDDL("a struct<b: array<struct<userPrompt: string>>>, n int")
    assert content_members(nested) == ["a.b.userPrompt"]
    with pytest.raises(ValueError, match="userPrompt"):
        read_telemetry(spark, out, nested)


def test_archive_plan(spark):
    """Ten jobs of one day apart, the newest today: the grace keeps the last two, the limit deletes, then age and the budget drop responses."""
    from lumbra.operators.retention import archive_plan

    rows = [(f"j{k}", f"2024-01-{k + 1:02d} 00:00:00", None if k == 3 else 10) for k in range(10)]
    jobs = spark.createDataFrame(rows, "directory string, terminal_at string, response_bytes bigint").withColumn("terminal_at", F.to_timestamp("terminal_at"))
    plan = lambda *a: sorted((r.directory, r.action) for r in archive_plan(jobs, "2024-01-10 00:00:00", 2, *a).collect())
    assert plan(99, 99, 99, 999) == []
    assert plan(9, 99, 99, 999) == [("j0", "delete")]
    assert plan(99, 99, 7, 999) == [("j0", "delete"), ("j1", "delete"), ("j2", "delete")]
    assert plan(9, 5, 99, 999) == [("j0", "delete"), ("j1", "drop"), ("j2", "drop"), ("j4", "drop")]
    assert plan(9, 99, 99, 60) == [("j0", "delete"), ("j1", "drop"), ("j2", "drop")]
    assert plan(99, 99, 0, 0) == [(f"j{k}", "delete") for k in range(8)]
    assert plan(9, 0, 99, 0, 3) == [("j0", "delete"), ("j1", "drop"), ("j2", "drop")]


def test_quarantine_plan_in_ranges(spark, monkeypatch):
    """Equal times, null bytes and names over many ranges, against a loop; no window is without partition but the one over the ranges."""
    from datetime import datetime, timedelta

    from lumbra.operators import ranges, retention

    monkeypatch.setattr(ranges, "RANGES", 7)
    now = datetime(2024, 1, 31)
    rows = [(f"d{k * 37 % 101}", now - timedelta(days=k % 20), None if k == 50 else k) for k in range(100)]
    entries = spark.createDataFrame(rows, "directory string, quarantined_at timestamp_ntz, bytes bigint")
    for limit, budget in ((60, 1500), (10, 99), (99, 9999), (99, 0)):
        want, kept, held = {}, len(rows), sum(r[2] or 0 for r in rows)
        for name, at, size in sorted(rows, key=lambda r: (r[1], r[0])):
            days = (now - at).days
            if days >= 18:
                want[name], kept, held = "age", kept - 1, held - (size or 0)
        for name, at, size in sorted(rows, key=lambda r: (r[1], r[0])):
            if 2 <= (now - at).days < 18:
                if kept > limit or held > budget:
                    want[name] = "count" if kept > limit else "bytes"
                    kept, held = kept - 1, held - (size or 0)
        plan = retention.quarantine_plan(entries, "2024-01-31 00:00:00", 2, 18, limit, budget)
        assert {r.directory: r.reason for r in plan.collect()} == want
    seen = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert seen and all("[range#" in x for x in seen)


def test_best_of_each_query(spark, monkeypatch):
    """Queries in several blocks, rows in several steps and tasks, with ties: every query has its best rows."""
    import numpy as np
    from lumbra.operators import search

    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(2)
    vectors = [v.tolist() for v in rng.integers(-2, 3, (1400, 3)).astype(float)]
    rows = spark.createDataFrame(list(enumerate(vectors)), "ordinal bigint, vector array<double>").repartition(2)
    queries = spark.createDataFrame([(k, vectors[k]) for k in range(10)], "query bigint, vector array<double>")
    want = {(q, o, n + 1) for q in range(10) for n, o in enumerate(sorted(range(1400), key=lambda o: (-float(np.dot(vectors[q], vectors[o])), o))[:20])}
    assert {(r.query, r.ordinal, r.rank) for r in search.best_of_each(queries, rows, 20).collect()} == want
