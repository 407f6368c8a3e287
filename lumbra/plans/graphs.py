"""Evaluation, span, routing, Markdown and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumbra.functions import markdown
from lumbra.operators import evaluation, retention, routing, spans
from lumbra.operators.tables import shared_folder
from lumbra.streaming import queue, telemetry

from .retrieval import table


def retrieval_metrics(spark, sf_dir):
    """Orders as cases, their items as hits; an order's customer names the target, urgent orders have no answer."""
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    cases = o.select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderpriority") == "1-URGENT").alias("no_answer"))
    targets = o.select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("Src\\"), (F.col("o_custkey") % 9).cast("string")).alias("path"), F.when(F.col("o_custkey") % 2 == 0, "S").otherwise("").alias("symbol"))
    hits = i.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("src/"), (F.col("l_partkey") % 9).cast("string")).alias("path"), F.when(F.col("l_suppkey") % 2 == 0, "S").otherwise("T").alias("symbol"))
    got = evaluation.evaluate(cases, hits, targets)
    return got.select("cases", *[F.round(c, 9).alias(c) for c in ("precision_5", "recall_10", "first_rank", "false_positives")])


def _spans(spark, sf_dir):
    first = F.col("l_suppkey").cast("int") % 40 + 1
    last = first + F.col("l_quantity").cast("int") % 25
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (first * 1000 + last).alias("id"), first.alias("first"), last.alias("last"))


def span_parents(spark, sf_dir):
    return spans.parents(_spans(spark, sf_dir).distinct())


def uncovered_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(60).alias("n_lines"))
    return spans.uncovered(docs, _spans(spark, sf_dir).drop("id"))


def model_routing(spark, sf_dir):
    """Orders as jobs, suppliers as models, customers' nations as profiles."""
    o = table(spark, sf_dir, "orders")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 25).cast("int").alias("profile"), (F.col("o_orderkey") % 900).alias("context"), F.when(F.col("o_orderkey") % 6 == 0, F.col("o_custkey") % 50).alias("pixels"), F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderkey") % 29 + 1).alias("override"))
    s = table(spark, sf_dir, "supplier")
    kind = F.when(F.col("s_suppkey") % 11 == 0, "experiment").when(F.col("s_suppkey") % 2 == 0, "candidate").otherwise("fallback")
    catalogue = s.select(F.col("s_nationkey").alias("profile"), F.col("s_suppkey").alias("model"), F.col("s_suppkey").alias("place"), kind.alias("kind"))
    models = s.select(F.col("s_suppkey").alias("model"), (F.col("s_suppkey") % 5 != 0).alias("installed"), ((F.col("s_suppkey") % 7 + 1) * 128).alias("most_context"), (F.col("s_suppkey") % 13 == 0).alias("disabled"), (F.col("s_suppkey") % 3 == 0).alias("resident"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 40).alias("most_pixels"), F.when(F.col("s_suppkey") % 17 == 0, "disabled").otherwise("stable").alias("lifecycle"))
    return routing.route(jobs, catalogue, models)


def markdown_validation(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("translated"))
    head, rest = F.lit("# H\n"), F.concat(F.lit("\n"), "source")
    kept = F.when(F.col("conv_id") % 3 == 0, "`a b` {{ x y }} {z}").when(F.col("conv_id") % 3 == 1, "`a b` {{ x y }}").otherwise("{z} {{ x y }}")
    own = F.col("turn") % 5 == 0  # some pairs with structures, kept or not
    p = a.join(b, ["conv_id", "turn"]).withColumn("translated", F.when(own, F.concat(head, kept, rest)).otherwise(F.col("translated"))).withColumn("source", F.when(own, F.concat(head, F.lit("`a b` {{ x y }} {z}"), rest)).otherwise(F.col("source")))
    return p.select("conv_id", "turn", markdown.markdown_check(F.col("source"), F.col("translated")).alias("result"))


def archive_plan(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("directory"), F.col("o_orderdate").alias("terminal_at"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice").cast("long")).alias("response_bytes"))
    return retention.archive_plan(o, "1998-08-02 00:00:00", 100, 2380, 2200, 1450, 1_000_000)


def _event_stream(spark, sf_dir):
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def stream_joined_jobs(spark, sf_dir):
    action = F.when(F.col("event_type") == "purchase", "finish").otherwise("enqueue")
    got = queue.joined_jobs(_event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("sequence"), action.alias("action")))
    return queue.drained(got, "joined-jobs", "append").drop("batch")


def stream_latest_progress(spark, sf_dir):
    got = queue.latest_progress(_event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("sequence"), F.col("value").alias("progress")))
    return queue.newest_batch(queue.drained(got, "latest-progress", "update"), "key")


def _jobs_stream(spark, sf_dir):
    e = _event_stream(spark, sf_dir)
    return e.select(F.col("event_id").alias("job_id"), F.col("event_type").alias("model"), F.concat(F.lit("profile"), (F.col("user_id") % 5).cast("string")).alias("profile"), F.col("ts").alias("recorded_at"), F.round(F.abs(F.col("value")) * 1000).cast("long").alias("execution_us"), "user_id")


def stream_durations(spark, sf_dir):
    """The rolling durations after all events: what ``duration_prediction`` gives over the whole table."""
    got = telemetry.rolling_durations(_jobs_stream(spark, sf_dir), ["model", "profile"])
    keyed = queue.drained(got, "durations", "update").withColumn("key", F.struct("model", "profile"))
    return queue.newest_batch(keyed.drop("model", "profile"), "key").select("key.model", "key.profile", "samples", "median_us", "p90_us")


def stream_silences(spark, sf_dir):
    """Gaps between the events of each user, users that are silent at the end, and jobs that failed by two unhealthy probes (events of one type are probes)."""
    e = _event_stream(spark, sf_dir)
    kind = F.when(F.col("event_type") != "error", "beat").when(F.col("event_id") % 3 != 0, "unhealthy").otherwise("healthy")
    got = telemetry.silences(e.select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("job_id"), kind.alias("kind")), "user_id", 600, "1 hour")
    return queue.drained(got, "silences", "append").drop("batch")


def stream_tasks(spark, sf_dir):
    """Task records: the first of each workflow, of the last days."""
    path = f"{shared_folder(spark)}/tasks-{uuid.uuid4().hex}"
    e = _event_stream(spark, sf_dir).select((F.col("event_id") % 900).alias("workflow"), F.col("ts").alias("recorded_at"), "event_id")
    first = telemetry.first_records(e, "workflow", "1 hour")
    telemetry.keep_tasks(first, path)
    return telemetry.kept_tasks(spark, path, first.schema).select("workflow", "event_id")


QUERIES = {f.__name__: f for f in (retrieval_metrics, span_parents, uncovered_lines, model_routing, markdown_validation, archive_plan, stream_joined_jobs, stream_latest_progress, stream_durations, stream_silences, stream_tasks)}

_SPANS = "s AS (SELECT DISTINCT l_orderkey AS doc, f * 1000 + l AS id, f AS first, l AS last FROM (SELECT *, f + trunc(l_quantity)::INT % 25 AS l FROM (SELECT *, (l_suppkey % 40 + 1)::INT AS f FROM lineitem)))"

_PAIRS = r"p AS (SELECT a.conv_id, a.turn, {x} AS x, {y} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1 WHERE a.role = 'user' AND b.role = 'assistant')"
_COUNTED = (("headings", r"(?m)^#{1,6}\s"), ("fence_markers", r"(?m)^[ \t]{0,3}(?:`{3,}|~{3,})"), ("list_markers", r"(?m)^\s*(?:[-*+]|\d+\.)\s"))
_KEPT = (("fenced_code", r"```[\s\S]*?```"), ("inline_code", r"`[^`\r\n]+`"), ("urls", r"https?://[^\s)]+"), ("placeholders", r"\{\{?[^{}\r\n]+\}?\}"))
_MARKDOWN = (
    "WITH " + _PAIRS.format(x="CASE a.turn % 5 WHEN 0 THEN '# H' || chr(10) || '`a b` {{ x y }} {z}' || chr(10) || a.text ELSE a.text END", y="CASE a.turn % 5 WHEN 0 THEN '# H' || chr(10) || CASE WHEN a.conv_id % 3 = 0 THEN '`a b` {{ x y }} {z}' WHEN a.conv_id % 3 = 1 THEN '`a b` {{ x y }}' ELSE '{z} {{ x y }}' END || chr(10) || a.text ELSE b.text END")
    + " SELECT conv_id, turn, CASE " + " ".join(f"WHEN len(regexp_extract_all(x, '{p}')) != len(regexp_extract_all(y, '{p}')) THEN '{n}'" for n, p in _COUNTED) + " "
    + " ".join(f"WHEN len([t for t in list_distinct(regexp_extract_all(x, '{p}')) if len([u for u in regexp_extract_all(x, '{p}') if u = t]) != (length(y) - length(replace(y, t, ''))) / length(t)]) > 0 THEN '{n}'" for n, p in _KEPT) + " ELSE 'ok' END AS result FROM p"
)

ORACLES = {
    "retrieval_metrics": """
        WITH m AS (SELECT o_orderkey AS id, min(l_linenumber) AS first FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_partkey % 9 = o_custkey % 9 AND (o_custkey % 2 != 0 OR l_suppkey % 2 = 0) WHERE l_linenumber <= 10 GROUP BY 1),
        c AS (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS no_answer, first, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS shown FROM orders LEFT JOIN m ON id = o_orderkey)
        SELECT count(*) AS cases, round(avg(CASE WHEN NOT no_answer THEN CASE WHEN first <= 5 THEN 0.2::DOUBLE ELSE 0 END END), 9) AS precision_5, round(avg(CASE WHEN NOT no_answer THEN (first IS NOT NULL)::INT END), 9) AS recall_10,
               round(avg(CASE WHEN NOT no_answer THEN coalesce(first, 11) END), 9) AS first_rank, round(avg(CASE WHEN no_answer THEN shown::INT END), 9) AS false_positives FROM c""",
    "span_parents": f"""
        WITH {_SPANS} SELECT s.*, (SELECT arg_max(p.id, (p.first, -p.last, p.id)) FROM s p WHERE p.doc = s.doc AND p.first <= s.first AND p.last >= s.last AND (p.first != s.first OR p.last != s.last OR p.id < s.id)) AS parent FROM s""",
    "uncovered_lines": f"""
        WITH {_SPANS}, l AS (SELECT o_orderkey AS doc, unnest(range(1, 61))::INT AS line FROM orders), f AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc = l.doc AND line BETWEEN first AND last)),
        g AS (SELECT *, line - row_number() OVER (PARTITION BY doc ORDER BY line) AS island FROM f) SELECT doc, min(line) AS first, max(line) AS last FROM g GROUP BY doc, island""",
    "model_routing": """
        WITH j AS (SELECT o_orderkey AS job_id, o_custkey % 25 AS profile, o_orderkey % 900 AS context, CASE WHEN o_orderkey % 6 = 0 THEN o_custkey % 50 END AS pixels, CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey % 29 + 1 END AS override FROM orders),
        f AS (SELECT job_id, s_suppkey AS model, CASE WHEN override IS NOT NULL THEN 0 WHEN s_suppkey % 11 = 0 THEN 1 WHEN s_suppkey % 2 = 0 THEN 2 ELSE 3 END AS stage FROM j JOIN supplier ON s_nationkey = profile
              WHERE s_suppkey % 5 != 0 AND s_suppkey % 13 != 0 AND s_suppkey % 17 != 0 AND (pixels IS NULL OR (s_suppkey % 4 != 0 AND pixels <= s_suppkey % 40)) AND context <= (s_suppkey % 7 + 1) * 128 AND (override IS NULL OR s_suppkey = override)),
        b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY stage, CASE WHEN stage = 2 AND model % 3 = 0 THEN 0 ELSE 1 END, model) = 1)
        SELECT j.job_id, model, stage, CASE WHEN model IS NULL THEN CASE WHEN override IS NOT NULL THEN 'invalid_override' ELSE 'unavailable' END END AS problem FROM j LEFT JOIN b ON j.job_id = b.job_id""",
    "markdown_validation": _MARKDOWN,
    "archive_plan": """
        WITH e AS (SELECT o_orderkey::VARCHAR AS directory, o_orderdate AS since, CASE WHEN o_orderkey % 4 != 0 THEN trunc(o_totalprice)::BIGINT END AS bytes, (epoch_us(TIMESTAMP '1998-08-02') - epoch_us(o_orderdate)) / 86400000000.0 AS days FROM orders),
        r AS (SELECT *, row_number() OVER (ORDER BY since, directory) AS nth FROM e),
        d AS (SELECT * FROM r WHERE days >= 100 AND nth <= least(256, greatest((SELECT count(*) FROM e WHERE days >= 2380), (SELECT count(*) - 1450 FROM e)))),
        b AS (SELECT *, row_number() OVER w AS place, coalesce(sum(bytes) OVER (ORDER BY since, directory ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r
              WHERE days >= 100 AND bytes IS NOT NULL AND directory NOT IN (SELECT directory FROM d) WINDOW w AS (ORDER BY since, directory))
        SELECT directory, 'delete' AS action FROM d UNION ALL
        SELECT directory, 'drop' FROM b WHERE place <= 256 - (SELECT count(*) FROM d) AND (days >= 2200 OR (SELECT sum(bytes) FROM e) - (SELECT coalesce(sum(bytes), 0) FROM d) - before > 1000000)""",
    "stream_joined_jobs": """
        WITH g AS (SELECT *, count_if(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS ended FROM events)
        SELECT event_id AS sequence, user_id AS key, min(event_id) OVER (PARTITION BY user_id, ended) AS job_sequence FROM g WHERE event_type != 'purchase'""",
    "stream_latest_progress": "SELECT user_id AS key, event_id AS sequence, value AS progress FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "stream_durations": """
        WITH r AS (SELECT event_type AS model, 'profile' || (user_id % 5) AS profile, round(abs(value) * 1000)::BIGINT AS us FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY ts DESC, event_id DESC) <= 101)
        SELECT model, profile, count(*) AS samples, quantile_cont(us, 0.5)::DOUBLE AS median_us, quantile_disc(us, 0.9) AS p90_us FROM r GROUP BY 1, 2""",
    "stream_silences": """
        WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, event_id, CASE WHEN event_type != 'error' THEN 'beat' WHEN event_id % 3 != 0 THEN 'unhealthy' ELSE 'healthy' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
        s AS (SELECT user_id, nth, CASE WHEN kind = 'beat' THEN us END AS last, CASE WHEN kind = 'beat' THEN event_id END AS job, NULL::BIGINT AS probed, 0 AS bad, false AS failed FROM e WHERE nth = 1
              UNION ALL SELECT user_id, nth, CASE WHEN kind = 'beat' THEN us ELSE last END, CASE WHEN kind = 'beat' THEN event_id ELSE job END, CASE WHEN kind = 'beat' THEN NULL WHEN counts THEN us ELSE probed END,
                               CASE WHEN kind = 'beat' THEN 0 WHEN counts AND kind = 'unhealthy' THEN bad + 1 WHEN counts THEN 0 ELSE bad END, counts AND kind = 'unhealthy' AND bad = 1
              FROM (SELECT e.*, last, job, probed, bad, e.kind != 'beat' AND last IS NOT NULL AND e.us - last >= 600000000 AND (probed IS NULL OR e.us - probed >= 60000000) AS counts FROM s JOIN e ON e.user_id = s.user_id AND e.nth = s.nth + 1)),
        b AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS later FROM e WHERE kind = 'beat')
        SELECT user_id AS key, event_id AS job_id, 'gap' AS event, later - us AS gap_us FROM b WHERE later - us > 600000000
        UNION ALL SELECT user_id, event_id, 'silent', NULL FROM b WHERE later IS NULL AND (us + 600000000) // 1000 < (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events) UNION ALL SELECT user_id, job, 'failed', NULL FROM s WHERE failed""",
    "stream_tasks": """
        WITH f AS (SELECT event_id % 900 AS workflow, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 900 ORDER BY ts, event_id) = 1)
        SELECT workflow, event_id FROM f WHERE ts::DATE >= (SELECT max(ts)::DATE - 7 FROM f)""",
}
