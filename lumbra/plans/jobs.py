"""Telemetry, scheduling, retention and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbra.functions import text as T
from lumbra.functions.times import micros
from lumbra.operators import retention, schedule, telemetry

from .retrieval import table

NOW = "2024-02-01 00:00:00"


def jobs(spark, sf_dir):
    """Events as jobs: the type is the model, the value the execution time."""
    e = table(spark, sf_dir, "events")
    outcome = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0), "technical_failure").when(F.col("event_id") % 41 == 0, "technical_failure").otherwise("succeeded")
    return e.select(
        F.col("event_id").alias("job_id"), F.col("event_type").alias("model"), F.concat(F.lit("profile"), (F.col("user_id") % 5).cast("string")).alias("profile"), F.col("ts").alias("recorded_at"),
        F.round(F.abs(F.col("value")) * 1000).cast("long").alias("execution_us"), outcome.alias("outcome"), (F.col("event_id") % 7 == 0).alias("was_cold"), (F.col("event_id") % 11 == 0).alias("used_fallback"), (F.length("props") / 4).cast("long").alias("net_tokens"), "user_id",
    )


_JOBS = """
    j AS (SELECT event_id AS job_id, event_type AS model, 'profile' || (user_id % 5) AS profile, ts AS recorded_at, round(abs(value) * 1000)::BIGINT AS execution_us,
          CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'technical_failure' WHEN event_id % 41 = 0 THEN 'technical_failure' ELSE 'succeeded' END AS outcome,
          event_id % 7 = 0 AS was_cold, event_id % 11 = 0 AS used_fallback, floor(length(props) / 4.0)::BIGINT AS net_tokens, user_id FROM events)"""


def telemetry_summary(spark, sf_dir):
    got = telemetry.summary(jobs(spark, sf_dir))
    return got.select("jobs", micros("first_at").alias("first_us"), micros("last_at").alias("last_us"), "succeeded", "cold", "fallbacks", "net_tokens")


def telemetry_by_model(spark, sf_dir):
    return telemetry.breakdown(jobs(spark, sf_dir), "model")


def telemetry_by_profile(spark, sf_dir):
    return telemetry.breakdown(jobs(spark, sf_dir), "profile")


def outcome_histogram(spark, sf_dir):
    return jobs(spark, sf_dir).groupBy("model", "outcome").agg(F.count("*").alias("jobs"))


def failure_outliers(spark, sf_dir):
    return telemetry.outliers(jobs(spark, sf_dir))


def duration_prediction(spark, sf_dir):
    return telemetry.predicted(jobs(spark, sf_dir), ["model", "profile"])


def predicted_jobs(spark, sf_dir):
    """Orders as waiting jobs: what is known of their kind, else the default of their class."""
    o = table(spark, sf_dir, "orders")
    model = F.element_at(F.array(*[F.lit(x) for x in ("purchase", "view", "unknown")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("short", "medium", "long")]), (F.col("o_custkey") % 3 + 1).cast("int"))
    r = o.select("o_orderkey", model.alias("model"), F.concat(F.lit("profile"), (F.col("o_custkey") % 7).cast("string")).alias("profile"), kind.alias("duration_class"))
    return telemetry.with_defaults(r, telemetry.predicted(jobs(spark, sf_dir), ["model", "profile"]), ["model", "profile"]).select("o_orderkey", "median_us", "p90_us")


def circuit_breaker(spark, sf_dir):
    return telemetry.circuit_opens(jobs(spark, sf_dir), "profile")


def watchdog_islands(spark, sf_dir):
    return telemetry.silences(jobs(spark, sf_dir), "user_id", 600)


def retained_telemetry(spark, sf_dir):
    age = micros(F.lit("2024-02-12 12:00:00")) - micros("recorded_at")
    return jobs(spark, sf_dir).where(age <= 30 * 86_400_000_000).select("job_id")


def _queued(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    got = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderkey").alias("sequence"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("m"), (F.col("o_custkey") % 7).cast("string")).alias("model"), (F.col("o_totalprice") * 100).cast("long").alias("predicted_us"), (F.col("o_orderkey") % 4 != 0).alias("dependency_ready"), (F.col("o_orderkey") % 5 == 0).alias("maintenance"))
    return got


def schedule_order(spark, sf_dir):
    return schedule.schedule(_queued(spark, sf_dir), "1990-01-01 00:00:00", "m3")


def schedule_starved(spark, sf_dir):
    """All jobs have waited too long: the oldest one's model comes first, whatever is resident."""
    return schedule.schedule(_queued(spark, sf_dir), "1999-01-01 00:00:00", "m3")


def queue_dedup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded")
    return schedule.first_enqueued(o.select(F.col("o_orderkey").alias("sequence"), F.col("o_custkey").alias("key"), state.alias("state")), "key")


def quarantine_plan(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    got = o.select(F.col("o_orderkey").cast("string").alias("directory"), F.col("o_orderdate").alias("quarantined_at"), F.col("o_totalprice").cast("long").alias("bytes"))
    return retention.quarantine_plan(got, "1998-08-02 00:00:00", 100, 2000, 100, 3_000_000)


def newest_generations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repository"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("published_at"))
    return retention.newest(o, ["repository"], 3).select("repository", "id", "nth")


def plain_translation_check(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a, b = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source")), c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("translated"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.length("source").alias("chars"), T.plain_check(F.col("source"), F.col("translated"), ("the of", "and the", "translate")).alias("result"))


def shared_budget(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.select("conv_id", "turn", F.greatest(F.lit(0), F.least(F.length("text"), 2000 - before)).cast("long").alias("kept_chars"))


def diagnostic_digest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.concat(F.lit("bad '"), F.col("user_id").cast("string"), F.lit("' in "), F.col("event_type")).alias("message"))
    got = e.groupBy("kind", T.diagnostic_shape(F.col("message")).alias("shape")).agg(F.min_by("message", "event_id").alias("first_message"), F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    return got


QUERIES = {f.__name__: f for f in (telemetry_summary, telemetry_by_model, telemetry_by_profile, outcome_histogram, failure_outliers, duration_prediction, predicted_jobs, circuit_breaker, watchdog_islands, retained_telemetry, schedule_order, schedule_starved, queue_dedup, quarantine_plan, newest_generations, plain_translation_check, shared_budget, diagnostic_digest)}

_BREAKDOWN = "WITH {jobs} SELECT {key}, count(*) AS jobs, count_if(outcome = 'succeeded') AS succeeded, count_if(was_cold) AS cold, count_if(used_fallback) AS fallbacks, quantile_disc(execution_us, 0.5) AS median_us, quantile_disc(execution_us, 0.9) AS p90_us, max(execution_us) AS longest_us, sum(net_tokens)::BIGINT AS net_tokens FROM j GROUP BY {key}"
ORACLES = {
    "telemetry_summary": f"WITH {_JOBS} SELECT count(*) AS jobs, epoch_us(min(recorded_at)) AS first_us, epoch_us(max(recorded_at)) AS last_us, count_if(outcome = 'succeeded') AS succeeded, count_if(was_cold) AS cold, count_if(used_fallback) AS fallbacks, sum(net_tokens)::BIGINT AS net_tokens FROM j",
    "telemetry_by_model": _BREAKDOWN.format(jobs=_JOBS, key="model"),
    "telemetry_by_profile": _BREAKDOWN.format(jobs=_JOBS, key="profile"),
    "outcome_histogram": f"WITH {_JOBS} SELECT model, outcome, count(*) AS jobs FROM j GROUP BY ALL",
    "failure_outliers": f"WITH {_JOBS}, b AS (SELECT model, count(*) AS jobs, count_if(outcome != 'succeeded') AS failures FROM j GROUP BY 1) SELECT * FROM b WHERE jobs >= 10 AND failures > 0 AND failures * 4 >= jobs AND failures * 2 >= (SELECT sum(failures) FROM b)",
    "duration_prediction": f"WITH {_JOBS}, r AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY model, profile ORDER BY recorded_at DESC, job_id DESC) <= 101) SELECT model, profile, count(*) AS samples, quantile_cont(execution_us, 0.5)::DOUBLE AS median_us, quantile_disc(execution_us, 0.9) AS p90_us FROM r GROUP BY 1, 2",
    "predicted_jobs": f"""
        WITH {_JOBS}, r AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY model, profile ORDER BY recorded_at DESC, job_id DESC) <= 101), p AS (SELECT model, profile, quantile_cont(execution_us, 0.5)::DOUBLE AS m, quantile_disc(execution_us, 0.9) AS n FROM r GROUP BY 1, 2)
        SELECT o_orderkey, coalesce(m, [5e6, 15e6, 60e6][o_custkey % 3 + 1])::DOUBLE AS median_us, coalesce(n, [10000000, 30000000, 120000000][o_custkey % 3 + 1])::BIGINT AS p90_us
        FROM orders LEFT JOIN p ON model = ['purchase', 'view', 'unknown'][o_orderkey % 3 + 1] AND profile = 'profile' || (o_custkey % 7)""",
    "circuit_breaker": f"""WITH {_JOBS}, l AS (SELECT *, lag(outcome) OVER w AS before, lag(outcome, 2) OVER w AS earlier FROM j WINDOW w AS (PARTITION BY profile ORDER BY recorded_at, job_id))
        SELECT profile, arg_min(job_id, (recorded_at, job_id)) AS job_id FROM l WHERE outcome = 'technical_failure' AND before = 'technical_failure' AND earlier IS DISTINCT FROM 'technical_failure' GROUP BY 1""",
    "watchdog_islands": f"WITH {_JOBS}, n AS (SELECT user_id, job_id, epoch_us(lead(recorded_at) OVER (PARTITION BY user_id ORDER BY recorded_at, job_id)) - epoch_us(recorded_at) AS gap_us FROM j) SELECT * FROM n WHERE gap_us > 600000000",
    "retained_telemetry": f"WITH {_JOBS} SELECT job_id FROM j WHERE epoch_us(TIMESTAMP '2024-02-12 12:00:00') - epoch_us(recorded_at) <= 30 * 86400000000",
    "schedule_order": """
        WITH c AS (SELECT o_orderkey AS job_id, o_orderdate AS created_at, left(o_orderpriority, 1)::INT AS priority, 'm' || (o_custkey % 7) AS model, trunc(o_totalprice * 100)::BIGINT AS predicted_us FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 4 != 0 AND o_orderkey % 5 != 0)
        SELECT job_id, model, row_number() OVER (ORDER BY predicted_us, created_at, priority, job_id)::INT AS place FROM c WHERE model = 'm3'""",
    "schedule_starved": """
        WITH c AS (SELECT o_orderkey AS job_id, o_orderdate AS created_at, left(o_orderpriority, 1)::INT AS priority, 'm' || (o_custkey % 7) AS model, trunc(o_totalprice * 100)::BIGINT AS predicted_us FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 4 != 0 AND o_orderkey % 5 != 0)
        SELECT job_id, model, row_number() OVER (ORDER BY predicted_us, created_at, priority, job_id)::INT AS place FROM c WHERE model = (SELECT model FROM c ORDER BY created_at, priority, job_id LIMIT 1)""",
    "queue_dedup": "WITH f AS (SELECT o_custkey AS key, min(o_orderkey) AS first FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1) SELECT o_orderkey AS sequence, o_custkey AS key, CASE WHEN o_orderstatus IN ('O', 'P') THEN first ELSE o_orderkey END AS job_sequence FROM orders LEFT JOIN f ON o_custkey = key",
    "quarantine_plan": """
        WITH e AS (SELECT o_orderkey::VARCHAR AS directory, o_orderdate AS since, trunc(o_totalprice)::BIGINT AS bytes, epoch_us(TIMESTAMP '1998-08-02') - epoch_us(o_orderdate) AS age FROM orders),
        a AS (SELECT *, age >= 100 * 86400000000 AS free, age >= 2000 * 86400000000 AS aged FROM e),
        r AS (SELECT *, row_number() OVER (ORDER BY since, directory) AS nth FROM a WHERE free AND NOT aged),
        o AS (SELECT *, nth <= (SELECT count(*) FROM a) - (SELECT count(*) FROM a WHERE free AND aged) - 100 AS over FROM r),
        k AS (SELECT *, (SELECT sum(bytes) FROM a) - coalesce((SELECT sum(bytes) FROM a WHERE free AND aged), 0) - coalesce((SELECT sum(bytes) FROM o WHERE over), 0) - coalesce(sum(bytes) OVER (ORDER BY since, directory ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM o WHERE NOT over)
        SELECT directory, 'age' AS reason FROM a WHERE free AND aged UNION ALL SELECT directory, 'count' FROM o WHERE over UNION ALL SELECT directory, 'bytes' FROM k WHERE held > 3000000""",
    "newest_generations": "SELECT o_custkey AS repository, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS nth FROM orders QUALIFY nth <= 3",
    "plain_translation_check": """
        SELECT a.conv_id, a.turn, length(a.text)::INT AS chars,
               CASE WHEN trim(b.text) = '' THEN 'empty' WHEN contains(b.text, '```') AND NOT contains(a.text, '```') THEN 'fence'
                    WHEN contains(lower(b.text), 'the of') OR contains(lower(b.text), 'and the') OR contains(lower(b.text), 'translate') THEN 'leak' WHEN length(b.text) > greatest(64, length(a.text) * 8) THEN 'length' ELSE 'ok' END AS result
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1 WHERE a.role = 'user' AND b.role = 'assistant'""",
    "shared_budget": "SELECT conv_id, turn, greatest(0, least(length(text), 2000 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS kept_chars FROM conversations",
    "diagnostic_digest": "SELECT event_type AS kind, 'bad '''' in ' || event_type AS shape, arg_min('bad ''' || user_id || ''' in ' || event_type, event_id) AS first_message, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2",
}
