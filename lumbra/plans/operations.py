"""Trials, batches, retention, state and validation queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumbra.operators import batches, experiments, snapshot, states
from lumbra.operators.tables import tasks_for

from .corpus import _pick
from .retrieval import _FILES as FILES_SQL
from .retrieval import _files as changed_files
from .retrieval import table

ACTIONS = ("promote", "continue", "fallback", "disable")


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    act = F.when(F.col("event_id") % 13 == 0, _pick(ACTIONS, F.floor(F.col("event_id") / 13)))
    outcome = F.when(F.col("event_id") % 3 == 0, "succeeded").when(F.col("event_id") % 11 == 0, "structural_failure").when(F.col("event_id") % 17 == 0, "context_failure").when(F.col("event_id") % 19 == 0, "cpu_offload").otherwise("technical_failure")
    return e.select(F.col("event_type").alias("profile"), (F.col("user_id") % 40).alias("model"), F.col("event_id").alias("sequence"), (F.col("event_id") % 900).alias("workflow"), F.when(act.isNull(), outcome).alias("outcome"), act.alias("action"))


def trial_states(spark, sf_dir):
    return experiments.trial_states(_log(spark, sf_dir))


def trial_reports(spark, sf_dir):
    log = _log(spark, sf_dir).where("action is null")
    pairs = log.groupBy("profile", "model").agg(F.count("*").alias("attempts"))
    e = table(spark, sf_dir, "events")
    records = e.select(F.col("event_type").alias("profile"), (F.col("user_id") % 40).alias("model"), (F.col("event_id") % 900).alias("workflow"), F.round(F.abs("value") * 1000).cast("long").alias("total_us"), (F.col("event_id") % 7 == 0).alias("cold"), (F.col("event_id") % 11 == 0).alias("used_fallback"), (F.col("event_id") % 100).alias("saved"))
    workflows = log.where("workflow % 4 != 1").select("profile", "model", "workflow").distinct()
    got = experiments.trial_report(pairs, workflows, records.where("workflow % 5 != 2"))
    return got.withColumn("mean_us", F.round("mean_us", 3))


def benchmark_cases(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    cases = o.select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 2 == 0).alias("allow_additional"))
    expected = li.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("case_id"), (F.col("l_partkey") % 5).alias("place"))
    return experiments.benchmark(cases, expected, li.select(F.col("l_orderkey").alias("case_id"), F.when(F.col("l_linenumber") == 2, F.col("l_partkey") % 4).otherwise(F.col("l_partkey") % 5).alias("place")))


def greedy_batches(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return batches.greedy_batches(d.select(F.col("lang").alias("queue"), F.col("doc_id").alias("position"), F.length("text").alias("chars")), 8000, 6).select("queue", "position", "batch")


def next_budgets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", batches.next_budget(F.col("l_partkey") * 100, F.col("l_suppkey") * 500 - 500, (F.col("l_quantity") - 1).cast("double")).alias("budget"))


def reduced_logs(spark, sf_dir):
    """Documents of each language reduced level by level; the reducer keeps each summary's first 20 characters."""
    d = table(spark, sf_dir, "documents")
    return batches.reduced(d.select(F.col("lang").alias("queue"), F.col("doc_id").alias("position"), F.col("text").alias("summary")), 1000, lambda parts: F.array_join(F.transform(parts, lambda p: F.left(p, F.lit(20))), "|"))


def policy_bounds(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey").cast("long")
    v = lambda name, value: states.policy_value(name, value).alias(name)
    grace = n % 2000 - 10
    return o.select("o_orderkey", v("response_grace_minutes", grace), states.policy_value("response_retention_minutes", n % 100 - 5, grace).alias("response_retention_minutes"), v("archive_entry_limit", n % 60), v("response_budget_bytes", n * 5000), v("quarantine_grace_hours", n % 300), v("installed_versions", n % 4))


def repository_states(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    state = states.repository_state(F.col("o_orderkey") % 7 != 0, _pick(("Current", "Failed", "Stale", "Updating"), F.col("o_custkey")), F.when(F.col("o_orderkey") % 5 != 0, F.when(F.col("o_orderkey") % 11 == 0, " ").otherwise(F.col("o_orderstatus"))), F.lit("O"), F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0)
    return o.select("o_orderkey", state.alias("state"))


def _generations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    got = o.repartition(tasks_for(o), "o_custkey").withColumn("top", F.max("o_orderkey").over(Window.partitionBy("o_custkey")))
    return got.select(F.col("o_custkey").alias("repository"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("published_at"), F.col("o_totalprice").cast("long").alias("bytes"), ((F.col("o_orderkey") == F.col("top")) & (F.col("o_custkey") % 3 != 0)).alias("is_current"))


RETENTION_NOW = "1996-01-02 00:00:00"


def retained_generations(spark, sf_dir):
    return states.retained_generations(_generations(spark, sf_dir), RETENTION_NOW, 2)


def removed_overlays(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kept = states.retained_generations(_generations(spark, sf_dir), RETENTION_NOW, 2)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("generation"), F.col("o_custkey").alias("repository"))
    overlays = li.join(o, F.col("l_orderkey") == F.col("generation")).select("repository", "generation", (F.col("l_linenumber") % 4).alias("worktree"), (F.col("l_partkey") % 6).alias("tree"), F.col("l_quantity").cast("long").alias("bytes"))
    reachable = spark.range(12).select((F.col("id") % 4).cast("int").alias("worktree"), (F.col("id") % 3).alias("tree"))
    return states.removed_overlays(overlays, kept, reachable).groupBy("repository", "reason").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def overlay_plans(spark, sf_dir):
    """Orders as generations whose items are commits; every fifth history doesn't connect."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    bases = o.select(F.col("o_orderkey").alias("generation"), F.lit("c0").alias("base_commit"), F.lit("t0").alias("base_tree"))
    name = lambda lead, n: F.concat(F.lit(lead), n.cast("string"))
    n = F.col("l_linenumber")
    history = li.select(F.col("l_orderkey").alias("generation"), (-n).alias("age"), name("c", n).alias("commit"), name("t", n).alias("tree"), F.when((F.col("l_orderkey") % 5 == 0) & (n == 2), "x").otherwise(name("c", n - 1)).alias("parent"), F.when(n % 3 != 0, name("t", n - 1)).alias("parent_tree"))
    return states.overlay_plan(history, bases)


def read_plans(spark, sf_dir):
    old, new = changed_files(spark, sf_dir)
    got = snapshot.partition_files(new, old).withColumn("source", F.regexp_extract("path", r"^[^/]*", 0))
    return states.read_plan(got, "source", 20)


def build_progress(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = states.progress(F.col("o_custkey"), F.col("o_custkey") + F.col("o_orderkey"), F.col("o_totalprice") / 1000)
    return o.select("o_orderkey", F.round(p["rate"], 6).alias("rate"), F.round(p["remaining_s"], 1).alias("remaining_s"))


def index_status(spark, sf_dir):
    old, new = changed_files(spark, sf_dir)
    size = F.length("path").cast("long").alias("bytes")
    changed = snapshot.partition_files(new, old).where("state = 'changed'").select("path", F.lit(2).alias("chunks"), size)
    return states.status_counts(old.select("path", F.lit(3).alias("chunks"), size), changed, snapshot.deleted_paths(old, new))


def directory_sizes(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.groupBy(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("directory")).agg(F.count("*").alias("files"), F.sum(F.octet_length("html").cast("long")).alias("bytes"))


def log_tokens(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(states.saturated_sum(F.length("text").cast("long") * 100_000).alias("tokens"))


def job_accounts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    t = states.job_tokens(F.length("text"), (F.col("turn") * 10).cast("long"), F.col("role"), F.col("turn") % 2 == 0)
    return c.select("conv_id", "turn", t["gross"].alias("gross"), t["net"].alias("net"), t["validator"].alias("validator"))


def csharp_coverage(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    files = o.select(F.col("o_custkey").alias("repository"), F.concat(F.col("o_orderkey").cast("string"), _pick((".CS", ".ts", ".md"), F.col("o_orderkey"))).alias("path"))
    projects = o.select(F.col("o_custkey").alias("repository"), (F.col("o_orderkey") % 19 != 0).alias("covered"))
    return states.coverage(files, files.where("repository % 4 != 1"), projects, False)


def present_worktrees(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 60).alias("path"), "s_suppkey")
    got = states.present(s, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("path")))
    return got.groupBy("present").agg(F.count("*").alias("n"))


def model_fits(spark, sf_dir):
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    adapters = s.select(F.col("s_nationkey").alias("machine"), F.col("s_suppkey").alias("adapter"), (F.abs("s_acctbal") / 8).cast("long").alias("bytes"), (F.col("s_suppkey") % 10 == 0).alias("chosen"))
    choices = p.select(F.col("p_partkey").alias("model"), (F.col("p_size") % 4).alias("context"), F.col("p_retailprice").cast("long").alias("bytes"), (F.col("p_partkey") % 3 != 0).alias("enabled"))
    return states.model_fit(adapters, choices)


def expired_telemetry(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    from lumbra.functions.times import micros

    ticks = micros("ts") * 10 + 621_355_968_000_000_000
    name = F.when(F.col("event_id") % 8 == 0, F.concat(F.lit("x-"), ticks.cast("string"))).otherwise(F.concat(ticks.cast("string"), F.lit("-a.json")))
    return states.expired(e.select("event_id", name.alias("name")), "2024-02-12 12:00:00").select("event_id")


def evaluation_problems(spark, sf_dir):
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    k = F.col("item_id")
    cases = b.select((F.when(k % 9 == 4, k - 1).otherwise(k)).alias("case_id"), F.when(k % 7 == 3, " ").otherwise(F.col("text")).alias("query"), F.lit("c").alias("category"), (k % 5 == 1).alias("no_answer"))
    targets = b.where("item_id % 5 != 0").select(k.alias("case_id"), F.concat(F.lit("d\\"), (k * 3).cast("string")).alias("path"), F.when(k % 4 == 2, "A.not there").otherwise("").alias("symbol"))
    sources = d.where("doc_id % 2 = 0").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), "text")
    return states.corpus_problems(cases, targets, sources)


def catalogue_problems(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    models = s.select((F.col("s_suppkey") % 90).cast("string").alias("tag"), _pick(("stable", "experimental", "stable"), F.col("s_suppkey")).alias("lifecycle"), _pick(("recommended", "manual"), F.col("s_suppkey")).alias("policy"))
    n = table(spark, sf_dir, "nation")
    routes = n.where("n_nationkey % 6 != 0").select(F.col("n_nationkey").cast("string").alias("profile"), F.when(F.col("n_nationkey") % 4 == 0, "deterministic").otherwise("model").alias("mode"))
    named = s.select((F.col("s_suppkey") % 17).cast("string").alias("profile"), (F.col("s_suppkey") * 2).cast("string").alias("tag"), _pick(("candidate", "fallback", "candidate"), F.col("s_suppkey")).alias("role"))
    allowed = s.select((F.col("s_suppkey") % 95).cast("string").alias("tag"))
    return states.catalogue_problems(models, routes, named, allowed, n.select(F.col("n_nationkey").cast("string").alias("profile")))


def missing_models(spark, sf_dir):
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    return p.where("p_size = 7").select((F.col("p_partkey") % 300).alias("model")).subtract(s.select((F.col("s_suppkey") * 2).alias("model")))


def reusable_corpora(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    from lumbra.functions.identity import same_snapshot

    own = [F.col("o_orderstatus"), (F.col("o_custkey") % 3), F.lit(64)]
    return o.select("o_orderkey", same_snapshot(own, [F.lit("O"), (F.col("o_orderkey") % 3), F.lit(64)]).alias("reusable"))


def publishable_generations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    generations = o.groupBy(F.col("o_custkey").alias("repository")).agg(F.max("o_orderkey").alias("generation"))
    overlays = o.where("o_custkey % 4 != 2").select(F.col("o_custkey").alias("repository"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderkey")).otherwise(F.lit(0)).alias("g"), (F.col("o_orderkey") % 6 != 0).alias("ready"))
    top = generations.select("repository", F.col("generation").alias("top"))
    overlays = overlays.join(top, "repository").select("repository", F.when(F.col("repository") % 8 == 0, F.col("g")).otherwise(F.col("top")).alias("generation"), "ready")
    return states.publishable(generations, overlays)


QUERIES = {f.__name__: f for f in (trial_states, trial_reports, benchmark_cases, greedy_batches, next_budgets, reduced_logs, policy_bounds, repository_states, retained_generations, removed_overlays, overlay_plans, read_plans, build_progress, index_status, directory_sizes, log_tokens, job_accounts, csharp_coverage, present_worktrees, model_fits, expired_telemetry, evaluation_problems, catalogue_problems, missing_models, reusable_corpora, publishable_generations)}

_LOG = """
    g AS (SELECT event_type AS profile, user_id % 40 AS model, event_id AS sequence, event_id % 900 AS workflow, CASE WHEN event_id % 13 = 0 THEN ['promote', 'continue', 'fallback', 'disable'][event_id // 13 % 4 + 1] END AS action,
          CASE WHEN event_id % 13 != 0 THEN CASE WHEN event_id % 3 = 0 THEN 'succeeded' WHEN event_id % 11 = 0 THEN 'structural_failure' WHEN event_id % 17 = 0 THEN 'context_failure' WHEN event_id % 19 = 0 THEN 'cpu_offload' ELSE 'technical_failure' END END AS outcome FROM events)"""
_CLAMP = lambda x, lo, hi: f"least(greatest({x}, {lo}), {hi})"
_GEN = f"""
    n AS (SELECT o_custkey AS repository, o_orderkey AS id, o_orderdate AS published, trunc(o_totalprice)::BIGINT AS bytes, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AND o_custkey % 3 != 0 AS cur FROM orders),
    h AS (SELECT *, cur OR (epoch_us(TIMESTAMP '{RETENTION_NOW}') - epoch_us(published) < 86400000000 AND (max(CASE WHEN cur THEN published END) OVER (PARTITION BY repository) IS NULL OR published >= max(CASE WHEN cur THEN published END) OVER (PARTITION BY repository))) AS held FROM n),
    q AS (SELECT *, count_if(held) OVER (PARTITION BY repository) AS n_held, row_number() OVER (PARTITION BY repository, held ORDER BY published DESC, id DESC) AS nth FROM h),
    k AS (SELECT repository, id, bytes, held OR nth <= greatest(0, 2 - n_held) AS kept FROM q)"""

ORACLES = {
    "trial_states": f"""
        WITH {_LOG}, r AS (SELECT *, sum(CASE WHEN action = 'continue' THEN 1 ELSE 0 END) OVER (PARTITION BY profile, model ORDER BY sequence) AS round FROM g), c AS (SELECT * FROM r QUALIFY round = max(round) OVER (PARTITION BY profile, model)),
        a AS (SELECT profile, model, arg_max(action, sequence) AS action, max(CASE WHEN action = 'promote' THEN sequence END) AS promoted_at, max(sequence) AS acted_at FROM c WHERE action IS NOT NULL GROUP BY ALL),
        t AS (SELECT profile, model, sequence, outcome FROM c WHERE action IS NULL QUALIFY row_number() OVER (PARTITION BY profile, model, workflow ORDER BY sequence) = 1),
        s AS (SELECT t.profile, t.model, count(*) AS attempts, count_if(outcome = 'succeeded') AS successes, count_if(outcome = 'technical_failure') AS technical_failures, count_if(outcome = 'structural_failure') AS structural_failures, count_if(outcome = 'context_failure') AS context_failures, count_if(outcome = 'cpu_offload') AS cpu_offloads, greatest(max(CASE WHEN outcome != 'technical_failure' THEN sequence END), max(promoted_at)) AS calm, max(sequence) AS tried FROM t LEFT JOIN a USING (profile, model) GROUP BY ALL),
        x AS (SELECT t.profile, t.model, count(*) AS consecutive FROM t JOIN s USING (profile, model) WHERE outcome = 'technical_failure' AND (calm IS NULL OR sequence > calm) GROUP BY ALL)
        SELECT p.profile, p.model, coalesce(attempts, 0) AS attempts, coalesce(successes, 0) AS successes, coalesce(technical_failures, 0) AS technical_failures, coalesce(structural_failures, 0) AS structural_failures, coalesce(context_failures, 0) AS context_failures, coalesce(cpu_offloads, 0) AS cpu_offloads, coalesce(consecutive, 0) AS consecutive,
               CASE WHEN tried IS NOT NULL AND (acted_at IS NULL OR tried > acted_at) THEN attempts >= 10 ELSE coalesce(action IN ('fallback', 'disable'), false) END AS paused,
               CASE WHEN tried IS NOT NULL AND (acted_at IS NULL OR tried > acted_at) THEN coalesce(consecutive, 0) >= 2 ELSE coalesce(action = 'disable', false) END AS open,
               promoted_at IS NOT NULL AND NOT coalesce(action IN ('fallback', 'disable'), false) AS promoted
        FROM (SELECT DISTINCT profile, model FROM g) p LEFT JOIN s USING (profile, model) LEFT JOIN x USING (profile, model) LEFT JOIN a USING (profile, model)""",
    "trial_reports": f"""
        WITH {_LOG}, p AS (SELECT profile, model, count(*) AS attempts FROM g WHERE action IS NULL GROUP BY ALL), w AS (SELECT DISTINCT profile, model, workflow FROM g WHERE action IS NULL AND workflow % 4 != 1),
        e AS (SELECT event_type AS profile, user_id % 40 AS model, event_id % 900 AS workflow, event_id, round(abs(value) * 1000)::BIGINT AS us FROM events WHERE event_id % 900 % 5 != 2),
        m AS (SELECT profile, model, count(*) AS observed, count_if(event_id % 11 = 0) AS fallbacks, avg(us) AS mean_us, quantile_disc(us, 0.5) AS median_us, quantile_disc(us, 0.9) AS p90_us, count_if(event_id % 7 = 0) AS cold, sum(event_id % 100)::BIGINT AS saved FROM e JOIN w USING (profile, model, workflow) GROUP BY ALL)
        SELECT profile, model, attempts, coalesce(observed, 0) AS observed, coalesce(fallbacks, 0) AS fallbacks, round(coalesce(mean_us, 0), 3) AS mean_us, coalesce(median_us, 0) AS median_us, coalesce(p90_us, 0) AS p90_us, coalesce(cold, 0) AS cold, coalesce(saved, 0) AS saved FROM p LEFT JOIN m USING (profile, model)""",
    "benchmark_cases": """
        WITH w AS (SELECT DISTINCT l_orderkey AS id, l_partkey % 5 AS place FROM lineitem WHERE l_linenumber <= 3), h AS (SELECT DISTINCT l_orderkey AS id, CASE WHEN l_linenumber = 2 THEN l_partkey % 4 ELSE l_partkey % 5 END AS place FROM lineitem),
        m AS (SELECT id, count(*) AS missing FROM (FROM w EXCEPT FROM h) GROUP BY 1), a AS (SELECT id, count(*) AS n FROM w GROUP BY 1), b AS (SELECT id, count(*) AS n FROM h GROUP BY 1)
        SELECT o_orderkey AS case_id, coalesce(missing, 0) = 0 AND (o_custkey % 2 = 0 OR coalesce(a.n, 0) = coalesce(b.n, 0)) AS passed, coalesce(a.n, 0) AS expected, coalesce(b.n, 0) AS actual, coalesce(missing, 0) AS missing FROM orders LEFT JOIN a ON a.id = o_orderkey LEFT JOIN b ON b.id = o_orderkey LEFT JOIN m ON m.id = o_orderkey""",
    "greedy_batches": """
        WITH RECURSIVE d AS (SELECT lang AS queue, doc_id AS position, coalesce(length(text), 0) AS chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth FROM documents),
        b AS (SELECT queue, position, nth, 0 AS batch, 1 AS n, chars AS total FROM d WHERE nth = 1
              UNION ALL SELECT d.queue, d.position, d.nth, CASE WHEN b.n = 6 OR b.total + d.chars > 8000 THEN batch + 1 ELSE batch END, CASE WHEN b.n = 6 OR b.total + d.chars > 8000 THEN 1 ELSE b.n + 1 END, CASE WHEN b.n = 6 OR b.total + d.chars > 8000 THEN d.chars ELSE b.total + d.chars END
              FROM b JOIN d ON d.queue = b.queue AND d.nth = b.nth + 1)
        SELECT queue, position, batch::BIGINT AS batch FROM b""",
    "next_budgets": """
        WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey * 100 AS b, l_suppkey * 500 - 500 AS c, (l_quantity - 1)::DOUBLE AS s FROM lineitem)
        SELECT l_orderkey, l_linenumber, (CASE WHEN c <= 0 OR s <= 0 THEN b ELSE floor(greatest(least(greatest(least(c / s * 15, b * 2.0::DOUBLE), b / 2.0::DOUBLE), 400000.0::DOUBLE), 8000.0::DOUBLE)) END)::BIGINT AS budget FROM x""",
    "policy_bounds": f"""
        SELECT o_orderkey, {_CLAMP('o_orderkey % 2000 - 10', 1, 1440)} AS response_grace_minutes, greatest({_CLAMP('o_orderkey % 100 - 5', 1, 43200)}, {_CLAMP('o_orderkey % 2000 - 10', 1, 1440)}) AS response_retention_minutes,
               greatest(o_orderkey % 60, 32) AS archive_entry_limit, greatest(o_orderkey * 5000, 16777216) AS response_budget_bytes, {_CLAMP('o_orderkey % 300', 1, 168)} AS quarantine_grace_hours, greatest(o_orderkey % 4, 2) AS installed_versions FROM orders""",
    "repository_states": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'NotConfigured' WHEN o_custkey % 4 = 1 THEN 'Failed' WHEN o_custkey % 4 = 3 THEN 'Updating' WHEN o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 OR o_orderstatus != 'O' THEN 'Stale'
               WHEN o_orderkey % 2 != 0 THEN 'Current' WHEN o_orderkey % 3 = 0 THEN 'DirtyCurrent' ELSE 'DirtyPending' END AS state FROM orders""",
    "retained_generations": f"WITH {_GEN} SELECT * FROM k",
    "removed_overlays": f"""
        WITH {_GEN}, o AS (SELECT o_custkey AS repository, l_orderkey AS id, l_linenumber % 4 AS worktree, l_partkey % 6 AS tree, trunc(l_quantity)::BIGINT AS bytes FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
        x AS (SELECT o.repository, o.bytes, CASE WHEN NOT kept THEN 'generation' WHEN tree >= 3 THEN 'unreachable' END AS reason FROM o JOIN k ON k.repository = o.repository AND k.id = o.id) SELECT repository, reason, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM x WHERE reason IS NOT NULL GROUP BY ALL""",
    "overlay_plans": """
        WITH h AS (SELECT l_orderkey AS g, l_linenumber AS n, CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 2 THEN 'x' ELSE 'c' || (l_linenumber - 1) END AS parent FROM lineitem),
        f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n) - 1 AS nth, parent = coalesce(lag('c' || n) OVER (PARTITION BY g ORDER BY n), 'c0') AS follows FROM h), w AS (SELECT *, bool_and(follows) OVER (PARTITION BY g) AS ok, max(n) OVER (PARTITION BY g) AS top FROM f)
        SELECT g AS generation, CASE WHEN ok AND n % 3 != 0 THEN 't' || (n - 1) ELSE 't0' END AS base_tree, 't' || n AS target_tree, 'c' || n AS commit, CASE WHEN ok THEN 'Commit' ELSE 'Collapsed' END AS kind, (CASE WHEN ok THEN nth ELSE 0 END)::INT AS nth FROM w WHERE ok OR n = top""",
    "read_plans": f"WITH {FILES_SQL} SELECT regexp_extract(path, '^[^/]*') AS source, count_if(state = 'changed') AS to_read, count_if(state = 'reused') AS reused, count_if(state = 'changed') > 20 AS refused FROM st GROUP BY 1",
    "build_progress": "WITH x AS (SELECT *, o_custkey / greatest(0.001::DOUBLE, o_totalprice / 1000) AS rate FROM orders) SELECT o_orderkey, round(rate, 6) AS rate, round(o_orderkey / greatest(0.001::DOUBLE, rate), 1) AS remaining_s FROM x",
    "index_status": f"""
        WITH {FILES_SQL}, ov AS (SELECT path FROM st WHERE state = 'changed'), b AS (SELECT path, lower(path) IN (FROM ov) AS o, path IN (SELECT path FROM del) AS d FROM old)
        SELECT count_if(NOT o AND NOT d) + (SELECT count(*) FROM ov) AS files, 3 * count_if(NOT o AND NOT d) + 2 * (SELECT count(*) FROM ov) AS chunks, count_if(o) AS shadowed, count_if(d AND NOT o) AS deleted, (sum(length(path)) + (SELECT sum(length(path)) FROM ov))::BIGINT AS bytes FROM b""",
    "directory_sizes": "SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS directory, count(*) AS files, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1",
    "log_tokens": "SELECT role, least(coalesce(sum(length(text) * 100000), 0), 2147483647)::BIGINT AS tokens FROM conversations GROUP BY 1",
    "job_accounts": "SELECT conv_id, turn, (length(text) + 3) // 4 AS gross, greatest(0, (length(text) + 3) // 4 - turn * 10) AS net, role || CASE WHEN turn % 2 = 0 THEN ':pass' ELSE ':fail' END AS validator FROM conversations",
    "csharp_coverage": "SELECT o_custkey AS repository, CASE WHEN NOT bool_and(o_orderkey % 19 != 0) OR (bool_or(o_orderkey % 3 = 0) AND o_custkey % 4 = 1) THEN 'warn' ELSE 'ok' END AS verdict FROM orders GROUP BY 1",
    "present_worktrees": "SELECT s_suppkey % 60 IN (SELECT n_nationkey FROM nation) AS present, count(*) AS n FROM supplier GROUP BY 1",
    "model_fits": """
        WITH a AS (SELECT s_nationkey AS machine, trunc(abs(s_acctbal) / 8)::BIGINT AS room FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_suppkey % 10 = 0) DESC, trunc(abs(s_acctbal) / 8)::BIGINT DESC, s_suppkey DESC) = 1),
        c AS (SELECT p_partkey AS model, p_size % 4 AS context, trunc(p_retailprice)::BIGINT AS bytes FROM part WHERE p_partkey % 3 != 0),
        l AS (SELECT machine, list(model ORDER BY bytes, model, context) AS c FROM a JOIN c ON bytes <= room GROUP BY 1)
        SELECT a.machine, c[1] AS minimal, c[(len(c) - 1) // 2 + 1] AS recommended, c[len(c)] AS extended FROM a LEFT JOIN l ON a.machine = l.machine""",
    "expired_telemetry": "SELECT event_id FROM events WHERE event_id % 8 != 0 AND epoch_us(ts) < epoch_us(TIMESTAMP '2024-02-12 12:00:00') - 30 * 86400000000",
    "evaluation_problems": """
        WITH c AS (SELECT CASE WHEN item_id % 9 = 4 THEN item_id - 1 ELSE item_id END AS id, CASE WHEN item_id % 7 = 3 THEN ' ' ELSE text END AS query, item_id % 5 = 1 AS none FROM benchmark), m AS (SELECT id, count(*) AS times FROM c GROUP BY 1),
        t AS (SELECT item_id AS id, item_id * 3 AS d, item_id % 4 = 2 AS named FROM benchmark WHERE item_id % 5 != 0), j AS (SELECT id, count(*) AS n, bool_or(doc_id IS NULL) AS missing, bool_or(named AND doc_id IS NOT NULL AND NOT contains(text, 'not there')) AS absent FROM t LEFT JOIN documents ON doc_id = d AND doc_id % 2 = 0 GROUP BY 1)
        SELECT DISTINCT * FROM (SELECT c.id AS case_id, CASE WHEN trim(query) = '' THEN 'blank' WHEN times > 1 THEN 'duplicate' WHEN none = (coalesce(n, 0) > 0) THEN 'inconsistent' WHEN missing THEN 'missing' WHEN absent THEN 'symbol_absent' END AS problem FROM c JOIN m USING (id) LEFT JOIN j ON j.id = c.id) WHERE problem IS NOT NULL""",
    "catalogue_problems": """
        WITH m AS (SELECT (s_suppkey % 90)::VARCHAR AS tag, s_suppkey % 3 = 1 AS trial, s_suppkey % 2 = 0 AS good FROM supplier), r AS (SELECT n_nationkey AS k, n_nationkey::VARCHAR AS profile, n_nationkey % 4 = 0 AS fixed FROM nation WHERE n_nationkey % 6 != 0),
        n AS (SELECT (s_suppkey % 17)::VARCHAR AS profile, (s_suppkey * 2)::VARCHAR AS tag, s_suppkey % 3 = 1 AS fallback FROM supplier), a AS (SELECT (s_suppkey % 95)::VARCHAR AS tag FROM supplier),
        p AS (SELECT profile, count_if(NOT fallback) AS c, count_if(fallback) AS f FROM n GROUP BY 1), x AS (SELECT r.profile, fixed, coalesce(c, 0) AS c, coalesce(f, 0) AS f FROM r LEFT JOIN p ON p.profile = r.profile)
        SELECT tag AS subject, 'duplicate_tag' AS problem FROM m GROUP BY tag HAVING count(*) > 1 UNION SELECT tag, 'duplicate_allowed' FROM a GROUP BY tag HAVING count(*) > 1 UNION SELECT n_nationkey::VARCHAR, 'no_route' FROM nation WHERE n_nationkey % 6 = 0
        UNION SELECT profile, 'incomplete' FROM x WHERE NOT fixed AND (c = 0 OR f = 0) UNION SELECT profile, 'names_models' FROM x WHERE fixed AND c + f > 0 UNION SELECT profile, 'unknown_model' FROM n WHERE tag NOT IN (SELECT tag FROM m) UNION SELECT tag, 'not_allowed' FROM a WHERE tag NOT IN (SELECT tag FROM m WHERE trial OR good)""",
    "missing_models": "SELECT p_partkey % 300 AS model FROM part WHERE p_size = 7 EXCEPT SELECT s_suppkey * 2 FROM supplier",
    "reusable_corpora": "SELECT o_orderkey, o_orderstatus = 'O' AND o_custkey % 3 = o_orderkey % 3 AS reusable FROM orders",
    "publishable_generations": """
        WITH g AS (SELECT o_custkey AS repository, max(o_orderkey) AS generation FROM orders GROUP BY 1), o AS (SELECT o_custkey AS repository, CASE WHEN o_custkey % 8 = 0 THEN o_orderkey ELSE generation END AS f, o_orderkey % 6 != 0 AS ready FROM orders JOIN g ON g.repository = o_custkey WHERE o_custkey % 4 != 2)
        SELECT g.repository, generation, coalesce(bool_and(ready AND f = generation), true) AS publishable FROM g LEFT JOIN o ON o.repository = g.repository GROUP BY ALL""",
}
