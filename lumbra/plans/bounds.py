"""Bounded scans, budgets, whole benchmark and readiness results, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbra.functions import identity
from lumbra.operators import budgets, experiments, navigation, semantic, states, telemetry

from .corpus import _pick
from .jobs import jobs
from .operations import benchmark_cases
from .retrieval import table

FILES, BYTES, RESULTS = 700, 4000, 150  # bounds that the small tables reach


def _files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select(F.concat(F.lpad((F.col("doc_id") * 7919 % 1_000_003).cast("string"), 7, "0"), _pick((".ts", ".json"), F.col("doc_id"))).alias("doc"), F.replace("text", F.lit(" the "), F.lit(" Class the ")).alias("text"))


def scanned_files(spark, sf_dir):
    """How many files a bounded scan reads, and what it leaves out."""
    s = navigation.scanned(_files(spark, sf_dir), FILES, BYTES)
    return s.groupBy("state").agg(F.count("*").alias("files"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


def heuristic_navigation(spark, sf_dir):
    """Where the word at a place of each fiftieth document stands in the scanned files; the first results and how many there are."""
    d = table(spark, sf_dir, "documents").where("text is not null and doc_id % 50 = 0")
    doc = F.concat(F.lpad((F.col("doc_id") * 7919 % 1_000_003).cast("string"), 7, "0"), _pick((".ts", ".json"), F.col("doc_id")))
    points = d.select(F.col("doc_id").alias("point_id"), doc.alias("doc"), F.lit(0).alias("line"), (F.col("doc_id") % 23).cast("int").alias("col"))
    got = navigation.occurrences_by_text(_files(spark, sf_dir), points, most_files=FILES, most_bytes=BYTES, most_results=RESULTS)
    return got.groupBy("point_id", "name").agg(F.count("*").alias("shown"), (F.max("found") - F.count("*")).alias("omitted"), F.count_if("declares").alias("declared"), F.max("doc").alias("last_doc"))


def input_bundles(spark, sf_dir):
    """Conversations as bundles of files under one budget of characters."""
    c = table(spark, sf_dir, "conversations")
    files = c.select(F.col("conv_id").alias("bundle"), F.col("turn").alias("nth"), (F.lit(14) + F.length("role") * 9).alias("header"), F.length("text").alias("chars"))
    return budgets.bundles(files, 700)


def image_budgets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long")
    return budgets.image_problems(li.select((F.col("l_orderkey") * 3 % 4000).alias("request"), (q * 620_000).alias("bytes"), (q * 300_000).alias("pixels")))


def replacement_problems(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    path = lambda sign: F.concat(F.lit(f"src{sign}"), (F.col("o_orderkey") % 5000).cast("string"))
    return semantic.replacement_problems(o.where("o_orderkey % 7 = 1").select(path("\\").alias("doc")), o.where("o_orderkey % 11 = 3").select(path("/").alias("doc")))


def _latencies(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("case_id"), F.col("l_extendedprice").cast("long").alias("us"))


def benchmark_latencies(spark, sf_dir):
    return experiments.benchmark_summary(benchmark_cases(spark, sf_dir), _latencies(spark, sf_dir))[1]


def benchmark_result(spark, sf_dir):
    got = experiments.benchmark_summary(benchmark_cases(spark, sf_dir), _latencies(spark, sf_dir))[0]
    return got.withColumn("correctness", F.round("correctness", 6))


#: The eight identities that an index and a request must share, as (name, what the index has, what is asked for), here from an order's columns.
IDENTITIES = ("repository", "generation", "tree", "dirty", "model", "dimension", "chunk_format", "index_format")


def readiness(spark, sf_dir):
    """Which requests find an index that is ready: its state, and all eight identities; some differ in one of them, and a null dirty hash equals a null."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    own = [F.concat(F.lit(f"{n}-"), (k % 3).cast("string")) for n in IDENTITIES]
    own[3] = F.when(k % 2 == 0, own[3])
    wanted = [F.when(k % 29 == i, F.lit("other")).otherwise(c) for i, c in enumerate(own)]
    return o.select("o_orderkey", identity.ready(_pick(("Current", "DirtyCurrent", "Stale", "Updating"), F.col("o_custkey")), own, wanted).alias("ready"))


def index_drift(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, name = F.col("o_orderkey"), lambda c: F.concat(F.lit("t"), c.cast("string"))
    dirty = F.when(k % 5 == 0, "d")
    got = states.drift(name(k % 3), name(k % 4), dirty, name(k % 7), name(k % 2), F.when(k % 6 != 0, name(k % 4)), F.when(k % 10 == 0, "d"))
    return o.select("o_orderkey", got.alias("d")).select("o_orderkey", "d.*")


KEYS = ("model", "profile", "task", "size_class", "duration_class", "device", "format", "language", "version")


def keyed_predictions(spark, sf_dir):
    """Durations by all nine parts of a kind of job, and the defaults of kinds that were never seen."""
    j = jobs(spark, sf_dir)
    parts = {"task": _pick(("ask", "embed"), F.col("user_id")), "size_class": _pick(("s", "m"), F.floor(F.col("user_id") / 2)), "device": F.lit("gpu"), "format": F.lit("q8"), "language": F.lit("en"), "version": F.lit("1"), "duration_class": _pick(("short", "medium", "long"), F.col("user_id"))}
    known = telemetry.predicted(j.withColumns(parts), list(KEYS))
    e = table(spark, sf_dir, "orders")
    asked = e.select("o_orderkey", _pick(("view", "click", "never"), F.col("o_orderkey")).alias("model"), F.concat(F.lit("profile"), (F.col("o_custkey") % 5).cast("string")).alias("profile"), _pick(("ask", "embed"), F.col("o_custkey")).alias("task"), _pick(("s", "m"), F.floor(F.col("o_custkey") / 2)).alias("size_class"),
                     _pick(("short", "medium", "long"), F.col("o_custkey")).alias("duration_class"), F.lit("gpu").alias("device"), F.when(F.col("o_orderkey") % 13 == 0, "q4").otherwise("q8").alias("format"), F.lit("en").alias("language"), F.lit("1").alias("version"))
    return telemetry.with_defaults(asked, known, list(KEYS)).select("o_orderkey", "median_us", "p90_us")


QUERIES = {f.__name__: f for f in (scanned_files, heuristic_navigation, input_bundles, image_budgets, replacement_problems, benchmark_latencies, benchmark_result, readiness, index_drift, keyed_predictions)}

_FILES = f"""
    f AS (SELECT doc_id, lpad((doc_id * 7919 % 1000003)::VARCHAR, 7, '0') || CASE WHEN doc_id % 2 = 0 THEN '.ts' ELSE '.json' END AS doc, replace(text, ' the ', ' Class the ') AS text FROM documents WHERE text IS NOT NULL),
    n AS (SELECT *, rank() OVER (ORDER BY doc) AS nth, count(*) OVER (ORDER BY doc RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM f),
    s AS (SELECT *, CASE WHEN upto > {FILES} THEN 'beyond' WHEN strlen(text) > {BYTES} THEN 'large' ELSE 'scanned' END AS state FROM n)"""
_CASES = """
    w AS (SELECT DISTINCT l_orderkey AS id, l_partkey % 5 AS place FROM lineitem WHERE l_linenumber <= 3), h AS (SELECT DISTINCT l_orderkey AS id, CASE WHEN l_linenumber = 2 THEN l_partkey % 4 ELSE l_partkey % 5 END AS place FROM lineitem),
    m AS (SELECT id, count(*) AS missing FROM (FROM w EXCEPT FROM h) GROUP BY 1), a AS (SELECT id, count(*) AS n FROM w GROUP BY 1), b AS (SELECT id, count(*) AS n FROM h GROUP BY 1),
    c AS (SELECT coalesce(missing, 0) = 0 AND (o_custkey % 2 = 0 OR coalesce(a.n, 0) = coalesce(b.n, 0)) AS passed FROM orders LEFT JOIN a ON a.id = o_orderkey LEFT JOIN b ON b.id = o_orderkey LEFT JOIN m ON m.id = o_orderkey)"""
ORACLES = {
    "scanned_files": f"WITH {_FILES} SELECT state, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM s GROUP BY 1",
    "heuristic_navigation": rf"""
        WITH {_FILES}, l AS (SELECT doc, doc_id, state, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS body FROM s),
        t AS (SELECT *, regexp_extract_all(body, '[\p{{L}}\p{{Nd}}_$-]+|[^\p{{L}}\p{{Nd}}_$-]+') AS p FROM l),
        k AS (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM t), x AS (SELECT *, p[k] AS piece, length(array_to_string(p[1:k - 1], '')) AS col, length(body) AS size FROM k),
        q AS (SELECT doc_id AS point_id, piece AS name FROM x WHERE doc_id % 50 = 0 AND line = 0 AND regexp_matches(piece, '[\p{{L}}\p{{Nd}}_$-]') AND length(piece) <= 256
              AND CASE WHEN doc_id % 23 = size AND size > 0 THEN size - 1 ELSE doc_id % 23 END >= col AND CASE WHEN doc_id % 23 = size AND size > 0 THEN size - 1 ELSE doc_id % 23 END < col + length(piece)),
        d AS (SELECT piece AS name, doc, line, col, lower(regexp_extract(array_to_string(p[1:k - 1], ''), '([^ \t(){{}}\[\]:;,=]+)[ \t(){{}}\[\]:;,=]*$', 1)) IN ('class', 'interface', 'enum', 'struct', 'record', 'def', 'function', 'type', 'namespace', 'module', 'const', 'let', 'var', 'trait', 'protocol')
                     OR (ends_with(doc, '.json') AND starts_with(regexp_replace(array_to_string(p[k + 1:], ''), '^\s*"?\s*', ''), ':')) AS declares FROM x WHERE state = 'scanned' AND piece IN (SELECT name FROM q)),
        r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc, line, col) AS nth, count(*) OVER (PARTITION BY name) AS found FROM d)
        SELECT point_id, name, count(*) AS shown, max(found) - count(*) AS omitted, count_if(declares) AS declared, max(doc) AS last_doc FROM q JOIN r USING (name) WHERE nth <= {RESULTS} GROUP BY ALL""",
    "input_bundles": """
        WITH RECURSIVE c AS (SELECT conv_id AS bundle, turn AS nth, 14 + length(role) * 9 AS h, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
        s AS (SELECT bundle, 0::BIGINT AS k, 700::BIGINT AS room, NULL::BIGINT AS nth, 0::BIGINT AS shown, false AS omitted, false AS truncated FROM (SELECT DISTINCT bundle FROM c)
              UNION ALL SELECT c.bundle, c.k, CASE WHEN room <= h + 2 THEN room WHEN n > room - h - 2 THEN 0 ELSE greatest(0, room - h - 2 - n - 2) END, c.nth, CASE WHEN room <= h + 2 THEN 0 ELSE least(n, room - h - 2) END, room <= h + 2, room > h + 2 AND n > room - h - 2
              FROM s JOIN c ON c.bundle = s.bundle AND c.k = s.k + 1)
        SELECT bundle, nth, shown, omitted, truncated FROM s WHERE k > 0""",
    "image_budgets": """
        WITH i AS (SELECT l_orderkey * 3 % 4000 AS request, count(*) AS n, max(trunc(l_quantity)::BIGINT) * 620000 AS top, sum(trunc(l_quantity)::BIGINT) * 620000 AS bytes, sum(trunc(l_quantity)::BIGINT) * 300000 AS pixels FROM lineitem GROUP BY 1)
        SELECT request, CASE WHEN n > 8 THEN 'too_many_images' WHEN top > 31457280 THEN 'image_too_large' WHEN bytes > 62914560 THEN 'images_too_large' WHEN pixels > 80000000 THEN 'too_many_pixels' END AS problem FROM i""",
    "replacement_problems": """
        WITH d AS (SELECT 'src/' || (o_orderkey % 5000) AS doc, count(*) AS n FROM orders WHERE o_orderkey % 7 = 1 GROUP BY 1), c AS (SELECT DISTINCT 'src/' || (o_orderkey % 5000) AS doc FROM orders WHERE o_orderkey % 11 = 3)
        SELECT doc, 'deleted_and_changed' AS problem FROM d JOIN c USING (doc) UNION ALL SELECT doc, 'deleted_twice' FROM d WHERE n > 1""",
    "benchmark_latencies": "SELECT l_orderkey % 500 AS case_id, quantile_disc(trunc(l_extendedprice)::BIGINT, 0.5) AS p50_us, quantile_disc(trunc(l_extendedprice)::BIGINT, 0.95) AS p95_us, max(trunc(l_extendedprice)::BIGINT) AS longest_us FROM lineitem GROUP BY 1",
    "benchmark_result": f"WITH {_CASES} SELECT count_if(passed) AS passed, count(*) AS total, round(count_if(passed) / count(*), 6) AS correctness FROM c",
    "readiness": "SELECT o_orderkey, o_custkey % 4 < 2 AND o_orderkey % 29 >= 8 AS ready FROM orders",
    "index_drift": """
        SELECT o_orderkey, o_orderkey % 3 != o_orderkey % 4 OR o_orderkey % 5 = 0 AS requires_overlay, (o_orderkey % 3 != o_orderkey % 4 OR o_orderkey % 5 = 0) AND o_orderkey % 6 != 0 AND (o_orderkey % 5 = 0) = (o_orderkey % 10 = 0) AS overlay_matches, o_orderkey % 7 != o_orderkey % 2 AS base_moved FROM orders""",
    "keyed_predictions": """
        WITH r AS (SELECT event_type AS model, 'profile' || (user_id % 5) AS profile, user_id % 2 AS t, user_id // 2 % 2 AS z, user_id % 3 AS c, round(abs(value) * 1000)::BIGINT AS us FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id % 5, user_id % 2, user_id // 2 % 2, user_id % 3 ORDER BY ts DESC, event_id DESC) <= 101),
        k AS (SELECT model, profile, t, z, c, quantile_cont(us, 0.5)::DOUBLE AS m, quantile_disc(us, 0.9) AS p FROM r GROUP BY ALL),
        a AS (SELECT o_orderkey, ['view', 'click', 'never'][o_orderkey % 3 + 1] AS model, 'profile' || (o_custkey % 5) AS profile, o_custkey % 2 AS t, o_custkey // 2 % 2 AS z, o_custkey % 3 AS c, o_orderkey % 13 != 0 AS q8 FROM orders)
        SELECT o_orderkey, coalesce(CASE WHEN q8 THEN m END, [5, 15, 60][a.c + 1] * 1000000.0::DOUBLE) AS median_us, coalesce(CASE WHEN q8 THEN p END, [10, 30, 120][a.c + 1] * 1000000)::BIGINT AS p90_us FROM a LEFT JOIN k ON k.model = a.model AND k.profile = a.profile AND k.t = a.t AND k.z = a.z AND k.c = a.c""",
}
