"""Search, chunking, snapshot and symbol-graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbra.functions import text as T
from lumbra.functions.vector import dot
from lumbra.operators import chunks, graph, search, snapshot

TERMS = ["tion", "ering", "src1", "f3"]
FLOOR, PER_FILE, K = 0.05, 3, 10
HIGH_FLOOR = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding with the document of the same number: label is the file, source the symbol, lang the signature."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    got = e.join(d, e["vec_id"] == d["doc_id"]).select(F.col("vec_id").alias("ordinal"), F.concat(F.lit("F"), F.col("label").cast("string")).alias("path"), F.col("source").alias("symbol"), F.col("lang").alias("signature"), F.col("text").alias("body"), "embedding")
    vector = F.round(dot(F.col("embedding"), query_vector(spark, sf_dir)), 6)
    return got.select("ordinal", "path", vector.alias("vector"), T.lexical_score(TERMS, F.col("symbol"), F.col("signature"), F.col("body"), F.col("path")).alias("lexical"))


def _asked_vectors(spark, sf_dir):
    """The stated set of queries, every row whose id is divisible by 50, and all rows."""
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector"))


def vector_topk(spark, sf_dir):
    return search.best_of_each(*_asked_vectors(spark, sf_dir), 20)


def vector_floor(spark, sf_dir):
    return search.above(*_asked_vectors(spark, sf_dir), HIGH_FLOOR)


def lexical_score(spark, sf_dir):
    return candidates(spark, sf_dir).where("lexical > 0").select("ordinal", "path", "lexical")


def rrf_hybrid(spark, sf_dir):
    return search.hybrid(candidates(spark, sf_dir), FLOOR).select("ordinal", "position", F.round("rrf", 12).alias("rrf"))


def hybrid_capped(spark, sf_dir):
    got = search.capped(search.hybrid(candidates(spark, sf_dir), FLOOR), PER_FILE, K)
    return got.select("ordinal", "path", "position", "vector", "lexical", F.round("score", 12).alias("score"))


_SCORED = f"""
    q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
    c AS (SELECT vec_id AS ordinal, 'F' || label AS path, round(list_dot_product(embedding::DOUBLE[], q), 6) AS vector,
          {' + '.join(f"CASE WHEN contains(lower(source), '{t}') THEN 3.0 WHEN contains(lower(lang), '{t}') THEN 2.0 WHEN contains(lower(text), '{t}') THEN 1.0 WHEN contains(lower('F' || label), '{t}') THEN 1.0 ELSE 0.0 END" for t in TERMS)} AS lexical
          FROM embeddings JOIN documents ON vec_id = doc_id, q)"""
_FUSED = _SCORED + f""",
    v AS (SELECT ordinal, vector, row_number() OVER (ORDER BY vector DESC, ordinal) AS vrank FROM c WHERE vector >= {FLOOR} QUALIFY vrank <= 250),
    l AS (SELECT ordinal, row_number() OVER (ORDER BY lexical DESC, ordinal) AS lrank FROM c WHERE lexical > 0 QUALIFY lrank <= 250),
    f AS (SELECT ordinal, vrank, lrank, v.vector AS eligible, coalesce(1.0::DOUBLE / (60 + vrank), 0) + coalesce(1.0::DOUBLE / (60 + lrank), 0) AS rrf FROM v FULL JOIN l USING (ordinal)),
    p AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, coalesce(eligible, 0) DESC, vrank NULLS LAST, lrank NULLS LAST) AS position FROM f)"""


def tokenize_terms(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.explode(T.query_terms(F.col("text"))).alias("term"))


def window_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    got = chunks.line_windows(d.select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text"))
    return got.select("path", "start_line", "end_line", "label", F.length("body").alias("chars"), F.md5(F.col("embedded").cast("binary")).alias("embedded"))


def log_fragments(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return chunks.text_fragments(d, "doc_id", "text", 1000, 100).select("doc_id", "part", "start", F.md5(F.col("fragment")).alias("md5"))


def log_fragment_tokens(spark, sf_dir):
    """Estimated tokens of each document's fragments, each character counted once, up to the largest 32-bit number."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return chunks.text_fragments(d, "doc_id", "text", 1000, 100).groupBy("doc_id").agg(F.least(F.sum(T.token_estimate(F.col("fresh"))), F.lit(2_147_483_647)).alias("tokens"), F.sum(F.length("fresh")).alias("chars"))


def canonical_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.canonical_hash(F.col("text")).alias("hash"))


def collapsed_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse(F.col("text"), 200).alias("collapsed"))


def token_estimate(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    bounds = T.token_bounds(F.length("text"))
    return c.select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"), bounds["lower"].alias("lower"), bounds["upper"].alias("upper"), T.context_tier(F.length("text")).alias("context"))


def _files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".TXT")))
    old = d.select("doc_id", path.alias("path"), F.sha2("text", 256).alias("hash")).where("doc_id % 19 != 0")
    text = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.select("doc_id", F.lower(path).alias("path"), F.sha2(text, 256).alias("hash")).where("doc_id % 17 != 0")
    return old, new


def incremental_partition(spark, sf_dir):
    old, new = _files(spark, sf_dir)
    return snapshot.partition_files(new, old)


def deleted_paths(spark, sf_dir):
    old, new = _files(spark, sf_dir)
    return snapshot.deleted_paths(old, new)


def overlay_visible(spark, sf_dir):
    old, new = _files(spark, sf_dir)
    changed = snapshot.partition_files(new, old).where("state = 'changed'").select("path", "hash")
    return snapshot.visible(old.select("path", "hash"), changed, snapshot.deleted_paths(old, new))


def build_plan(spark, sf_dir):
    old, new = _files(spark, sf_dir)
    return snapshot.partition_files(new, old).groupBy("state").agg(F.count("*").alias("files"))


def embedding_cache_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    cache = d.where("doc_id % 3 = 0").select(F.sha2("body", 256).alias("fingerprint"), "doc_id").groupBy("fingerprint").agg(F.min("doc_id").alias("vector"))
    return snapshot.cached_vectors(d, cache).select("doc_id", "fingerprint", "vector")


_PATH = "source || '/' || doc_id || '.TXT'"
_FILES = f"""
    old AS (SELECT {_PATH} AS path, sha256(text) AS hash FROM documents WHERE doc_id % 19 != 0),
    new AS (SELECT lower({_PATH}) AS path, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 17 != 0),
    st AS (SELECT new.path, new.hash, CASE WHEN new.hash = old.hash THEN 'reused' ELSE 'changed' END AS state FROM new LEFT JOIN old ON new.path = lower(old.path)),
    del AS (SELECT path FROM old WHERE lower(path) NOT IN (SELECT path FROM new))"""


def occurrences(spark, sf_dir):
    """Line items as occurrences: a document is an order, a symbol a part; ordered (O) items are definitions, others references, returned ones both."""
    li = table(spark, sf_dir, "lineitem")
    roles = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_linestatus") == "O", 1).otherwise(2)
    return li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 5 + 1).cast("int").alias("end_line"), F.col("l_partkey").alias("symbol"), roles.alias("roles"))


def asked(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("symbol"))


def goto_definition(spark, sf_dir):
    return graph.definitions(occurrences(spark, sf_dir), asked(spark, sf_dir))


def find_references(spark, sf_dir):
    return graph.references(occurrences(spark, sf_dir), asked(spark, sf_dir), True)


def find_implementations(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    edges = part.select(F.col("p_partkey").alias("source"), (F.col("p_partkey") % 97 + 1).alias("target"))
    return graph.implementations(occurrences(spark, sf_dir), edges, asked(spark, sf_dir))


def occurrence_at(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), F.col("o_orderkey").alias("doc"), F.lit(4).alias("line"))
    return graph.at_position(occurrences(spark, sf_dir), points).select("point_id", "start_line", "end_line", "symbol")


_OCC = """
    o AS (SELECT l_orderkey AS doc, l_linenumber AS start_line, (l_linenumber + l_quantity::INT % 5 + 1)::INT AS end_line, l_partkey AS symbol,
          CASE WHEN l_returnflag = 'R' THEN 3 WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS roles FROM lineitem),
    s AS (SELECT p_partkey AS symbol FROM part WHERE p_size = 7)"""

QUERIES = {f.__name__: f for f in (vector_topk, vector_floor, lexical_score, rrf_hybrid, hybrid_capped, tokenize_terms, window_chunks, log_fragments, log_fragment_tokens, canonical_hash, collapsed_text, token_estimate, incremental_partition, deleted_paths, overlay_visible, build_plan, embedding_cache_join, goto_definition, find_references, find_implementations, occurrence_at)}

_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
ORACLES = {
    "vector_topk": "WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id AS ordinal, round(list_dot_product(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q) SELECT query, ordinal, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, ordinal)::INT AS rank FROM s QUALIFY rank <= 20",
    "vector_floor": f"WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id AS ordinal, round(list_dot_product(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q) SELECT * FROM s WHERE score >= {HIGH_FLOOR}",
    "lexical_score": f"WITH {_SCORED} SELECT ordinal, path, lexical::DOUBLE AS lexical FROM c WHERE lexical > 0",
    "rrf_hybrid": f"WITH {_FUSED} SELECT ordinal, position::INT AS position, round(rrf, 12) AS rrf FROM p",
    "hybrid_capped": f"""WITH {_FUSED}, n AS (SELECT ordinal, path, position, vector, lexical, row_number() OVER (PARTITION BY lower(path) ORDER BY position) AS nth FROM p JOIN c USING (ordinal))
        SELECT ordinal, path, position::INT AS position, vector, lexical::DOUBLE AS lexical, round(1.0::DOUBLE / (60 + position), 12) AS score FROM n WHERE nth <= {PER_FILE} ORDER BY position LIMIT {K}""",
    "tokenize_terms": rf"""
        WITH w AS (SELECT item_id, unnest(regexp_split_to_array(text, '[^\p{{L}}\p{{Nd}}_]+')) AS word FROM benchmark),
        p AS (SELECT item_id, unnest(string_split(word, '_')) AS part FROM w),
        t AS (SELECT item_id, word AS term FROM w UNION ALL SELECT item_id, part FROM p
              UNION ALL SELECT item_id, unnest(string_split(regexp_replace(part, '([^\p{{Lu}}])(\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), chr(1))) FROM p)
        SELECT DISTINCT item_id, lower(term) AS term FROM t WHERE length(term) >= 3 AND lower(term) NOT IN ({_STOPS})""",
    "window_chunks": r"""
        WITH d AS (SELECT source || '/' || doc_id || '.txt' AS path, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
        s AS (SELECT path, lines, len(lines) AS n, unnest(range(0, len(lines), 48)) AS start FROM d),
        b AS (SELECT *, left(array_to_string(lines[start + 1:start + 60], chr(10)), 6000) AS body FROM s WHERE start = 0 OR start + 12 < n)
        SELECT path, (start + 1)::INT AS start_line, least(start + 60, n)::INT AS end_line,
               CASE WHEN n > 48 THEN '[' || (start // 48 + 1) || '/' || ceil(n / 48.0)::INT || ']' ELSE '' END AS label, length(body)::INT AS chars, md5('File: ' || path || chr(10) || 'Lines: ' || (start + 1) || '-' || least(start + 60, n) || chr(10) || chr(10) || body) AS embedded
        FROM b WHERE regexp_replace(body, '\s', '', 'g') != ''""",
    "log_fragments": """
        WITH s AS (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 1000 THEN [0] ELSE range(0, greatest(length(text) - 100, 1), 900) END) AS start FROM documents)
        SELECT doc_id, (start // 900)::INT AS part, start::INT AS start, md5(substring(text, start + 1, 1000)) AS md5 FROM s""",
    "log_fragment_tokens": rf"""
        WITH s AS (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 1000 THEN [0] ELSE range(0, greatest(length(text) - 100, 1), 900) END) AS start FROM documents WHERE text IS NOT NULL),
        f AS (SELECT doc_id, CASE WHEN start = 0 THEN substring(text, 1, 1000) ELSE substring(text, start + 101, 900) END AS f FROM s),
        l AS (SELECT doc_id, f, length(regexp_replace(f, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(f, '[^Ѐ-ӿ]', '', 'g')) AS cyr FROM f), e AS (SELECT *, CASE WHEN letters > 0 THEN cyr::DOUBLE / letters ELSE 0.0 END AS share FROM l)
        SELECT doc_id, sum(ceil(length(f) / (4.0::DOUBLE * (1 - share) + 2.2::DOUBLE * share)))::BIGINT AS tokens, sum(length(f))::BIGINT AS chars FROM e GROUP BY 1""",
    "canonical_hash": "SELECT doc_id, sha256(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), chr(13) || chr(10))) AS hash FROM documents",
    "collapsed_text": "SELECT doc_id, left(array_to_string([trim(x, ' ' || chr(9) || chr(13)) for x in string_split(text, chr(10)) if trim(x, ' ' || chr(9) || chr(13)) != ''], ' '), 200) AS collapsed FROM documents",
    "token_estimate": rf"""
        WITH l AS (SELECT *, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^Ѐ-ӿ]', '', 'g')) AS cyr FROM conversations),
        s AS (SELECT *, CASE WHEN letters > 0 THEN cyr::DOUBLE / letters ELSE 0.0 END AS share FROM l)
        SELECT conv_id, turn, ceil(length(text) / (4.0::DOUBLE * (1 - share) + 2.2::DOUBLE * share))::BIGINT AS tokens, ceil(length(text) / 6.0)::BIGINT AS lower, ceil(length(text) / 3.0)::BIGINT AS upper,
               CASE {' '.join(f'WHEN length(text) <= {a} THEN {b}' for a, b in T.CONTEXT_TIERS)} ELSE {T.LARGEST_CONTEXT} END AS context FROM s""",
    "incremental_partition": f"WITH {_FILES} SELECT * FROM st",
    "deleted_paths": f"WITH {_FILES} SELECT path FROM del",
    "overlay_visible": f"WITH {_FILES}, ov AS (SELECT path, hash FROM st WHERE state = 'changed') SELECT path, hash, 'overlay' AS layer FROM ov UNION ALL SELECT path, hash, 'base' FROM old WHERE lower(path) NOT IN (SELECT path FROM ov) AND path NOT IN (SELECT path FROM del)",
    "build_plan": f"WITH {_FILES} SELECT state, count(*) AS files FROM st GROUP BY state",
    "embedding_cache_join": "WITH c AS (SELECT sha256(text) AS fingerprint, min(doc_id) AS vector FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) SELECT doc_id, sha256(text) AS fingerprint, vector FROM documents LEFT JOIN c ON c.fingerprint = sha256(text)",
    "goto_definition": f"WITH {_OCC} SELECT * FROM o WHERE roles & 1 != 0 AND symbol IN (FROM s)",
    "find_references": f"WITH {_OCC} SELECT * FROM o WHERE roles & 2 != 0 AND symbol IN (FROM s) UNION ALL SELECT * FROM o WHERE roles & 1 != 0 AND symbol IN (FROM s)",
    "find_implementations": f"WITH {_OCC} SELECT DISTINCT * FROM o WHERE roles & 1 != 0 AND symbol IN (SELECT p_partkey FROM part WHERE p_partkey % 97 + 1 IN (FROM s))",
    "occurrence_at": f"WITH {_OCC} SELECT o_orderkey AS point_id, start_line, end_line, symbol FROM o JOIN orders ON doc = o_orderkey WHERE start_line <= 4 AND 4 < end_line QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY end_line - start_line, start_line, symbol) = 1",
}
