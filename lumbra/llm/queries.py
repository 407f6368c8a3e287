"""The operators as queries over the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_windows, decontamination, exact_dedup, language_id, lexical_search, mixing, near_join, packing, phrases, quality_mil, quality_rules, toxicity, url_filter
from .common import crc_mod, table

VOCABULARY = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")


def vocabulary() -> dict:
    """Places of the public vocabulary files, for ``packing.Encoder``."""
    import public_tokenizers

    names = [public_tokenizers.path(n) for n in VOCABULARY]
    return {"vocabulary": names[0], "ranks": names[1], "pattern": public_tokenizers.PATTERN}


def scored(documents: DataFrame, score: str, held_out, *more: str) -> DataFrame:
    return documents.select("doc_id", held_out.alias("held_out"), F.col(score).alias("score"), (F.col(score) >= 0.3).cast("int").alias("predicted"), *more)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(documents, labels, crc_mod("doc_id", 4) != 2)
    return scored(toxicity.score_toxicity(documents, model, ["doc_id"]), "tox_score", crc_mod("doc_id", 4) == 2, "tox_threshold", "toxic_found")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import stored

    prints = stored(exact_dedup.fingerprints(table(spark, sf_dir, "documents"), ["doc_id"]), "op2-prints")
    got = exact_dedup.decisions(prints, "doc_id", largest=True)
    return got.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack(table(spark, sf_dir, "documents"), **vocabulary())
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_mil.fit_quality(documents, labels, crc_mod("doc_id", 5) != 0)
    return scored(quality_mil.score_quality(documents, model, ["doc_id"]), "quality_score", crc_mod("doc_id", 5) == 0)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality_rules.fit_ratio(documents, table(spark, sf_dir, "labels"))
    return quality_rules.judge_quality(documents, model, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_id.train(language_id.language_sample(documents, crc_mod("doc_id", 4) != 2))
    return language_id.predict_language(documents, model, ["doc_id"]).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_rejected")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no labels of urls, so the rules' verdicts are the labels; suffix statistics would only repeat them and are not in this result."""
    pages = table(spark, sf_dir, "pages")
    model = url_filter.fit_urls(pages)
    return url_filter.judge(pages, model, ["page_id", "url"]).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_join.jaccard_components(table(spark, sf_dir, "documents"), "doc_id", n=4, num=85, den=100)
    return got.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.place(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    files = vocabulary()
    return chat_windows.read_back(chat_windows.windows(rows, lambda: packing.Encoder(**files)))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return got.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_toxicity, op2_exact_dedup, op3_packing, op4_quality_classifier, op5_quality_rules, op6_language_id, op7_url_filters, op8_ngram_jaccard_join, op9_mixing, op10_chat_formatting, op11_collocations, op12_lexical_search, op13_decontamination]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    terms = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"  # of lower-cased texts
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return {
        "op2_exact_dedup": f"""
            WITH t AS (SELECT doc_id, sha256({lower}) AS text_sha256 FROM documents),
                 g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""",
        "op9_mixing": """
            WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
            s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
            w AS (SELECT *, CASE number % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, (source_size * 2)::DOUBLE AS lim FROM s),
            r AS (SELECT *, lim / weight AS ratio, coalesce(sum(lim) OVER (ORDER BY lim / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_,
                         sum(weight) OVER (ORDER BY lim / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM w),
            l AS (SELECT *, max(CASE WHEN (total - full_) / rest <= ratio THEN (total - full_) / rest END) OVER () AS level FROM r),
            t AS (SELECT source, number, source_size, least(lim, coalesce(level * weight, lim)) AS target FROM l),
            p AS (SELECT doc_id, size, source_size, target, number, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size + size / 2.0::DOUBLE AS middle FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
            c AS (SELECT *, CASE WHEN size = 0 THEN 0 WHEN middle + source_size < target THEN 2 WHEN middle < target THEN 1 ELSE 0 END AS copies, CASE number % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS a FROM p)
            SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken,
                   CASE WHEN copies > 0 THEN round(CASE WHEN a = 1 THEN least(middle / target, 1.0) ELSE 2 * least(middle / target, 1.0) / (a + sqrt(greatest(a * a + 4 * (1 - a) * least(middle / target, 1.0), 0.0))) END, 6) END AS position
            FROM c""",
        "op11_collocations": f"""
            WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
                 w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
                 n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
                 i AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
                 f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM i GROUP BY ALL HAVING count(*) >= 30),
                 c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
                 inner_ AS (SELECT lang, f AS above, array_to_string(w[i:i + m - 1], ' ') AS phrase
                            FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
                 above AS (SELECT lang, phrase, max(above) AS above FROM inner_ GROUP BY ALL),
                 own AS (SELECT c.* FROM c LEFT JOIN above USING (lang, phrase) WHERE above IS NULL OR 100 * above < 80 * f),
                 cut AS (SELECT lang, phrase, f AS a, k AS words, unnest(range(1, k)) AS k, w FROM own),
                 s AS (SELECT cut.lang, cut.phrase, a, cut.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
                       FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:cut.k], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[cut.k + 1:], ' ')),
                 least AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM least JOIN n USING (lang) QUALIFY rank <= 2000""",
        "op12_lexical_search": f"""
            WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({lower}, '{terms}') AS w FROM documents),
                 t AS (SELECT sum((len(w) > 0)::INT)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
                 e AS (SELECT row, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT row, doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
                 q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({lower}, '{terms}')) AS term FROM benchmark),
                 v AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM e, t GROUP BY term, n_docs),
                 s AS (SELECT item_id, row, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
                       FROM q JOIN e USING (term) JOIN v USING (term), t GROUP BY ALL)
            SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
        "op13_decontamination": f"""
            WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({lower}, '{terms}') AS w FROM documents),
                 b AS (SELECT item_id, regexp_extract_all({lower}, '{terms}') AS w FROM benchmark),
                 v AS (SELECT item_id, least(len(w), 10) AS m, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0),
                 win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS words FROM v),
                 p AS (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win)),
                 h AS (SELECT row, i, x.m, item_id FROM (SELECT row, i, m, array_to_string(w[i:i + m - 1], ' ') AS words FROM p) x JOIN win USING (m, words)),
                 hit AS (SELECT row, count(DISTINCT word_at) AS n_hit FROM (SELECT row, unnest(range(i, i + m)) AS word_at FROM h) GROUP BY row),
                 items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM h) GROUP BY row)
            SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
            FROM d LEFT JOIN hit USING (row) LEFT JOIN items USING (row)""",
    }
