"""Queries over paths, identities, source texts and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbra.functions import identity, paths, report, source
from lumbra.functions import text as T
from lumbra.functions.vector import dot, normalised
from lumbra.operators import batches, snapshot

from .retrieval import query_vector, table

FOLDERS = ("src", "bin", "src/.claude/worktrees/w1", "lib/Node_Modules", "docs", "src\\test")
NAMES = ("a.cs", "b.TS", "c.min.js", "d.md", "e.exe", "f", "token_store.py", ".env.json", "g.Designer.cs", "h.pem", "package-lock.json", "i.yaml")
RELATIVE = ("a/b.cs", "../x.cs", "a/../../b.cs", "a/./b/../c.cs", "/abs.cs", "C:\\x.cs", "..")
LEFT_ROOT = (False, True, True, False, True, True, True)
TASK = "find the passage that answers the question"


def _pick(values, n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v.lower()}'" for v in values) + ")"


def _files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat(_pick(FOLDERS, F.col("doc_id")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("_"), _pick(NAMES, F.floor(F.col("doc_id") / 6)))
    return d.select("doc_id", path.alias("path"), "text", "source", "lang")


_PATHS = f"""p AS (SELECT *, lower(replace(path, '\\', '/')) AS lp FROM (SELECT *, {_list(FOLDERS)}[doc_id % 6 + 1] || '/' || doc_id || '_' || {_list(NAMES)}[doc_id // 6 % 12 + 1] AS path FROM documents)),
    f AS (SELECT *, string_split(lp, '/') AS seg, regexp_extract(lp, '\\.[^./]+$') AS ext FROM p)"""
_CHUNKER = f"CASE WHEN {' OR '.join(f"ends_with(lp, '{e}')" for e in paths.EXCLUDED_ENDS)} THEN NULL WHEN ext IN {_in(paths.SYNTAX_EXTENSIONS)} THEN 'syntax' WHEN ext IN {_in(paths.WINDOW_EXTENSIONS)} THEN 'window' END"


def corpus_scan(spark, sf_dir):
    """Indexable files outside excluded folders, of a size that is read, with their chunker."""
    f = _files(spark, sf_dir)
    kept = f.where(paths.walked(F.col("path")) & (F.octet_length("text") <= 20_000) & (F.octet_length("text") <= paths.MOST_BYTES))
    return kept.select("doc_id", "path", paths.chunker(F.col("path")).alias("chunker")).where("chunker is not null")


def dirty_policy(spark, sf_dir):
    f = _files(spark, sf_dir)
    return f.select("doc_id", paths.dirty_allowed(F.col("path"), F.col("doc_id") % 7 == 0).alias("allowed"))


def confined_paths(spark, sf_dir):
    """Paths of each document under a root of its own, and what stands at them: some are missing, links, unavailable or folders, on the way or at the end."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace(_pick(RELATIVE, F.col("doc_id")), F.lit("a/"), F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit("/"))).alias("path"))
    at = F.col("doc_id").cast("string")
    folder = d.select(F.concat(F.lit("a"), at).alias("path"), _pick(("folder", "link", "folder", "folder", "unavailable"), F.floor(F.col("doc_id") / 7)).alias("kind"))
    files = [d.select(F.concat(F.lit("a"), at, F.lit(name)).alias("path"), _pick(kinds, F.floor(F.col("doc_id") / 35)).alias("kind")) for name, kinds in (("/b.cs", ("file", "link", "file")), ("/c.cs", ("file", "folder", "unavailable")))]
    got = snapshot.confined(d, folder.unionByName(files[0]).unionByName(files[1]))
    return got.select("doc_id", "state")


def worktree_list(spark, sf_dir):
    """Blocks of a listing, one text for each nation, as rows."""
    c = table(spark, sf_dir, "customer")
    branch = F.when(F.col("c_custkey") % 3 == 0, "detached").otherwise(F.concat(F.lit("branch refs/heads/b"), F.col("c_custkey").cast("string")))
    lines = F.concat_ws("\n", F.concat(F.lit("worktree /w/"), F.col("c_custkey").cast("string")), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("HEAD "), F.md5(F.col("c_name").cast("binary")))), branch, F.when(F.col("c_custkey") % 4 == 0, "prunable gone"))
    listing = c.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list(lines)), "\n\n").alias("text"))
    return worktrees(listing)


def worktrees(listings):
    """(path, head, branch, detached, prunable) of porcelain listings (text): blocks between empty lines; without a path or a head they are left out."""
    block = listings.select(F.explode(F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), r"\n\n+")).alias("block")).select(F.split("block", "\n").alias("lines"))
    of = lambda lead: F.try_element_at(F.transform(F.filter("lines", lambda x: x.startswith(lead)), lambda x: F.substr(x, F.lit(len(lead) + 1))), F.lit(-1))
    some = lambda test: F.exists("lines", test)
    got = block.select(of("worktree ").alias("path"), of("HEAD ").alias("head"), of("branch ").alias("branch"), some(lambda x: x == "detached").alias("detached"), some(lambda x: x.startswith("prunable")).alias("prunable"))
    return got.where("path is not null and head is not null")


def null_paths(spark, sf_dir):
    """Paths of NUL-separated lists, once each whatever their case, the first spelling of each list."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "A\\").otherwise("a/"), (F.col("p_partkey") % 50).cast("string"), F.lit(".cs"))
    lists = p.groupBy((F.col("p_partkey") % 4).alias("k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", name.alias("name")))), lambda x: x["name"]), "\0").alias("z"))
    each = lists.select("k", F.posexplode(F.split("z", "\0")).alias("at", "path")).where("path != ''").withColumn("path", T.slashes(F.col("path")))
    return each.groupBy("k", F.lower("path").alias("key")).agg(F.min_by("path", "at").alias("path")).select("k", "path")


def query_prompts(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    model = F.when(F.col("item_id") % 2 == 0, "Qwen3-Embedding:8b").otherwise("other")
    return b.select("item_id", F.md5(identity.query_prompt(model, F.col("text"), TASK).cast("binary")).alias("md5"))


def _chunk_fields(o):
    dirty = F.when(F.col("o_orderkey") % 3 == 0, F.repeat(F.lit("d"), 140))
    return o.select("o_orderkey", F.concat(F.lit("repo-"), (F.col("o_custkey") % 5).cast("string")).alias("r"), F.col("o_orderpriority").alias("g"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("t"), dirty.alias("d"), (F.col("o_orderkey") % 70_000).cast("int").alias("n"))


def _chunk_ids(spark, sf_dir):
    f = _chunk_fields(table(spark, sf_dir, "orders"))
    return f.withColumn("chunk_id", identity.chunk_id(F.col("r"), F.col("g"), F.col("t"), F.col("d"), F.col("n")))


def chunk_ids(spark, sf_dir):
    return _chunk_ids(spark, sf_dir).select("o_orderkey", "chunk_id")


def chunk_id_checks(spark, sf_dir):
    """Ids that were tampered with, cut or spelt wrongly, and others against snapshots that differ in one field."""
    c = _chunk_ids(spark, sf_dir)
    k = F.col("o_orderkey") % 11
    payload = F.regexp_extract("chunk_id", r"^cs1\.([^.]*)\.", 1)
    sent = (
        F.when(k == 1, F.concat(F.lit("cs1."), payload, F.lit("."), F.repeat(F.lit("A"), 43))).when(k == 2, F.replace("chunk_id", F.lit("cs1."), F.lit("cs2.")))
        .when(k == 3, F.left("chunk_id", F.lit(40))).when(k == 4, F.concat("chunk_id", F.lit(".x"))).otherwise(F.col("chunk_id"))
    )
    got = identity.parsed_chunk_ids(c.withColumn("sent", sent), "sent")
    actual = {"repository": F.when(k == 5, "other").otherwise(F.col("r")), "generation": F.when(k == 6, "other").otherwise(F.col("g")), "tree": F.when(k == 7, "other").otherwise(F.col("t")), "dirty": F.when(k == 8, "other").otherwise(F.col("d"))}
    most = F.when(k == 9, F.col("n")).otherwise(F.col("n") + 1)
    verdict = F.when(F.col("problem").isNotNull(), F.col("problem")).otherwise(F.coalesce(identity.chunk_mismatch(actual, F.col("ordinal"), most), F.lit("ok")))
    return got.select("o_orderkey", verdict.alias("verdict"), "ordinal")


def identity_hashes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = lambda c: F.col(c).cast("string")
    fields = [s("o_custkey"), F.col("o_orderstatus"), s("o_orderkey"), F.lit("model"), F.lit(64), F.lit(3), F.lit(4), F.lit(2), F.lit(1)]
    return o.select(
        "o_orderkey", identity.generation_id(fields, F.col("o_custkey") % 3).alias("generation_id"),
        identity.overlay_id(F.col("o_orderstatus"), s("o_custkey"), s("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, s("o_orderkey")), F.lit("Commit"), F.lit(None)).alias("overlay_id"),
        identity.query_key("search:query:", F.col("o_orderstatus"), s("o_custkey"), F.col("o_orderpriority")).alias("query_key"),
        identity.batch_key("search:index:", F.col("o_orderstatus"), F.array(s("o_custkey"), F.col("o_orderpriority"))).alias("batch_key"),
    )


def corpus_hashes(spark, sf_dir):
    f = _files(spark, sf_dir)
    content = F.when(F.col("doc_id") % 9 != 0, F.col("text"))
    return batches.content_hashes(f.select(F.concat_ws("-", "lang", "source").alias("corpus"), "path", content.alias("content")))


def token_reports(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    saved = (F.col("l_extendedprice") * F.pow(F.lit(10.0), F.col("l_linenumber") % 4) / 10).cast("long")
    us = (F.col("l_extendedprice") * F.pow(F.lit(10.0), F.col("l_linenumber") % 5)).cast("long")
    return li.select(
        "l_orderkey", "l_linenumber", report.described_range(saved).alias("saved"), report.duration(us).alias("took"), report.percent(F.col("l_linenumber"), (F.col("l_quantity")).cast("int")).alias("share"),
        report.image_tokens(F.col("l_partkey"), F.col("l_suppkey")).alias("image"), report.receipt_tokens(F.col("l_partkey")).alias("receipt"), report.no_less_than_zero(F.col("l_partkey") - F.col("l_suppkey") * 20).alias("waited"),
        report.size_bucket(F.col("l_partkey") * 10 - 10).alias("size"), report.count_bucket(F.col("l_linenumber") - 1).alias("images"), report.pixel_bucket(F.col("l_partkey") * F.col("l_suppkey")).alias("pixels"),
    )


def translation_reports(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    both = report.translation_tokens(F.col("text"), F.left("text", F.lit(50)))
    return c.select("conv_id", "turn", both["local"].alias("local"), both["net_saved"].alias("net_saved"), report.saved_tokens(F.lit(30).cast("long"), F.col("text")).alias("saved"))


def clamped_logs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clamp_head_tail(F.col("text"), 600).cast("binary")).alias("md5"))


def identifiers_at(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    line, column = F.get(T.split_lines(F.col("text")), F.lit(0)), source.zero_based((F.col("doc_id") % 60 + 1).cast("int"))
    return d.select("doc_id", source.identifier_at(line, column).alias("identifier"))


def snippets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    kept = T.canonical_hash(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    got = d.select("doc_id", source.snippet(F.col("text"), F.when(F.col("doc_id") % 4 != 0, kept), (F.col("doc_id") % 5 + 1).cast("int"), (F.col("doc_id") % 30 + 1).cast("int") + 4).alias("s"))
    return got.select("doc_id", F.md5(F.col("s").cast("binary")).alias("md5"), source.snippet_lines(F.col("s")).cast("int").alias("lines"))


def source_flags(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("// <auto-generated />\n"), "text")).when(F.col("doc_id") % 9 == 1, F.concat(F.repeat(F.lit(" "), 490), F.lit("<auto-generated />"))).otherwise(F.col("text"))
    symbol = F.concat(_pick(("scip-ts npm p 1 ", "scip-local a ", "dotnet "), F.col("doc_id")), F.col("source"), _pick((".", "#", "()."), F.floor(F.col("doc_id") / 3)), _pick(("", "x"), F.floor(F.col("doc_id") / 9)))
    return d.select("doc_id", source.generated(text).alias("generated"), source.inferable(symbol).alias("inferable"))


def _fenced(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null")
    flat = F.regexp_replace("text", r"[`~\r\n]", " ")
    block = F.concat(F.lit("```py\n"), flat, F.lit("\n~~~\n```\n"))
    return c.select("conv_id", "turn", F.concat(F.lit("Intro "), flat, F.lit("\n"), block, F.lit("middle\n~~~\nx\n~~~\n"), flat).alias("text"), flat.alias("flat"), block.alias("block"))


def fenced_code(spark, sf_dir):
    return _fenced(spark, sf_dir).select("conv_id", "turn", F.posexplode(source.fenced_parts(F.col("text"))).alias("nth", "part")).select("conv_id", "turn", "nth", F.md5(F.col("part.text").cast("binary")).alias("md5"), "part.translatable")


def protected_fences(spark, sf_dir):
    """Texts with marks in the place of their blocks, and what comes back from a translation that keeps, loses or doubles a mark."""
    p = _fenced(spark, sf_dir).withColumn("p", source.protected(F.col("text")))
    k, text = F.col("turn") % 3, F.translate("p.text", "aeiou", "AEIOU")
    back = source.restored(F.when(k == 0, text).when(k == 1, F.replace(text, F.lit("__PROTECTED_FENCE_0001__"), F.lit(""))).otherwise(F.concat(text, F.lit("__PROTECTED_FENCE_0000__"))), F.col("p.blocks"))
    return p.select("conv_id", "turn", F.md5(F.col("p.text").cast("binary")).alias("marked"), F.md5(back.cast("binary")).alias("restored"))


def boundary_breaks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null")
    text = F.concat(F.repeat(F.lit("\r\n"), (F.col("turn") % 3).cast("int")), F.lit("<"), "text", F.lit(">"), F.repeat(F.lit("\n"), (F.col("conv_id") % 3).cast("int")))
    b = source.boundary_breaks(text)
    return c.select("conv_id", "turn", F.length(b["leading"]).alias("leading"), F.md5(b["text"].cast("binary")).alias("md5"), F.length(b["trailing"]).alias("trailing"))


def soft_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return batches.soft_chunks(d, "doc_id", "text", 1000).select("doc_id", "part", F.md5(F.col("chunk").cast("binary")).alias("md5"))


def unit_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    unit = normalised(F.transform("embedding", lambda x: x * 3))
    return e.select("vec_id", F.round(F.get(unit, F.lit(0)), 4).alias("first"), F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x * x), 4).alias("square"))


def filtered_search(spark, sf_dir):
    """Candidates of one kind whose path holds a part are scored; others never are."""
    e = table(spark, sf_dir, "embeddings")
    files = e.select("label").distinct().select(F.col("label"), F.concat(F.lit("Src\\File"), F.col("label").cast("string"), F.lit(".cs")).alias("path"))
    chunks = e.select(F.col("vec_id").alias("ordinal"), "label", F.when(F.col("vec_id") % 3 == 0, "Type").otherwise("Method").alias("kind"), "embedding").where("kind = 'Method'")
    kept = chunks.join(files, "label").where(F.lower(T.slashes(F.col("path"))).contains("src/file1"))
    return kept.select("ordinal", "path", F.round(dot(F.col("embedding"), query_vector(spark, sf_dir)), 6).alias("score"))


def calibrated_search(spark, sf_dir):
    """Which requests a calibrated model's profile and a ready index let through."""
    o = table(spark, sf_dir, "orders")
    profiles = spark.createDataFrame([("calibrated", 0.43)], "model string, floor double")
    r = o.select("o_orderkey", _pick(("calibrated", "unknown"), F.floor(F.col("o_orderkey") / 3)).alias("model"), F.when(F.col("o_orderkey") % 3 == 1, 0.43).when(F.col("o_orderkey") % 3 == 2, 0.5).alias("asked"), _pick(("Current", "DirtyCurrent", "Stale"), F.col("o_custkey")).alias("state"), "o_custkey", "o_orderstatus")
    got = r.join(F.broadcast(profiles), "model", "left")  # the profiles are a fixed list
    ok = identity.ready(F.col("state"), [F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")), F.col("model")], [F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.col("model")])
    verdict = F.when(F.col("floor").isNull(), "not_calibrated").when(F.col("asked") != F.col("floor"), "other_floor").when(~ok, "not_ready").otherwise("ok")
    return got.select("o_orderkey", verdict.alias("verdict"))


QUERIES = {f.__name__: f for f in (corpus_scan, dirty_policy, confined_paths, worktree_list, null_paths, query_prompts, chunk_ids, chunk_id_checks, identity_hashes, corpus_hashes, token_reports, translation_reports, clamped_logs, identifiers_at, snippets, source_flags, fenced_code, protected_fences, boundary_breaks, soft_chunks, unit_vectors, filtered_search, calibrated_search)}

_EST = lambda t: rf"ceil(length({t}) / (4.0::DOUBLE * (1 - CASE WHEN length(regexp_replace({t}, '[^\p{{L}}]', '', 'g')) > 0 THEN length(regexp_replace({t}, '[^Ѐ-ӿ]', '', 'g'))::DOUBLE / length(regexp_replace({t}, '[^\p{{L}}]', '', 'g')) ELSE 0 END) + 2.2::DOUBLE * CASE WHEN length(regexp_replace({t}, '[^\p{{L}}]', '', 'g')) > 0 THEN length(regexp_replace({t}, '[^Ѐ-ӿ]', '', 'g'))::DOUBLE / length(regexp_replace({t}, '[^\p{{L}}]', '', 'g')) ELSE 0 END))::BIGINT"
_B64 = lambda b: f"rtrim(translate(base64({b}), '+/', '-_'), '=')"
_STR = lambda c: f"CASE WHEN strlen({c}) < 128 THEN printf('%02X', strlen({c})) ELSE printf('%02X', strlen({c}) % 128 + 128) || printf('%02X', strlen({c}) // 128) END || hex({c})"
_CHUNK = f"""
    c AS (SELECT o_orderkey, 'repo-' || (o_custkey % 5) AS r, o_orderpriority AS g, md5(o_orderkey::VARCHAR) AS t, CASE WHEN o_orderkey % 3 = 0 THEN repeat('d', 140) END AS d, (o_orderkey % 70000)::INT AS n FROM orders),
    b AS (SELECT *, unhex('01' || {_STR('r')} || {_STR('g')} || {_STR('t')} || CASE WHEN d IS NULL THEN '00' ELSE '01' || {_STR('d')} END || printf('%02X%02X%02X%02X', n % 256, n // 256 % 256, n // 65536 % 256, n // 16777216)) AS payload FROM c)"""
_ROUND = lambda x: f"CASE WHEN {x} >= 10 THEN round_even({x}, 0)::BIGINT::VARCHAR ELSE regexp_replace(round_even({x}, 1)::VARCHAR, '\\.0$', '') END"
_FENCED = """x AS (SELECT conv_id, turn, regexp_replace(text, '[`~\\r\\n]', ' ', 'g') AS flat FROM conversations WHERE text IS NOT NULL), y AS (SELECT *, '```py' || chr(10) || flat || chr(10) || '~~~' || chr(10) || '```' || chr(10) AS block, '~~~' || chr(10) || 'x' || chr(10) || '~~~' || chr(10) AS second FROM x)"""
_RFIND = lambda sep, rev: f"CASE WHEN contains(w, {sep}) AND length(w) - position({rev} IN reverse(w)) + 1 - length({sep}) >= length(w) // 2 THEN length(w) - position({rev} IN reverse(w)) + 1 ELSE 0 END"
_N, _R = "chr(10)", "chr(13)"
_BREAK = f"greatest({_RFIND(f'{_R}||{_N}||{_R}||{_N}', f'{_N}||{_R}||{_N}||{_R}')}, {_RFIND(f'{_N}||{_N}', f'{_N}||{_N}')}, {_RFIND(f'{_R}||{_N}', f'{_N}||{_R}')}, {_RFIND(_N, _N)}, {_RFIND("' '", "' '")})"
_CANON = "replace(replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), chr(13) || chr(10))"

ORACLES = {
    "corpus_scan": f"WITH {_PATHS} SELECT * FROM (SELECT doc_id, path, {_CHUNKER} AS chunker FROM f WHERE NOT list_has_any(seg[:-2], {_list([n.lower() for n in paths.EXCLUDED_FOLDERS])}) AND NOT contains('/' || lp, '/.claude/worktrees/') AND strlen(text) <= 20000) WHERE chunker IS NOT NULL",
    "dirty_policy": f"WITH {_PATHS} SELECT doc_id, doc_id % 7 != 0 AND NOT list_has_any(seg, {_list([n.lower() for n in paths.DIRTY_EXCLUDED_FOLDERS])}) AND ext NOT IN {_in(paths.SECRET_EXTENSIONS)} AND NOT ({' OR '.join(f"contains(seg[-1], '{p}')" for p in paths.SECRET_PARTS)}) AND ({_CHUNKER}) IS NOT NULL AS allowed FROM f",
    "confined_paths": f"""
        WITH d AS (SELECT doc_id, [{', '.join(str(x).lower() for x in LEFT_ROOT)}][doc_id % {len(RELATIVE)} + 1] AS out, ['folder', 'link', 'folder', 'folder', 'unavailable'][doc_id // 7 % 5 + 1] AS folder,
                          CASE WHEN doc_id % 7 = 3 THEN ['file', 'folder', 'unavailable'][doc_id // 35 % 3 + 1] ELSE ['file', 'link', 'file'][doc_id // 35 % 3 + 1] END AS last FROM documents)
        SELECT doc_id, CASE WHEN out THEN 'outside' WHEN folder != 'folder' THEN folder WHEN last = 'folder' THEN 'missing' WHEN last = 'file' THEN 'ok' ELSE last END AS state FROM d""",
    "worktree_list": "SELECT '/w/' || c_custkey AS path, md5(c_name) AS head, CASE WHEN c_custkey % 3 != 0 THEN 'refs/heads/b' || c_custkey END AS branch, c_custkey % 3 = 0 AS detached, c_custkey % 4 = 0 AS prunable FROM customer WHERE c_custkey % 5 != 0",
    "null_paths": "WITH n AS (SELECT p_partkey % 4 AS k, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'A/' ELSE 'a/' END || (p_partkey % 50) || '.cs' AS path FROM part) SELECT k, arg_min(path, p_partkey) AS path FROM n GROUP BY k, lower(path)",
    "query_prompts": f"SELECT item_id, md5(CASE WHEN item_id % 2 = 0 THEN 'Instruct: {TASK}' || chr(10) || 'Query: ' || text ELSE text END) AS md5 FROM benchmark",
    "chunk_ids": f"WITH {_CHUNK} SELECT o_orderkey, 'cs1.' || {_B64('payload')} || '.' || {_B64('unhex(sha256(payload))')} AS chunk_id FROM b",
    "chunk_id_checks": """
        SELECT o_orderkey, CASE o_orderkey % 11 WHEN 1 THEN 'chunk_id_tampered' WHEN 2 THEN 'chunk_id_malformed' WHEN 3 THEN 'chunk_id_malformed' WHEN 4 THEN 'chunk_id_malformed' WHEN 5 THEN 'wrong_repository' WHEN 6 THEN 'stale_generation'
               WHEN 7 THEN 'stale_worktree' WHEN 8 THEN 'stale_overlay' WHEN 9 THEN 'chunk_out_of_range' ELSE 'ok' END AS verdict, CASE WHEN o_orderkey % 11 NOT IN (1, 2, 3, 4) THEN o_orderkey % 70000 END AS ordinal FROM orders""",
    "identity_hashes": """
        SELECT o_orderkey, sha256(concat_ws(chr(10), o_custkey, o_orderstatus, o_orderkey, 'model', 64, 3, 4, 2, 1) || CASE WHEN o_custkey % 3 > 0 THEN chr(10) || (o_custkey % 3) ELSE '' END) AS generation_id,
               sha256(o_orderstatus || chr(10) || o_custkey || chr(10) || o_orderkey || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE '' END || chr(10) || 'Commit' || chr(10)) AS overlay_id,
               'search:query:' || upper(sha256(o_orderstatus || chr(0) || o_custkey || chr(0) || o_orderpriority)) AS query_key, 'search:index:' || upper(sha256(o_orderstatus || o_custkey || chr(0) || o_orderpriority || chr(0))) AS batch_key FROM orders""",
    "corpus_hashes": f"WITH {_PATHS} SELECT lang || '-' || source AS corpus, sha256(string_agg(replace(path, '\\', '/') || chr(0) || CASE WHEN doc_id % 9 != 0 AND text IS NOT NULL THEN {_CANON.format('text')} ELSE '<deleted>' END || chr(0), '' ORDER BY lp)) AS hash FROM p GROUP BY 1",
    "token_reports": f"""
        WITH s AS (SELECT *, trunc(l_extendedprice * pow(10.0::DOUBLE, l_linenumber % 4) / 10)::BIGINT AS saved, trunc(l_extendedprice * pow(10.0::DOUBLE, l_linenumber % 5))::BIGINT AS us FROM lineitem),
        r AS (SELECT *, saved * (1 - CASE WHEN saved < 100000 THEN 0.15::DOUBLE ELSE 0.2::DOUBLE END) AS low, saved * (1 + CASE WHEN saved < 100000 THEN 0.15::DOUBLE ELSE 0.2::DOUBLE END) AS high FROM s)
        SELECT l_orderkey, l_linenumber, CASE WHEN saved <= 0 THEN '0' WHEN high >= 1000000 THEN '~' || {_ROUND('(low / 1e6)')} || '–' || {_ROUND('(high / 1e6)')} || 'M' ELSE '~' || {_ROUND('(low / 1e3)')} || '–' || {_ROUND('(high / 1e3)')} || 'K' END AS saved,
               CASE WHEN us < 1000000 THEN ((us + 500) // 1000) || 'ms' WHEN us < 60000000 THEN ((us + 50000) // 1000000) || '.' || ((us + 50000) // 100000 % 10) || 's' ELSE (us // 60000000) || 'm' || lpad((us // 1000000 % 60)::VARCHAR, 2, '0') || 's' END AS took,
               CASE WHEN trunc(l_quantity)::INT = 0 THEN '0%' ELSE ((200 * l_linenumber + trunc(l_quantity)::INT) // (2 * trunc(l_quantity)::INT)) || '%' END AS share,
               ceil(l_partkey::DOUBLE * l_suppkey / 750)::BIGINT AS image, (l_partkey + 3) // 4 AS receipt, greatest(l_partkey - l_suppkey * 20, 0) AS waited,
               CASE WHEN l_partkey * 10 - 10 <= 0 THEN 'empty' WHEN l_partkey * 10 - 10 <= 4000 THEN 'small' WHEN l_partkey * 10 - 10 <= 16000 THEN 'medium' ELSE 'large' END AS size,
               CASE l_linenumber WHEN 1 THEN 'none' WHEN 2 THEN 'one' WHEN 3 THEN 'few' WHEN 4 THEN 'few' WHEN 5 THEN 'few' ELSE 'many' END AS images,
               CASE WHEN l_partkey * l_suppkey <= 0 THEN 'none' WHEN l_partkey * l_suppkey <= 1048576 THEN 'small' WHEN l_partkey * l_suppkey <= 4194304 THEN 'medium' ELSE 'large' END AS pixels FROM r""",
    "translation_reports": f"SELECT conv_id, turn, {_EST('text')} + {_EST('left(text, 50)')} AS local, greatest(0, {_EST('text')} - {_EST('left(text, 50)')}) AS net_saved, greatest(0, 30 - {_EST('text')}) AS saved FROM conversations",
    "clamped_logs": "SELECT doc_id, md5(CASE WHEN length(text) > 600 THEN left(text, 100) || chr(10) || chr(10) || '[... ' || (length(text) - 600) || ' characters omitted from the middle ...]' || chr(10) || chr(10) || right(text, 500) ELSE text END) AS md5 FROM documents",
    "identifiers_at": r"""
        WITH l AS (SELECT doc_id, string_split(replace(text, chr(13), chr(10)), chr(10))[1] AS line, (doc_id % 60)::INT AS col FROM documents WHERE text IS NOT NULL),
        a AS (SELECT *, CASE WHEN col = length(line) AND col > 0 THEN col - 1 ELSE col END AS pos FROM l),
        e AS (SELECT *, regexp_extract(left(line, pos), '[\p{L}\p{Nd}_$-]*$') AS before, regexp_extract(substring(line, pos + 1), '^[\p{L}\p{Nd}_$-]*') AS after FROM a)
        SELECT doc_id, CASE WHEN col <= length(line) AND after != '' THEN before || after END AS identifier FROM e""",
    "snippets": f"""
        WITH l AS (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines, (doc_id % 5 + 1)::INT AS start, (doc_id % 30 + 5)::INT AS stop FROM documents WHERE text IS NOT NULL),
        e AS (SELECT *, least(len(lines), stop, start - 1 + 12) AS last FROM l),
        s AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 AND doc_id % 4 != 0 THEN '{source.CHANGED.replace("'", "''")}' WHEN start > len(lines) THEN '{source.UNAVAILABLE}' ELSE array_to_string(lines[start:last], chr(10)) || CASE WHEN last < stop THEN chr(10) || '    ...' ELSE '' END END AS s, start > len(lines) AND NOT (doc_id % 10 = 0 AND doc_id % 4 != 0) AS gone FROM e),
        o AS (SELECT *, CASE WHEN ends_with(s, chr(10) || '    ...') THEN left(s, length(s) - 8) ELSE s END AS own FROM s)
        SELECT doc_id, md5(s) AS md5, (CASE WHEN gone OR own = '' THEN 0 ELSE length(own) - length(replace(own, chr(10), '')) + 1 END)::INT AS lines FROM o""",
    "source_flags": """
        SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text IS NOT NULL OR NULL WHEN doc_id % 9 = 1 THEN false ELSE contains(left(text, 500), '<auto-generated') END AS generated,
               doc_id % 3 = 0 AND doc_id // 9 % 2 = 0 AND source IS NOT NULL AS inferable FROM documents""",
    "fenced_code": f"""
        WITH {_FENCED}, z AS (SELECT conv_id, turn, unnest([{{'n': 0, 't': 'Intro ' || flat || chr(10), 'f': true}}, {{'n': 1, 't': block, 'f': false}}, {{'n': 2, 't': 'middle' || chr(10), 'f': true}}, {{'n': 3, 't': second, 'f': false}}, {{'n': 4, 't': flat, 'f': true}}]) AS p FROM y)
        SELECT conv_id, turn, p.n::INT AS nth, md5(p.t) AS md5, p.f AS translatable FROM z WHERE p.t != ''""",
    "protected_fences": f"""
        WITH {_FENCED} SELECT conv_id, turn, md5('Intro ' || flat || chr(10) || '__PROTECTED_FENCE_0000__middle' || chr(10) || '__PROTECTED_FENCE_0001__' || flat) AS marked,
               CASE WHEN turn % 3 = 0 THEN md5('IntrO ' || translate(flat, 'aeiou', 'AEIOU') || chr(10) || block || 'mIddlE' || chr(10) || second || translate(flat, 'aeiou', 'AEIOU')) END AS restored FROM y""",
    "boundary_breaks": "SELECT conv_id, turn, (turn % 3 * 2)::INT AS leading, md5('<' || text || '>') AS md5, (conv_id % 3)::INT AS trailing FROM conversations WHERE text IS NOT NULL",
    "soft_chunks": f"""
        WITH RECURSIVE s AS (SELECT doc_id, 0 AS part, text AS rest, CASE WHEN length(text) > 1000 THEN coalesce(nullif((SELECT {_BREAK} FROM (SELECT left(text, 1000) AS w)), 0), 1000) ELSE length(text) END AS size FROM documents WHERE text IS NOT NULL AND text != ''
            UNION ALL SELECT doc_id, part + 1, after, CASE WHEN length(after) > 1000 THEN coalesce(nullif((SELECT {_BREAK} FROM (SELECT left(after, 1000) AS w)), 0), 1000) ELSE length(after) END FROM (SELECT *, substring(rest, size + 1) AS after FROM s WHERE length(rest) > size))
        SELECT doc_id, part::INT AS part, md5(left(rest, size)) AS md5 FROM s""",
    "unit_vectors": "WITH v AS (SELECT vec_id, [(x * 3::FLOAT)::DOUBLE for x in embedding] AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum([x * x for x in v])) AS n FROM v) SELECT vec_id, round(v[1] / n, 4) AS first, round(list_sum([(x / n) * (x / n) for x in v]), 4) AS square FROM n",
    "filtered_search": "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id AS ordinal, 'Src\\File' || label || '.cs' AS path, round(list_dot_product(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q WHERE vec_id % 3 != 0 AND label::VARCHAR LIKE '1%'",
    "calibrated_search": """
        SELECT o_orderkey, CASE WHEN o_orderkey // 3 % 2 = 1 THEN 'not_calibrated' WHEN o_orderkey % 3 = 2 THEN 'other_floor' WHEN o_custkey % 3 = 2 OR (CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END) IS DISTINCT FROM (CASE WHEN o_orderstatus != 'P' THEN o_orderstatus END) THEN 'not_ready' ELSE 'ok' END AS verdict FROM orders""",
}
