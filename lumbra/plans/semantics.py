"""Symbol-table and definition-chunk queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbra.operators import definitions, semantic, spans
from lumbra.operators.tables import tasks_for

from .corpus import _pick
from .graphs import _spans
from .retrieval import asked, table


def ranged(spark, sf_dir):
    """Line items as occurrences with columns: document an order, symbol a part; every other one has an enclosing range."""
    li = table(spark, sf_dir, "lineitem")
    sl, q = (F.col("l_linenumber") / 2).cast("int"), F.col("l_quantity").cast("int")
    sc = (F.col("l_suppkey") % 9).cast("int")
    el, ec = sl + q % 3, sc + 1 + q % 7
    roles = F.when(F.col("l_linestatus") == "O", 1).otherwise(2) + F.when(F.col("l_returnflag") == "R", semantic.ROLE_READ).otherwise(0)
    enclosing = F.when(F.col("l_partkey") % 2 == 0, F.struct(sl.alias("sl"), F.lit(0).alias("sc"), (el + q % 4).alias("el"), F.lit(20).alias("ec")))
    return li.select(F.col("l_orderkey").alias("doc"), sl.alias("sl"), sc.alias("sc"), el.alias("el"), ec.alias("ec"), F.col("l_partkey").alias("symbol"), roles.cast("int").alias("roles"), enclosing.alias("enclosing"))


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), (F.col("p_partkey") % 97 + 1).alias("target"), _pick(("Override", "Implementation"), F.col("p_partkey")).alias("kind"))


def incoming_relationships(spark, sf_dir):
    return semantic.relationships(ranged(spark, sf_dir).drop("enclosing"), _edges(spark, sf_dir), asked(spark, sf_dir), True, "Override")


def outgoing_relationships(spark, sf_dir):
    return semantic.relationships(ranged(spark, sf_dir).drop("enclosing"), _edges(spark, sf_dir), asked(spark, sf_dir), False)


def resolved_positions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    points = o.select(F.col("o_orderkey").alias("point_id"), F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 4).cast("int").alias("line"), (F.col("o_custkey") % 12).cast("int").alias("col"))
    return semantic.resolved(ranged(spark, sf_dir), points)


def occurrence_roles(spark, sf_dir):
    """Roles of one place and symbol together, with its first enclosing range."""
    return ranged(spark, sf_dir).groupBy("doc", "sl", "sc", "el", "ec", "symbol").agg(F.bit_or("roles").alias("roles"), F.max("enclosing.el").alias("enclosing_end"))


def ordered_locations(spark, sf_dir):
    """The first places of one symbol's family, a bounded report."""
    return semantic.located(ranged(spark, sf_dir).where("symbol % 50 = 7").drop("enclosing"), 200)


def _indexes(spark, sf_dir):
    """A base index and a current one: documents gone, new, changed, and changed in one occurrence only."""
    o, r = table(spark, sf_dir, "orders"), ranged(spark, sf_dir).select("doc", "sl", "sc", "symbol")
    p = table(spark, sf_dir, "part")
    doc = o.select(F.col("o_orderkey").alias("doc"), F.col("o_orderstatus").alias("hash"))
    base = {"docs": doc.where("doc % 19 != 3"), "occurrences": r.where("doc % 19 != 3"), "symbols": p.select(F.col("p_partkey").alias("symbol"), F.col("p_brand").alias("name")), "edges": _edges(spark, sf_dir)}
    new = doc.where("doc % 17 != 5").withColumn("hash", F.when(F.col("doc") % 23 == 1, F.lit("new")).otherwise(F.col("hash")))
    moved = r.where("doc % 17 != 5").withColumn("symbol", F.when((F.col("doc") % 29 == 2) & (F.col("sc") == 4), F.col("symbol") % 10 + 1).otherwise(F.col("symbol")))
    edges = base["edges"].where("source % 31 != 4")
    return base, {"docs": new, "occurrences": moved, "symbols": base["symbols"].withColumn("name", F.upper("name")), "edges": edges}


def _dirty(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey % 37 = 6").select(F.col("o_orderkey").alias("doc"))


def overlay_documents(spark, sf_dir):
    base, current = _indexes(spark, sf_dir)
    return semantic.overlay(base, current, _dirty(spark, sf_dir))["touched"]


def overlay_occurrences(spark, sf_dir):
    """Base and overlay together have the occurrences of the current index."""
    base, current = _indexes(spark, sf_dir)
    got = semantic.materialised(base, semantic.overlay(base, current, _dirty(spark, sf_dir)))
    return got["occurrences"].repartition(tasks_for(current["occurrences"]), "doc").groupBy("doc", "symbol").agg(F.count("*").alias("n"))


def overlay_symbols(spark, sf_dir):
    base, current = _indexes(spark, sf_dir)
    return semantic.overlay(base, current, _dirty(spark, sf_dir))["symbols"]


def occurrence_differences(spark, sf_dir):
    base, current = _indexes(spark, sf_dir)
    return semantic.differences(base["occurrences"], current["occurrences"])


def supplemented_documents(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    base = o.where("o_orderkey % 3 != 0").select(F.col("o_orderkey").alias("doc"), F.col("o_orderstatus").alias("hash"))
    more = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderkey") % 5 == 1, "other").otherwise(F.col("o_orderstatus")).alias("hash"))
    return semantic.supplemented(base, more, "doc", "hash")


SYMBOLS = ("local 7", "local 16(line)", "local a b", "scip-ts npm pkg 1.0 a/B#", "scip-ts npm  two words x", "scip-ts npm pkg", "local", "scheme . . . name.")
VALID = ("scip-local D 7", "scip-local D 16(line)", None, "scip-ts npm pkg 1.0 a/B#", None, None, None, "scheme . . . name.")


def imported_symbols(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", semantic.imported_symbol(_pick(SYMBOLS, F.col("p_partkey")), F.lit("D")).alias("symbol"), semantic.imported_kind((F.col("p_partkey") % 90).cast("int")).alias("kind"), semantic.imported_roles((F.col("p_partkey") % 16).cast("int")).cast("int").alias("roles"))


def resource_definitions(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    uses = li.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 400).alias("key"))
    return semantic.unambiguous(uses, p.select((F.col("p_partkey") % 300).alias("key"), (F.col("p_partkey") % 7).alias("doc"))).drop("key")


def definition_catalogue(spark, sf_dir):
    o = ranged(spark, sf_dir).withColumn("doc", F.concat(F.lit("src\\"), F.col("doc").cast("string")))
    named = F.concat(_pick(("scip-ts npm p 1 a", "scip-local d ", "dotnet "), F.col("symbol")), F.col("symbol").cast("string"), _pick(("#", ".", "()"), F.floor(F.col("symbol") / 3)))
    return semantic.definition_catalogue(o.withColumn("symbol", named)).select("doc", "symbol", "sl", "sc", F.col("enclosing.el").alias("until"))


def token_positions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(" the "), F.lit(" Class the "))).otherwise(F.replace("text", F.lit(" the "), F.lit(" the: ")))
    return semantic.token_positions(d.select(F.concat(F.col("doc_id").cast("string"), _pick((".ts", ".json"), F.col("doc_id"))).alias("doc"), text.alias("text")), "the")


def live_documents(spark, sf_dir):
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    k = F.col("event_id")
    opened = e.select((F.col("user_id") % 1500).alias("doc"), F.when(k % 7 == 0, (k - 1000) * 2 + 1).otherwise(k * 2).alias("version"), F.col("event_type").alias("text"), k.alias("sequence"))
    got = semantic.live_documents(d.select(F.col("doc_id").alias("doc"), "text"), opened)
    return got.select("doc", F.md5(F.col("text").cast("binary")).alias("md5"), "version", "stale")


def imported_ranges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    n = [F.col("l_linenumber"), (F.col("l_suppkey") % 9).cast("int"), F.col("l_quantity").cast("int") % 8, (F.col("l_partkey") % 9).cast("int")]
    numbers = F.when(F.col("l_orderkey") % 3 == 0, F.array(*n)).when(F.col("l_orderkey") % 3 == 1, F.array(*n[:3])).otherwise(F.array(*n[:2]))
    r = semantic.imported_range(numbers)
    return li.select("l_orderkey", "l_linenumber", *[r[c].alias(c) for c in ("sl", "sc", "el", "ec")])


def inferred_extents(spark, sf_dir):
    """Declarations and reported spans at lines of the documents' texts, a word on each line."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    words = F.split(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " "), " ")
    lines = d.select(F.col("doc_id").alias("doc"), F.posexplode(words).alias("k", "word")).select("doc", (F.col("k") + 1).alias("line"), "word")
    names = lines.where(F.length("word") == 9).select("doc", "line", (F.col("line") % 3).alias("column"), F.col("word").alias("name"))
    reported = lines.where(F.length("word") == 10).select("doc", F.col("line").alias("first"), (F.col("line") + F.col("line") % 17).alias("last")).distinct()
    return definitions.inferred_extents(names, reported, lines.select("doc", "line", (definitions.trimmable(F.col("word")) | (F.length("word") == 2)).alias("trimmable")))


def qualified_paths(spark, sf_dir):
    s = _spans(spark, sf_dir).distinct().withColumn("name", F.concat(F.lit("s"), (F.col("id") % 100).cast("string")))
    return definitions.qualified(s).select("doc", "id", "path")


def own_lines(spark, sf_dir):
    return definitions.own_lines(spans.parents(_spans(spark, sf_dir).distinct())).groupBy("doc", "id").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


def split_bodies(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    bodies = d.select("doc_id", F.concat(F.lit("File: "), "source", F.lit("\n")).alias("header"), F.split(F.replace("text", F.lit(" "), F.lit("\n")), "\n").alias("lines"))
    return definitions.split_windows(bodies).select("doc_id", "label", "offset", "shown", F.md5(F.col("body").cast("binary")).alias("md5"))


def region_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    files = d.select(F.col("doc_id").alias("doc"), F.split(F.replace("text", F.lit(" "), F.lit("\n")), "\n").alias("lines"))
    regions = files.where(F.size("lines") >= 20).select("doc", F.explode(F.array(F.struct(F.lit(2).alias("first"), F.lit(9).alias("last")), F.struct(F.lit(12).alias("first"), F.size("lines").alias("last")))).alias("r")).select("doc", "r.*")
    return definitions.region_windows(regions, files).select("doc", "first", "last", "label", F.md5(F.col("body").cast("binary")).alias("md5"))


QUERIES = {f.__name__: f for f in (incoming_relationships, outgoing_relationships, resolved_positions, occurrence_roles, ordered_locations, overlay_documents, overlay_occurrences, overlay_symbols, occurrence_differences, supplemented_documents, imported_symbols, resource_definitions, inferred_extents, qualified_paths, own_lines, split_bodies, region_windows, definition_catalogue, token_positions, live_documents, imported_ranges)}

_RANGED = """
    r AS (SELECT l_orderkey AS doc, trunc(l_linenumber / 2.0)::INT AS sl, (l_suppkey % 9)::INT AS sc, (trunc(l_linenumber / 2.0)::INT + trunc(l_quantity)::INT % 3)::INT AS el, ((l_suppkey % 9)::INT + 1 + trunc(l_quantity)::INT % 7)::INT AS ec, l_partkey AS symbol,
          (CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END + CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END)::INT AS roles, CASE WHEN l_partkey % 2 = 0 THEN (trunc(l_linenumber / 2.0)::INT + trunc(l_quantity)::INT % 3 + trunc(l_quantity)::INT % 4)::INT END AS ee FROM lineitem)"""
_EDGES = "e AS (SELECT p_partkey AS source, p_partkey % 97 + 1 AS target, CASE WHEN p_partkey % 2 = 0 THEN 'Override' ELSE 'Implementation' END AS kind FROM part), s AS (SELECT p_partkey AS symbol FROM part WHERE p_size = 7)"
_INDEX = _RANGED + """,
    bo AS (SELECT doc, sl, sc, symbol FROM r WHERE doc % 19 != 3), co AS (SELECT doc, sl, sc, CASE WHEN doc % 29 = 2 AND sc = 4 THEN symbol % 10 + 1 ELSE symbol END AS symbol FROM r WHERE doc % 17 != 5),
    bd AS (SELECT o_orderkey AS doc, o_orderstatus AS hash FROM orders WHERE o_orderkey % 19 != 3), cd AS (SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 23 = 1 THEN 'new' ELSE o_orderstatus END AS hash FROM orders WHERE o_orderkey % 17 != 5),
    t AS (SELECT doc FROM bd FULL JOIN cd USING (doc) WHERE bd.hash IS DISTINCT FROM cd.hash UNION SELECT doc FROM (FROM bo EXCEPT FROM co) UNION SELECT doc FROM (FROM co EXCEPT FROM bo) UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 37 = 6 AND (o_orderkey % 19 != 3 OR o_orderkey % 17 != 5)),
    be AS (SELECT p_partkey AS source, p_partkey % 97 + 1 AS target FROM part), ce AS (SELECT * FROM be WHERE source % 31 != 4)"""
_LINES = "string_split(replace(text, ' ', chr(10)), chr(10))"
_NAMED = "sp AS (SELECT DISTINCT l_orderkey AS doc, f * 1000 + l AS id, f AS first, l AS last FROM (SELECT *, f + trunc(l_quantity)::INT % 25 AS l FROM (SELECT *, (l_suppkey % 40 + 1)::INT AS f FROM lineitem)))"
_NESTED = "(p.first <= s.first AND p.last >= s.last AND (p.first != s.first OR p.last != s.last OR p.id < s.id))"

ORACLES = {
    "incoming_relationships": f"WITH {_RANGED}, {_EDGES} SELECT DISTINCT doc, sl, sc, el, ec, r.symbol, roles, kind FROM r JOIN e ON r.symbol = source WHERE roles & 1 != 0 AND kind = 'Override' AND target IN (FROM s)",
    "outgoing_relationships": f"WITH {_RANGED}, {_EDGES} SELECT DISTINCT doc, sl, sc, el, ec, r.symbol, roles, kind FROM r JOIN e ON r.symbol = target WHERE roles & 1 != 0 AND source IN (FROM s)",
    "resolved_positions": f"""
        WITH {_RANGED}, p AS (SELECT o_orderkey AS point_id, o_orderkey AS doc, (o_custkey % 4)::INT AS line, (o_custkey % 12)::INT AS col FROM orders),
        x AS (SELECT point_id, symbol FROM r JOIN p USING (doc) WHERE (line > sl OR (line = sl AND col >= sc)) AND (line < el OR (line = el AND col < ec)) QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY sl DESC, sc DESC, el, ec, symbol) = 1),
        d AS (SELECT doc, sl AS line, symbol, sc, el, ec, ee FROM r WHERE roles & 1 != 0 QUALIFY row_number() OVER (PARTITION BY doc, sl, symbol ORDER BY sc, el, ec) = 1),
        n AS (SELECT doc, line, count(*) AS n FROM d GROUP BY ALL),
        h AS (SELECT d.doc, d.line, d.symbol FROM d JOIN n USING (doc, line) WHERE n = 1 OR (ee IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d o WHERE o.doc = d.doc AND o.line = d.line AND o.symbol != d.symbol AND NOT (0 <= o.sc AND (d.ee > o.el OR (d.ee = o.el AND 20 >= o.ec)))))),
        k AS (SELECT doc, line, min(symbol) AS symbol FROM h GROUP BY ALL HAVING count(*) = 1)
        SELECT point_id, symbol, true AS exact FROM x UNION ALL SELECT point_id, symbol, false FROM p JOIN k USING (doc, line) WHERE point_id NOT IN (SELECT point_id FROM x)""",
    "occurrence_roles": f"WITH {_RANGED} SELECT doc, sl, sc, el, ec, symbol, bit_or(roles) AS roles, max(ee) AS enclosing_end FROM r GROUP BY ALL",
    "ordered_locations": f"WITH {_RANGED} SELECT doc, sl, sc, el, ec, symbol, roles FROM r WHERE symbol % 50 = 7 ORDER BY doc, sl, sc, el, ec, symbol LIMIT 200",
    "overlay_documents": f"WITH {_INDEX} SELECT doc, doc NOT IN (SELECT doc FROM cd) AS deleted FROM t",
    "overlay_occurrences": f"WITH {_INDEX} SELECT doc, symbol, count(*) AS n FROM co GROUP BY ALL",
    "overlay_symbols": f"""
        WITH {_INDEX}, i AS (SELECT symbol FROM bo WHERE doc IN (FROM t) UNION SELECT symbol FROM co WHERE doc IN (FROM t)), ie AS (SELECT * FROM ce WHERE source IN (FROM i) OR target IN (FROM i)),
        w AS (SELECT symbol FROM co WHERE doc IN (FROM t) UNION SELECT source FROM ie UNION SELECT target FROM ie) SELECT p_partkey AS symbol, upper(p_brand) AS name FROM part WHERE p_partkey IN (FROM w)""",
    "occurrence_differences": f"WITH {_INDEX} SELECT *, 'missing' AS side FROM (FROM bo EXCEPT FROM co) UNION ALL SELECT *, 'extra' FROM (FROM co EXCEPT FROM bo)",
    "supplemented_documents": "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 1 THEN 'other' ELSE o_orderstatus END AS hash, o_orderkey % 3 != 0 AND o_orderkey % 2 = 0 AND o_orderkey % 5 = 1 AS conflict FROM orders WHERE o_orderkey % 3 != 0 OR o_orderkey % 2 = 0",
    "imported_symbols": f"""
        SELECT p_partkey, [{', '.join('NULL' if v is None else f"'{v}'" for v in VALID)}][p_partkey % {len(VALID)} + 1] AS symbol,
               CASE {' '.join(f"WHEN p_partkey % 90 IN ({', '.join(map(str, c))}) THEN '{k}'" for k, c in semantic.KINDS.items())} ELSE 'Unknown' END AS kind,
               (CASE WHEN p_partkey % 2 = 1 THEN 1 ELSE 2 END + p_partkey // 2 % 2 * 4 + p_partkey // 4 % 2 * 8 + p_partkey // 8 % 2 * 16)::INT AS roles FROM part""",
    "resource_definitions": "WITH k AS (SELECT p_partkey % 300 AS key, count(DISTINCT p_partkey % 7) AS n, min(p_partkey % 7) AS d FROM part GROUP BY 1) SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN d END AS defined_in FROM lineitem LEFT JOIN k ON key = l_partkey % 400",
    "definition_catalogue": f"""
        WITH {_RANGED}, n AS (SELECT *, ['scip-ts npm p 1 a', 'scip-local d ', 'dotnet '][symbol % 3 + 1] || symbol || ['#', '.', '()'][symbol // 3 % 3 + 1] AS name FROM r WHERE roles & 1 != 0)
        SELECT 'src/' || doc AS doc, name AS symbol, sl, sc, ee AS until FROM n WHERE ee IS NOT NULL OR (symbol % 3 = 0 AND symbol // 3 % 3 < 2)""",
    "token_positions": r"""
        WITH d AS (SELECT doc_id || CASE WHEN doc_id % 2 = 0 THEN '.ts' ELSE '.json' END AS doc, string_split(replace(replace(replace(text, ' the ', CASE WHEN doc_id % 3 = 0 THEN ' Class the ' ELSE ' the: ' END), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc, unnest(range(0, len(lines))) AS line, unnest(lines) AS body FROM d), t AS (SELECT *, regexp_extract_all(body, '[\p{L}\p{Nd}_$-]+|[^\p{L}\p{Nd}_$-]+') AS p FROM l WHERE contains(body, 'the')),
        k AS (SELECT doc, line, body, p, unnest(range(1, len(p) + 1)) AS k FROM t), f AS (SELECT doc, line, body, array_to_string(p[1:k - 1], '') AS before, array_to_string(p[k + 1:], '') AS after FROM k WHERE p[k] = 'the')
        SELECT doc, line::INT AS line, length(before)::INT AS col, lower(regexp_extract(before, '([^ \t(){}\[\]:;,=]+)[ \t(){}\[\]:;,=]*$', 1)) IN ('class', 'interface', 'enum', 'struct', 'record', 'def', 'function', 'type', 'namespace', 'module', 'const', 'let', 'var', 'trait', 'protocol')
               OR (ends_with(doc, '.json') AND starts_with(regexp_replace(after, '^\s*"?\s*', ''), ':')) AS declares FROM f""",
    "live_documents": """
        WITH o AS (SELECT user_id % 1500 AS doc, CASE WHEN event_id % 7 = 0 THEN (event_id - 1000) * 2 + 1 ELSE event_id * 2 END AS version, event_type AS text, event_id FROM events),
        l AS (SELECT *, coalesce(version <= max(version) OVER (PARTITION BY doc ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM o), v AS (SELECT doc, arg_max(text, version) AS live, max(version) AS version, bool_or(late) AS stale FROM l GROUP BY doc)
        SELECT coalesce(v.doc, doc_id) AS doc, md5(coalesce(live, text)) AS md5, version, coalesce(stale, false) AS stale FROM documents FULL JOIN v ON v.doc = doc_id""",
    "imported_ranges": """
        WITH n AS (SELECT l_orderkey, l_linenumber, l_linenumber AS a, (l_suppkey % 9)::INT AS b, (trunc(l_quantity)::INT % 8) AS c, (l_partkey % 9)::INT AS d FROM lineitem),
        f AS (SELECT l_orderkey, l_linenumber, a, b, CASE WHEN l_orderkey % 3 = 0 THEN c ELSE a END AS e, CASE WHEN l_orderkey % 3 = 0 THEN d ELSE c END AS f, l_orderkey % 3 != 2 AS whole FROM n), g AS (SELECT *, whole AND (e > a OR (e = a AND f >= b)) AS good FROM f)
        SELECT l_orderkey, l_linenumber, CASE WHEN good THEN a END AS sl, CASE WHEN good THEN b END AS sc, CASE WHEN good THEN e END AS el, CASE WHEN good THEN f END AS ec FROM g""",
    "inferred_extents": r'''
        WITH w AS (SELECT doc_id AS doc, string_split(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS w FROM documents WHERE text IS NOT NULL), l AS (SELECT doc, unnest(range(1, len(w) + 1))::INT AS line, unnest(w) AS word FROM w),
        rep AS (SELECT doc, line AS first, line + line % 17 AS last FROM l WHERE length(word) = 10), e AS (SELECT doc, line, NULL::INT AS last, word AS name FROM l WHERE length(word) = 9 UNION ALL SELECT doc, first, last, NULL FROM rep),
        c AS (SELECT doc, line, name FROM (SELECT *, max(last) OVER (PARTITION BY doc ORDER BY line RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until FROM e) WHERE name IS NOT NULL AND (until IS NULL OR until < line)),
        b AS (SELECT doc, line FROM c UNION SELECT doc, first FROM rep UNION SELECT doc, len(w) + 1 FROM w), u AS (SELECT doc, line, lead(line) OVER (PARTITION BY doc ORDER BY line) - 1 AS until FROM b),
        s AS (SELECT doc, line FROM l WHERE NOT (word = '' OR length(word) = 2 OR starts_with(word, '//') OR starts_with(word, '/*') OR starts_with(word, '*') OR starts_with(word, '#')))
        SELECT c.doc, c.name, c.line AS first, max(s.line) AS last FROM c JOIN u ON u.doc = c.doc AND u.line = c.line JOIN s ON s.doc = c.doc AND s.line > c.line AND s.line <= u.until GROUP BY ALL''',
    "qualified_paths": f"WITH {_NAMED} SELECT s.doc, s.id, string_agg('s' || (p.id % 100), '.' ORDER BY p.first, -p.last, p.id) AS path FROM sp s JOIN sp p ON p.doc = s.doc AND ({_NESTED} OR p.id = s.id) GROUP BY s.doc, s.id",
    "own_lines": f"""
        WITH {_NAMED}, n AS (SELECT s.*, (SELECT arg_max(p.id, (p.first, -p.last, p.id)) FROM sp p WHERE p.doc = s.doc AND {_NESTED}) AS parent FROM sp s),
        l AS (SELECT doc, id, unnest(range(first, last + 1))::INT AS line FROM n),
        o AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM n c WHERE c.doc = l.doc AND c.parent = l.id AND l.line BETWEEN c.first AND c.last) OR EXISTS (SELECT 1 FROM n c WHERE c.doc = l.doc AND c.parent = l.id AND l.line = c.first))
        SELECT doc, id, count(*) AS n, sum(line)::BIGINT AS lines FROM o GROUP BY ALL""",
    "split_bodies": f"""
        WITH b AS (SELECT doc_id, 'File: ' || source || chr(10) AS h, {_LINES} AS lines FROM documents WHERE text IS NOT NULL), w AS (SELECT *, len(lines) AS n, length(h) + length(array_to_string(lines, chr(10))) AS whole FROM b),
        s AS (SELECT *, whole <= 6000 AS fits, greatest(20, (6000 - length(h)) // greatest(1, whole // greatest(n, 1))) AS wide FROM w),
        o AS (SELECT *, unnest(CASE WHEN fits THEN [0] ELSE range(0, greatest(n, 1), greatest(1, wide - 8)) END) AS "offset" FROM s)
        SELECT doc_id, CASE WHEN fits THEN '' ELSE ' [' || ("offset" // (wide - 8) + 1) || '/' || ceil(n / (wide - 8)::DOUBLE)::BIGINT || ']' END AS label, "offset"::INT AS "offset", (CASE WHEN fits THEN n ELSE least(wide, n - "offset") END)::INT AS shown,
               md5(left(h || array_to_string(CASE WHEN fits THEN lines ELSE lines["offset" + 1:"offset" + wide] END, chr(10)), 6000)) AS md5 FROM o WHERE fits OR "offset" = 0 OR "offset" - (wide - 8) + wide < n""",
    "region_windows": f"""
        WITH f AS (SELECT doc_id AS doc, {_LINES} AS lines FROM documents WHERE text IS NOT NULL), g AS (SELECT doc, lines, unnest([[2, 9], [12, len(lines)]]) AS r FROM f WHERE len(lines) >= 20),
        w AS (SELECT doc, lines, r, unnest(range(r[1], r[2] + 1, 48)) AS a FROM g), k AS (SELECT doc, r, a, least(r[2], a + 59) AS z, lines FROM w WHERE a = r[1] OR a - r[1] + 12 < r[2] - r[1] + 1),
        x AS (SELECT doc, r, a, z, array_to_string(lines[a:z], chr(10)) AS body FROM k), y AS (SELECT *, row_number() OVER (PARTITION BY doc, r ORDER BY a) AS nth, count(*) OVER (PARTITION BY doc, r) AS parts FROM x WHERE regexp_replace(body, '\\s', '', 'g') != '')
        SELECT doc, a::INT AS first, z::INT AS last, CASE WHEN parts > 1 THEN ' [' || nth || '/' || parts || ']' ELSE '' END AS label, md5(body) AS md5 FROM y""",
}
