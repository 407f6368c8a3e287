"""Chunks along what a text declares: from its syntax, and along given definitions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbra.operators import definitions, syntax
from lumbra.operators.tables import tasks_for

from .retrieval import table


def sources(spark, sf_dir):
    """Orders as C#-like files: a namespace, a class with a field, an automatic property and one with a body, a method for each line item, and a nested enum. Braces in strings and comments tell nothing."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    key = F.col("o_orderkey").cast("string")
    item = lambda n, part: say("\n    /// <summary>Line ", n, ".</summary>\n    public int Line", n, '(int q, string s = "(")\n    {\n        if (q > 1) { return \'}\'; } /* } */\n        return ', part, "\n    }\n")
    # The items of an order meet as numbers, in tasks of bounded rows; their text is made after that. Equal numbers stand in the order of their text.
    tasks = tasks_for(li)
    o, li = o.repartition(tasks, "o_orderkey"), li.repartition(tasks, "l_orderkey")
    items = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.concat(F.col("l_partkey").cast("string"), F.lit(";")).alias("part")))).alias("items"))  # at most 7
    methods = F.array_join(F.transform("items", lambda x: item(x["n"].cast("string"), x["part"])), "")
    head = say("namespace Shop.", F.col("o_orderstatus"), ';\n\n/// <summary>Order { ', key, '.</summary>\npublic sealed class Order', key, ' : IOrder\n{\n    private readonly string[] _open = { "{", "}" };\n    public int Count { get; private set; } = 5;\n\n    public string State\n    {\n        get { return @"""{"; }\n    }\n')
    tail = "\n    public enum Mode\n    {\n        Fast = 1, // {\n        Slow,\n    }\n}\n"
    return o.join(items, "o_orderkey", "left").select(say("src/o", key, ".cs").alias("doc"), say(head, F.coalesce(methods, F.lit("")), tail).alias("text"))


def syntax_chunks(spark, sf_dir):
    got = syntax.syntax_chunks(sources(spark, sf_dir))
    return got.select("doc", "kind", "symbol", "signature", "namespace", "first", "last", F.md5(F.col("body").cast("binary")).alias("md5"))


def syntax_definitions(spark, sf_dir):
    """Definitions of each file, out of its text alone."""
    return syntax.definitions_of(sources(spark, sf_dir)).select("doc", "name", "first", "last")


FIXED = [("Outer", 2, 0, 2, 30), ("inner", 4, 2, 4, 9), ("other", 12, 2, 12, 20), ("Late", 40, 0, 40, 60), ("gone", 150, 0, 150, 260), ("loose", 70, 3, None, None)]


def symbol_chunks(spark, sf_dir):
    """Documents with a word on each line, cut along definitions that stand at fixed lines."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    files = d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("doc"), F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", "\n").alias("text"))
    fixed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(line).alias("line"), F.lit(c).alias("column"), F.lit(a).cast("int").alias("first"), F.lit(b).cast("int").alias("last")) for n, line, c, a, b in FIXED])
    found = files.select("doc", F.explode(fixed).alias("d")).select("doc", "d.*")
    return definitions.symbol_chunks(files, found).select("doc", "kind", "symbol", "first", "last", F.md5(F.col("body").cast("binary")).alias("md5"))


QUERIES = {f.__name__: f for f in (syntax_chunks, syntax_definitions, symbol_chunks)}

_SOURCES = """
    o AS (SELECT o_orderkey AS k, 'src/o' || o_orderkey || '.cs' AS doc, 'Shop.' || o_orderstatus AS ns, 'Order' || o_orderkey AS t FROM orders),
    m AS (SELECT k, doc, ns, t, l_linenumber AS n, l_partkey AS p, (row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_partkey || ';'))::INT AS nth FROM o JOIN lineitem ON l_orderkey = k),
    c AS (SELECT k, count(l_orderkey)::INT AS n FROM o LEFT JOIN lineitem ON l_orderkey = k GROUP BY k)"""
ORACLES = {
    "syntax_definitions": f"""
        WITH {_SOURCES}
        SELECT doc, t AS name, 4 AS first, 19 + 7 * n AS last FROM o JOIN c USING (k) UNION ALL SELECT doc, 'State', 9, 12 FROM o UNION ALL SELECT doc, 'Line' || n, 8 + 7 * nth, 12 + 7 * nth FROM m
        UNION ALL SELECT doc, 'Mode', 14 + 7 * n, 18 + 7 * n FROM o JOIN c USING (k)""",
    "syntax_chunks": f"""
        WITH {_SOURCES}, h AS (SELECT *, 'File: ' || doc || chr(10) || 'Namespace: ' || ns || chr(10) AS top, chr(10) AS e FROM o JOIN c USING (k)),
        s AS (SELECT k, string_agg('    public int Line' || n || '(int q, string s = "(")' || chr(10), '' ORDER BY n) AS lines FROM m GROUP BY k)
        SELECT doc, 'Type' AS kind, t AS symbol, 'public sealed class ' || t || ': IOrder' AS signature, ns AS namespace, 4 AS first, 19 + 7 * n AS last,
               md5(top || '/// <summary>Order {{ ' || k || '.</summary>' || e || 'public sealed class ' || t || ': IOrder' || e || '    private readonly string[] _open = {{ "{{", "}}" }};' || e || '    public int Count {{ get; set; }}' || e || '    public string State {{ get; }}' || e
                   || coalesce(lines, '') || '    public enum Mode {{ Fast = 1, // {{ Slow, }}' || e) AS md5 FROM h LEFT JOIN s USING (k)
        UNION ALL SELECT doc, 'Type', t || '.Mode', 'public enum Mode', ns, 14 + 7 * n, 18 + 7 * n, md5(top || 'public enum Mode' || e || '    Fast = 1' || e || '    Slow' || e) FROM h
        UNION ALL SELECT doc, 'Method', t || '.State', 'public string State', ns, 9, 12, md5(top || 'Type: ' || t || e || 'public string State' || e || '    {{' || e || '        get {{ return @\"\"\"{{\"; }}' || e || '    }}') FROM h
        UNION ALL SELECT doc, 'Method', t || '.Line' || m.n, 'public int Line' || m.n || '(int q, string s = "(")', ns, 8 + 7 * nth, 12 + 7 * nth,
               md5('File: ' || doc || chr(10) || 'Namespace: ' || ns || chr(10) || 'Type: ' || t || chr(10) || '/// <summary>Line ' || m.n || '.</summary>' || chr(10) || 'public int Line' || m.n || '(int q, string s = "(")' || chr(10) || '    {{' || chr(10)
                   || '        if (q > 1) {{ return ''}}''; }} /* }} */' || chr(10) || '        return ' || p || ';' || chr(10) || '    }}') FROM m""",
    "symbol_chunks": r"""
        WITH f AS (SELECT source AS folder, source || '/' || doc_id || '.ts' AS doc, string_split(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS lines FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(0))),
        n AS (SELECT *, len(lines)::INT AS n FROM f),
        sp AS (SELECT n.*, d.* FROM n, (VALUES ('Outer', 2, 30), ('inner', 4, 9), ('other', 12, 20), ('Late', 40, 60), ('gone', 150, 260)) d(name, first, last) WHERE d.last <= n
               UNION ALL SELECT *, 'loose', 70, (SELECT max(k) FROM range(71, CASE WHEN n >= 260 THEN 150 ELSE n + 1 END) t(k) WHERE NOT (lines[k] = '' OR starts_with(lines[k], '//') OR starts_with(lines[k], '/*') OR starts_with(lines[k], '*') OR starts_with(lines[k], '#')))::INT FROM n WHERE n >= 70),
        s AS (SELECT *, CASE WHEN name IN ('inner', 'other') AND n >= 30 THEN 'Outer' END AS within, name = 'Outer' AS outer_ FROM sp WHERE last IS NOT NULL),
        b AS (SELECT *, 'File: ' || doc || chr(10) || CASE WHEN folder != '' THEN 'Namespace: ' || folder || chr(10) ELSE '' END || CASE WHEN within IS NOT NULL THEN 'Within: Outer' || chr(10) ELSE '' END AS h,
                     CASE WHEN outer_ THEN lines[2:4] || lines[10:12] || lines[21:30] ELSE lines[first:last] END AS own FROM s),
        w AS (SELECT *, len(own) AS m, length(h) + length(array_to_string(own, chr(10))) AS whole FROM b), x AS (SELECT *, whole <= 6000 AS fits, greatest(20, (6000 - length(h)) // greatest(1, whole // greatest(m, 1))) AS wide FROM w),
        o AS (SELECT *, unnest(CASE WHEN fits THEN [0] ELSE range(0, greatest(m, 1), greatest(1, wide - 8)) END) AS off FROM x),
        defs AS (SELECT doc, CASE WHEN outer_ OR regexp_matches(left(lines[first], 200), '\b(?:class|interface)\b') THEN 'Type' ELSE 'Method' END AS kind, CASE WHEN within IS NOT NULL THEN 'Outer.' ELSE '' END || name || CASE WHEN fits THEN '' ELSE ' [' || (off // (wide - 8) + 1) || '/' || ceil(m / (wide - 8)::DOUBLE)::BIGINT || ']' END AS symbol,
                 (first + off)::INT AS first, (CASE WHEN fits THEN last ELSE least(last, first + off + least(wide, m - off) - 1) END)::INT AS last, md5(left(h || array_to_string(CASE WHEN fits THEN own ELSE own[off + 1:off + wide] END, chr(10)), 6000)) AS md5 FROM o WHERE fits OR off = 0 OR off - (wide - 8) + wide < m),
        cut AS (SELECT doc, first, last FROM s UNION ALL SELECT doc, n + 1, n + 1 FROM n), g AS (SELECT doc, coalesce(max(last) OVER (PARTITION BY doc ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS a0, first - 1 AS z0 FROM cut),
        r AS (SELECT doc, lines, a0, z0, unnest(range(a0, z0 + 1, 48)) AS a FROM g JOIN n USING (doc) WHERE a0 <= z0), k AS (SELECT doc, a0, a, least(z0, a + 59) AS z, lines FROM r WHERE a = a0 OR a - a0 + 12 < z0 - a0 + 1),
        t AS (SELECT doc, a0, a, z, array_to_string(lines[a:z], chr(10)) AS body FROM k), y AS (SELECT *, row_number() OVER (PARTITION BY doc, a0 ORDER BY a) AS nth, count(*) OVER (PARTITION BY doc, a0) AS parts FROM t WHERE regexp_replace(body, '\s', '', 'g') != '')
        SELECT * FROM defs UNION ALL SELECT doc, 'Text', doc || CASE WHEN parts > 1 THEN ' [' || nth || '/' || parts || ']' ELSE '' END, a::INT, z::INT, md5(body) FROM y""",
}
