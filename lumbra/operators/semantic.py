"""Symbol tables: relationships, declarations on a line, overlays over a base, supplements, imported symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbra.functions.paths import extension
from lumbra.functions.source import inferable
from lumbra.functions.text import slashes, split_lines

from .covering import best_covering
from .graph import DEFINITION
from .tables import tasks_for, written

ROLE_IMPORT, ROLE_WRITE, ROLE_READ = 4, 8, 16
#: Kind codes of imported symbols.
KINDS = {
    "Type": (7, 11, 21, 49, 54, 55, 59), "Method": (9, 17, 26, 66, 67, 68, 69, 70, 71, 76, 80), "Event": (13, 78), "Field": (15, 77, 79),
    "Property": (18, 41, 45, 47, 81), "Namespace": (29, 30, 35), "Parameter": (37, 38, 44, 52), "Local": (61, 82),
}


#: A text in tokens and what stands between them.
TOKENS = r"[\p{L}\p{Nd}_$-]+|[^\p{L}\p{Nd}_$-]+"
#: Words before a declared name, and ends of attributes that name things.
DECLARING = ("class", "interface", "enum", "struct", "record", "def", "function", "type", "namespace", "module", "const", "let", "var", "trait", "protocol")
NAMING = ('id="', 'name="', 'x:Name="', 'x:Key="')


def relationships(occurrences: DataFrame, edges: DataFrame, symbols: DataFrame, incoming: bool, kind: str | None = None) -> DataFrame:
    """Definitions of the symbols related to the given ones, with the kind of the relationship, once each. edges (source, target, kind)."""
    near, far = ("target", "source") if incoming else ("source", "target")
    own = edges if kind is None else edges.where(F.col("kind") == kind)
    related = own.join(symbols.select(F.col("symbol").alias(near)).distinct(), near, "left_semi").select(F.col(far).alias("symbol"), "kind").distinct()
    return occurrences.where(F.col("roles").bitwiseAND(DEFINITION) != 0).join(related, "symbol").distinct()


def resolved(occurrences: DataFrame, points: DataFrame) -> DataFrame:
    """(point_id, symbol, exact) for points (point_id, doc, line, col).

    The narrowest occurrence at the point; where there is none, the only symbol that the line declares, or the one declaration whose enclosing range holds all
    others of the line. occurrences: doc, sl, sc, el, ec, symbol, roles, enclosing (null or a struct of sl, sc, el, ec).
    """
    late = [-F.col("sl"), -F.col("sc"), F.col("el"), F.col("ec")]  # of nested ranges the one that begins last is the narrowest
    best = written(best_covering(occurrences, points, late, F.struct("symbol"), "symbol").select("point_id", "best.symbol"), "covering")  # swept once, read twice
    left = points.join(best.select("point_id"), "point_id", "left_anti")
    key = F.struct("sl", "sc", "el", "ec")
    declared = occurrences.where(F.col("roles").bitwiseAND(DEFINITION) != 0).groupBy("doc", F.col("sl").alias("line"), "symbol").agg(F.min_by(F.struct("sl", "sc", "el", "ec", "enclosing"), key).alias("d"))
    line = ["doc", "line"]
    wanted = declared.join(left.select(*line).distinct(), line, "left_semi")
    # A range holds all others of its line if it begins with or before the first of them and ends with or after the last.
    start, end, outer = F.struct("d.sl", "d.sc"), F.struct("d.el", "d.ec"), F.col("d.enclosing")
    order = Window.partitionBy(*line).orderBy("symbol")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    every = wanted.withColumn("first", F.least(F.min(start).over(before), F.min(start).over(after))).withColumn("last", F.greatest(F.max(end).over(before), F.max(end).over(after)))
    alone = F.col("first").isNull()
    begins = (outer["sl"] < F.col("first.sl")) | ((outer["sl"] == F.col("first.sl")) & (outer["sc"] <= F.col("first.sc")))
    ends = (outer["el"] > F.col("last.el")) | ((outer["el"] == F.col("last.el")) & (outer["ec"] >= F.col("last.ec")))
    sole = every.where(alone | (begins & ends)).groupBy(*line).agg(F.count("*").alias("k"), F.min("symbol").alias("symbol")).where("k = 1")
    return best.withColumn("exact", F.lit(True)).unionByName(left.join(sole, line).select("point_id", "symbol", F.lit(False).alias("exact")))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` that ``right`` lacks (side missing) and the other way round (side extra), once each."""
    n = tasks_for(left, right)
    both = left.withColumn("_left", F.lit(True)).unionByName(right.withColumn("_left", F.lit(False)))
    sides = both.repartition(n, *left.columns).groupBy(*left.columns).agg(F.min("_left").alias("_every"), F.max("_left").alias("_some"))
    return sides.where(F.col("_every") == F.col("_some")).select(*left.columns, F.when(F.col("_some"), "missing").otherwise("extra").alias("side"))


def replacement_problems(deleted: DataFrame, changed: DataFrame) -> DataFrame:
    """(doc, problem) of an overlay that is inconsistent: documents that are deleted twice, or deleted and changed. deleted and changed: doc; slashes don't tell paths apart."""
    gone = deleted.select(slashes(F.col("doc")).alias("doc")).groupBy("doc").agg(F.count("*").alias("n"))
    both = gone.select("doc").intersect(changed.select(slashes(F.col("doc")).alias("doc"))).withColumn("problem", F.lit("deleted_and_changed"))
    return both.unionByName(gone.where("n > 1").select("doc", F.lit("deleted_twice").alias("problem")))


def affected(base_docs: DataFrame, current_docs: DataFrame, base_occurrences: DataFrame, current_occurrences: DataFrame, dirty: DataFrame) -> DataFrame:
    """(doc, deleted) of documents that an overlay replaces: dirty ones, those whose hash differs or is on one side only, and those whose set of occurrences differs."""
    both = base_docs.select("doc", F.col("hash").alias("old")).join(current_docs.select("doc", F.col("hash").alias("new")), "doc", "full_outer")
    changed = both.where(~F.col("old").eqNullSafe(F.col("new"))).select("doc")
    moved = differences(base_occurrences, current_occurrences).select("doc")
    every = changed.union(moved).union(dirty.select("doc")).distinct()
    # Read by several steps of an overlay, so found once.
    return written(every.join(both, "doc").select("doc", F.col("new").isNull().alias("deleted")), "touched")


def overlay(base: dict[str, DataFrame], current: dict[str, DataFrame], dirty: DataFrame) -> dict[str, DataFrame]:
    """The slices of ``current`` (docs, symbols, occurrences, edges) that differ from ``base``, and ``touched`` (doc, deleted)."""
    touched = affected(base["docs"], current["docs"], base["occurrences"], current["occurrences"], dirty)
    docs = touched.select("doc")
    n = tasks_for(current["occurrences"])
    occurrences = current["occurrences"].repartition(n, "doc").join(docs.repartition(n, "doc"), "doc", "left_semi")
    impacted = base["occurrences"].join(docs, "doc", "left_semi").select("symbol").union(occurrences.select("symbol")).distinct()
    edges = _touching(current["edges"], impacted)
    wanted = occurrences.select("symbol").union(edges.select("source")).union(edges.select("target")).distinct()
    symbols = current["symbols"].withColumn("_p", F.lit(0)).unionByName(base["symbols"].withColumn("_p", F.lit(1))).join(wanted, "symbol", "left_semi")
    return {"touched": touched, "docs": current["docs"].join(docs, "doc", "left_semi"), "occurrences": occurrences, "edges": edges, "symbols": first_by(symbols, "symbol", "_p")}


def first_by(rows: DataFrame, key: str, priority: str) -> DataFrame:
    """One row for each key, that of the least priority; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (key, priority)]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(priority, *rest)).alias("_r")).select(key, *[F.col(f"_r.{c}") for c in rest])


def _touching(edges: DataFrame, symbols: DataFrame, how: str = "in") -> DataFrame:
    """Edges with an end among ``symbols`` (once each), or with none."""
    marked = symbols.select("symbol").distinct()
    hit = edges.join(marked.select(F.col("symbol").alias("source"), F.lit(True).alias("_a")), "source", "left").join(marked.select(F.col("symbol").alias("target"), F.lit(True).alias("_b")), "target", "left")
    touched = F.col("_a").isNotNull() | F.col("_b").isNotNull()
    return hit.where(touched if how == "in" else ~touched).select(*edges.columns)


def materialised(base: dict[str, DataFrame], layer: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Base and overlay as one index: what the overlay touches comes from it, and only symbols that something names stay."""
    touched = layer["touched"].select("doc")
    impacted = base["occurrences"].unionByName(layer["occurrences"]).join(touched, "doc", "left_semi").select("symbol")
    docs = base["docs"].join(touched, "doc", "left_anti").unionByName(layer["docs"])
    n = tasks_for(base["occurrences"])
    untouched = base["occurrences"].repartition(n, "doc").join(touched.repartition(n, "doc"), "doc", "left_anti")
    occurrences = untouched.unionByName(layer["occurrences"])
    edges = _touching(base["edges"], impacted, "out").unionByName(layer["edges"])
    wanted = occurrences.select("symbol").union(edges.select("source")).union(edges.select("target")).distinct()
    symbols = first_by(layer["symbols"].withColumn("_p", F.lit(0)).unionByName(base["symbols"].withColumn("_p", F.lit(1))), "symbol", "_p")
    return {"docs": docs, "occurrences": occurrences, "edges": edges, "symbols": symbols.join(wanted, "symbol", "left_semi")}


def supplemented(base: DataFrame, more: DataFrame, key: str, checked: str) -> DataFrame:
    """Rows of both, the base's first for each key; ``conflict`` where both have the key and their ``checked`` columns differ."""
    other = more.select(F.col(key), F.col(checked).alias("_other")).dropDuplicates([key])
    got = first_by(base.withColumn("_p", F.lit(0)).unionByName(more.withColumn("_p", F.lit(1))), key, "_p").join(other, key, "left")
    return got.withColumn("conflict", F.col("_other").isNotNull() & ~F.col("_other").eqNullSafe(F.col(checked))).drop("_other")


def imported_roles(code: Column) -> Column:
    role = F.when(code.bitwiseAND(1) != 0, 1).otherwise(2)
    for bit, own in ((2, ROLE_IMPORT), (4, ROLE_WRITE), (8, ROLE_READ)):
        role = role + F.when(code.bitwiseAND(bit) != 0, own).otherwise(0)
    return role


def imported_kind(code: Column) -> Column:
    out = None
    for name, codes in KINDS.items():
        out = F.when(code.isin(*codes), name) if out is None else out.when(code.isin(*codes), name)
    return out.otherwise("Unknown")


def imported_symbol(symbol: Column, doc: Column) -> Column:
    """A local symbol gets its document's name; a global one needs a scheme, a manager, a package and a version (two blanks stand for one) before its own name. Null if it isn't valid."""
    part = r"(?:[^ ]|  )+ (?! )"
    whole = symbol.rlike(f"^(?!local){part}{part}{part}{part}.*\\S")
    local = F.substr(symbol, F.lit(7))
    good_local = symbol.startswith("local ") & (local != "") & ~local.rlike(r"[\s\p{Cc}]") & doc.isNotNull()
    return F.when(good_local, F.concat(F.lit("scip-local "), doc, F.lit(" "), local)).when(~symbol.startswith("local ") & whole, symbol)


def unambiguous(uses: DataFrame, resources: DataFrame) -> DataFrame:
    """(use columns, doc) of uses (.., key) whose key one document alone defines; null where several or none do. resources (key, doc)."""
    by = resources.groupBy("key").agg(F.count_distinct("doc").alias("n"), F.min("doc").alias("defined_in"))
    return uses.join(by, "key", "left").withColumn("defined_in", F.when(F.col("n") == 1, F.col("defined_in"))).drop("n")


def located(occurrences: DataFrame, most: int) -> DataFrame:
    """The first ``most`` places by document, start and end."""
    return occurrences.orderBy("doc", "sl", "sc", "el", "ec", "symbol").limit(most)


def imported_range(numbers: Column) -> Column:
    """struct(sl, sc, el, ec) of an imported range of four numbers, or of three on one line; null if it isn't one or ends before it starts."""
    n = F.size(numbers)
    four = F.when(n == 4, numbers).when(n == 3, F.array(F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1)), F.get(numbers, F.lit(0)), F.get(numbers, F.lit(2))))
    at = [F.get(four, F.lit(k)) for k in range(4)]
    good = F.forall(four, lambda x: x >= 0) & ((at[2] > at[0]) | ((at[2] == at[0]) & (at[3] >= at[1])))
    return F.when(good, F.struct(*[a.alias(c) for a, c in zip(at, ("sl", "sc", "el", "ec"), strict=True)]))


def definition_catalogue(occurrences: DataFrame) -> DataFrame:
    """Definitions (doc, symbol, sl, sc, enclosing) that chunks can be cut along: with a body, or of a kind whose extent can be inferred. Equal paths but for their slashes are one document."""
    own = occurrences.where(F.col("roles").bitwiseAND(DEFINITION) != 0)
    return own.where(F.col("enclosing").isNotNull() | inferable(F.col("symbol"))).select(slashes(F.col("doc")).alias("doc"), "symbol", "sl", "sc", "enclosing")


def tokens_of(lines: DataFrame, name: str | None = None) -> DataFrame:
    """lines (doc, line, body) by ``TOKENS``: (doc, line, body, k, piece, all), of the pieces that are ``name`` if it is given. Each row holds its whole line, so the others are left out before there are rows."""
    pieces = F.regexp_extract_all("body", F.lit(TOKENS), F.lit(0))
    rows = lines.select("doc", "line", "body", pieces.alias("all"))
    if name is None:
        return rows.select("doc", "line", "body", "all", F.posexplode("all").alias("k", "piece"))
    places = F.filter(F.transform("all", lambda x, k: F.when(x == name, k)), lambda k: k.isNotNull())
    return rows.select("doc", "line", "body", "all", F.explode(places).alias("k")).withColumn("piece", F.lit(name))


def declares_before(found: DataFrame) -> DataFrame:
    """Pieces of ``tokens_of`` with ``col`` and ``declares``: a declaring word or an attribute that names things stands before the piece, or, by the file's kind, a selector's sign before
    or a colon after it."""
    found = found.withColumn("before", F.array_join(F.slice("all", 1, F.col("k")), ""))
    # No declaring word or sign is longer than what is left of the tail, so of a long line only the tail is read, unless it is all signs and blanks.
    tail = F.substr("before", F.greatest(F.length("before") - 199, F.lit(1)), F.lit(200))
    near = F.when(tail.rlike(r"[^\s(){}\[\]:;,=][\s(){}\[\]:;,=]{0,150}$"), tail).otherwise(F.col("before"))
    found = found.withColumn("_near", near)
    word = F.regexp_extract("_near", r"([^ \t(){}\[\]:;,=]+)[ \t(){}\[\]:;,=]*$", 1)
    compact, after = F.regexp_replace("_near", r"\s+$", ""), F.regexp_replace(F.substr("body", F.length("before") + F.length("piece") + 1), r'^\s*"?\s*', "")
    ends = F.lit(False)
    for lead in NAMING:
        ends = ends | F.lower(compact).endswith(lead.lower())
    kind = extension(F.col("doc"))
    declares = F.lower(word).isin(*DECLARING) | ends | ((kind == ".css") & (compact.endswith(".") | compact.endswith("#"))) | (kind.isin(".yaml", ".yml", ".json") & after.startswith(":"))
    return found.withColumn("col", F.length("before")).withColumn("declares", declares).drop("_near")


def token_positions(files: DataFrame, name: str) -> DataFrame:
    """(doc, line, col, declares) of every whole-token occurrence of ``name`` in files (doc, text), by text alone. Letters, digits, ``_``, ``$`` and ``-`` make tokens."""
    lines = files.select("doc", F.posexplode(split_lines(F.col("text"))).alias("line", "body")).where(F.contains("body", F.lit(name)))
    return declares_before(tokens_of(lines, name)).select("doc", "line", "col", "declares")


def live_documents(snapshot: DataFrame, opened: DataFrame) -> DataFrame:
    """snapshot (doc, text) with the newest version of each open document (doc, version, text) in its place; ``stale`` says that a version was sent after a newer one.

    opened has ``sequence``, the order in which versions were sent.
    """
    top = Window.partitionBy("doc").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    late = opened.withColumn("_late", F.coalesce(F.col("version") <= F.max("version").over(top), F.lit(False)))
    live = late.groupBy("doc").agg(F.max_by("text", "version").alias("live"), F.max("version").alias("version"), F.bool_or("_late").alias("stale"))
    return snapshot.join(live, "doc", "full_outer").select("doc", F.coalesce("live", "text").alias("text"), "version", F.coalesce("stale", F.lit(False)).alias("stale"))
