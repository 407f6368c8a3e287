"""Text functions as Column expressions: newlines, hashes, query terms, lexical tiers, token estimates, validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that a query never searches for.
STOP_WORDS = (
    "the", "and", "for", "with", "that", "this", "from", "where", "which", "what", "when",
    "how", "does", "did", "are", "was", "were", "has", "have", "into", "out", "any", "all",
    "код", "где", "как", "что", "для", "это", "при", "или", "если", "файл", "класс", "метод",
)

# Characters at most, and the context that is enough for them.
CONTEXT_TIERS = ((4_000, 2048), (12_000, 4096), (24_000, 8192), (48_000, 16384), (96_000, 32768), (192_000, 65536), (384_000, 131072))
LARGEST_CONTEXT = 262144


def line_feeds(text: Column) -> Column:
    """Any of CRLF, CR and LF becomes LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def canonical_text(text: Column) -> Column:
    """Any of CRLF, CR and LF becomes CRLF."""
    return F.replace(line_feeds(text), F.lit("\n"), F.lit("\r\n"))


def canonical_hash(text: Column) -> Column:
    return F.sha2(canonical_text(text), 256)


def split_lines(text: Column) -> Column:
    return F.split(line_feeds(text), "\n", -1)


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def blank(text: Column) -> Column:
    """Null, or nothing but white space: blanks, tabs, line ends."""
    return ~F.coalesce(text.rlike(r"\S"), F.lit(False))


def units(text: Column) -> Column:
    """Length in UTF-16 code units: a character above U+FFFF counts as two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def left_units(text: Column, most: int | Column) -> Column:
    """The beginning of a text of at most ``most`` UTF-16 code units, never half a character."""
    most = F.lit(most) if isinstance(most, int) else most
    whole = F.encode(text, "UTF-16BE")
    cut = F.substr(whole, F.lit(1), 2 * most)
    broken = F.hex(F.substr(cut, F.octet_length(cut) - 1, F.lit(1))).between("D8", "DB")  # the first half of a pair
    some = F.decode(F.substr(whole, F.lit(1), 2 * most - F.when(broken, 2).otherwise(0)), "UTF-16BE")
    return F.when(units(text) <= most, text).when(units(text) == F.length(text), F.left(text, most)).otherwise(some)


def collapse(text: Column, most: int) -> Column:
    """Trimmed non-empty lines joined with blanks, cut at ``most`` UTF-16 code units."""
    lines = F.filter(F.transform(split_lines(text), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return left_units(F.array_join(lines, " "), most)


def camel_pieces(word: Column) -> Column:
    """Pieces of a word cut before each upper-case letter that follows another kind; none if there is no such place."""
    got = F.split(word, r"(?<=[^\p{Lu}])(?=\p{Lu})", -1)
    return F.when(F.size(got) > 1, got).otherwise(F.array().cast("array<string>"))


def query_terms(query: Column) -> Column:
    """Distinct lower-cased terms: words, their parts between underscores and the parts' camel pieces, of 3 letters at least and not stop words."""
    words = F.filter(F.split(query, r"[^\p{L}\p{Nd}_]+"), lambda x: x != "")
    parts = F.transform(words, lambda w: F.filter(F.split(w, "_"), lambda x: x != ""))
    every = F.flatten(F.zip_with(words, parts, lambda w, p: F.concat(F.array(w), p, F.flatten(F.transform(p, camel_pieces)))))
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.lower(x)), lambda x: (F.length(x) >= 3) & ~x.isin(*STOP_WORDS)))


def lexical_score(terms: list[str], symbol: Column, signature: Column, body: Column, path: Column) -> Column:
    """Sum over terms of the first tier that holds the term: symbol 3, signature 2, body 1, path 1."""
    lowered = [(F.lower(c), w) for c, w in ((symbol, 3.0), (signature, 2.0), (body, 1.0), (slashes(path), 1.0))]
    total = F.lit(0.0)
    for term in terms:
        tier = None
        for column, weight in lowered:
            hit = column.contains(term.lower())
            tier = F.when(hit, F.lit(weight)) if tier is None else tier.when(hit, F.lit(weight))
        total = total + tier.otherwise(0.0)
    return total


def token_estimate(text: Column) -> Column:
    """ceil(length / (4.0 (1 - s) + 2.2 s)) with s the Cyrillic share of the letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    cyrillic = F.length(F.regexp_replace(text, r"[^Ѐ-ӿ]", ""))
    share = F.when(letters > 0, cyrillic / letters).otherwise(0.0)
    return F.ceil(F.length(text) / (4.0 * (1 - share) + 2.2 * share)).cast("long")


def token_bounds(characters: Column) -> Column:
    """struct(point, lower, upper): a quarter, a sixth and a third of the characters, rounded up."""
    return F.struct(*[F.ceil(characters / d).cast("long").alias(n) for n, d in (("point", 4), ("lower", 6), ("upper", 3))])


def context_tier(characters: Column) -> Column:
    out = None
    for most, context in CONTEXT_TIERS:
        out = F.when(characters <= most, context) if out is None else out.when(characters <= most, context)
    return out.otherwise(LARGEST_CONTEXT)


def clamp_head_tail(text: Column, most: int = 720_000) -> Column:
    """Texts over ``most`` characters keep the first sixth and the last five sixths of it, and say how many are left out between."""
    head, n = most // 6, F.length(text)
    told = F.concat(F.lit("\n\n[... "), (n - most).cast("string"), F.lit(" characters omitted from the middle ...]\n\n"))
    return F.when(n > most, F.concat(F.left(text, F.lit(head)), told, F.right(text, F.lit(most - head)))).otherwise(text)


def diagnostic_shape(message: Column) -> Column:
    """The message without what stands in single quotes; unchanged if a quote is left open."""
    quotes = F.length(message) - F.length(F.replace(message, F.lit("'")))
    return F.when(quotes % 2 == 0, F.regexp_replace(message, "'[^']*'", "''")).otherwise(message)


def plain_check(source: Column, translated: Column, leak_marks: tuple[str, ...]) -> Column:
    """The first failing check of a plain translation: empty, fence, leak or length; else ok."""
    leak = F.lit(False)
    for mark in leak_marks:
        leak = leak | F.lower(translated).contains(mark.lower())
    return (
        F.when(blank(translated), "empty")
        .when(translated.contains("```") & ~source.contains("```"), "fence")
        .when(leak, "leak").when(F.length(translated) > F.greatest(F.lit(64), F.length(source) * 8), "length").otherwise("ok")
    )
