"""Syntactic chunks of C#-like sources, found from the text alone.

Comments, strings and marks of structure are told apart by one regular expression over the bytes of a batch of texts. Depth, line and place are sums over these bytes. A statement is what stands
between two of ``{``, ``}`` and ``;`` outside parentheses; the block that holds it is the last one that was opened one level up. Kinds of named statements (namespaces, types) decide which others can be
members; their heads, and nothing else, leave the batch, and what they declare is read by SQL expressions. Texts are not shuffled to be cut; what stands in bodies of members can declare nothing and stays there.

Fixed limits: interpolated strings that hold quotes inside their holes are read as ending there; attributes are part of a declaration's lines, not of its signature.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbra.functions.text import collapse, split_lines

from . import definitions
from .chunks import MOST_CHARS

TAKEN = "array<struct<kind: string, path: string, signature: string, namespace: string, first: int, last: int, whole: string, header: string, own: string>>"
STEP, STEP_BYTES = 4096, 250_000  # texts and their bytes that are summed at once, so that they stay in a core's cache; a longer text is alone
MOST_SIGNATURE, MOST_SUMMARY, MOST_VALUE, LONG_EXPRESSION, MARKED = 400, 200, 120, 80, 500
_PLAIN, _VERBATIM = rb'[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"', rb'"[^"]*+(?:""[^"]*+)*+"'
#: Comments, raw, verbatim and plain strings and characters; a lone ``#`` counts as a comment.
MARK = re.compile(
    rb"[/#\"'$@](?:(?<=/)(?:/[^\n]*+|\*.*?(?:\*/|\Z))|(?<=#)|(?<=\")(?:\"\"+.*?\"\"\"+|" + _PLAIN + rb")|(?<=\$)(?:\$*\"\"\"+.*?\"\"\"+|@" + _VERBATIM + rb'|"' + _PLAIN + rb")|(?<=@)\$?" + _VERBATIM
    + rb"|(?<=')(?:\\[^\n'][^'\n]*+|\\'|[^'\\\n\x80-\xff]|[\xc0-\xff][\x80-\xbf]{1,3})')", re.S
)
DIRECTIVE = re.compile(rb"^[ \t]{0,99}(#[^\n]*)|" + MARK.pattern, re.S | re.M)
WORDS = ("class", "interface", "struct", "enum", "record", "namespace")
NAMESPACE = r"^namespace\s+([\w.]+)"
#: As Java reads them: words and blanks in ASCII, their bounds in Unicode.
_SPACE = re.compile(NAMESPACE, re.A)
_TYPE = re.compile(r"^[^({=:]*?\b(class|interface|struct|enum|record(?:[ \t-\r]+(?:class|struct))?)[ \t-\r]+(@?[A-Za-z0-9_]+)")
_ENUM = re.compile(r"^[^({=:]*?\benum[ \t-\r]")
_FILLED = re.compile(r"^[^(=]*=(?!>)")
_ATTRIBUTES, _BLANKS, _ENDED = re.compile(r"^(?:\[[^\]]*\]\s*)+", re.A), re.compile(r"\s+", re.A), re.compile(r"\s*[{;]$", re.A)
METHOD = r"^[^(=\[]*?(~?@?\w+)\s*(?:<[^(]*>)?\s*\("
OPERATOR = r"^[^(]*?\boperator\s+([^\s(]+)\s*\("

#: What a text declares: ``type`` and ``namespace`` hold it, ``head`` is on one line (but for values), ``filled`` says that an initialiser's block follows it, ``accessors`` are heads in its own block, and one is ``bodied``.
NAMED = "what string, name string, head string, sign string, filled boolean, bodied boolean, first int, last int"
ENTRY = NAMED + ", type string, namespace string, accessors array<string>, note string, text string"
WHAT = ("Namespace", "Type", "Enum", "Member", "Value", "File")
#: Heads of methods for sure, whatever stands before or behind: their blocks list nothing.
CALLED, NO_CALL = r"^[\w\s<>,.?]*\w\s*\(", "delegate|event"
_OPEN, _CLOSE, _END = b"{};"


def _table(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


_STRUCTURE, _BOUND, _NOTED, _BLANK, _SINGLE = map(_table, (b"{};()", b"{};", b"/#", b" \t\n\v\f\r", b"/#\"'@${};()"))


def _covered(size: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``size`` bytes are in one of the ranges, which don't meet."""
    step = np.zeros(size + 1, np.int8)
    step[begin] += 1
    step[end] -= 1
    return np.cumsum(step[:-1], dtype=np.int8).astype(bool)


def _marks(raw: bytes, off: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """The beginnings and ends of comments and strings of texts; directives are asked for in those with a ``#`` alone."""
    at: list[int] = []
    for a, b, directives in zip(off[:-1].tolist(), off[1:].tolist(), hashed.tolist(), strict=True):
        if directives:
            at += [a + x for m in DIRECTIVE.finditer(raw[a:b]) for x in (m.span(1) if m.lastindex else m.span())]
        else:
            at += [x for m in MARK.finditer(raw, a, b) for x in m.span()]
    return np.array(at, np.int64).reshape(-1, 2)


class Statements:
    """The statements of texts in order, as columns: ``text``, ``depth``, ``head`` without comments, ``end`` (its last sign of structure, or 0), ``start`` and ``stop`` (bytes), ``first`` and ``last`` (lines).

    Depth and line are those of the last token and of the first one that isn't a comment, a directive or blank; what is blank or comments only is no statement.
    """

    def __init__(self, texts: pa.Array):
        off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        self.raw, off = data.tobytes(), off - off[0]
        hashes = np.flatnonzero(data == ord("#"))
        marks = _marks(self.raw, off, np.diff(np.searchsorted(hashes, off)) > 0)
        begin, end = marks[:, 0], marks[:, 1]
        noted = _NOTED[data[begin]]
        inside, comment = _covered(len(data), begin, end), _covered(len(data), begin[noted], end[noted])
        at = np.flatnonzero(_STRUCTURE[data] & ~inside)
        sign, lines = data[at], np.flatnonzero(data == ord("\n"))

        def summed(up: str, down: str):
            sums = np.append(0, np.cumsum((sign == ord(up)).astype(np.int64) - (sign == ord(down))))
            return lambda text, p: sums[np.searchsorted(at, p)] - sums[np.searchsorted(at, off[text])]

        text = np.searchsorted(off, at, "right") - 1
        bound, cut = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        bound[at[_BOUND[sign] & (summed("(", ")")(text, at) <= 0)] + 1] = True
        cut[off[1:]] = True
        stop = np.flatnonzero((bound | cut)[1:]) + 1
        start, code = np.append(0, stop)[: len(stop)], ~comment
        loud = np.append(np.flatnonzero(code & ~_BLANK[data]), len(data))
        heads = pa.StringArray.from_buffers(len(stop), pa.py_buffer(np.append(0, np.cumsum(code, dtype=np.int32)[stop - 1]).astype(np.int32)), pa.py_buffer(data[code]))
        first = loud[np.searchsorted(loud, start)]
        there = first < stop
        start, first, stop, text = start[there], first[there], stop[there], np.searchsorted(off, start[there], "right") - 1
        last = stop - 1
        rest = np.flatnonzero(~bound[stop])
        if len(rest):  # what no sign ends, up to the end of its text: where its last token begins
            single, own = np.append(-1, np.flatnonzero(_SINGLE[data] & ~inside)), off[text[rest]]
            whole = inside[last[rest]]
            before = single[np.searchsorted(single, stop[rest]) - 1]
            so_far = np.append(0, end)[np.searchsorted(end, stop[rest], "right")]
            filler = np.where(before == last[rest], before, np.maximum(np.maximum(before + 1, so_far), own))
            last[rest] = np.where(whole, np.append(begin, 0)[np.minimum(np.searchsorted(end, stop[rest]), len(begin))], filler)
        line = lambda p: np.searchsorted(lines, p) - np.searchsorted(lines, off[text]) + 1
        ends = data[stop - 1]
        self.text, self.depth, self.head = text, summed("{", "}")(text, last), pc.ascii_ltrim_whitespace(heads.filter(pa.array(there)))
        self.end = np.where(_BOUND[ends] & ~inside[stop - 1], ends, 0)
        self.start, self.stop, self.first, self.last, self.off = first, stop, line(first), line(last), off
        self._from, self._comments = start, marks[noted]
        self._nest()

    def notes(self, k: np.ndarray) -> list[str]:
        """The documentation before the statements: its lines that aren't blank."""
        spans = [(x, y) for x, y in self._comments.tolist() if self.raw.startswith((b"///", b"/**"), x, y)]
        begins, told = np.array([x for x, _ in spans], np.int64), [self.raw[x:y].decode() for x, y in spans]
        a, b = (np.searchsorted(begins, p[k]).tolist() for p in (self._from, self.start))
        return ["\n".join(x.strip() for n in told[i:j] for x in n.split("\n") if x.strip()) if i < j else "" for i, j in zip(a, b, strict=True)]

    def _nest(self) -> None:
        """By their places: ``holder``, the statement that opened the block they are in (-1: none); ``previous`` and ``following`` in the same block; ``close`` of the block that they open; whether they are ``named``, as only types and namespaces are, and ``told``.

        Told are those in no block or in that of a named one, the named ones, and what is in the blocks of all these, where it can list accessors. The others are in bodies and declare nothing.
        """
        n, text, depth = len(self.text), self.text, self.depth
        opened, ends = self.end == _OPEN, self.end == _CLOSE

        def has(some: np.ndarray, pattern: str) -> np.ndarray:
            found = some.copy()
            found[some] = np.asarray(pc.match_substring_regex(self.head.filter(pa.array(some)), pattern))
            return found

        named = has(~ends, "|".join(WORDS))
        # A statement that a brace ends stands inside the block that the brace closes.
        opens = np.flatnonzero(opened)
        who, level, opening = np.append(np.arange(n), opens), np.append(depth, depth[opens] + 1), np.repeat([False, True], [n, len(opens)])
        order, begin, end = _runs(text[who], level, who)
        who, opening, place = who[order], opening[order], np.arange(len(order))
        before = np.maximum.accumulate(np.where(opening, place, -1))
        behind = np.minimum.accumulate(np.where(~opening & ends[who], place, len(order))[::-1])[::-1]
        holder, close = np.full(n, -1), np.full(n, -1)
        holder[who[~opening]] = np.where(before >= begin, who[before], -1)[~opening]
        close[who[opening]] = np.where(behind < end, np.append(who, -1)[behind], -1)[opening]
        order, begin, end = _runs(text, holder, np.arange(n))
        place, previous, following = np.arange(n), np.full(n, -1), np.full(n, -1)
        previous[order], following[order] = np.where(place > begin, order[place - 1], -1), np.where(place + 1 < end, np.append(order, -1)[place + 1], -1)
        asked = named | (holder < 0) | named[holder]
        called = has(asked & opened, CALLED)
        self.told = asked | ((asked & ~(called & ~has(called, NO_CALL)))[holder] & (holder >= 0))
        self.holder, self.previous, self.following, self.close, self.named = holder, previous, following, close, named


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by keys (first one first), and the first place of each place's run of equal keys (all but the last key) and the one behind it."""
    order = np.lexsort(keys[::-1])
    new = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys[:-1]], axis=0))[: len(order)]
    begins = np.flatnonzero(new)
    many = np.diff(np.append(begins, len(order)))
    return order, np.repeat(begins, many), np.repeat(begins + many, many)


def _bare(head: str) -> str:
    return _ATTRIBUTES.sub("", head) if head.startswith("[") else head


def _changed(heads: pa.Array, which, how) -> pa.Array:
    """Heads with the few to which ``which`` applies changed one by one."""
    return pc.replace_with_mask(heads, which, pa.array([how(h) for h in heads.filter(which).to_pylist()], pa.string())) if pc.any(which).as_py() else heads


def one_line(heads: pa.Array, end: np.ndarray) -> pa.Array:
    """Heads without attributes and what ends them, each on one line."""
    bare = _changed(heads, pc.starts_with(heads, "["), _bare)
    bare = pc.if_else(pa.array(_BOUND[end] & (end != _CLOSE)), pc.ascii_rtrim_whitespace(pc.utf8_slice_codeunits(bare, 0, -1)), bare)
    bare = _changed(bare, pa.array(end == 0), lambda h: _ENDED.sub("", h))
    return pc.utf8_trim(_changed(bare, pc.match_substring_regex(bare, r"[\s\v][\s\v]|[\t\n\v\f\r]"), lambda h: _BLANKS.sub(" ", h)), " ")


def _short(raw: bytes) -> str:
    """The beginning of ``collapse``: what stands in the first lines, a little more than is asked for."""
    out, size = [], 0
    for m in re.finditer(rb"[^\n]+", raw):
        out.append(m[0].decode())
        size += len(m[0].strip(b" \t\v\f\r").decode())
        if size > MOST_SUMMARY * 2:
            break
    return "\n".join(out)


def _above(s: Statements, kind: np.ndarray, name: dict[int, str]) -> tuple[np.ndarray, list[str], list[str | None]]:
    """The named statements that open a block, with the path of types and the namespace that hold what is in it."""
    n = len(s.text)
    paths, spaces, held, now, kinds = [], [], [], -1, dict(zip(name, kind[list(name)].tolist(), strict=True))
    until = np.where(s.close >= 0, s.close, np.arange(n))
    of = np.flatnonzero((s.end == _OPEN) & s.named)
    for k, text, end in zip(of.tolist(), s.text[of].tolist(), until[of].tolist(), strict=True):
        held = [p for p in held if p[1] >= k] if now == text else []
        chain = [*[p for p, e in held if e >= end], k]
        now = text
        paths.append(".".join([name[p] for p in chain if kinds.get(p, 0) > 1]))
        spaces.append(next((name[p] for p in reversed(chain) if kinds.get(p) == 1), None))
        held.append((k, end))
    return of, paths, spaces


def declared(s: Statements, whole: bool) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    """The places of all statements that may be declarations, of the types that hold them (-1: none), and their ``NAMED``, or ``ENTRY`` if they are to be ``whole``."""
    n, opened = len(s.text), s.end == _OPEN
    kind, name, first_space = np.zeros(n, np.int8), {}, {}  # 1: namespace, 2: type, 3: enum
    for k, told in zip(np.flatnonzero(s.named).tolist(), one_line(s.head.filter(pa.array(s.named)), s.end[s.named]).to_pylist(), strict=True):
        if m := _SPACE.match(told):
            kind[k], name[k] = 1, m[1]
            first_space.setdefault(int(s.text[k]), m[1])
        elif m := _TYPE.match(told):
            kind[k], name[k] = 3 if _ENUM.match(told) else 2, m[2]
    outside = (s.holder < 0) | (kind[s.holder] != 0)  # what stands there may be a declaration
    held_by = np.where(s.holder >= 0, kind[s.holder], 0) if n else kind
    # What follows an initialiser's block, up to its end, belongs to it.
    filled = outside & opened
    filled[filled] = np.asarray(pc.match_substring_regex(s.head.filter(pa.array(filled)), r"^(?:\[|[^(=]*=)"))
    filled[filled] = [bool(_FILLED.match(_bare(h))) for h in s.head.filter(pa.array(filled)).to_pylist()]
    tail = filled[s.previous] & (s.previous >= 0) if n else filled
    # The values of an enum are one statement, up to the brace that closes it.
    code = np.select([kind > 1, (held_by == 2) & (kind == 0) & (s.end != _CLOSE), (held_by == 3) & (s.end == _CLOSE)], [kind - 1, 3, 4], 0)
    at = np.flatnonzero(outside & ~tail & (code > 0))
    code, last = code[at], np.where(opened & (s.close >= 0), s.close, np.arange(n))
    last = np.where(filled & (s.following >= 0), s.following, last)[at]
    holder, own = s.holder[at], np.zeros(n, bool)
    own[at[code == 3]] = True
    # Of a member's own block only accessors are asked for.
    inner = np.flatnonzero(s.told & (s.holder >= 0) & (kind == 0) & ((s.end == _OPEN) | (s.end == _END)) & own[s.holder]) if n else at
    bodied = np.bincount(s.holder[inner[opened[inner]]], minlength=n)[at] > 0
    head = s.head.take(pa.array(at))
    known = lambda places, some, values: pa.array(values, pa.string()).take(pa.array(p := np.searchsorted(some, places), mask=np.append(some, -2)[p] != places))  # noqa: E731; null elsewhere
    columns = [
        pa.array(WHAT).take(pa.array(code)), known(at, np.array(list(name), np.int64), list(name.values())), pc.if_else(pa.array(code == 4), head, one_line(head, s.end[at])),
        pa.array(["{", "}", ";", ""]).take(pa.array(np.select([s.end[at] == x for x in b"{};"], [0, 1, 2], 3))), pa.array(filled[at]), pa.array(bodied), pa.array(s.first[at], pa.int32()), pa.array(s.last[last], pa.int32()),
    ]
    if whole:
        of, paths, spaces = _above(s, kind, name)
        space = pc.coalesce(known(holder, of, spaces), known(s.text[at], np.array(list(first_space), np.int64), list(first_space.values())), pa.scalar(""))
        inner = inner[np.argsort(s.holder[inner], kind="stable")]
        many = np.bincount(s.holder[inner], minlength=n)[at]
        accessors = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), one_line(s.head.take(pa.array(inner)), s.end[inner]))
        parts = zip(code.tolist(), held_by[at].tolist(), s.start[at].tolist(), s.stop[last].tolist(), strict=True)
        texts = [s.raw[a:b] if c == 3 else _short(s.raw[a:b]) if c < 3 and h > 1 else None for c, h, a, b in parts]
        columns += [known(holder, of, paths).fill_null(""), space, accessors, pa.array(s.notes(at), pa.string()), pa.array(texts, pa.string())]
    return at, np.where(held_by[at] > 1, holder, -1), pa.StructArray.from_arrays(columns, names=_names(ENTRY if whole else NAMED))


def _names(fields: str) -> list[str]:
    return [f.split(" ", 1)[0] for f in fields.split(", ")]


def _structs(fields: str) -> str:
    return f"struct<{', '.join(f.replace(' ', ': ', 1) for f in fields.split(', '))}>"


def _steps(batches, most: int, size: int):
    """(doc, texts with line feeds alone) of batches in steps of ``most`` texts and about ``size`` bytes at most."""
    for batch in batches:
        texts = batch.column(1).cast(pa.string())
        if pc.any(pc.match_substring(texts, "\r")).as_py():
            texts = pc.replace_substring(pc.replace_substring(texts, "\r\n", "\n"), "\r", "\n")
        sizes, at = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64)), 0
        while at < len(texts):
            until = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size, "right"))
            many = max(1, min(until - at, most))
            yield batch.column(0).slice(at, many), texts.slice(at, many)
            at += many


def _cut(files: DataFrame, rows, **columns: str) -> DataFrame:
    """Rows (doc and ``columns``) that ``rows`` gives, as the places of texts and the values, for the texts of each step."""
    kind, most, size = files.schema["doc"].dataType.simpleString(), STEP, STEP_BYTES

    def cut(batches):
        for doc, texts in _steps(batches, most, size):
            text, values = rows(texts)
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(text, pa.int64())), *values], names=["doc", *columns])

    return files.select("doc", "text").mapInArrow(cut, ", ".join(f"{n} {t}" for n, t in {"doc": kind, **columns}.items()))


def statements(files: DataFrame) -> DataFrame:
    """Files (doc, text) as ``statements``, an array of those that are told in order (head, first, last, end)."""

    def rows(texts: pa.Array):
        s = Statements(texts)
        told = pa.array(s.told)
        signs = pa.array([chr(e) if e else "" for e in s.end.tolist()], pa.string())
        found = pa.StructArray.from_arrays([s.head.filter(told), pa.array(s.first, pa.int32()).filter(told), pa.array(s.last, pa.int32()).filter(told), signs.filter(told)], names=["head", "first", "last", "end"])
        ends = np.searchsorted(s.text[s.told], np.arange(len(texts) + 1))
        return np.arange(len(texts)), [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)]

    return _cut(files, rows, statements=f"array<{_structs('head string, first int, last int, end string')}>")


def entries(files: DataFrame) -> DataFrame:
    """Files (doc, text) as rows (doc, ``NAMED``) of what may be a declaration in them. What one text tells stays with it, so nothing is shuffled."""

    def rows(texts: pa.Array):
        s = Statements(texts)
        at, _, found = declared(s, False)
        return s.text[at], found.flatten()

    return _cut(files, rows, **dict(f.split(" ", 1) for f in NAMED.split(", ")))


def types(files: DataFrame) -> DataFrame:
    """Files (doc, text) as rows (doc, own, members): a type's ``ENTRY`` (null if it is no declaration itself) and those in its block, in order; and a whole file where there is no type."""

    def rows(texts: pa.Array):
        s = Statements(texts)
        at, holder, found = declared(s, True)
        of_type = np.asarray(pc.is_in(found.field("what"), pa.array(["Type", "Enum"])))
        every = np.unique(np.append(at[of_type], holder[holder >= 0]))
        place = np.searchsorted(at, every)
        own = found.take(pa.array(place, mask=np.append(at, -1)[place] != every))
        order = np.flatnonzero(holder >= 0)
        order = order[np.argsort(holder[order], kind="stable")]
        ends = np.append(np.searchsorted(holder[order], every), len(order))
        alone = np.setdiff1d(np.arange(len(texts)), s.text[at[of_type]])
        text, none = texts.take(pa.array(alone)), pa.nulls(len(alone))
        files = [pa.array(["File"] * len(alone), pa.string()) if f.name == "what" else text if f.name == "text" else none.cast(f.type) for f in found.type]
        own = pa.concat_arrays([own, pa.StructArray.from_arrays(files, fields=list(found.type))])
        members = pa.ListArray.from_arrays(pa.array(np.append(ends, np.repeat(len(order), len(alone))), pa.int32()), found.take(pa.array(order)))
        return np.append(s.text[every], alone), [own, members]

    return _cut(files, rows, own=_structs(ENTRY), members=f"array<{_structs(ENTRY)}>")


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used and wherever a plan is folded."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _if_has(text: Column, words: tuple[str, ...], found: Column, otherwise: Column) -> Column:
    """``found`` of texts that hold one of the words, which a regular expression needs; the others aren't read for it."""
    there = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        there = there | F.contains(text, F.lit(w))
    return F.when(there, found).otherwise(otherwise)


def heads_of(told: Column) -> Column:
    """What the regular expressions of a member's head tell, once."""
    no, none = F.lit(False), F.lit("")
    no_call = _if_has(told, ("delegate", "event"), told.rlike(r"^[^(]*?\b(?:delegate|event)\s"), no)
    method = _if_has(told, ("(",), F.regexp_extract(told, METHOD, 1), none)
    operator = _if_has(told, ("operator",), F.regexp_extract(told, OPERATOR, 1), none)
    indexer = _if_has(told, ("this",), told.rlike(r"^[^(=]*?\bthis\s*\["), no)
    arrow = _if_has(told, ("=>",), F.regexp_extract(told, r"^[^(=]*?=>\s*(.*)$", 1), none)
    event = _if_has(told, ("event",), told.rlike(r"\bevent\s"), no)
    return F.struct(method.alias("method"), no_call.alias("no_call"), operator.alias("operator"), indexer.alias("indexer"), arrow.alias("arrow"), event.alias("event"))


def _called(h: Column) -> Column:
    return (h["method"] != "") & ~h["no_call"]


def _parts(y: Column, h: Column) -> tuple[Column, Column, Column]:
    """Whether a member is one with a list of parameters, a property, and one with a block of accessors."""
    called = _called(h) | (h["operator"] != "")
    braces = (y["sign"] == "{") & ~y["filled"] & ~called & ~h["indexer"]
    return called, (braces | (h["arrow"] != "")) & ~h["event"], braces


def own_of(y: Column, h: Column) -> Column:
    """Whether a member has a chunk of its own: methods, constructors, operators and indexers, and properties with a long expression or with an accessor that has a body."""
    called, prop, _ = _parts(y, h)
    return called | h["indexer"] | (prop & F.when(h["arrow"] != "", F.length(h["arrow"]) > LONG_EXPRESSION).otherwise(y["bodied"]))


def name_of(told: Column, h: Column) -> Column:
    return F.when(h["operator"] != "", F.concat(F.lit("operator "), h["operator"])).when(h["indexer"], "this[]").when(_called(h), h["method"]).otherwise(F.regexp_extract(F.regexp_replace(told, r"\s*(?:=.*)?$", ""), r"(@?\w+)$", 1))


def declares(told: Column) -> Column:
    """Whether a member's head is one."""
    return ~told.startswith("=") & (told != "")


def member_of(y: Column, h: Column) -> Column:
    """What a member declares: name, signature, summary (null: its signature) and own."""
    told, (called, prop, braces) = y["head"], _parts(y, h)
    until_close = F.regexp_extract(told, r"^([^(]*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)).*$", 1)  # with three levels of parentheses
    plain = F.trim(_if_has(told, ("=>",), F.regexp_replace(told, r"\s*=>.*$", ""), told))
    close = let(until_close, lambda c: F.when(c != "", _if_has(c, (" (",), F.regexp_replace(c, r"^(.*?\w>?)\s+\(", "$1("), c)))
    signature = F.coalesce(F.when(called, close), F.when(prop | h["indexer"], plain), told)
    words = F.array_join(F.transform(y["accessors"], lambda x: F.regexp_extract(x, r"(\w+)(?:\s*=>.*)?$", 1)), "; ")
    summary = F.when(prop & braces, F.concat(plain, F.lit(" { "), words, F.lit("; }"))).when(~(called | h["indexer"] | prop), F.concat(told, F.when(y["sign"] == ";", ";").otherwise("")))
    own = own_of(y, h)
    return F.struct(F.when(own, name_of(told, h)).alias("name"), F.left(signature, F.lit(MOST_SIGNATURE)).alias("signature"), summary.alias("summary"), own.alias("own"))


def _written_by_hand(files: DataFrame) -> DataFrame:
    """Files without the mark of generated ones near their beginning."""
    return files.where(~F.contains(F.lower(F.left("text", F.lit(MARKED))), F.lit("<auto-generated")))


def syntax_chunks(files: DataFrame) -> DataFrame:
    """Chunks (doc, kind, symbol, signature, namespace, first, last, body) of files (doc, text): one of each type with a line for each member, one of each member that has its own (in
    parts if it is long), and the whole file where there is no type. Files that are marked as generated near their beginning give nothing."""
    line = lambda name, c: F.when(c != "", F.concat(F.lit(name), c, F.lit("\n"))).otherwise("")
    path = lambda y, name: F.when(y["type"] == "", name).otherwise(F.concat(y["type"], F.lit("."), name))
    top = lambda y: F.concat(line("File: ", F.col("doc")), line("Namespace: ", y["namespace"]))

    def read(y: Column) -> Column:
        return F.struct(y.alias("y"), F.when((y["what"] == "Member") & declares(y["head"]), heads_of(y["head"])).alias("h"))

    def tell(x: Column) -> Column:
        return F.struct(x["y"].alias("y"), F.when(x["h"].isNotNull(), member_of(x["y"], x["h"])).alias("m"))

    def lines(x: Column) -> Column:
        """What a type lists of a statement in its block."""
        y, m = x["y"], x["m"]
        pieces = F.transform(F.filter(F.split(F.regexp_replace(y["head"], r"\s*\}$", ""), r",(?![^(]*\))"), lambda p: F.trim(p) != ""), lambda p: F.left(F.trim(F.regexp_replace(p, r"\s+", " ")), F.lit(MOST_VALUE)))
        own = F.when(m.isNotNull() & ~y["filled"], F.left(F.coalesce(m["summary"], m["signature"]), F.lit(MOST_SUMMARY))).when(m.isNotNull() | y["what"].isin("Type", "Enum"), collapse(y["text"], MOST_SUMMARY))
        return F.transform(F.when(y["what"] == "Value", pieces).when(own.isNotNull(), F.array(own)).otherwise(F.array().cast("array<string>")), lambda p: F.concat(F.lit("    "), p))

    def chunk(kind: str, y: Column, name: Column, signature: Column, whole: Column, header: Column, text: Column, last: Column | None = None) -> Column:
        known = kind != "File"
        return F.struct(
            F.lit(kind).alias("kind"), (path(y, name) if known else name).alias("path"), signature.alias("signature"), F.coalesce(y["namespace"], F.lit("")).alias("namespace") if known else F.regexp_extract(text, r"(?m)^\s*" + NAMESPACE[1:], 1).alias("namespace"),
            (y["first"] if known else F.lit(1)).alias("first"), (y["last"] if last is None else last).alias("last"), whole.alias("whole"), header.alias("header"), text.alias("own"),
        )

    own, found, none = F.col("own"), F.col("found"), F.lit(None).cast("string")
    rows = types(_written_by_hand(files)).withColumn("found", F.transform(F.transform("members", read), tell)).withColumn("told", own["head"])
    signature = F.left(F.regexp_replace(_if_has(F.col("told"), ("where",), F.regexp_replace("told", r"\s+where\s.*$", ""), F.col("told")), r"^([^:]*?)\s+:", "$1:"), F.lit(MOST_SIGNATURE))
    rows = rows.withColumn("signature", signature).withColumn("listed", F.array_join(F.flatten(F.transform(found, lines)), "\n"))
    whole = F.left(F.concat(top(own), line("", own["note"]), "signature", F.lit("\n"), line("", F.col("listed"))), F.lit(MOST_CHARS))
    type_chunk = F.when(own["what"].isin("Type", "Enum"), F.array(chunk("Type", own, own["name"], F.col("signature"), whole, F.lit(""), F.lit(""))))
    file = chunk("File", own, F.regexp_extract("doc", r"[^/]*$", 0), F.col("doc"), none, line("File: ", F.col("doc")), own["text"], F.size(split_lines(own["text"])))
    file_chunk = F.when((own["what"] == "File") & own["text"].rlike(r"\S"), F.array(file))

    def member_chunk(x: Column) -> Column:
        y, m = x["y"], x["m"]
        header = F.concat(top(y), line("Type: ", y["type"]), line("", y["note"]))
        return chunk("Method", y, m["name"], m["signature"], none, header, y["text"])

    members = F.transform(F.filter(found, lambda x: F.coalesce(x["m"]["own"], F.lit(False))), member_chunk)
    rows = rows.select("doc", F.explode(F.concat(F.coalesce(type_chunk.cast(TAKEN), file_chunk.cast(TAKEN), F.array().cast(TAKEN)), members.cast(TAKEN))).alias("c")).select("doc", "c.*")
    # Only what doesn't fit needs its lines.
    fits = F.length("header") + F.length("own") <= MOST_CHARS
    rows = rows.withColumn("lines", F.when(fits, F.array("own")).otherwise(F.split("own", "\n", -1))).drop("own")
    cut = definitions.split_windows(rows)
    end = F.when(F.col("label") == "", F.col("last")).otherwise(F.least(F.col("last"), F.col("first") + F.col("offset") + F.col("shown") - 1))
    return cut.select("doc", "kind", F.concat("path", "label").alias("symbol"), "signature", "namespace", (F.col("first") + F.col("offset")).cast("int").alias("first"), end.cast("int").alias("last"), F.coalesce("whole", "body").alias("body"))


def definitions_of(files: DataFrame) -> DataFrame:
    """Definitions (doc, name, line, column, first, last) of all types and of members with a chunk of their own, as ``definitions.symbol_chunks`` takes them."""
    is_type, y, h = F.col("what").isin("Type", "Enum"), {c: F.col(c) for c in _names(NAMED)}, F.col("h")
    rows = entries(_written_by_hand(files)).where(is_type | ((F.col("what") == "Member") & declares(F.col("head"))))
    # Exploded, so that a filter behind it doesn't compute it again.
    rows = rows.withColumn("h", F.explode(F.array(F.when(~is_type, heads_of(F.col("head")))))).where(is_type | own_of(y, h))
    name = F.when(is_type, F.col("name")).otherwise(name_of(F.col("head"), h))
    return rows.select("doc", name.alias("name"), F.col("first").alias("line"), F.lit(0).alias("column"), "first", "last")
