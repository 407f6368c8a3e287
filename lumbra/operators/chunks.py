"""Chunkers as table-valued expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbra.functions.text import split_lines, units

WINDOW, OVERLAP, MOST_CHARS = 60, 12, 6000


def line_windows(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Windows of 60 lines that overlap by 12, with the text that is embedded: the path and the lines as a header, then the body. The label counts ceil(lines / 48) parts, also where the last of them has no lines of its own; blank windows are left out after numbering."""
    step = WINDOW - OVERLAP
    lines = files.where(~F.contains(F.col(text), F.char(F.lit(0)))).select(F.col(path).alias("path"), split_lines(F.col(text)).alias("lines")).withColumn("n", F.size("lines"))
    got = lines.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step)))).where((F.col("start") == 0) | (F.col("start") + OVERLAP < F.col("n")))
    body = F.array_join(F.slice("lines", F.col("start") + 1, F.lit(WINDOW)), "\n")
    parts = F.ceil(F.col("n") / step)
    label = F.when(parts > 1, F.concat(F.lit("["), (F.col("start") / step + 1).cast("int").cast("string"), F.lit("/"), parts.cast("string"), F.lit("]"))).otherwise("")
    return (
        got.select("path", (F.col("start") + 1).alias("start_line"), F.least(F.col("start") + WINDOW, F.col("n")).alias("end_line"), label.alias("label"), F.left(body, F.lit(MOST_CHARS)).alias("body"))
        .where(F.regexp_replace("body", r"\s", "") != "")
        .withColumn("embedded", F.concat(F.lit("File: "), "path", F.lit("\nLines: "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\n\n"), "body"))
    )


def unit_fragments(text: str, size: int, overlap: int) -> list[tuple[int, str, str]]:
    """(start, fragment, fresh) of a text by UTF-16 code units; a pair is never cut: what is fresh takes its second half along, what is repeated leaves its first half out."""
    data = text.encode("utf-16-le", "surrogatepass")
    n, at, tail, out = len(data) // 2, 0, b"", []
    half = lambda d, i, lead: d[2 * i + 1] & 0xFC == lead
    while at < n or not out:
        fresh = min(max(1, size - len(tail) // 2), n - at)
        if 0 < at + fresh < n and half(data, at + fresh - 1, 0xD8) and half(data, at + fresh, 0xDC):
            fresh += 1
        own = data[2 * at : 2 * (at + fresh)]
        whole = tail + own
        out.append((at - len(tail) // 2, *(x.decode("utf-16-le", "replace") for x in (whole, own))))
        at += fresh
        start = max(0, len(whole) // 2 - overlap)
        if start and half(whole, start, 0xDC) and half(whole, start - 1, 0xD8):
            start += 1
        tail = whole[2 * start :]
    return out


def text_fragments(texts: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """Fragments of ``size`` UTF-16 code units; each but the first begins with the last ``overlap`` units before it. ``fresh`` is what it has beyond them.

    Texts without characters above U+FFFF are cut by arithmetic; the others, whose cuts depend on the ones before, text by text in Arrow batches.
    """
    plain = F.coalesce(units(F.col(text)) == F.length(F.col(text)), F.lit(True))
    kind = texts.schema[key].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for own, value in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                got = unit_fragments(value, size, overlap)
                columns = [pa.array([own.as_py()] * len(got), batch.schema.field(0).type), pa.array(range(len(got)), pa.int32()), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got]), pa.array([g[2] for g in got])]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "part", "start", "fragment", "fresh"])

    rest = texts.where(~plain).select(key, text).mapInArrow(cut, f"`{key}` {kind}, part int, start int, fragment string, fresh string")
    fresh = max(1, size - overlap)
    n = F.length(F.col(text))
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(fresh)))
    got = texts.where(plain).select(F.col(key), F.col(text).alias("_t"), F.posexplode(starts).alias("part", "at"))
    own = F.substring(F.col("_t"), F.col("at") + 1 + F.when(F.col("part") > 0, overlap).otherwise(0), F.lit(size))
    got = got.select(key, "part", F.col("at").alias("start"), F.substring(F.col("_t"), F.col("at") + 1, F.lit(size)).alias("fragment"), F.left(own, F.when(F.col("part") > 0, size - overlap).otherwise(size)).alias("fresh"))
    return got.unionByName(rest)
