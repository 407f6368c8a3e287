"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import itertools
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

#: A word, wherever an operator counts or shingles words: no ASCII white space. ``bytes.split()`` finds the same words.
WORD = r"[^\x20\x09-\x0D]+"

#: Words that one numpy step handles at once; longer texts are handled in several steps.
STEP_WORDS = 120_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is named and Spark runs in this process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: While a job of an operator's own runs: its shuffle files go when it ends, and texts reach Python in small batches.
OWN_JOBS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextlib.contextmanager
def own_job(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in OWN_JOBS}
    for k, v in OWN_JOBS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps neither compute it twice nor depend on its executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    with own_job(spark):
        df.write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got.stored_at = path
    return got


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


HINT_BITS = 1 << 27  # at most, of the bitmap of ``may_hold``: 16 MB, whatever the input


def may_hold(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` with ``_hit``: false only where ``key`` is surely not among ``keys`` (one column of the same name).

    The keys' hashes are a bitmap of bounded size, broadcast in pages, so rows that cannot match are told apart without a shuffle. A full
    bitmap tells nothing apart and the rows are joined as they would be without it.
    """
    bits, n = 1 << 18, keys.count()
    while bits < min(16 * n, HINT_BITS):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    pages = keys.groupBy(F.bitmap_bucket_number(place(key)).alias("_page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(key))).alias("_bits"))
    found = rows.withColumn("_place", place(key)).join(F.broadcast(pages), F.bitmap_bucket_number("_place") == F.col("_page"), "left")  # at most HINT_BITS / 32768 pages of 4 KB
    return found.withColumn("_hit", _bit("_bits", "_place")).drop("_place", "_page", "_bits")


def _bit(page: str, number: str) -> Column:
    """The bit of a number in its page of a bitmap; false without a page."""
    bit = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substr(page, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


MOST_PAGES = 4096  # of 4 KB, that ``flagged`` broadcasts
MOST_LEVELS = 12


def flagged(rows: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: is the integer ``key`` among ``keys`` (one column of the same name). Exact, and no row moves.

    The keys themselves are a bitmap; its pages are broadcast if they are few, as with ids that are numbered. Else bitmaps of hashes decide, each of bounded size: one
    of the keys, one of the other ids that hit it, one of the keys that hit that, and so on until nothing hits; the first bitmap that an id doesn't hit
    tells which side it is on. Only ids are shuffled to find them. Keys that fill the bitmaps are joined at last.
    """
    pages = stored(keys.where(F.col(key).isNotNull()).groupBy(F.bitmap_bucket_number(key).alias("_page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("_bits")), "pages")
    if pages.count() <= MOST_PAGES:
        found = rows.join(F.broadcast(pages), F.bitmap_bucket_number(key) == F.col("_page"), "left")
        return found.withColumn(name, _bit("_bits", key)).drop("_page", "_bits")
    inside = stored(keys.where(F.col(key).isNotNull()).distinct(), "keys")
    outside = stored(may_hold(rows.select(key).where(F.col(key).isNotNull()), key, inside).where("_hit").select(key).distinct().join(inside, key, "left_anti"), "others")
    sides, level = [inside, outside], 1
    rows = may_hold(rows, key, inside).withColumn("_side", F.when(~F.col("_hit"), F.lit(False))).drop("_hit")
    while not sides[1].isEmpty():  # sides[1] hits the bitmaps so far, wrongly
        if level == MOST_LEVELS:
            return rows.join(inside.withColumn("_in", F.lit(True)), key, "left").withColumn(name, F.coalesce("_side", "_in", F.lit(False))).drop("_in", "_side")
        salted = F.concat_ws(":", F.lit(level), F.col(key))
        one = lambda df: df.select(salted.alias("_salted"))  # noqa: E731,B023
        hit = lambda df: may_hold(df.withColumn("_salted", salted), "_salted", one(sides[1])).drop("_salted")  # noqa: E731,B023
        rows = hit(rows).withColumn("_side", F.coalesce("_side", F.when(~F.col("_hit"), F.lit(level % 2 == 1)))).drop("_hit")
        sides = [sides[1], stored(hit(sides[0]).where("_hit").select(key), "others")]
        level += 1
    return rows.withColumn(name, F.coalesce("_side", F.lit(level % 2 == 1)) & F.col(key).isNotNull()).drop("_side")


def among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is among ``keys``; only rows that may match are shuffled."""
    return may_hold(rows, key, keys).where("_hit").drop("_hit").join(keys, key, "left_semi")


def without(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is not among stored ``keys``; only rows that may match are shuffled."""
    told = may_hold(rows, key, keys)
    return told.where(~F.col("_hit")).drop("_hit").unionByName(told.where("_hit").drop("_hit").join(keys, key, "left_anti"))


def numbered(documents: DataFrame, *columns: Column, files: bool = False) -> DataFrame:
    """Rows with ``_row``, a number of its own for each that stays the same in every reading, ``_all``, a struct of all columns, and ``columns``.

    ``files`` says that ``documents`` is a plain reading of Parquet files: its rows are numbered by file and place in the file. Other
    tables are written first.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_all")
    if not files or "_metadata" in documents.columns:
        return stored(documents.select(whole, *columns, F.monotonically_increasing_id().alias("_row")), "numbered")
    placed = documents.select(whole, *columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))
    of_file = placed.select("_path").distinct().withColumn("_file", F.row_number().over(Window.orderBy("_path")))  # the driver lists these files anyway
    return placed.join(F.broadcast(of_file), "_path").withColumn("_row", F.shiftleft(F.col("_file").cast("long"), 36) + F.col("_at")).drop("_path", "_file", "_at")


def raw(rows: DataFrame) -> DataFrame:
    """The columns that ``numbered`` was given."""
    return rows.select("_all.*")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


SAMPLE_TOTAL = 64_000_000  # characters that a sample of texts may have in all


def lowest(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows by ``order``, whose first column is a 64-bit hash, without a top ``most`` from every partition.

    Rows are counted by the first bits of the hash, so only rows up to the range of hashes that holds the ``most``-th are compared.
    """
    part = F.shiftright(order[0], 50)
    counts = rows.select(part.alias("_part")).groupBy("_part").count()  # at most 2 ** 14 rows
    upto = counts.withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count")).where(F.col("_before") < most).agg(F.max("_part").alias("_upto"))
    return rows.join(F.broadcast(upto), part <= F.col("_upto")).drop("_upto").orderBy(*order).limit(most)  # one row is broadcast


def sampled(candidates: DataFrame, columns: list[str], rows: int, max_chars: int, total: int = SAMPLE_TOTAL) -> Iterator[Row]:
    """At most ``rows`` of candidates (doc_id, text, ``columns``) with at most ``total`` characters in all, in the order of a hash of doc_id.

    Null texts and texts over ``max_chars`` are not sampled. Rows are chosen by their hashes before any text is moved; they come one by one, so
    that no more than their features need to be held.
    """
    fit = candidates.where(F.col("text").isNotNull() & (F.length("text") <= max_chars)).withColumn("_text", F.xxhash64("text"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("_text"), *map(F.col, columns)]
    top = lowest(fit.select("doc_id", "_text", F.length("text").alias("_chars"), *columns), order, rows)
    top = top.withColumn("_sum", F.sum("_chars").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= total)
    ids = top.select("doc_id", "_text").distinct()  # at most ``rows``
    got = fit.join(F.broadcast(ids), ["doc_id", "_text"]).orderBy(*order).select("text", *columns)
    return itertools.islice(got.toLocalIterator(), rows)  # partition by partition


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int, max_chars: int, columns: tuple[str, ...] = ()) -> Iterator[Row]:
    """Rows (text, y, ``columns``) of at most ``rows`` labelled documents, see ``sampled``.

    ``keep`` is a condition on doc_id. A document with several labels counts with the largest, a null label as none.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = lowest(known, [F.xxhash64("doc_id"), F.col("doc_id")], rows)
    return sampled(documents.select("doc_id", "text", *columns).join(F.broadcast(ids), "doc_id"), ["y", *columns], rows, max_chars)


def judged(documents: DataFrame, columns: list[str], inputs: list[str], run, results: str) -> DataFrame:
    """``columns`` of every document and the ``results`` that ``run(batch)`` gives for its columns ``inputs``, in steps of 512 rows.

    Results take the place of columns of the same name.
    """
    names = [f.split()[0] for f in results.split(", ")]
    whole = F.struct(*[F.col(f"`{c}`") for c in columns if c not in names], F.lit(0).alias("_")).alias("_all")
    rows = documents.select(whole, *[F.col(c).cast("string").alias(f"_{k}") for k, c in enumerate(inputs)])

    def steps(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), *run(*(part.column(k + 1).to_pylist() for k in range(len(inputs))))], names=["_all", *names])

    got = rows.mapInArrow(steps, f"_all {rows.schema['_all'].dataType.simpleString()}, {results}")
    return got.select(*[F.col(f"_all.`{c}`").alias(c) for c in columns if c not in names], *names)


class WordCodes(dict):
    """Word (bytes) to an integer code; computes a code once and forgets all when it holds too many."""

    def __init__(self, code, most: int = 100_000):
        super().__init__()
        self.code, self.most = code, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = self.code(word)
        return got

    def packed(self, text: str | None, kind: type) -> np.ndarray:
        return np.fromiter(self.of(text), kind)

    def of(self, text: str | None) -> list[int]:
        return list(map(self.__getitem__, text.encode("utf-8", "replace").split())) if text else []


_EDGE = "\"'.,;:!?()[]{}<>|*#$%&-_=+~`/\\«»„“”‘’…"


def plain_word(word: bytes) -> str:
    """Lower-cased, without punctuation at its ends."""
    return word.decode("utf-8", "replace").lower().strip(_EDGE)


def word_hash(word: bytes) -> int:
    """32 bits of the plain word; 0 is for words of punctuation only."""
    w = plain_word(word)
    return (zlib.crc32(w.encode()) or 1) if w else 0


def segments(codes: list[list[int]], overlap: int, most: int = STEP_WORDS) -> Iterator[list[tuple[int, list[int]]]]:
    """Groups of (document index, words) with at most ``most`` words each; longer documents come in overlapping pieces."""
    held, n = [], 0
    for i, words in enumerate(codes):
        for at in range(0, max(1, len(words) - overlap), most - overlap):
            piece = words[at : at + most]
            if n + len(piece) > most and held:
                yield held
                held, n = [], 0
            held.append((i, piece))
            n += len(piece)
    if held:
        yield held


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def platt(logit: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Scale and shift of a logit that make it a calibrated probability (Newton steps with a small penalty)."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * logit + b)
        g = np.array([((p - y) * logit).sum() + 0.1 * (a - 1), (p - y).sum() + 0.01 * b])
        w = p * (1 - p)
        h = np.array([[(w * logit * logit).sum() + 0.1, (w * logit).sum()], [(w * logit).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = max(0.05, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)
