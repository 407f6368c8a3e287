"""Telemetry records as JSON lines: strict and tolerant readers, and a guard against content in records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType, StringType

# A record with a member whose name contains one of these holds content.
CONTENT = ("prompt", "answer", "content", "image", "path", "secret")
BROKEN = "_unreadable"


def content_members(kind: DataType, above: str = "") -> list[str]:
    """Dotted names of the members, at any depth, that may hold content."""
    if isinstance(kind, ArrayType):
        return content_members(kind.elementType, above)
    if not isinstance(kind, StructType):
        return []
    out = []
    for f in kind.fields:
        name = f"{above}{f.name}"
        out += [name] if any(x in f.name.lower() for x in CONTENT) else content_members(f.dataType, f"{name}.")
    return out


def read_telemetry(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """Records under ``path``. Strict: a malformed record is an error. Tolerant: it is a row of nulls with its text in ``_unreadable``."""
    held = content_members(schema)
    if held:
        raise ValueError(f"telemetry must not hold content: {', '.join(held)}")
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(StructType([*schema.fields, StructField(BROKEN, StringType())])).option("columnNameOfCorruptRecord", BROKEN).json(path)


def readable(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The good records of a tolerant read, and one row with how many were ``unreadable``."""
    return records.where(F.col(BROKEN).isNull()).drop(BROKEN), records.select(F.count(BROKEN).alias("unreadable"))


def append_telemetry(records: DataFrame, path: str) -> None:
    held = content_members(records.schema)
    if held:
        raise ValueError(f"telemetry must not hold content: {', '.join(held)}")
    records.write.mode("append").json(path)


def in_file_order(records: DataFrame) -> DataFrame:
    """Records of ``read_telemetry`` with ``file`` (its name) and ``nth``, the record's place in the order of the file names and of the records in each file."""
    named = records.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).withColumn("_k", F.monotonically_increasing_id())
    return named.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("_k"))).drop("_k")


def first_of_workflows(records: DataFrame, workflow: str, order: str) -> DataFrame:
    """One record for each workflow, the first by ``order``; records without a workflow all stay."""
    names = records.columns
    first = records.where(F.col(workflow).isNotNull()).groupBy(workflow).agg(F.min_by(F.struct(*names), F.struct(order, *[c for c in names if c != order])).alias("_r")).select("_r.*")
    return records.where(F.col(workflow).isNull()).unionByName(first)


def kept(records: DataFrame, recorded_at: str, now: str, days: int) -> DataFrame:
    """Records that are not older than ``days``; what an append leaves of those before it."""
    return records.where(F.col(recorded_at) >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))
