"""Tables in the folder that the cluster shares: written once, read by many steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where none is named and Spark runs in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps neither compute it again nor need its executors."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


TASK_ROWS = 250_000


def tasks_for(*tables: DataFrame) -> int:
    """How many tasks have about ``TASK_ROWS`` rows of the tables each, so that a task's memory doesn't grow with the input."""
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, *(-(-t.count() // TASK_ROWS) for t in tables))
