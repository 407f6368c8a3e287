"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Stages take and (but the last) return the columns of documents, whatever else stands among them; columns with names that an operator uses inside are only
carried. Null and empty texts, ties, repeated rows, very long texts and empty tables have the results that each stage's docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbra.llm import exact_dedup, mixing, near_join, packing, toxicity
from lumbra.llm.common import dropped, stored, table
from lumbra.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled documents, doesn't reject at their language's threshold.

    Null and empty texts are scored like a text without words; repeated rows stay or go together; without labels of both classes every document stays
    or goes by their share; an empty table gives an empty table.
    """
    model = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z lower-cased): the one with the smallest doc_id, null ids last.

    Null and empty texts are equal; of repeated rows one stays; an empty table gives an empty table.
    """
    return exact_dedup.deduplicate(docs, files=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group joined by links of similarity 0.8 or more on five-word shingles: the first row in the table.

    Documents without words are linked with nothing and stay; repeated rows are one group; an empty table gives an empty table.
    """
    return near_join.drop_near_duplicates(docs, files=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources, copies included, sorted by training position.

    Documents without words are never taken; a null source is a source; repeated rows count as often as they come; an empty table gives an empty table.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens.

    Null and empty texts are their end id; repeated rows are packed as often as they come; an empty table gives an empty table.
    """
    return packing.pack(docs, **vocabulary()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            dropped(before)  # the next stage is written, nothing reads it any more
        before = docs
    return docs
