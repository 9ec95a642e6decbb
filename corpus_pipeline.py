"""A corpus pipeline of five stages over ``documents``.

Each stage takes the session, its predecessor's rows and the folder of the tables, and returns a DataFrame; all but the
last return the columns of ``documents``. Stages are independent of each other's state: what passes between them is a
Parquet table.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import decontaminate, exact_dedup, jaccard, packing, quality
from helixframe.llm.shared import remove, shared_dir, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labelled rows outside the held-out fold.

    Null texts count as empty; an empty text is one empty line and judged as such; repeated rows are judged alike. Rows with
    null ids are judged by their text. All columns stay, whatever their names; an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal after lower-casing A-Z: that of the largest id, null ids last.

    Null and empty texts are one group; of rows that repeat the largest id one stays. All columns stay, whatever their names.
    """
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by trigram similarity: that of the largest id, null ids last.

    Texts without words (null and empty ones too) are one group; of rows that repeat an id and a text one stays. All columns
    stay, whatever their names.
    """
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked, by templates and slots.

    Null and empty texts stay; repeated rows are judged one by one; null and empty items match nothing. All columns stay,
    whatever their names.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in training sequences.

    Null and empty texts have the end token alone; rows with null or repeated ids are packed like others; an empty table
    gives no rows; other columns are ignored.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]

#: SQL can express neither the classifier nor the packing; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written to the shared folder and read again as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        atexit.register(remove, spark, path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
