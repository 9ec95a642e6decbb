"""Exact deduplication by Grace hashing (operator 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grace import decided, folded
from .shared import fresh, numbered, table


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, fold_bytes: int = 24 << 20, table_bytes: int = 64 << 20) -> DataFrame:
    """Groups of texts that are identical after lower-casing A-Z only.

    One row for each input row: ``doc_id, keep_id, group_size, kept, text_sha256``. Null texts count as empty; the
    empty texts are a group. The row with the largest id stays; a null id is smaller than all others; of rows that
    repeat the largest id exactly one is ``kept``. An empty table gives an empty result; other columns are ignored.
    """
    docs = numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("content")))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "id", "content")
    local = folded(rows, lower=True, fold_bytes=fold_bytes)
    groups = decided(local, table_bytes=table_bytes).select(F.col("rid").alias("rep"), "keep_rid", "keep_id", "group_size")
    return local.select("rid", "id", "rep", "digest").join(groups, "rep").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each group of equal texts (see :func:`exact_groups`); all columns stay, whatever their names.

    Null and empty texts are one group; of rows that repeat the largest id of a group one stays.
    """
    docs = numbered(docs)
    rid = fresh(docs, "row_number")
    rows = docs.withColumn(rid, F.monotonically_increasing_id())
    local = folded(rows.select(rid, F.col(id_col).cast("long"), F.col(text_col).cast("string")), lower=True)
    winners = decided(local).filter("rid = keep_rid").select(F.col("rid").alias(rid))
    return rows.join(winners, rid, "left_semi").drop(rid)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
