"""The driver's tables in the shapes of the domain, for Spark and as DuckDB common table expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import table

LETTERS, BASES = string.ascii_uppercase + string.ascii_lowercase, "ACGT" * 13


def bases(text: Column) -> Column:
    """Letters as nucleotides; everything else is left out."""
    return F.regexp_replace(F.translate(text, LETTERS, BASES), "[^ACGT]", "")


_BASES_SQL = f"regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g')"


def reads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("read_id"), bases(F.col("text")).alias("seq"), "lang", "source")


def refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("ref_id"), bases(F.col("text")).alias("seq"))


READS = f"reads AS (SELECT doc_id AS read_id, {_BASES_SQL} AS seq, lang, source FROM documents)"
REFS = f"refs AS (SELECT item_id::BIGINT AS ref_id, {_BASES_SQL} AS seq FROM benchmark)"


def weights(spark: SparkSession, d: str) -> DataFrame:
    """Unnormalised candidate weights (read_id, bucket_id, w)."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("read_id"), F.col("l_suppkey").alias("bucket_id")).agg(F.sum("l_quantity").alias("w"))


WEIGHTS = "weights AS (SELECT l_orderkey AS read_id, l_suppkey AS bucket_id, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2)"
WAVE = f"{WEIGHTS}, wave AS (SELECT read_id, bucket_id, w / sum(w) OVER (PARTITION BY read_id) AS p FROM weights)"


def pyramid(spark: SparkSession, d: str) -> DataFrame:
    """Finest buckets with their parents: (l2, l1, l0, bio_prior, pos)."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("l2"), F.col("n_nationkey").cast("long").alias("l1"), F.col("n_regionkey").cast("long").alias("l0"),
        (1 + F.greatest("s_acctbal", F.lit(0.0)) / 10000).alias("bio_prior"), (F.col("s_suppkey") * 20000).alias("pos"),
    )


PYRAMID = """pyramid AS (SELECT s_suppkey AS l2, n_nationkey::BIGINT AS l1, n_regionkey::BIGINT AS l0,
  1 + greatest(s_acctbal, 0e0) / 10000e0 AS bio_prior, s_suppkey * 20000 AS pos FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def prob_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("read_id"), F.col("l_partkey").alias("bucket_id"), (F.col("l_quantity") / 50).alias("probability"), (1 - F.col("l_discount")).alias("confidence"),
        (F.col("l_linenumber") % 3).cast("int").alias("level"), F.col("l_linenumber").cast("int").alias("iteration"), (F.col("l_returnflag") == "R").alias("is_collapsed"),
    )


PROB_ROWS = """prob_rows AS (SELECT l_orderkey AS read_id, l_partkey AS bucket_id, l_quantity / 50e0 AS probability, 1 - l_discount AS confidence,
  (l_linenumber % 3)::INT AS level, l_linenumber::INT AS iteration, l_returnflag = 'R' AS is_collapsed FROM lineitem)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("cell"), F.col("event_type").alias("paralog"), (F.col("value") / (1 + F.col("value"))).alias("prob"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("conf"),
    )


CELLS = r"""cells AS (SELECT user_id AS cell, event_type AS paralog, value / (1 + value) AS prob,
  regexp_extract(props, '"k"\s*:\s*(-?\d+)', 1)::DOUBLE / 100 AS conf FROM events)"""


def intervals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        (F.col("o_custkey") % 7).alias("ref_id"), (F.col("o_orderkey") * 10).alias("start"), (F.col("o_orderkey") * 10 + 5 + F.floor("o_totalprice") % 200).alias("end"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("layer"), F.when(F.col("o_orderstatus") == "O", 1.5).alias("lambda_scale"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_custkey") % 5 / 4 + 0.5).alias("weight_scale"), F.col("o_orderkey").alias("interval_id"),
    )


INTERVALS = """intervals AS (SELECT o_custkey % 7 AS ref_id, o_orderkey * 10 AS "start", o_orderkey * 10 + 5 + floor(o_totalprice)::BIGINT % 200 AS "end",
  substr(o_orderpriority, 1, 1)::INT AS layer, CASE WHEN o_orderstatus = 'O' THEN 1.5e0 END AS lambda_scale,
  CASE WHEN o_orderstatus <> 'F' THEN (o_custkey % 5) / 4e0 + 0.5e0 END AS weight_scale, o_orderkey AS interval_id FROM orders)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("ref_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") * 3).alias("pos"), F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").cast("int").alias("hit"))


POINTS = "points AS (SELECT l_suppkey % 7 AS ref_id, l_orderkey * 10 + l_linenumber * 3 AS pos, l_orderkey AS read_id, l_linenumber::INT AS hit FROM lineitem)"


def calls_a(spark: SparkSession, d: str) -> DataFrame:
    """One mapper's calls: (read_id, chrom, pos, mapped, secondary, mapq)."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("read_id"), (F.col("o_custkey") % 5).alias("chrom"), day.alias("pos"), (F.col("o_orderstatus") != "F").alias("mapped"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("kind"), (F.floor("o_totalprice") % 61).cast("int").alias("mapq"),
    )


CALLS_A = """calls_a AS (SELECT o_orderkey AS read_id, o_custkey % 5 AS chrom, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS pos,
  o_orderstatus <> 'F' AS mapped, substr(o_orderpriority, 1, 1)::INT AS kind, (floor(o_totalprice)::BIGINT % 61)::INT AS mapq FROM orders)"""


def calls_b(spark: SparkSession, d: str) -> DataFrame:
    """Another mapper's calls, from the first line of each order that was shipped in time."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, d, "lineitem").filter("l_returnflag <> 'A'").groupBy(F.col("l_orderkey").alias("read_id")).agg(
        (F.min("l_suppkey") % 5).alias("chrom"), F.min(day).alias("pos"), (F.max("l_quantity") > 20).alias("mapped")
    )


CALLS_B = """calls_b AS (SELECT l_orderkey AS read_id, min(l_suppkey) % 5 AS chrom, min(datediff('day', DATE '1970-01-01', l_shipdate::DATE)) AS pos,
  max(l_quantity) > 20 AS mapped FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)"""

PARALOGS = ("P0", "P1", "P2", "P3")


def psv_sites(spark: SparkSession, d: str) -> DataFrame:
    """Alleles by site and paralog: (psv_id, paralog, allele); every fifth paralog of a site is missing."""
    each = F.explode(F.sequence(F.lit(0), F.lit(len(PARALOGS) - 1)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("psv_id"), each.alias("k")).select(
        "psv_id", F.concat(F.lit("P"), F.col("k")).alias("paralog"), F.substring(F.lit("ACGT"), (1 + (F.col("psv_id") * (F.col("k") + 1) + F.col("k")) % 4).cast("int"), F.lit(1)).alias("allele"), "k"
    ).filter("(psv_id + k) % 5 <> 0").drop("k")


PSV_SITES = """psv_sites AS (SELECT p_partkey AS psv_id, 'P' || k AS paralog, substr('ACGT', (1 + (p_partkey * (k + 1) + k) % 4)::INT, 1) AS allele
  FROM part, range(4) AS t(k) WHERE (p_partkey + k) % 5 <> 0)"""


def psv_obs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("read_id"), F.col("l_partkey").alias("psv_id"), F.substring(F.lit("ACGT"), (1 + F.col("l_suppkey") % 4).cast("int"), F.lit(1)).alias("base"),
        F.col("l_quantity").cast("int").alias("base_quality"),
    )


PSV_OBS = "psv_obs AS (SELECT l_orderkey AS read_id, l_partkey AS psv_id, substr('ACGT', (1 + l_suppkey % 4)::INT, 1) AS base, l_quantity::INT AS base_quality FROM lineitem)"
