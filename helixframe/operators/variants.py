"""Variant priors by bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prior_buckets(variants: DataFrame, bucket_bp: int = 100) -> DataFrame:
    """(contig, bucket, n_snv, snv_max_af, n_sv, sv_max_af, sv_type_bits) of variants (contig, pos, is_sv, af, type_bit)."""
    sv = F.col("is_sv")
    return variants.groupBy("contig", F.floor(F.col("pos") / bucket_bp).alias("bucket")).agg(
        F.count_if(~sv).alias("n_snv"), F.coalesce(F.max(F.when(~sv, F.col("af"))), F.lit(0.0)).alias("snv_max_af"),
        F.count_if(sv).alias("n_sv"), F.coalesce(F.max(F.when(sv, F.col("af"))), F.lit(0.0)).alias("sv_max_af"), F.coalesce(F.bit_or(F.when(sv, F.col("type_bit"))), F.lit(0)).alias("sv_type_bits"),
    )


def lookup(points: DataFrame, buckets: DataFrame, bucket_bp: int = 100) -> DataFrame:
    """Points (contig, pos, ..) with their bucket's counts; 0 where there is none."""
    return points.withColumn("bucket", F.floor(F.col("pos") / bucket_bp)).join(buckets, ["contig", "bucket"], "left").na.fill(0, ["n_snv", "n_sv", "sv_type_bits"])
