"""Evaluation of mappings: summaries, truth, concordance, baselines, lossless validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ratio


def mapping_summary(calls: DataFrame) -> DataFrame:
    """Over (mapped, kind): primary, secondary, supplementary and unmapped records with rates."""
    s = calls.agg(
        F.count("*").alias("records"), F.count_if(F.col("mapped") & (F.col("kind") <= 3)).alias("primary"), F.count_if(F.col("mapped") & (F.col("kind") == 4)).alias("secondary"),
        F.count_if(F.col("mapped") & (F.col("kind") == 5)).alias("supplementary"), F.count_if(~F.col("mapped")).alias("unmapped"),
    )
    reads = F.col("primary") + F.col("unmapped")
    return s.withColumn("mapping_rate", F.when(reads > 0, F.col("primary") / reads).otherwise(0.0)).withColumn("drop_rate", F.when(reads > 0, F.col("unmapped") / reads).otherwise(0.0))


def mapq_histogram(calls: DataFrame) -> DataFrame:
    return calls.filter("mapped").groupBy("mapq").agg(F.count("*").alias("n"))


def truth_evaluation(calls: DataFrame, truth: DataFrame, tolerance: int) -> DataFrame:
    """One row of tp, fp, fn, precision, recall and f1; a read without a call counts as not found."""
    j = truth.select("read_id", F.col("chrom").alias("_c"), F.col("pos").alias("_p")).join(calls.select("read_id", "chrom", "pos", "mapped"), "read_id", "left")
    found = F.coalesce("mapped", F.lit(False))
    right = found & (F.col("chrom") == F.col("_c")) & (F.abs(F.col("pos") - F.col("_p")) <= tolerance)
    s = j.agg(F.count("*").alias("n_truth"), F.count_if(right).alias("tp"), F.count_if(found & ~right).alias("fp"), F.count_if(~found).alias("fn"))
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("n_truth")))
    return s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def concordance_class(tolerance: int) -> Column:
    """Over a full join with columns mapped_a, chrom_a, pos_a and those of b; absent counts as unmapped."""
    a, b = F.coalesce("mapped_a", F.lit(False)), F.coalesce("mapped_b", F.lit(False))
    same = F.col("chrom_a") == F.col("chrom_b")
    return (
        F.when(a & b & same & (F.abs(F.col("pos_a") - F.col("pos_b")) <= tolerance), "same_position").when(a & b & same, "same_chrom_diff_pos").when(a & b, "diff_chrom")
        .when(a, "only_a").when(b, "only_b").otherwise("both_unmapped")
    )


def concordance(a: DataFrame, b: DataFrame, tolerance: int) -> DataFrame:
    sides = [x.select("read_id", F.col("mapped").alias(f"mapped_{s}"), F.col("chrom").alias(f"chrom_{s}"), F.col("pos").alias(f"pos_{s}")) for x, s in ((a, "a"), (b, "b"))]
    return sides[0].join(sides[1], "read_id", "full").withColumn("category", concordance_class(tolerance))


def concordance_counts(joined: DataFrame) -> DataFrame:
    """Counts and percentages; the percentage's total is one row."""
    n = joined.groupBy("category").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("_t")))).select("category", "n", F.round(100 * F.col("n") / F.col("_t"), 3).alias("percent"))


def baseline(a: DataFrame, b: DataFrame) -> DataFrame:
    """Reads mapped by both, one or neither of two mappers, with recalls against each other."""
    j = concordance(a, b, 0)
    x, y = F.coalesce("mapped_a", F.lit(False)), F.coalesce("mapped_b", F.lit(False))
    s = j.agg(F.count("*").alias("n"), F.count_if(x & y).alias("n_both"), F.count_if(x & ~y).alias("n_only_a"), F.count_if(~x & y).alias("n_only_b"), F.count_if(~x & ~y).alias("n_neither"))
    return s.withColumn("recall_a", ratio("n_both", F.col("n_both") + F.col("n_only_b"))).withColumn("recall_b", ratio("n_both", F.col("n_both") + F.col("n_only_a"))).withColumn("ratio", ratio(F.col("n_both") + F.col("n_only_a"), F.col("n_both") + F.col("n_only_b")))


def real_validation(a: DataFrame, b: DataFrame, *, reads: DataFrame | None = None, least_ratio: float = 0.995) -> DataFrame:
    """One row: whether a mapper accounts for all its reads and maps at least ``least_ratio`` of what the baseline maps.

    ``reads`` (read_id): the input; every one of them has exactly one call of ``a``. Without it the baseline's reads are the input.
    """
    given = (b if reads is None else reads).select("read_id").distinct()
    calls = a.groupBy("read_id").agg(F.count("*").alias("_c"))
    told = given.join(calls, "read_id", "left").agg(F.count("*").alias("n_reads"), F.count_if(F.coalesce("_c", F.lit(0)) == 1).alias("n_accounted"))
    s = baseline(a, b).join(F.broadcast(told)).withColumn("complete", F.col("n_accounted") == F.col("n_reads"))  # one row each
    return s.withColumn("passed", F.col("complete") & (F.col("ratio") >= least_ratio))


def position_correct(pos: Column, truth: Column, length: Column, *, least: int = 100, share: float = 0.01) -> Column:
    return F.abs(pos - truth) <= F.greatest(F.lit(least), F.floor(length * share))


def validation(records: DataFrame, truth: DataFrame) -> DataFrame:
    """Lossless check over a full join: records without truth, truth without records, status counts, accuracy."""
    from .records import is_lossless

    r = records.withColumn("_ok", is_lossless()).withColumn("_r", F.lit(True))
    t = truth.select("read_id", F.col("pos").alias("true_pos"), F.lit(True).alias("_t"))
    j = r.join(t, "read_id", "full")
    mapped = F.col("status") == "Mapped"
    right = mapped & position_correct(F.col("pos"), F.col("true_pos"), F.col("read_len"))
    s = j.agg(
        F.count("*").alias("n_ids"), F.count_if(F.col("_r").isNull()).alias("n_missing"), F.count_if(F.col("_t").isNull()).alias("n_extra"), F.count_if(F.coalesce("_ok", F.lit(False))).alias("n_lossless"),
        F.count_if(mapped).alias("n_mapped"), F.count_if(F.col("status") == "Tentative").alias("n_tentative"), F.count_if(F.col("status") == "Unmapped").alias("n_unmapped"), F.count_if(right & F.col("_t").isNotNull()).alias("n_correct"),
    )
    return s.withColumn("position_accuracy", F.when(F.col("n_mapped") > 0, F.col("n_correct") / F.col("n_mapped")).otherwise(0.0)).withColumn("passed", (F.col("n_missing") == 0) & (F.col("n_lossless") == F.col("n_ids") - F.col("n_missing")))


def round_trip(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Rows of two tables that should be equal: matched, differing, and on one side only."""
    j = a.select(*keys, F.col(value).alias("_x"), F.lit(1).alias("_a")).join(b.select(*keys, F.col(value).alias("_y"), F.lit(1).alias("_b")), keys, "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    close = F.abs(F.col("_x") - F.col("_y")) <= tolerance
    return j.agg(F.count_if(both & close).alias("matched"), F.count_if(both & ~close).alias("different"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))


def replicates(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
