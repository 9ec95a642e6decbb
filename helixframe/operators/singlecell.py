"""Cell by paralog matrices and their quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ratio
from .relational import entropy

METHODS = ("mean", "max", "sum", "weighted")


def matrix(cells: DataFrame, method: str = "mean", *, min_probability: float = 0.01, min_reads_per_cell: int = 1, min_reads_per_paralog: int = 1) -> DataFrame:
    """(cell, paralog, value, read_count, mean_confidence): one shuffle of partial sums."""
    n, p, cp = F.count("*"), F.sum("prob"), F.sum(F.col("conf") * F.col("prob"))
    value = {"mean": p / n, "max": F.max("prob"), "sum": p, "weighted": F.when(cp > 0, p / cp).otherwise(p / n)}[method]
    m = cells.filter(F.col("prob") >= min_probability).groupBy("cell", "paralog").agg(value.alias("value"), n.alias("read_count"), (cp / n).alias("mean_confidence"))
    if min_reads_per_cell > 1:
        m = m.withColumn("_c", F.sum("read_count").over(Window.partitionBy("cell"))).filter(F.col("_c") >= min_reads_per_cell).drop("_c")
    if min_reads_per_paralog > 1:
        m = m.join(m.groupBy("paralog").agg(F.sum("read_count").alias("_p")).filter(F.col("_p") >= min_reads_per_paralog), "paralog").drop("_p")
    return m


def row_normalised(m: DataFrame) -> DataFrame:
    return m.withColumn("normalised", F.col("value") / F.sum("value").over(Window.partitionBy("cell")))


def dense(m: DataFrame, paralogs: list[str]) -> DataFrame:
    """One column for each paralog, 0 where a cell lacks it."""
    return m.groupBy("cell").pivot("paralog", paralogs).agg(F.first("value")).na.fill(0.0)


def matrix_stats(m: DataFrame) -> DataFrame:
    s = m.agg(F.count_distinct("cell").alias("n_cells"), F.count_distinct("paralog").alias("n_paralogs"), F.count("*").alias("nnz"), F.sum("read_count").alias("total_reads"))
    return s.withColumn("sparsity", F.when(F.col("nnz") > 0, 1 - ratio(F.col("nnz"), F.col("n_cells") * F.col("n_paralogs"))).otherwise(0.0))


def dominance(values: Column) -> Column:
    """Largest over second largest of a descending array: 1 for one value, 100 if the second is about 0."""
    return F.when(F.size(values) < 2, 1.0).when(values[1] <= 1e-9, 100.0).otherwise(values[0] / values[1])


def cell_qc(m: DataFrame, confidence: float = 0.5) -> DataFrame:
    share = m.withColumn("share", F.col("value") / F.sum("value").over(Window.partitionBy("cell")))
    return share.groupBy("cell").agg(
        F.sum("read_count").alias("total_reads"), F.sum(F.when(F.col("value") > 0, F.col("read_count")).otherwise(0)).alias("assigned_reads"),
        F.sum(F.when(F.col("mean_confidence") >= confidence, F.col("read_count")).otherwise(0)).alias("confident_reads"), F.count("*").alias("n_paralogs"),
        F.avg("mean_confidence").alias("mean_confidence"), F.expr("percentile(mean_confidence, 0.5)").alias("median_confidence"), entropy(F.col("share"), 1e-9).alias("entropy"),
        F.sort_array(F.collect_list("value"), asc=False).alias("_values"),
    ).withColumn("assignment_rate", F.col("assigned_reads") / F.col("total_reads")).withColumn("dominance", dominance(F.col("_values"))).drop("_values")


def paralog_qc(m: DataFrame) -> DataFrame:
    """Per paralog; the number of cells is one row that every group takes."""
    total = m.agg(F.count_distinct("cell").alias("_cells"))
    var = F.coalesce(F.var_samp("value"), F.lit(0.0))
    g = m.groupBy("paralog").agg(F.count("*").alias("n_cells"), F.sum("read_count").alias("reads"), F.avg("value").alias("mean_p"), F.expr("percentile(value, 0.5)").alias("median_p"), var.alias("variance_p"))
    return g.join(F.broadcast(total)).withColumn("cv", F.when(F.col("mean_p") > 0, F.sqrt("variance_p") / F.col("mean_p")).otherwise(0.0)).withColumn("detection_rate", F.col("n_cells") / F.col("_cells")).drop("_cells")


def passing(qc: DataFrame, *, reads: int = 10, paralogs: int = 1, rate: float = 0.1, confidence: float = 0.5, most_entropy: float = 1.5) -> DataFrame:
    return qc.filter(
        (F.col("total_reads") >= reads) & (F.col("n_paralogs") >= paralogs) & (F.col("assignment_rate") >= rate) & (F.col("mean_confidence") >= confidence) & (F.col("entropy") <= most_entropy)
    )


def histogram(df: DataFrame, value: str, width: float = 0.1) -> DataFrame:
    """Counts by bin; values at or above the last bin belong to it."""
    last = round(1 / width + 0.4999) - 1
    b = F.least(F.floor(F.col(value) / width), F.lit(last)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def moments(df: DataFrame, value: str, threshold: float = 0.5) -> DataFrame:
    """Mean, median, sample deviation, and the skewness that divides central moments by the sample deviation."""
    x = F.col(value).cast("double")
    s = df.agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("_g"), F.var_pop(x).alias("_v"),
        F.count_if(x < threshold).alias("below"), F.count_if(x >= threshold).alias("above"),
    )
    # Spark's skewness has the population deviation in its denominator.
    return s.withColumn("skewness", F.when(F.col("sd") > 0, F.col("_g") * F.pow(F.sqrt("_v") / F.col("sd"), 3)).otherwise(0.0)).drop("_g", "_v")
