"""Stall detection over the entropies of iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def states(df: DataFrame, key: str, order: str, entropy: str, *, window: int = 5, swing: float = 0.1, least: float = 0.01, ratio: float = 0.8) -> DataFrame:
    """Adds ``state``: Warming, Oscillating, NoProgress, HighUncertainty or Fine, from the last ``window`` entropies."""
    w = Window.partitionBy(key).orderBy(order)
    e = F.col(entropy)
    d = df.withColumn("_d", e - F.lag(e).over(w)).withColumn("_f", F.when(F.col("_d") * F.lag("_d").over(w) < 0, 1).otherwise(0))
    full, inner, deltas = (w.rowsBetween(-(window - k), 0) for k in (1, 3, 2))
    first = F.first_value(e).over(full)
    state = (
        F.when(F.count("*").over(full) < window, "Warming").when((F.sum("_f").over(inner) >= 2) & (F.max(F.abs("_d")).over(deltas) > swing), "Oscillating")
        .when(F.abs(first - e) < least, "NoProgress").when(e / first > ratio, "HighUncertainty").otherwise("Fine")
    )
    return d.withColumn("state", state).drop("_d", "_f")
