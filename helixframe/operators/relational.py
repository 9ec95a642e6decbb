"""Generic relational operators: ranking, normalisation, islands, and range joins as bin equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; partial limits run before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def top_two(df: DataFrame, keys: Sequence[str], bucket: str, p: str) -> DataFrame:
    """Largest and second probability of each group with their buckets; ties go to the smaller bucket.

    An aggregate, not a window: two candidates a group and task leave the map side.
    """
    best = F.max_by(bucket, F.struct(F.col(p), -F.col(bucket)))
    first = df.groupBy(*keys).agg(F.max(p).alias("max_p"), best.alias("best_bucket"))
    rest = df.join(first, list(keys)).filter(F.col(bucket) != F.col("best_bucket"))
    second = rest.groupBy(*keys).agg(F.max(p).alias("second_p"), best.alias("second_bucket"))
    return first.join(second, list(keys), "left")


def best_fraction(df: DataFrame, keys: Sequence[str], score: str, fraction: float) -> DataFrame:
    """Rows whose score is at least the truncated fraction of their group's best."""
    best = F.max(score).over(Window.partitionBy(*keys))
    return df.withColumn("_best", best).filter(F.col(score) >= F.floor(F.col("_best") * fraction)).drop("_best")


def normalise(df: DataFrame, keys: Sequence[str], value: str, out: str, floor: float = 1e-10) -> DataFrame:
    """Values over their group's sum; uniform where the sum is at most ``floor``."""
    w = Window.partitionBy(*keys)
    total = F.sum(value).over(w)
    return df.withColumn(out, F.when(total > floor, F.col(value) / total).otherwise(F.lit(1.0) / F.count(F.lit(1)).over(w)))


def softmax(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    shifted = F.exp(F.col(value) - F.max(value).over(w))
    return df.withColumn("_e", shifted).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def entropy(p: Column, least: float = 1e-10) -> Column:
    """Aggregate: entropy in bits of the probabilities above ``least``."""
    return -F.sum(F.when(p > least, p * F.log2(p)).otherwise(F.lit(0.0)))


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, label: str) -> DataFrame:
    """Adjacent intervals of equal label merged: a new island begins where the one before ends elsewhere or is named differently."""
    w = Window.partitionBy(*keys).orderBy(start)
    fresh = F.when((F.lag(end).over(w) == F.col(start)) & F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)
    numbered = df.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.first(label).alias(label), F.count("*").alias("n_windows")).drop("_island")


def relabel(df: DataFrame, label: str, order: str, out: str) -> DataFrame:
    """Labels numbered from 0 in the order of their first appearance."""
    first = df.groupBy(label).agg(F.min(order).alias("_first"))
    return df.join(dense_ids(first, ["_first", label], out).drop("_first"), label)


def dense_ids(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Rows numbered from 0 in an order, without a global window: ranges are sorted apart, then each adds the sizes of those before."""
    at = F.monotonically_increasing_id()
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))  # one row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("_range", before.alias("_before")), "_range").withColumn(out, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def points_in_intervals(points: DataFrame, intervals: DataFrame, *, on: Sequence[str], pos: str = "pos", start: str = "start", end: str = "end", width: int = 256) -> DataFrame:
    """Pairs with ``start <= pos < end``: an equi-join on bins of ``width``, intervals once for each bin they touch."""
    left = points.withColumn("_bin", F.floor(F.col(pos) / width))
    right = intervals.filter(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return left.join(right, [*on, "_bin"]).filter((F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(end))).drop("_bin")


def overlapping(a: DataFrame, b: DataFrame, *, on: Sequence[str], a_span: tuple[str, str], b_span: tuple[str, str], width: int = 256) -> DataFrame:
    """Pairs of intervals that overlap; a pair is kept in the bin of the later start alone."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    joined = a.withColumn("_bin", bins(*a_span)).join(b.withColumn("_bin", bins(*b_span)), [*on, "_bin"])
    (s1, e1), (s2, e2) = a_span, b_span
    meets = (F.col(s1) < F.col(e2)) & (F.col(s2) < F.col(e1))
    return joined.filter(meets & (F.floor(F.greatest(s1, s2) / width) == F.col("_bin"))).drop("_bin")


def within_distance(df: DataFrame, *, key: str, pos: str, on: Sequence[str], radius: int) -> DataFrame:
    """Ordered pairs of different rows at most ``radius`` apart: (on, key, pos, key_2, pos_2)."""
    left = df.select(*on, key, pos).withColumn("_bin", F.floor(F.col(pos) / radius))
    right = df.select(*on, F.col(key).alias(f"{key}_2"), F.col(pos).alias(f"{pos}_2")).withColumn("_bin", F.explode(F.array(*[F.floor(F.col(f"{pos}_2") / radius) + k for k in (-1, 0, 1)])))
    return left.join(right, [*on, "_bin"]).filter((F.col(key) != F.col(f"{key}_2")) & (F.abs(F.col(pos) - F.col(f"{pos}_2")) <= radius)).drop("_bin")
