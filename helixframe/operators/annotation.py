"""Region rules and annotation layers."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import islands, points_in_intervals

OVERRIDES = ("lambda_scale", "weight_scale")


@dataclass(frozen=True)
class Predicate:
    """One test of a window feature: ge, le, eq, range, in, is_null; gt and lt are taken as ge and le."""

    feature: str
    op: str
    lo: float = 0.0
    hi: float = 0.0
    values: tuple = ()

    def column(self, features: list[str]) -> Column:
        if self.feature not in features:
            return F.lit(False)
        x = F.col(self.feature)
        missing = x.isNull() | ((x < 0) if self.feature == "tandem_period" else F.lit(False))
        tests = {"ge": x >= self.lo, "gt": x >= self.lo, "le": x <= self.lo, "lt": x <= self.lo, "eq": F.abs(x - self.lo) <= 1e-6, "range": x.between(self.lo, self.hi), "in": x.isin(*self.values) if self.values else F.lit(False), "is_null": missing}
        test = tests.get(self.op, F.lit(False))
        return test if self.op == "is_null" else F.coalesce(test & ~missing, F.lit(False))


@dataclass(frozen=True)
class Rule:
    name: str
    priority: int
    predicates: tuple[Predicate, ...] = ()
    hints: dict = field(default_factory=dict)


def load_rules(text: str) -> list[Rule]:
    """Rules of a JSON document; both key spellings in use are read."""
    rules = []
    for r in json.loads(text).get("rules", []):
        raw = r.get("predicates", r.get("predicate", r.get("feature_signature", [])))
        raw = [{"feature": k, **({"op": "eq", "lo": v} if not isinstance(v, dict) else {"op": next(iter(v)), "lo": next(iter(v.values()))})} for k, v in raw.items()] if isinstance(raw, dict) else raw
        tests = tuple(Predicate(p["feature"], p["op"], float(p.get("lo", p.get("value", 0)) or 0), float(p.get("hi", 0) or 0), tuple(p.get("values", ()))) for p in raw)
        rules.append(Rule(r.get("region_name", r.get("region", "")), int(r.get("priority", 0)), tests, r.get("mapping_hints", {})))
    return rules


def classify(windows: DataFrame, rules: list[Rule], out: str = "region") -> DataFrame:
    """The first rule, by descending priority, whose predicates all hold; a rule without predicates always does."""
    result = None
    for r in sorted(rules, key=lambda r: -r.priority):
        test = F.lit(True)
        for p in r.predicates:
            test = test & p.column(windows.columns)
        result = F.when(test, r.name) if result is None else result.when(test, r.name)
    return windows.withColumn(out, result if result is not None else F.lit(None).cast("string"))


def merged(classified: DataFrame, key: str, label: str = "region") -> DataFrame:
    return islands(classified.filter(F.col(label).isNotNull()), [key], "start", "end", label)


def parameters_at(points: DataFrame, intervals: DataFrame, *, on: str = "ref_id", most: int = 32, width: int = 256) -> DataFrame:
    """Each point with the parameters of the intervals that cover it: of each, the highest layer's that sets it.

    At most the ``most`` intervals of highest layer count, as the stab query has it; ties go to the later start.
    """
    keys = [c for c in points.columns if c != on]
    hits = points_in_intervals(points, intervals, on=[on], width=width)
    w = Window.partitionBy(on, *keys).orderBy(F.desc("layer"), F.desc("start"), F.desc("interval_id"))
    top = hits.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most)
    return top.groupBy(on, *keys).agg(F.count("*").alias("n_intervals"), F.max("layer").alias("top_layer"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_k"))).alias(c) for c in OVERRIDES])


def overlay(df: DataFrame, over: list[str], under: list[str], out: list[str]) -> DataFrame:
    """The upper list's parameters, where set, over the lower's."""
    return df.withColumns({o: F.coalesce(a, b) for a, b, o in zip(over, under, out)})


def overlay(regions: DataFrame, rules: DataFrame, hints: DataFrame) -> DataFrame:
    """(region, source, weight): what a rule says of a region, else the hint of its own file, else weight 1 from nowhere."""
    r, h = rules.select("region", F.col("weight").alias("_r")), hints.select("region", F.col("weight").alias("_h"))
    j = regions.select("region").join(r, "region", "left").join(h, "region", "left")
    return j.select("region", F.when(F.col("_r").isNotNull(), "rule").when(F.col("_h").isNotNull(), "hint").alias("source"), F.coalesce("_r", "_h", F.lit(1.0)).alias("weight"))
