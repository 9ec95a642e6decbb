"""Probability waves over hierarchical buckets: expectation-maximisation, collapse, refinement, propagation.

A wave is a long table (read_id, bucket_id, p). All steps are joins, aggregates and windows, so they are checked
against SQL; the loops in :func:`run_em` and :func:`run_levels` bring one row of statistics to the driver a round.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import bounded, cut, ratio
from .relational import entropy, normalise, top_k, top_two, within_distance


@dataclass(frozen=True)
class EmConfig:
    gamma: float = 0.3
    likelihood_weight: float = 1.0
    coverage_weight: float = 1.0
    ai_weight: float = 1.0
    bio_weight: float = 1.0
    least_coverage: float = 0.001
    collapse: float = 0.99
    max_rounds: int = 50
    epsilon: float = 1e-5


def coverage(wave: DataFrame) -> DataFrame:
    """Expected reads for each bucket; a bucket has one row, so hot buckets are summed map-side."""
    return wave.groupBy("bucket_id").agg(F.sum("p").alias("coverage"))


def few_buckets(wave: DataFrame, most: int = 100_000) -> bool:
    """Whether a wave has at most ``most`` buckets; later waves of the same level have no others."""
    return wave.select("bucket_id").distinct().limit(most + 1).count() <= most


def neighbourhood(buckets: DataFrame, *, sigma: float = 100_000.0, least: float = 0.001, most: int = 20, key: str = "bucket_id", pos: str = "pos", contig: str = "contig") -> DataFrame:
    """(bucket_id, neighbour, weight): Gaussian weights of buckets of the same contig, the heaviest ``most`` each."""
    radius = int(sigma * math.sqrt(-2 * math.log(least)))
    pairs = within_distance(buckets, key=key, pos=pos, on=[contig], radius=radius)
    gap = (F.col(pos) - F.col(f"{pos}_2")).cast("double")
    weighted = pairs.withColumn("weight", F.exp(-gap * gap / (2 * sigma * sigma))).filter(F.col("weight") >= least)
    return top_k(weighted, [key], [F.desc("weight"), F.col(f"{key}_2")], most).select(F.col(key).alias("bucket_id"), F.col(f"{key}_2").alias("neighbour"), "weight")


def smoothing(wave: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(read_id, bucket_id, support): the weighted mass that a read has on a bucket's neighbours."""
    return wave.select("read_id", F.col("bucket_id").alias("neighbour"), F.col("p").alias("_q")).join(neighbours, "neighbour").groupBy("read_id", "bucket_id").agg(F.sum(F.col("weight") * F.col("_q")).alias("support"))


def em_step(wave: DataFrame, *, config: EmConfig = EmConfig(), likelihood: Column | None = None, ai_prior: Column | None = None, bio: DataFrame | None = None, neighbours: DataFrame | None = None, evidence: DataFrame | None = None, few: bool = False) -> DataFrame:
    """One round: damped update by likelihood, coverage and priors, then normalisation for each read.

    ``few``: the buckets' number has been checked (:func:`few_buckets`), so that what each of them has is sent to all tasks
    and the wave stays where its reads are; else it is joined by bucket. ``evidence``: (read_id, bucket_id, likelihood) of a
    read's own, absent pairs have 0; ``bio``: (bucket_id, bio_prior), absent buckets weigh 1; ``neighbours``: as :func:`neighbourhood` gives them.
    """
    c = config
    side = F.broadcast if few else (lambda df: df)
    w = wave.join(side(coverage(wave)), "bucket_id")
    f = F.greatest("coverage", F.lit(c.least_coverage)) if c.coverage_weight == 1 else F.pow(F.greatest("coverage", F.lit(c.least_coverage)), F.lit(c.coverage_weight))
    for term, weight in ((likelihood, c.likelihood_weight), (ai_prior, c.ai_weight)):
        if term is not None:
            f = f * (term if weight == 1 else F.pow(term, F.lit(weight)))
    if evidence is not None:
        w = w.join(evidence.select("read_id", "bucket_id", F.col("likelihood").alias("_l")), ["read_id", "bucket_id"], "left")
        own = F.coalesce("_l", F.lit(0.0))
        f = f * (own if c.likelihood_weight == 1 else F.pow(own, F.lit(c.likelihood_weight)))
    if bio is not None:
        w = w.join(side(bio.select("bucket_id", "bio_prior")) if few and few_buckets(bio) else bio.select("bucket_id", "bio_prior"), "bucket_id", "left")
        prior = F.coalesce("bio_prior", F.lit(1.0))
        f = f * (prior if c.bio_weight == 1 else F.pow(prior, F.lit(c.bio_weight)))
    if neighbours is not None:
        w = w.join(smoothing(wave, neighbours), ["read_id", "bucket_id"], "left")
        f = f * (1 + F.coalesce("support", F.lit(0.0)))
    return normalise(w.withColumn("_f", (1 - c.gamma) * F.col("p") + c.gamma * f), ["read_id"], "_f", "p").select("read_id", "bucket_id", "p")


def smooth(wave: DataFrame, neighbours: DataFrame) -> DataFrame:
    """One pass of neighbour support alone."""
    w = wave.join(smoothing(wave, neighbours), ["read_id", "bucket_id"], "left")
    return normalise(w.withColumn("_f", F.col("p") * (1 + F.coalesce("support", F.lit(0.0)))), ["read_id"], "_f", "p").select("read_id", "bucket_id", "p")


def em_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    both = after.join(before.withColumnRenamed("p", "_old"), ["read_id", "bucket_id"])
    per = both.groupBy("read_id").agg(F.max(F.abs(F.col("p") - F.col("_old"))).alias("delta"), entropy(F.col("p")).alias("entropy"), F.max("p").alias("max_p"))
    return per.agg(F.count("*").alias("n_reads"), F.max("delta").alias("max_delta"), F.avg("entropy").alias("mean_entropy"), F.count_if(F.col("max_p") >= 0.99).alias("n_collapsed"))


def run_em(wave: DataFrame, *, config: EmConfig = EmConfig(), on_round: Callable | None = None, on_stall: Callable | None = None, stop_rate: float | None = None, **terms) -> tuple[DataFrame, DataFrame]:
    """Rounds until nothing moves by more than epsilon; (active wave, collapsed reads). Collapsed reads leave the loop.

    ``stop_rate``: the share of collapsed reads from which the level is left. ``on_round(round, statistics)`` sees each
    round; ``on_stall(round, state)`` is called where the entropies of the last five rounds say that they get nowhere, and
    ends the loop by returning True.
    """
    done: DataFrame | None = None
    now = cut(wave)
    entropies: list[float] = []
    total, fallen, few = None, 0, few_buckets(now)
    for k in range(config.max_rounds):
        after = cut(em_step(now, config=config, few=few, **terms))
        stats = em_stats(now, after).first()
        if on_round:
            on_round(k, stats.asDict())
        fixed = collapse(after, config.collapse).filter("collapsed")
        done = fixed if done is None else done.unionByName(fixed)
        now = after.join(fixed.select("read_id"), "read_id", "left_anti")
        total = stats["n_reads"] if total is None else total
        fallen += stats["n_collapsed"] if config.collapse == 0.99 else fixed.count()
        if not stats["n_reads"] or stats["max_delta"] < config.epsilon or (stop_rate is not None and fallen >= stop_rate * total):
            break
        entropies.append(stats["mean_entropy"] or 0.0)
        state = stall_state(entropies)
        if on_stall and state in ("Oscillating", "NoProgress") and on_stall(k, state):
            break
        now = cut(now)
    return now, done


def stall_state(entropies: list[float], *, window: int = 5, swing: float = 0.1, least: float = 0.01, ratio_: float = 0.8) -> str:
    """What :func:`stall.states` says of the last of a run's mean entropies."""
    last = entropies[-window:]
    if len(last) < window:
        return "Warming"
    delta = [b - a for a, b in zip(last, last[1:])]
    if sum(a * b < 0 for a, b in zip(delta[-4:], delta[-3:])) >= 2 and max(map(abs, delta)) > swing:
        return "Oscillating"
    if abs(last[0] - last[-1]) < least:
        return "NoProgress"
    return "HighUncertainty" if last[0] and last[-1] / last[0] > ratio_ else "Fine"


def collapse(wave: DataFrame, threshold: float = 0.99) -> DataFrame:
    """(read_id, max_p, best_bucket, collapsed)."""
    best = wave.groupBy("read_id").agg(F.max("p").alias("max_p"), F.max_by("bucket_id", F.struct(F.col("p"), -F.col("bucket_id"))).alias("best_bucket"))
    return best.withColumn("collapsed", F.col("max_p") >= threshold)


def classify(wave: DataFrame, *, converged: float = 0.99, gap: float = 0.05, low: float = 0.5) -> DataFrame:
    """Why a read isn't placed: Orphaned, Converged, Ambiguous, LowConfidence or None."""
    t = top_two(wave, ["read_id"], "bucket_id", "p")
    p1, p2 = F.col("max_p"), F.coalesce("second_p", F.lit(0.0))
    kind = F.when(p1 < 1e-9, "Orphaned").when(p1 >= converged, "Converged").when((p1 - p2 < gap) & (p2 > 0), "Ambiguous").when(p1 < low, "LowConfidence").otherwise("None")
    return t.withColumn("dropout", kind).join(wave.groupBy("read_id").agg(entropy(F.col("p")).alias("entropy")), "read_id")


def collapse_stats(classified: DataFrame) -> DataFrame:
    kinds = ("Orphaned", "Converged", "Ambiguous", "LowConfidence", "None")
    s = classified.agg(F.count("*").alias("n_reads"), *[F.count_if(F.col("dropout") == k).alias(f"n_{k.lower()}") for k in kinds], F.avg("max_p").alias("mean_max_p"), F.min("max_p").alias("min_max_p"), F.max("max_p").alias("max_max_p"), F.avg("entropy").alias("mean_entropy"))
    return s.withColumn("collapse_rate", ratio("n_converged", "n_reads")).withColumn("dropout_rate", F.when(F.col("n_reads") > 0, 1 - ratio(F.col("n_converged") + F.col("n_none"), "n_reads")).otherwise(0.0))


def refine(wave: DataFrame, children: DataFrame, *, least: float = 0.01, prior: str | None = None) -> DataFrame:
    """The wave one level finer: candidates of at least ``least`` share their mass among all their children (parent, child)."""
    weight = F.col(prior) if prior else F.lit(1.0)
    # Shares are computed among the children, before they meet the reads: no window over the joined rows.
    split = children.select(F.col("parent").alias("bucket_id"), "child", (weight / F.sum(weight).over(Window.partitionBy("parent"))).alias("_w"))
    # One shuffle, by read: the sum over a child's parents and the normalisation find their rows together.
    parts = wave.filter(F.col("p") >= least).join(split, "bucket_id").repartition("read_id")
    share = F.col("p") * F.col("_w")
    merged = parts.withColumn("_s", share).groupBy("read_id", F.col("child").alias("bucket_id")).agg(F.sum("_s").alias("p"))
    return normalise(merged, ["read_id"], "p", "p")


def refine_shared(wave: DataFrame, children: DataFrame, *, least: float = 0.01) -> DataFrame:
    """(read_id, parent, n, p): :func:`refine` over a tree, where all n children of a parent have the same p, without a row for each."""
    n = children.groupBy("parent").agg(F.count("*").alias("n"))
    parts = wave.filter(F.col("p") >= least).join(n.withColumnRenamed("parent", "bucket_id"), "bucket_id")
    return normalise(parts, ["read_id"], "p", "_t").select("read_id", F.col("bucket_id").alias("parent"), "n", (F.col("_t") / F.col("n")).alias("p"))


def should_refine(wave: DataFrame, *, sure: float = 0.9, share: float = 0.8) -> DataFrame:
    s = wave.groupBy("read_id").agg(F.max("p").alias("m")).agg(F.count("*").alias("n_reads"), F.count_if(F.col("m") >= sure).alias("n_sure"))
    return s.withColumn("share", ratio("n_sure", "n_reads")).withColumn("refine", F.col("share") >= share)


def run_levels(reads: DataFrame, levels: list[DataFrame], children: list[DataFrame], *, config: EmConfig = EmConfig(), evidence: list[DataFrame] | None = None, level_rate: float = 0.8, **terms) -> DataFrame:
    """Uniform start over the coarsest buckets, then EM and refinement level by level: the finest wave.

    A level above the finest is also left once ``level_rate`` of its reads have collapsed.

    ``levels[0]``: (bucket_id); ``children[i]``: (parent, child) from level i to i + 1; ``evidence[i]``: as
    :func:`em_step` takes it, for the buckets of level i.
    """
    n = levels[0].count()
    wave = reads.select("read_id").join(bounded(levels[0].select("bucket_id"))).withColumn("p", F.lit(1.0 / max(n, 1)))
    for k in range(len(children) + 1):
        if k:
            wave = refine(wave, children[k - 1])
        last = k == len(children)
        active, done = run_em(wave, config=config, evidence=evidence[k] if evidence else None, stop_rate=None if last else level_rate, **terms)
        fixed = done.select("read_id", F.col("best_bucket").alias("bucket_id"), F.lit(1.0).alias("p"))
        wave = cut(active.select("read_id", "bucket_id", "p").unionByName(fixed))
    return wave


def extract(collapsed: DataFrame, buckets: DataFrame) -> DataFrame:
    """(read_id, target, position, confidence) of collapsed reads: the start of their bucket (bucket_id, target, start)."""
    return collapsed.filter("collapsed").join(buckets, collapsed["best_bucket"] == buckets["bucket_id"]).select("read_id", "target", F.col("start").alias("position"), F.col("max_p").alias("confidence"))


def bucket_estimate(targets: DataFrame, size: int) -> DataFrame:
    return targets.agg(F.sum("length").alias("total_length"), F.sum(F.ceil(F.col("length") / size)).cast("long").alias("n_buckets"))


def member_confidence(rep: Column, similarity: Column, cohesion: Column) -> Column:
    """Confidence that a member inherits from its representative, between 0.1 and 0.95."""
    x = rep * 0.8 * (1 - 0.5 + 0.5 * similarity) * (1 - 0.3 + 0.3 * cohesion) * F.when(similarity < 0.3, 0.5).otherwise(1.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(0.95), x))


def propagate(members: DataFrame, wave: DataFrame, cohesion: DataFrame, *, most: int = 10) -> DataFrame:
    """Members' waves from their representatives' ten best candidates: (read_id, bucket_id, p, confidence).

    ``members``: (read_id, rep_id, cluster_id, similarity or null); ``cohesion``: (cluster_id, cohesion).
    """
    best = normalise(top_k(wave, ["read_id"], [F.desc("p"), F.col("bucket_id")], most), ["read_id"], "p", "p")
    best = best.join(wave.groupBy("read_id").agg(F.max("p").alias("rep_p")), "read_id").select(F.col("read_id").alias("rep_id"), "bucket_id", "p", "rep_p")
    m = members.join(cohesion, "cluster_id", "left").withColumn("_s", F.coalesce("similarity", F.lit(0.01)))
    return m.join(best, "rep_id").select("read_id", "bucket_id", "p", member_confidence(F.col("rep_p"), F.col("_s"), F.coalesce("cohesion", F.lit(0.0))).alias("confidence"))


def propagation_stats(members: DataFrame) -> DataFrame:
    """One row over propagated waves (read_id, bucket_id, p, confidence)."""
    return members.agg(F.count_distinct("read_id").alias("n_members"), F.count("*").alias("n_entries"), F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("min_confidence"), F.avg("p").alias("mean_p"))


def pyramid_tiles(targets: DataFrame, *, coarse: int = 5_000_000, fine: int = 50_000) -> DataFrame:
    """(level, bucket_id, ref_id, start, end, parent): targets tiled at two sizes, ids in order of targets and starts."""
    tiles = lambda level, size: targets.filter("length > 0").select(F.lit(level).alias("level"), "ref_id", F.col("length"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"), F.lit(size).alias("_size"))
    both = tiles(1, coarse).unionByName(tiles(2, fine)).withColumn("end", F.least(F.col("start") + F.col("_size"), F.col("length")))
    # Ids by offsets of the targets' tile counts: no window over all tiles.
    counts = targets.select("ref_id", *[F.ceil(F.col("length") / s).cast("long").alias(f"_n{k}") for k, s in ((1, coarse), (2, fine))])
    before = Window.orderBy("ref_id").rowsBetween(Window.unboundedPreceding, -1)  # one row for each target
    offsets = counts.select("ref_id", *[F.coalesce(F.sum(f"_n{k}").over(before), F.lit(0)).alias(f"_o{k}") for k in (1, 2)])
    own = F.when(F.col("level") == 1, F.col("_o1")).otherwise(F.col("_o2")) + F.floor(F.col("start") / F.col("_size"))
    parent = F.when(F.col("level") == 2, F.col("_o1") + F.floor(F.col("start") / coarse))
    return both.join(offsets, "ref_id").select("level", own.cast("long").alias("bucket_id"), "ref_id", "start", "end", parent.cast("long").alias("parent"))
