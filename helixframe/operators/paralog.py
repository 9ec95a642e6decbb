"""Paralog-specific variants: likelihoods, posteriors, informativeness, catalogue building; anchors of exon copies."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cigar import bases_at
from ..functions.sequence import code_of, hamming, kmers, seeds_in
from ..runtime import bounded
from .relational import points_in_intervals, softmax


def likelihoods(obs: DataFrame, sites: DataFrame, paralogs: DataFrame, *, error: float = 0.01, min_quality: int = 20, min_informativeness: float = 0.5) -> DataFrame:
    """(read_id, paralog, log_likelihood, support, conflict) of every paralog for each read with an observation.

    ``obs``: (read_id, psv_id, base, base_quality); ``sites``: (psv_id, paralog, allele, informativeness). Sites that
    lack a paralog's allele add nothing to it. Sites join by id; only paralog names, of a checked number, are sent everywhere.
    """
    info = sites.groupBy("psv_id").agg(F.max("informativeness").alias("_inf")).filter(F.col("_inf") >= min_informativeness).select("psv_id")
    o = obs.filter(F.col("base_quality") >= min_quality).join(info, "psv_id")
    told = o.join(sites.select("psv_id", "paralog", "allele"), "psv_id")
    hit = F.col("base") == F.col("allele")
    known = told.groupBy("read_id", "paralog").agg(
        F.sum(F.when(hit, math.log(1 - error)).otherwise(math.log(error / 3))).alias("_l"), F.count_if(hit).alias("_s"), F.count_if(~hit).alias("_c")
    )
    each = o.select("read_id").distinct().join(bounded(paralogs))
    return each.join(known, ["read_id", "paralog"], "left").select("read_id", "paralog", F.coalesce("_l", F.lit(0.0)).alias("log_likelihood"), F.coalesce("_s", F.lit(0)).alias("support"), F.coalesce("_c", F.lit(0)).alias("conflict"))


def posteriors(likelihood: DataFrame) -> DataFrame:
    """Adds ``posterior`` under a uniform prior."""
    return softmax(likelihood, ["read_id"], "log_likelihood", "posterior")


def assignments(posterior: DataFrame, *, sure: float = 0.9) -> DataFrame:
    """(read_id, paralog, posterior, entropy, assigned, ambiguous): the best paralog, ties to the smaller name."""
    p = F.col("posterior")
    return posterior.groupBy("read_id").agg(
        F.max(p).alias("posterior"), F.min_by("paralog", F.struct(-p, F.col("paralog"))).alias("paralog"), (-F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0))).alias("entropy")
    ).withColumn("assigned", F.col("posterior") >= sure).withColumn("ambiguous", F.col("posterior") < sure)


def informativeness(sites: DataFrame) -> DataFrame:
    """(psv_id, n_paralogs, n_alleles, informativeness): allele entropy over the log of the number of paralogs."""
    a = sites.groupBy("psv_id", "allele").agg(F.count("*").alias("n"))
    total, h = F.sum("n"), F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")
    g = a.groupBy("psv_id").agg(total.alias("n_paralogs"), F.count("*").alias("n_alleles"), h.alias("_h"))
    return g.withColumn("informativeness", F.when((F.col("n_alleles") > 1) & (F.col("n_paralogs") > 1), F.col("_h") / F.log2("n_paralogs")).otherwise(0.0)).drop("_h")


def merge_calls(a: DataFrame, b: DataFrame, weight: float = 0.5) -> DataFrame:
    """Two calls (read_id, paralog, p, n_psvs) as one: a product where both saw variants, else a weighted mean; normalised."""
    x = a.select("read_id", "paralog", F.col("p").alias("_p"), F.col("n_psvs").alias("_n"))
    y = b.select("read_id", "paralog", F.col("p").alias("_q"), F.col("n_psvs").alias("_m"))
    j = x.join(y, ["read_id", "paralog"], "full")
    w = Window.partitionBy("read_id")
    both = (F.coalesce(F.max("_n").over(w), F.lit(0)) > 0) & (F.coalesce(F.max("_m").over(w), F.lit(0)) > 0)
    p, q = F.coalesce("_p", F.lit(0.0)), F.coalesce("_q", F.lit(0.0))
    v = j.withColumn("_v", F.when(both, p * q).otherwise((1 - weight) * p + weight * q))
    total = F.sum("_v").over(w)
    return v.withColumn("p", F.when(total > 0, F.col("_v") / total).otherwise(0.0)).select("read_id", "paralog", "p")


def catalogue(sequences: DataFrame, *, least: float = 0.5) -> DataFrame:
    """Variant sites of aligned paralog sequences (paralog, seq): (pos, paralog, allele, informativeness).

    Columns up to the shortest sequence; kept if informative.
    """
    shortest = sequences.agg(F.min(F.length("seq")).alias("_n"))
    cols = sequences.join(F.broadcast(shortest)).filter("_n > 0").select("paralog", F.posexplode(F.split(F.substr("seq", F.lit(1), F.col("_n")), "")).alias("pos", "allele")).filter("allele <> ''")
    info = informativeness(cols.withColumnRenamed("pos", "psv_id")).filter(F.col("informativeness") >= least).select(F.col("psv_id").alias("pos"), "informativeness")
    return cols.join(info, "pos")


def sites_in(spans: DataFrame, sites: DataFrame, *, on: str = "chrom") -> DataFrame:
    """Pairs of spans (chrom, start, end) and sites (chrom, pos) with ``start <= pos <= end``, by bins."""
    return points_in_intervals(sites, spans.withColumn("_end", F.col("end") + 1), on=[on], end="_end").drop("_end")


def observations(hits: DataFrame, sites: DataFrame, *, quality: int = 30, width: int = 256) -> DataFrame:
    """(read_id, hit, psv_id, base, read_pos, base_quality): the bases that alignments have at variant sites.

    ``hits``: (read_id, hit, chrom, start, end, cigar, seq), ``sites``: (psv_id, chrom, pos), one row a site. A hit meets
    the lists of the bins of ``width`` that it touches, so it is shuffled once for each and its bases are not; a deleted
    site gives nothing.
    """
    lists = sites.filter("pos is not null").groupBy("chrom", F.floor(F.col("pos") / width).alias("_bin")).agg(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "psv_id")).alias("_sites"))  # a bin has at most ``width`` places
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
    met = hits.filter("end >= start").select("read_id", "hit", "chrom", "start", "end", "cigar", "seq", bins.alias("_bin")).join(lists, ["chrom", "_bin"])
    inside = F.filter("_sites", lambda x: x["pos"].between(F.col("start"), F.col("end")))
    met = met.select("read_id", "hit", "cigar", F.col("start").cast("long").alias("start"), "seq", F.transform(inside, lambda x: x["pos"]).alias("_at"), F.transform(inside, lambda x: x["psv_id"]).alias("psv_id")).filter(F.size("_at") > 0)
    return bases_at(met, ["read_id", "hit"], "psv_id").select("read_id", "hit", "psv_id", "base", "read_pos", F.lit(quality).alias("base_quality"))


def updated_calls(called: DataFrame, posterior: DataFrame, *, weight: float = 0.5) -> DataFrame:
    """Records' paralog calls (read_id, paralog, p, n_psvs) after new posteriors (the same columns): merged where a read has a call."""
    old = called.select("read_id").distinct()
    both = merge_calls(called.join(posterior.select("read_id").distinct(), "read_id", "left_semi"), posterior.join(old, "read_id", "left_semi"), weight)
    kept = called.join(posterior.select("read_id").distinct(), "read_id", "left_anti").select("read_id", "paralog", "p")
    return both.unionByName(kept).unionByName(posterior.join(old, "read_id", "left_anti").select("read_id", "paralog", "p"))


def allele_code(base: Column) -> Column:
    """A, C, G, T and deletions as 0 to 4, everything else 5."""
    at = F.instr(F.lit("ACGT-"), F.upper(base))
    return F.when((F.length(base) == 1) & (at > 0), at - 1).otherwise(5)


def allele_of(code: Column) -> Column:
    return F.when(code.between(0, 4), F.substring(F.lit("ACGT-"), (code + 1).cast("int"), F.lit(1))).otherwise("N")


def anchor_hits_within(reads: DataFrame, anchors: DataFrame, mismatches: int, *, least_tile: int = 8, most: int = 1 << 20) -> DataFrame:
    """(read_id, gene, copy, exon, forward): anchors that a read contains with at most ``mismatches`` substitutions, on either strand.

    By the pigeon-hole principle one of mismatches + 1 tiles of an anchor occurs unchanged. The tiles' first bases, as many
    as the shortest tile has, are an equi-join key; candidates are verified base by base. Anchors whose tiles would be
    shorter than ``least_tile`` match exactly only.
    """
    rc = F.reverse(F.translate("anchor", "ACGT", "TGCA"))
    both = anchors.withColumn("forward", F.lit(True)).unionByName(anchors.withColumn("anchor", rc).withColumn("forward", F.lit(False)))
    tile = F.floor(F.length("anchor") / (mismatches + 1)).cast("int")
    both = both.withColumn("_m", F.when(tile >= least_tile, mismatches).otherwise(0)).withColumn("_tile", F.floor(F.length("anchor") / (F.col("_m") + 1)).cast("int"))
    k = min(31, both.agg(F.min("_tile")).first()[0] or least_tile)
    tiles = both.withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_m")))).withColumn("_off", F.col("_t") * F.col("_tile"))
    tiles = tiles.withColumn("_key", code_of(F.substr("anchor", F.col("_off") + 1, F.lit(k))))
    keys = tiles.select("_key").distinct().limit(most + 1).toPandas()["_key"].to_numpy(np.int64)
    if len(keys) <= most:
        found = seeds_in(reads, "read_id", "seq", np.sort(keys.view(np.uint64)), k)
    else:
        found = kmers(reads, "read_id", "seq", k).select("read_id", "pos", code_of(F.col("kmer")).alias("code"))
    seeds = found.select("read_id", F.col("pos").alias("_p"), F.col("code").alias("_key"))
    hits = seeds.join(tiles, "_key").withColumn("_at", F.col("_p") - F.col("_off")).filter("_at >= 0").select("read_id", "_at", "anchor", "gene", "copy", "exon", "forward", "_m").distinct()
    there = hits.join(reads.select("read_id", "seq"), "read_id").withColumn("_s", F.substr("seq", (F.col("_at") + 1).cast("int"), F.length("anchor"))).drop("seq")
    return there.filter((F.length("_s") == F.length("anchor")) & (hamming(F.col("_s"), F.col("anchor")) <= F.col("_m"))).select("read_id", "gene", "copy", "exon", "forward").distinct()


def anchor_hits(reads: DataFrame, anchors: DataFrame, k: int, *, most: int = 1 << 20) -> DataFrame:
    """(read_id, gene, copy, exon, forward): anchors that a read contains, on either strand.

    Containment by an equi-join on the anchor's first k-mer (k up to 31), verified on the whole anchor; no theta join.
    Anchors are at least ``k`` long. Up to ``most`` different keys (8 bytes each, checked) are sent to the scan of the
    reads, which then emits only k-mers that are keys; beyond, all k-mers are joined.
    """
    rc = F.reverse(F.translate("anchor", "ACGT", "TGCA"))
    both = anchors.withColumn("forward", F.lit(True)).unionByName(anchors.withColumn("anchor", rc).withColumn("forward", F.lit(False)))
    both = both.withColumn("_key", code_of(F.substring("anchor", 1, k)))
    keys = both.select("_key").distinct().limit(most + 1).toPandas()["_key"].to_numpy(np.int64)
    if len(keys) <= most:
        found = seeds_in(reads, "read_id", "seq", np.sort(keys.view(np.uint64)), k)
    else:
        found = kmers(reads, "read_id", "seq", k).select("read_id", "pos", code_of(F.col("kmer")).alias("code"))
    seeds = found.select("read_id", (F.col("pos") + 1).cast("int").alias("_at"), F.col("code").alias("_key"))
    hits = seeds.join(both, "_key").select("read_id", "_at", "anchor", "gene", "copy", "exon", "forward")
    checked = hits.join(reads.select("read_id", "seq"), "read_id").filter(F.substr("seq", F.col("_at"), F.length("anchor")) == F.col("anchor"))
    return checked.select("read_id", "gene", "copy", "exon", "forward").distinct()


def best_copy(hits: DataFrame) -> DataFrame:
    """Per read the copy with most distinct exons, then most hits, then the smallest name; and what ties with it."""
    c = hits.groupBy("read_id", "gene", "copy").agg(F.count_distinct("exon").alias("n_exons"), F.count("*").alias("n_hits"), F.max("forward").alias("forward"))
    w = Window.partitionBy("read_id")
    r = c.withColumn("_k", F.rank().over(w.orderBy(F.desc("n_exons"), F.desc("n_hits")))).filter("_k = 1")
    return r.groupBy("read_id").agg(
        F.min(F.struct("copy", "gene", "n_exons", "n_hits", "forward")).alias("b"), F.count_distinct("gene").alias("_g"), F.count("*").alias("_n"), F.array_sort(F.collect_set("copy")).alias("tied")
    ).select("read_id", "b.gene", "b.copy", "b.n_exons", "b.n_hits", "b.forward", (F.col("_g") > 1).alias("ambiguous_gene"), (F.col("_n") > 1).alias("ambiguous_copy"), F.array_join("tied", ",").alias("tied_copies"))


def resort(calls: DataFrame, *, min_exons: int = 2) -> DataFrame:
    """Adds ``relabelled``: enough exons and one gene; such reads take the copy as target with probability 1."""
    ok = (F.col("n_exons") >= min_exons) & ~F.col("ambiguous_gene")
    return calls.withColumn("relabelled", ok).withColumn("target", F.when(ok, F.col("copy"))).withColumn("paralog_p", F.when(ok, 1.0))


def in_locus(contig: Column, start: Column, locus: str, begin: int, end: int) -> Column:
    """The position lies in ``begin <= start < end`` of the locus' contig (see :func:`locus_matches`)."""
    return locus_matches(contig, locus) & (start >= begin) & (start < end)


def resort_alignments(alignments: DataFrame, calls: DataFrame, places: DataFrame, *, locus: tuple[str, int, int], genes: tuple[str, ...] = (), min_exons: int = 2) -> DataFrame:
    """Alignments (read_id, target, start, end) after re-sorting by exon copies: target, start, end, paralog_p, relabelled.

    An alignment passes the gate if its target is one of ``genes`` or it starts in the locus (contig, begin, end). If the
    read's call (see :func:`best_copy`) has enough exons of one gene, it moves to the copy's place (copy, contig, start,
    end; a copy without one keeps the coordinates) with probability 1; all others stay as they are.
    """
    c = resort(calls, min_exons=min_exons).filter("relabelled").select("read_id", "copy")
    p = places.select("copy", F.col("start").alias("_s"), F.col("end").alias("_e"))
    j = alignments.join(c, "read_id", "left").join(p, "copy", "left")
    gate = F.col("target").isin(*genes) | in_locus(F.col("target"), F.col("start"), *locus) if genes else in_locus(F.col("target"), F.col("start"), *locus)
    ok = F.coalesce(gate & F.col("copy").isNotNull(), F.lit(False))
    moved = lambda new, old: F.when(ok, F.coalesce(new, old)).otherwise(F.col(old)).alias(old)
    return j.select("read_id", moved("copy", "target"), moved("_s", "start"), moved("_e", "end"), F.when(ok, 1.0).alias("paralog_p"), ok.alias("relabelled"))


def locus_matches(contig: Column, locus: str) -> Column:
    """The contig is the locus or ends with it after one of # _ . | / :"""
    return (contig == locus) | contig.rlike(r"[#_.|/:]" + re.escape(locus) + "$")
