"""Seeding joins: minimizers of reads against an index of reference minimizers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import coded_minimizers, minimizer_totals
from ..runtime import cut, ratio
from .relational import top_k


def occurrences(index: DataFrame, key: str = "kmer") -> DataFrame:
    return index.groupBy(key).agg(F.count("*").alias("n_occ"))


def suppress(index: DataFrame, max_occ: int, key: str = "kmer") -> DataFrame:
    """The index without keys of more than ``max_occ`` postings: heavy hitters go before the join, not after."""
    return index.join(occurrences(index, key).filter(F.col("n_occ") <= max_occ).select(key), key, "left_semi")


def seed_join(queries: DataFrame, index: DataFrame, *, max_occ: int | None = 5000, key: str = "kmer", max_hits: int | None = None) -> DataFrame:
    """(read_id, ref_id, ref_pos, query_pos, same_strand) for each query minimizer and each posting of its key.

    ``same_strand``: the read's and the reference's k-mers have the same orientation. ``max_occ``: keys with more postings
    are left out, None: no key is. ``max_hits``: the most hits of a read, those of its first query positions; of a key no
    more than its first ``max_hits`` postings can be among them, so the others don't meet the reads.
    """
    i = index if max_occ is None else suppress(index, max_occ, key)
    if max_hits is not None:
        i = top_k(i, [key], [F.col("ref_id"), F.col("pos")], max_hits).drop("rank")
    i = i.select(key, "ref_id", F.col("pos").alias("ref_pos"), F.col("same_strand").alias("_r"))
    q = queries.select(key, "read_id", F.col("pos").alias("query_pos"), F.col("same_strand").alias("_q"))
    hits = q.join(i, key).select("read_id", "ref_id", "ref_pos", "query_pos", (F.col("_q") == F.col("_r")).alias("same_strand"))
    if max_hits is None:
        return hits
    return top_k(hits, ["read_id"], [F.col("query_pos"), F.col("ref_id"), F.col("ref_pos")], max_hits).drop("rank")


def index_stats(sequences: DataFrame, index: DataFrame, key: str = "kmer") -> DataFrame:
    """Distinct keys, minimizers and mean spacing."""
    s = index.agg(F.count_distinct(key).alias("n_keys"), F.count("*").alias("n_minimizers"))
    return s.join(F.broadcast(sequences.agg(F.sum(F.length("seq")).alias("total_bases")))).withColumn("spacing", ratio("total_bases", "n_minimizers"))


def minimizer_summary(reads: DataFrame, key: str, seq: str, *, k: int = 11, w: int = 5) -> DataFrame:
    """(key, n, first_pos, last_pos, n_kmers) of each key with minimizers; n_kmers are the different ones.

    Rows are summed up where they are read. Only keys that several rows have, null among them, take a row for each minimizer.
    """
    again = cut(reads.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_again")))
    if again.isEmpty():
        return minimizer_totals(reads, key, seq, k=k, w=w)
    same = F.col(key).eqNullSafe(F.col("_again"))
    found = coded_minimizers(reads.join(again, same, "left_semi"), key, seq, k=k, w=w).groupBy(key)
    told = found.agg(F.count("*").alias("n"), F.min("pos").cast("int").alias("first_pos"), F.max("pos").cast("int").alias("last_pos"), F.count_distinct("kmer").alias("n_kmers"))
    return minimizer_totals(reads.join(again, same, "left_anti"), key, seq, k=k, w=w).unionByName(told)
