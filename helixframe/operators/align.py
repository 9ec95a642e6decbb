"""Reads to alignments: seeding join, chaining, extension, filter, mapping quality."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alignment as K
from ..functions import sequence as Q
from ..runtime import cut, ratio
from .records import multi_mapq, unique_mapq
from .seeding import seed_join

CHAINS = "read_id long, chain int, score double, second double, ref_id long, forward boolean, first_ref long, last_ref long, ref_pos array<long>, query_pos array<long>"
ALIGNED = "read_id long, chain int, score double, second double, n_chains int, ref_id long, is_reverse boolean, start long, end long, cigar string, identity double, aligned long, length long"


def hits(reads: DataFrame, refs: DataFrame, *, k: int = 15, w: int = 10, max_occ: int = 5000) -> DataFrame:
    """Seeds of reads (read_id, seq) on references (ref_id, seq)."""
    index = Q.hashed_minimizers(refs, "ref_id", "seq", k=k, w=w).withColumnRenamed("forward", "same_strand")
    queries = Q.hashed_minimizers(reads, "read_id", "seq", k=k, w=w).withColumnRenamed("forward", "same_strand")
    return seed_join(queries, index, max_occ=max_occ, key="hash")


def chained(found: DataFrame, config: K.ChainConfig = K.ChainConfig()) -> DataFrame:
    """Chains of each read. A read's anchors number at most its minimizers times the index's occurrence bound."""
    grouped = found.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("ref_id", "ref_pos", "query_pos", "same_strand"))).alias("a")).filter(F.size("a") >= config.min_anchors)
    flat = grouped.select("read_id", *[F.col("a")[f].alias(f) for f in ("ref_id", "ref_pos", "query_pos", "same_strand")])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for read, ref, rp, qp, fwd in pdf.itertuples(index=False):
                anchors = [(int(a), int(b), int(c), bool(d)) for a, b, c, d in zip(ref, rp, qp, fwd)]
                found = K.chains(anchors, config)
                for n, (score, at) in enumerate(found):
                    own = [anchors[i] for i in at]
                    out.append((read, n, score, found[1][0] if len(found) > 1 else 0.0, own[0][0], own[0][3], own[0][1], own[-1][1], [a[1] for a in own], [a[2] for a in own]))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in CHAINS.split(", ")])

    return flat.mapInPandas(run, CHAINS)


def with_windows(chains: DataFrame, refs: DataFrame, offset: str, stop, *, tile: int = 1 << 14) -> DataFrame:
    """Adds ``window``, the reference from ``offset`` up to ``stop``: tiles of the reference meet the chains, never whole references."""
    tiles = Q.pieces(refs, ["ref_id"], "seq", tile, tile, name="_text").select("ref_id", F.floor(F.col("start") / tile).alias("_tile"), "_text")
    c = chains.withColumn("_stop", stop)
    need = c.select("read_id", "chain", "ref_id", F.col(offset).alias("_from"), "_stop", F.explode(F.sequence(F.floor(F.col(offset) / tile), F.floor((F.col("_stop") - 1) / tile))).alias("_tile"))
    # A chain's tiles: its span over the tile size, plus one.
    # Of a tile only the window's part is grouped and joined again.
    skip = F.greatest(F.lit(0), F.col("_from") - F.col("_tile") * tile).cast("int")
    part = F.substr("_text", skip + 1, (F.least(F.col("_stop") - F.col("_tile") * tile, F.lit(tile)) - skip).cast("int"))
    text = need.join(tiles, ["ref_id", "_tile"]).withColumn("_text", part).groupBy("read_id", "chain").agg(F.array_sort(F.collect_list(F.struct("_tile", "_text"))).alias("_t"))
    whole = F.array_join(F.transform("_t", lambda x: x["_text"]), "")
    return c.join(text.select("read_id", "chain", whole.alias("window")), ["read_id", "chain"]).drop("_stop")


def extended(chains: DataFrame, reads: DataFrame, refs: DataFrame, *, most: int = 5, end: int = 500, pad: int = 50, k: int = 15) -> DataFrame:
    """The best ``most`` chains of each read as alignments. Only the reference's window around a chain leaves the JVM."""
    total = Window.partitionBy("read_id")
    c = chains.withColumn("n_chains", F.count("*").over(total).cast("int")).filter(F.col("chain") < most)
    j = with_windows(c.withColumn("offset", F.greatest(F.lit(0), F.col("first_ref") - end - pad)), refs, "offset", F.col("last_ref") + k + end + pad)
    j = j.join(reads.select("read_id", F.when(F.length("seq") > 0, F.col("seq")).otherwise("").alias("seq")), "read_id")
    names = [x.split()[0] for x in ALIGNED.split(", ")]
    comp = bytes.maketrans(b"ACGT", b"TGCA")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for row in pdf.itertuples(index=False):
                read, pairs = row.seq.encode(), list(zip(map(int, row.ref_pos), map(int, row.query_pos)))
                if not row.forward:
                    read = read.translate(comp)[::-1]
                    pairs = [(r, len(read) - q - k) for r, q in pairs]
                start, stop, ops = K.align_chain(read, row.window.encode(), int(row.offset), pairs, k, end=end, pad=pad)
                ident, bases = K.identity(ops)
                out.append((row.read_id, row.chain, row.score, row.second, row.n_chains, row.ref_id, not row.forward, start, stop, "".join(f"{n}{o}" for o, n in ops), ident, bases, len(read)))
            yield pd.DataFrame(out, columns=names)

    return j.select("read_id", "chain", "score", "second", "n_chains", "ref_id", "forward", "offset", "ref_pos", "query_pos", "window", "seq").mapInPandas(run, ALIGNED)


def align(reads: DataFrame, refs: DataFrame, *, k: int = 15, w: int = 10, max_occ: int = 5000, min_identity: float = 0.8, min_bases: int = 50, config: K.ChainConfig | None = None) -> DataFrame:
    """Alignments that pass identity and length, with mapping quality; ``is_primary``: the read's first passing chain."""
    config = config or K.ChainConfig(k=k)
    # Written once, as a window and a join use the chains: else reads are seeded and chained again for each.
    chains = cut(chained(hits(reads, refs, k=k, w=w, max_occ=max_occ), config))
    return passing(extended(chains, reads, refs, k=k), min_identity=min_identity, min_bases=min_bases)


def passing(aligned: DataFrame, *, min_identity: float = 0.8, min_bases: int = 50) -> DataFrame:
    """Extended chains that pass identity and length, with mapping quality and ``is_primary``."""
    passed = aligned.filter((F.col("identity") >= min_identity) & (F.col("aligned") >= min_bases))
    first = F.min("chain").over(Window.partitionBy("read_id"))
    mapq = F.when(F.col("n_chains") == 1, unique_mapq(F.col("score"), F.greatest(F.col("aligned"), F.lit(1)), F.col("identity"))).otherwise(multi_mapq(F.col("score") - F.col("second"), F.col("n_chains"), F.col("identity")))
    return passed.withColumn("is_primary", F.col("chain") == first).withColumn("mapq", mapq)


def alignment_stats(aligned: DataFrame, reads: DataFrame) -> DataFrame:
    p = aligned.filter("is_primary")
    s = p.agg(F.count("*").alias("aligned_reads"), F.avg("identity").alias("mean_identity"), F.avg("mapq").alias("mean_mapq"))
    return s.join(F.broadcast(reads.agg(F.count("*").alias("reads")))).withColumn("mapping_rate", ratio("aligned_reads", "reads"))


def stage_counts(found: DataFrame, chains: DataFrame, aligned: DataFrame, *, min_identity: float = 0.8, min_bases: int = 50) -> DataFrame:
    """One row: hits, chains, extensions, and what the identity and length filters leave out."""
    h, c = found.agg(F.count("*").alias("n_hits")), chains.agg(F.count("*").alias("n_chains"))
    low, short = F.col("identity") < min_identity, F.col("aligned") < min_bases
    e = aligned.agg(F.count("*").alias("n_extensions"), F.count_if(low).alias("n_low_identity"), F.count_if(~low & short).alias("n_too_short"))
    return h.join(F.broadcast(c)).join(F.broadcast(e))  # one row each


def nm_estimate(identity, aligned):
    """Edit distance that identity and aligned bases imply, truncated."""
    return ((1 - identity) * aligned).cast("int")
