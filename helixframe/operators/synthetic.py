"""Simulated reads, loci with duplicated genes and paralog families, with truth."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

READS = "read_id long, ref_id long, true_start long, true_end long, reverse boolean, seq string"


def simulate(refs: DataFrame, *, per_ref: int = 10, length: int = 150, error: float = 0.02, seed: int = 42) -> DataFrame:
    """Reads of references (ref_id, seq): errors are 70 % substitutions, 15 % deletions, 15 % insertions.

    Each read has its own generator, seeded by its number, so the result doesn't depend on the partitioning.
    """
    numbered = refs.select("ref_id", "seq", F.explode(F.sequence(F.lit(0), F.lit(per_ref - 1))).alias("_k")).filter(F.length("seq") > 0).withColumn("read_id", F.col("ref_id") * per_ref + F.col("_k"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        comp = bytes.maketrans(b"ACGT", b"TGCA")
        for pdf in it:
            out = []
            for ref, seq, read in zip(pdf["ref_id"], pdf["seq"], pdf["read_id"]):
                g = np.random.default_rng([seed, int(read)])
                size = min(length, len(seq))
                start = int(g.integers(0, len(seq) - size + 1))
                text = damaged(seq[start : start + size].encode(), error, g)
                reverse = bool(g.integers(0, 2))
                out.append((read, ref, start, start + size, reverse, (text.translate(comp)[::-1] if reverse else text).decode()))
            yield pd.DataFrame(out, columns=["read_id", "ref_id", "true_start", "true_end", "reverse", "seq"])

    return numbered.select("ref_id", "seq", "read_id").mapInPandas(run, READS)


def damaged(seq: bytes, error: float, g: np.random.Generator) -> bytes:
    """A sequence with errors: 70 % substitutions, 15 % deletions, 15 % insertions of a base after it."""
    b = np.frombuffer(seq, np.uint8)
    kind = np.searchsorted([1 - error, 1 - 0.3 * error, 1 - 0.15 * error], g.random(len(b)), side="right")
    other = np.frombuffer(b"ACGT", np.uint8)[(np.searchsorted(np.frombuffer(b"ACGT", np.uint8), b) + g.integers(1, 4, len(b))) % 4]
    any_ = np.frombuffer(b"ACGT", np.uint8)[g.integers(0, 4, len(b))]
    two = np.stack([np.where(kind == 1, other, b), any_], axis=1)
    return two[np.stack([kind != 2, kind == 3], axis=1)].tobytes()


def random_reference(spark, n: int, length: int, seed: int = 42) -> DataFrame:
    """(ref_id, seq) of random bases."""
    base = lambda i: F.substring(F.lit("ACGT"), (1 + F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(4))).cast("int"), F.lit(1))
    return spark.range(n).select(F.col("id").alias("ref_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), base), "").alias("seq"))


def paralog_family(refs: DataFrame, copies: int, divergence: float, seed: int = 7) -> DataFrame:
    """(paralog, seq): each reference with diverged copies, substitutions at hashed positions."""
    c = refs.select("ref_id", "seq", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    letters = F.filter(F.split("seq", ""), lambda x: x != "")
    differs = lambda i: (F.col("copy") > 0) & (F.pmod(F.xxhash64("ref_id", "copy", i, F.lit(seed)), F.lit(10_000)) < int(divergence * 10_000))
    changed = F.transform(letters, lambda b, i: F.when(differs(i), F.translate(b, "ACGT", "GTAC")).otherwise(b))
    return c.select(F.concat(F.lit("P"), F.col("ref_id").cast("string"), F.lit("_"), F.col("copy").cast("string")).alias("paralog"), F.array_join(changed, "").alias("seq"))


GENES = ("IGHM", "IGHD", "IGHG3", "IGHG1", "IGHA1", "IGHG2", "IGHG4", "IGHE", "IGHA2")


@dataclass(frozen=True)
class Locus:
    """A locus and its duplicate: equal but for ``n_psvs`` planted variants outside the identical middle, and reads of both."""

    length: int = 20_000
    n_psvs: int = 20
    read_length: int = 2_000
    spread: int = 200
    canonical_depth: int = 30
    dup_depth: int = 0
    dup_fraction: float = 0.3
    identical: float = 0.0
    error: float = 0.01
    genes: tuple[str, ...] = GENES
    seed: int = 42

    @property
    def n_reads(self) -> int:
        return self.length * (self.canonical_depth + self.dup_depth) // self.read_length

    @property
    def share(self) -> float:
        return self.dup_depth / (self.canonical_depth + self.dup_depth) if self.dup_depth else self.dup_fraction

    @property
    def same(self) -> tuple[int, int]:
        n = int(self.length * self.identical)
        return (self.length - n) // 2, (self.length - n) // 2 + n


PRESETS = {
    "canonical": Locus(dup_fraction=0.0),
    "mosaic": Locus(canonical_depth=15, dup_depth=15),
    **{f"dup_{k}": Locus(dup_fraction=k / 100) for k in (5, 10, 30, 50, 100)},
    "identical_half": Locus(identical=0.5, dup_fraction=0.5, n_psvs=10),
    "tiny": Locus(length=5_000, n_psvs=5, read_length=1_000, spread=100, canonical_depth=10),
}
#: Paralog families: members, region length, variants, identity.
FAMILIES = {
    "constant": (("IGHG1", "IGHG2", "IGHG3", "IGHG4", "IGHGP"), 50_000, 20, 0.95),
    "nphp1": (("NPHP1", "NPHP1B"), 80_000, 30, 0.98),
    "mhc": (("HLA-A", "HLA-A-pseudo"), 30_000, 15, 0.92),
}
#: End-to-end levels: the locus, the reads, and the share of reads that must come back to their place.
LEVELS = {"minimal": (Locus(length=10_000, n_psvs=5, read_length=2_000), 10, 0.8), "standard": (Locus(length=30_000, n_psvs=15, read_length=5_000), 50, 0.9), "stress": (Locus(length=100_000, n_psvs=50, read_length=10_000), 200, 0.95)}


def hashed(*parts) -> Column:
    """32 bits of the MD5 of the parts' text: the same number in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("_", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def locus_bases(spark, c: Locus) -> DataFrame:
    """(pos, base, dup_base, gene, is_psv) of each place of the locus."""
    pos, (a, b) = F.col("pos"), c.same
    free = (pos < a) | (pos >= b)
    d = spark.range(c.length).withColumnRenamed("id", "pos").withColumn("base", F.substring(F.lit("ACGT"), (hashed("base", c.seed, pos) % 4 + 1).cast("int"), F.lit(1)))
    chosen = d.filter(free).select("pos", hashed("psv", c.seed, pos).alias("h")).orderBy("h", "pos").limit(c.n_psvs).select("pos", F.lit(True).alias("is_psv"))  # n_psvs rows
    gene = F.element_at(F.array(*[F.lit(g) for g in c.genes]), (F.least(F.floor(pos / (c.length // len(c.genes))), F.lit(len(c.genes) - 1)) + 1).cast("int"))
    j = d.join(F.broadcast(chosen), "pos", "left").withColumn("is_psv", F.coalesce("is_psv", F.lit(False)))
    return j.select("pos", "base", F.when(F.col("is_psv"), F.translate("base", "ACGT", "CGTA")).otherwise(F.col("base")).alias("dup_base"), gene.alias("gene"), "is_psv")


def locus_sequences(bases: DataFrame) -> DataFrame:
    """(origin, seq) of the canonical locus and the duplicate: as long as the configuration says."""
    both = bases.groupBy().agg(F.array_sort(F.collect_list(F.struct("pos", "base", "dup_base"))).alias("b"))
    text = lambda f: F.array_join(F.transform("b", lambda x: x[f]), "")
    return both.select(F.explode(F.array(F.struct(F.lit("CAN").alias("origin"), text("base").alias("seq")), F.struct(F.lit("DUP").alias("origin"), text("dup_base").alias("seq")))).alias("x")).select("x.*")


def locus_reads(spark, c: Locus, bases: DataFrame, n: int | None = None) -> DataFrame:
    """(read_id, name, origin, start, end, gene, seq): reads of both copies, with the configuration's errors."""
    i = F.col("read_id")
    size = F.greatest(F.lit(100), F.least(F.lit(c.length), F.lit(c.read_length - c.spread) + hashed("len", c.seed, i) % (2 * c.spread + 1)))
    r = spark.range(n if n is not None else c.n_reads).withColumnRenamed("id", "read_id").withColumn("size", size)
    r = r.withColumn("start", hashed("start", c.seed, i) % (F.lit(c.length) - F.col("size") + 1)).withColumn("end", F.col("start") + F.col("size"))
    r = r.withColumn("origin", F.when(hashed("origin", c.seed, i) < int(c.share * 2**32), "DUP").otherwise("CAN"))
    gene = F.element_at(F.array(*[F.lit(g) for g in c.genes]), (F.least(F.floor(F.col("start") / (c.length // len(c.genes))), F.lit(len(c.genes) - 1)) + 1).cast("int"))
    r = r.withColumn("gene", gene).join(F.broadcast(locus_sequences(bases)), "origin")  # two rows
    r = r.withColumn("seq", F.substr("seq", (F.col("start") + 1).cast("int"), F.col("size").cast("int")))
    r = r.withColumn("name", F.concat(F.lit("synth_"), i.cast("string"), F.lit("_"), F.col("origin"), F.lit("_"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("_"), F.col("gene")))
    out = r.select("read_id", "name", "origin", "start", "end", "gene", "seq")
    return with_errors(out, c.error, c.seed) if c.error else out


def with_errors(reads: DataFrame, error: float, seed: int) -> DataFrame:
    """Reads (read_id, seq, ..) with errors, each by a generator of its own number."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf["seq"] = [damaged(s.encode(), error, np.random.default_rng([seed, int(k)])).decode() for k, s in zip(pdf["read_id"], pdf["seq"])]
            yield pdf

    return reads.mapInPandas(run, reads.schema)


def family_copies(spark, name: str, seed: int = 42) -> DataFrame:
    """(paralog, seq) of a family: its members differ from the first by substitutions at hashed places."""
    members, length, _, identity = FAMILIES[name]
    one = locus_sequences(locus_bases(spark, Locus(length=length, n_psvs=0, seed=seed))).filter("origin = 'CAN'")
    letters = F.filter(F.split("seq", ""), lambda x: x != "")
    each = one.select("seq", F.posexplode(F.array(*[F.lit(m) for m in members])).alias("k", "paralog"))
    differs = lambda i: (F.col("k") > 0) & (hashed("fam", seed, F.col("k"), i) % 10_000 < int((1 - identity) * 10_000))
    return each.select("paralog", F.array_join(F.transform(letters, lambda b, i: F.when(differs(i), F.translate(b, "ACGT", "CGTA")).otherwise(b)), "").alias("seq"))


def end_to_end(spark, level: str, seed: int = 42) -> DataFrame:
    """One row (level, n_reads, accuracy, passed): reads of a synthetic locus, aligned, against where they came from."""
    from .align import align

    c, n, least = LEVELS[level]
    c = replace(c, seed=seed)
    bases = cut(locus_bases(spark, c))
    reads = cut(locus_reads(spark, c, bases, n))
    ref = locus_sequences(bases).filter("origin = 'CAN'").select(F.lit(0).cast("long").alias("ref_id"), "seq")
    a = align(reads.select("read_id", "seq"), ref).filter("is_primary").select("read_id", F.col("start").alias("at"), "is_reverse")
    j = reads.select("read_id", "start").join(a, "read_id", "left")
    right = (F.abs(F.col("at") - F.col("start")) <= 10) & ~F.col("is_reverse")
    return j.agg(F.count("*").alias("n_reads"), (F.count_if(F.coalesce(right, F.lit(False))) / F.count("*")).alias("accuracy")).select(F.lit(level).alias("level"), "n_reads", "accuracy", (F.col("accuracy") >= least).alias("passed"))
