"""Kernels against plain dynamic programming and brute force."""

import random
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import alignment as K
from helixframe.functions import cigar, sequence as Q
from helixframe.operators import align, synthetic


def least_cost(q, r, c=K.Costs()):
    inf = 10**9

    @lru_cache(None)
    def m(i, j):
        if i == j == 0:
            return 0
        if not i or not j:
            return inf
        return min(m(i - 1, j - 1), ins(i - 1, j - 1), dele(i - 1, j - 1)) + (c.match if q[i - 1] == r[j - 1] else c.mismatch)

    @lru_cache(None)
    def ins(i, j):
        if not i:
            return inf
        if not j:
            return c.open + (i - 1) * c.extend
        return min(ins(i - 1, j) + c.extend, m(i - 1, j) + c.open)

    @lru_cache(None)
    def dele(i, j):
        if not j:
            return inf
        if not i:
            return c.open + (j - 1) * c.extend
        return min(dele(i, j - 1) + c.extend, m(i, j - 1) + c.open)

    n = len(q), len(r)
    return min(m(*n), ins(*n), dele(*n))


def cost_of(ops, c=K.Costs()):
    return sum(n * {"=": c.match, "X": c.mismatch}[o] if o in "=X" else c.open + (n - 1) * c.extend for o, n in ops)


@pytest.mark.parametrize("seed", range(30))
def test_global_alignment_is_optimal(seed):
    g = random.Random(seed)
    q = "".join(g.choice("ACGT") for _ in range(g.randint(0, 14)))
    r = "".join(g.choice("ACGT") for _ in range(g.randint(0, 14))) if seed % 2 else q[: g.randint(0, len(q))] + "".join(g.choice("ACGT") for _ in range(3)) + q[5:]
    cost, ops = K.global_align(q.encode(), r.encode())
    assert cost == (least_cost(q, r) if q or r else 0)
    assert sum(n for o, n in ops if o in "=XI") == len(q) and sum(n for o, n in ops if o in "=XD") == len(r)
    at_q = at_r = 0
    for o, n in ops:
        for _ in range(n):
            if o in "=X":
                assert (q[at_q] == r[at_r]) == (o == "=")
            at_q, at_r = at_q + (o in "=XI"), at_r + (o in "=XD")
    assert cost_of(ops) == cost


def test_extension_leaves_out_what_differs():
    assert K.extend(b"ACGTACGTAC", b"ACGTACGTAC") == (10, 10, [("=", 10)])
    i, j, ops = K.extend(b"ACGTACGTAC" + b"GGGGGGGG", b"ACGTACGTAC" + b"TTTTTTTT")
    assert (i, j) == (10, 10)


def test_chains_follow_colinear_anchors():
    good = [(0, 100 + 10 * k, 5 + 10 * k, True) for k in range(10)]
    noise = [(0, 5000, 40, True), (1, 7, 7, True), (0, 90, 90, False)]
    found = K.chains(noise + good)
    assert len(found) == 1 and found[0][1] == list(range(3, 13)) and found[0][0] == 1 + 9 * 10
    reverse = [(2, 100 + 10 * k, 200 - 10 * k, False) for k in range(5)]
    assert K.chains(reverse)[0][1] == [0, 1, 2, 3, 4]
    assert K.chains([]) == [] and K.chains(good[:2]) == []


def brute_minimizers(seq, k, w):
    comp = {"A": "T", "C": "G", "G": "C", "T": "A"}
    code = lambda s: int("".join("0123"["ACGT".index(c)] for c in s), 4)
    out, window, last = [], [], None
    for pos in range(len(seq) - k + 1):
        kmer = seq[pos : pos + k].upper()
        if any(c not in "ACGT" for c in kmer):
            window, last = [], None
            continue
        f, r = code(kmer), code("".join(comp[c] for c in reversed(kmer)))
        window = [x for x in window if x[1] > pos - w] + [(int(Q.hash_kmer(np.array([min(f, r)], np.uint64))[0]), pos, f <= r)]
        if pos >= w - 1 or pos == len(seq) - k:
            best = min(window, key=lambda x: (x[0], x[1]))
            if best[1] != last:
                out.append(best)
                last = best[1]
    return out


@pytest.mark.parametrize("seed", range(20))
def test_minimizer_kernel_matches_brute_force(seed):
    g = random.Random(seed)
    seq = "".join(g.choice("ACGTacgt" + "N" * (seed % 3)) for _ in range(g.randint(0, 120)))
    k, w = g.choice([(5, 4), (7, 10), (11, 1)])
    h, p, s = Q.minimizers_of(seq.encode(), k, w)
    assert list(zip(h.tolist(), p.tolist(), s.tolist())) == brute_minimizers(seq, k, w)


def test_period():
    assert Q.period_of(b"ACG" * 20) == 3
    assert Q.period_of(b"ACGTTGCAAGGCTTAACCGG") == -1 and Q.period_of(b"") == -1 and Q.period_of(b"AC") == -1


def test_sequence_columns(spark):
    df = spark.createDataFrame([("acgtn",), ("",), ("GGCC",)], "s string")
    rows = df.select(Q.reverse_complement(F.col("s")).alias("rc"), Q.gc_content(F.col("s")).alias("gc"), Q.tokens(F.col("s"), 8).alias("t")).collect()
    assert [r.rc for r in rows] == ["NACGT", "", "GGCC"]
    assert [round(r.gc, 3) for r in rows] == [0.5, 0.0, 1.0]
    assert [list(r.t) for r in rows] == [[2, 4, 5, 6, 7, 8, 3, 0], [2, 3, 0, 0, 0, 0, 0, 0], [2, 6, 6, 5, 5, 3, 0, 0]]
    h = spark.createDataFrame([("ACGT", "AGGT"), ("A", "AC")], "a string, b string").select(Q.hamming(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in h] == [1, None]


def test_cigar_columns(spark):
    df = spark.createDataFrame([("5S10M2I3D4=1X2N3H",), ("*",)], "cigar string")
    r = cigar.stats(df, "cigar").collect()
    assert (r[0].query_length, r[0].ref_length, r[0].aligned) == (22, 20, 15) and abs(r[0].identity - 14 / 20) < 1e-9
    assert (r[1].query_length, r[1].identity) == (0, 0.0)
    assert [x.ok for x in df.select(cigar.is_valid(F.col("cigar")).alias("ok")).collect()] == [True, True]


def test_simulated_reads_are_placed(spark):
    refs = synthetic.random_reference(spark, 3, 3000).cache()
    reads = synthetic.simulate(refs, per_ref=8, length=400, error=0.03).cache()
    assert sorted(reads.collect()) == sorted(synthetic.simulate(refs.repartition(3), per_ref=8, length=400, error=0.03).collect())
    placed = align.align(reads.select("read_id", "seq"), refs, k=13, w=6).filter("is_primary")
    j = reads.join(placed.drop("ref_id").join(placed.select("read_id", F.col("ref_id").alias("found")), "read_id"), "read_id", "left").collect()
    right = [r for r in j if r.found == r.ref_id and abs(r.start - r.true_start) <= 20 and r.is_reverse == r.reverse]
    assert len(right) >= 0.9 * len(j)
    stats = align.alignment_stats(placed, reads).first()
    assert stats.reads == 24 and stats.mean_identity > 0.9


def test_paralog_family(spark):
    from helixframe.operators import paralog

    fam = synthetic.paralog_family(synthetic.random_reference(spark, 1, 500), 4, 0.05)
    sites = paralog.catalogue(fam, least=0.3).select("pos").distinct().count()
    assert fam.count() == 4 and 10 < sites < 120


def test_kernels_equal_the_declarative_forms(spark):
    g = random.Random(11)
    rows = [(k, "".join(g.choice("ACGT") for _ in range(g.choice([0, 5, 10, 11, 14, 200, 900])))) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, seq string")
    slow = {(r.id, r.pos, r.kmer, r.same_strand) for r in Q.minimizers(df, "id", "seq").collect()}
    text = lambda c, k=11: "".join("ACGT"[(c >> 2 * (k - 1 - i)) & 3] for i in range(k))
    assert {(r.id, r.pos, text(r.kmer), r.same_strand) for r in Q.coded_minimizers(df, "id", "seq").collect()} == slow
    odd = spark.createDataFrame([*rows, (50, None), (51, "ACGNNACGTACG"), (52, "acgt" * 9)], "id long, seq string")
    stats = {r.id: r for r in Q.window_statistics(odd, ["id"], "seq").collect()}
    up = odd.withColumn("seq", F.upper("seq"))
    for r in Q.kmer_entropy(up, ["id"], "seq", 3).collect():
        assert abs(stats[r.id].entropy - r.entropy) < 1e-9
    density = {r.id: r.density for r in Q.palindrome_density(up, ["id"], "seq").collect()}
    assert {k: r.density for k, r in stats.items() if r.density is not None} == pytest.approx(density)
    codes = df.filter("length(seq) > 10").select(Q.code_of(F.substring("seq", 1, 8)).alias("c"), F.substring("seq", 1, 8).alias("k")).collect()
    assert all(text(r.c, 8) == r.k for r in codes)


def test_anchor_keys_beyond_the_bound_give_the_same(spark):
    from helixframe.operators import paralog

    g = random.Random(12)
    reads = [(k, "".join(g.choice("ACGT") for _ in range(300))) for k in range(20)]
    anchors = [("G", f"G_{k}", "CH1", s[50:90]) for k, s in reads[:5]] + [("G", "G_x", "CH2", "ACGT" * 10)]
    r, a = spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(anchors, "gene string, copy string, exon string, anchor string")
    few, many = (sorted(paralog.anchor_hits(r, a, 20, most=m).collect()) for m in (1 << 20, 0))
    assert few == many and {x.read_id for x in few} == {0, 1, 2, 3, 4}


@pytest.mark.parametrize("seed", range(15))
def test_approximate_containment(seed):
    g = random.Random(seed)
    seq = "".join(g.choice("ACGT") for _ in range(200))
    anchor = list(seq[60:100])
    for p in g.sample(range(40), g.randint(0, 3)):
        anchor[p] = g.choice("ACGT".replace(anchor[p], ""))
    anchor = "".join(anchor)
    for k in (0, 1, 2, 3):
        want = any(sum(x != y for x, y in zip(seq[i : i + 40], anchor)) <= k for i in range(161))
        assert Q.found_within(seq.encode(), anchor.encode(), k) == want


def test_bound_on_broadcast_tables(spark):
    from helixframe.runtime import bounded

    with pytest.raises(ValueError):
        bounded(spark.range(11), 10)
    assert bounded(spark.range(10), 10).count() == 10
