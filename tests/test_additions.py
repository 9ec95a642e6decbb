"""Kernels and operators against brute force: CIGAR walks, anchors with mismatches, indexes, stalls, waves sent or joined."""

import random
import re

import numpy as np
import pytest

from helixframe.functions import cigar
from helixframe.functions import sequence as Q
from helixframe.operators import evaluation, graph, paralog, stall, wave


def brute_walk(text, start):
    if not re.fullmatch(r"([0-9]+[MIDNSHP=X])+", text or ""):
        return []
    r, q, out = start, 0, []
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", text):
        for _ in range(int(n)):
            if op in "M=X":
                out.append((r, q))
            r += op in "MDN=X"
            q += op in "MIS=X"
    return out


@pytest.mark.parametrize("most", [1 << 20, 7])
def test_walk_matches_a_loop(spark, most):
    rng = random.Random(1)
    texts = ["", "*", None, "5M", "0M3=", "bad", "3S", "2H4M2D1X3I2N6=1P4S"] + ["".join(f"{rng.randrange(12)}{rng.choice('MIDNSHP=X')}" for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    df = spark.createDataFrame([(k, f"n{k}", t, 100 * k) for k, t in enumerate(texts)], "k long, name string, cigar string, start long")
    got = [tuple(r) for r in cigar.walk(df, ["k", "name"], "cigar", "start", most=most).collect()]
    want = [(k, f"n{k}", r, q) for k, t in enumerate(texts) for r, q in brute_walk(t, 100 * k)]
    assert sorted(got) == sorted(want) and len(want) > 1000


@pytest.mark.parametrize("mismatches", [0, 1, 3])
def test_anchors_within_mismatches(spark, mismatches):
    rng = random.Random(2)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    anchors = [base(rng.choice([20, 32, 40])) for _ in range(8)]
    reads = []
    for k in range(60):
        a = list(rng.choice(anchors))
        for _ in range(rng.randrange(5)):
            a[rng.randrange(len(a))] = rng.choice("ACGT")
        a = "".join(a)
        reads.append((k, base(rng.randrange(30)) + (a if k % 2 else a[::-1].translate(str.maketrans("ACGT", "TGCA"))) + base(rng.randrange(30))))
    reads += [(60, ""), (61, None)]
    r = spark.createDataFrame(reads, "read_id long, seq string")
    a = spark.createDataFrame([("G", f"C{k}", "CH1", x) for k, x in enumerate(anchors)], "gene string, copy string, exon string, anchor string")
    got = {(x.read_id, x.copy, x.forward) for x in paralog.anchor_hits_within(r, a, mismatches).collect()}
    want = set()
    for k, s in reads:
        for i, x in enumerate(anchors):
            for forward in (True, False):
                y = x if forward else x[::-1].translate(str.maketrans("ACGT", "TGCA"))
                if Q.found_within((s or "").encode(), y.encode(), mismatches):
                    want.add((k, f"C{i}", forward))
    assert want and got == want


def test_product_quantiser_keeps_the_near_ones(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = centres[np.arange(600) % 12] + 0.2 * rng.normal(size=(600, 16))
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, vector array<double>")
    exact = graph.knn(v.filter("id < 60"), v, 5)
    for parts, least in ((0, 0.95), (4, 0.9)):
        assert graph.recall(graph.knn_ivf(v.filter("id < 60"), v, 5, lists=12, probes=2, pq_parts=parts, part_rows=20), exact).first()["recall"] >= least


@pytest.mark.parametrize("metric", ["cosine", "inner", "l2"])
def test_metrics_in_blocks(spark, metric):
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (50, 6)).astype(float)
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, vector array<double>")
    s = graph.likeness(x, x, metric)
    np.fill_diagonal(s, -np.inf)
    want = {(k, int(j)) for k in range(50) for j in np.lexsort((np.arange(50), -np.round(s[k], 9)))[:4]}
    found = graph.knn(v, v, 4, block=13, metric=metric).collect()
    assert len(found) == 200 and all(abs(r.similarity - s[r.src, r.dst]) < 1e-9 for r in found)
    assert len(want - {(r.src, r.dst) for r in found}) <= 200 * 0.05  # rounding of equal values


def test_stall_states_are_those_of_the_table(spark):
    rng = np.random.default_rng(5)
    for series in ([1.0] * 9, list(np.linspace(3, 0.1, 9)), [1, 2] * 5, list(3 * rng.random(12))):
        rows = spark.createDataFrame([(0, k, float(e)) for k, e in enumerate(series)], "run long, k long, e double")
        want = {r.k: r.state for r in stall.states(rows, "run", "k", "e").collect()}
        assert [wave.stall_state([float(e) for e in series[: k + 1]]) for k in range(len(series))] == [want[k] for k in range(len(series))]


def test_waves_are_the_same_sent_or_joined(spark):
    rng = np.random.default_rng(6)
    w = spark.createDataFrame([(int(r), int(b), float(rng.random())) for r in range(40) for b in rng.choice(30, 4, replace=False)], "read_id long, bucket_id long, p double")
    bio = spark.createDataFrame([(b, 1.0 + b / 10) for b in range(0, 30, 2)], "bucket_id long, bio_prior double")
    a, b = ({(r.read_id, r.bucket_id): r.p for r in wave.em_step(w, bio=bio, few=few).collect()} for few in (True, False))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    assert wave.few_buckets(w, 30) and not wave.few_buckets(w, 5)


def test_levels_stop_at_the_rate_and_tell_rounds(spark):
    w = spark.createDataFrame([(r, b, 0.5 if r == 9 else 0.998 if b == 0 else 0.002) for r in range(10) for b in (0, 1)], "read_id long, bucket_id long, p double")
    for rate, n in ((0.8, 1), (None, 3)):
        rounds = []
        active, done = wave.run_em(w, config=wave.EmConfig(max_rounds=3, epsilon=-1.0, gamma=0.01), stop_rate=rate, on_round=lambda k, s: rounds.append(k))
        assert len(rounds) == n and done.count() == 9 and active.select("read_id").distinct().count() == 1


def test_a_mapper_that_loses_reads_is_incomplete(spark):
    a = spark.createDataFrame([(k, 1, 5, True) for k in range(10)], "read_id long, chrom long, pos long, mapped boolean")
    reads = spark.range(10).withColumnRenamed("id", "read_id")
    assert evaluation.real_validation(a, a, reads=reads).first()["passed"]
    assert not evaluation.real_validation(a.filter("read_id > 0"), a.filter("read_id > 0"), reads=reads).first()["complete"]
    assert not evaluation.real_validation(a.unionByName(a.filter("read_id = 1")), a, reads=reads).first()["complete"]


def test_sizes_are_renumbered(spark):
    l = spark.createDataFrame([(k, 7 if k < 5 else 3 if k < 7 else 20 + k) for k in range(10)], "node long, label long")
    got = {r.node: (r.label, r.name) for r in graph.filter_sizes(l, 2, 5).collect()}
    assert {got[k] for k in range(5)} == {(1, "C1")} and {got[k] for k in (5, 6)} == {(0, "C0")} and {got[k] for k in (7, 8, 9)} == {(2, "FILTERED")}


def test_like_reads_have_like_sketches(spark):
    rng = random.Random(7)
    base = "".join(rng.choice("ACGT") for _ in range(400))
    other = "".join(rng.choice("ACGT") for _ in range(400))
    rows = [(0, base), (1, base[:200] + "A" + base[201:]), (2, base[::-1].translate(str.maketrans("ACGT", "TGCA"))), (3, other), (4, ""), (5, None)]
    v = {r.id: np.array(r.vector) for r in graph.kmer_sketch(spark.createDataFrame(rows, "read_id long, seq string")).collect()}
    assert v[0] @ v[1] > 0.9 and abs(v[0] @ v[2] - 1) < 1e-9 and abs(v[0] @ v[3]) < 0.4 and not v[4].any() and not v[5].any()
