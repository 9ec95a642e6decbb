"""Operators on small inputs with edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from helixframe.operators import annotation, evaluation, graph, paralog, records, relational, singlecell, stall, wave


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_normalise_is_uniform_for_zero_sums(spark):
    df = frame(spark, "r long, w double", (1, 0.0), (1, 0.0), (2, 1.0), (2, 3.0))
    got = sorted((x.r, x.p) for x in relational.normalise(df, ["r"], "w", "p").collect())
    assert got == [(1, 0.5), (1, 0.5), (2, 0.25), (2, 0.75)]


def test_top_two_breaks_ties_by_bucket(spark):
    df = frame(spark, "read_id long, bucket_id long, p double", (1, 9, 0.5), (1, 3, 0.5), (2, 1, 1.0))
    got = {x.read_id: (x.best_bucket, x.second_bucket) for x in relational.top_two(df, ["read_id"], "bucket_id", "p").collect()}
    assert got == {1: (3, 9), 2: (1, None)}


def test_islands_and_relabel(spark):
    df = frame(spark, "k long, start long, end long, label string", (1, 0, 5, "a"), (1, 5, 9, "a"), (1, 9, 12, "b"), (1, 13, 15, "b"), (2, 0, 5, "a"))
    got = sorted((x.k, x.start, x.end, x.label, x.n_windows) for x in relational.islands(df, ["k"], "start", "end", "label").collect())
    assert got == [(1, 0, 9, "a", 2), (1, 9, 12, "b", 1), (1, 13, 15, "b", 1), (2, 0, 5, "a", 1)]
    ids = {x.label: x.n for x in relational.relabel(df, "label", "start", "n").collect()}
    assert ids == {"a": 0, "b": 1}


def test_range_joins_at_borders(spark):
    p = frame(spark, "c long, pos long, id long", (1, 0, 1), (1, 255, 2), (1, 256, 3), (1, 600, 4), (2, 5, 5), (1, -1, 6))
    i = frame(spark, "c long, start long, end long", (1, 0, 256), (1, 256, 257), (1, 300, 300), (1, -10, 700))
    got = sorted((x.id, x.start) for x in relational.points_in_intervals(p, i, on=["c"]).collect())
    assert got == [(1, -10), (1, 0), (2, -10), (2, 0), (3, -10), (3, 256), (4, -10), (6, -10)]
    a = frame(spark, "c long, s1 long, e1 long", (1, 0, 1000), (1, 1000, 1001))
    b = frame(spark, "c long, s2 long, e2 long", (1, 999, 1000), (1, 1000, 2000), (1, 0, 0), (2, 0, 9))
    got = sorted((x.s1, x.s2) for x in relational.overlapping(a, b, on=["c"], a_span=("s1", "e1"), b_span=("s2", "e2")).collect())
    assert got == [(0, 999), (1000, 1000)]
    near = relational.within_distance(frame(spark, "c long, id long, pos long", (1, 1, 0), (1, 2, 10), (1, 3, 21), (2, 4, 0)), key="id", pos="pos", on=["c"], radius=10)
    assert sorted((x.id, x.id_2) for x in near.collect()) == [(1, 2), (2, 1)]


def waves(spark):
    return frame(spark, "read_id long, bucket_id long, p double", (1, 0, 0.5), (1, 1, 0.5), (2, 1, 1.0), (3, 2, 0.34), (3, 3, 0.33), (3, 4, 0.33))


def test_em_keeps_mass_and_converges(spark):
    seen = []
    active, done = wave.run_em(waves(spark), config=wave.EmConfig(max_rounds=30), on_round=lambda k, s: seen.append(s["max_delta"]))
    assert seen and seen[-1] < seen[0] + 1e-12
    per = active.groupBy("read_id").agg(F.sum("p").alias("s")).collect()
    assert all(abs(x.s - 1) < 1e-9 for x in per)
    placed = {x.read_id: x.best_bucket for x in done.collect()}
    assert placed[2] == 1 and set(placed) | {x.read_id for x in per} == {1, 2, 3}


def test_levels_refine_down(spark):
    reads = frame(spark, "read_id long", (1,), (2,))
    top = frame(spark, "bucket_id long", (0,), (1,))
    children = frame(spark, "parent long, child long", (0, 10), (0, 11), (1, 12))
    got = wave.run_levels(reads, [top], [children], config=wave.EmConfig(max_rounds=3), likelihood=F.when(F.col("bucket_id") >= 10, 1.0).otherwise(1.0))
    sums = got.groupBy("read_id").agg(F.sum("p").alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == 2 and all(abs(x.s - 1) < 1e-9 and x.n == 3 for x in sums)


def test_levels_follow_the_reads_weights(spark, small):
    from helixframe.plans.extras import stage2_levels
    from helixframe.plans.wave import wave as weights

    got = stage2_levels(spark, small).toPandas()
    own = weights(spark, small).toPandas()
    assert set(got.read_id) == set(own.read_id)
    best = got.sort_values("p").groupby("read_id").tail(1)
    assert best.bucket_id.nunique() > 1
    assert len(best.merge(own, on=["read_id", "bucket_id"])) > 0.95 * len(best)


def test_communities_stand_still(spark):
    """No node is left that would gain by a move."""
    import random

    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(150), 2))) for _ in range(300)}
    both = [(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs]
    label = {x.node: x.label for x in graph.communities(frame(spark, "src long, dst long, weight double", *both)).collect()}
    k, total, links = {}, {}, {}
    for a, b, w in both:
        k[a] = k.get(a, 0) + w
        links.setdefault(a, {}).setdefault(label[b], 0)
        links[a][label[b]] += w
    for v in k:
        total[label[v]] = total.get(label[v], 0) + k[v]
    m = len(pairs)
    gains = [(w - links[v].get(label[v], 0)) / m - k[v] * (total[c] - (total[label[v]] - k[v])) / (2 * m * m) for v in k for c, w in links[v].items() if c != label[v]]
    assert max(gains) <= 1e-7


def test_dropout_kinds(spark):
    df = frame(spark, "read_id long, bucket_id long, p double", (1, 0, 0.0), (2, 0, 1.0), (3, 0, 0.5), (3, 1, 0.5), (4, 0, 0.45), (4, 1, 0.3), (5, 0, 0.7), (5, 1, 0.3))
    assert {x.read_id: x.dropout for x in wave.classify(df).collect()} == {1: "Orphaned", 2: "Converged", 3: "Ambiguous", 4: "LowConfidence", 5: "None"}


def test_empty_waves(spark):
    empty = waves(spark).limit(0)
    assert wave.em_step(empty).count() == 0 and wave.classify(empty).count() == 0
    assert wave.collapse_stats(wave.classify(empty)).first().n_reads == 0


def test_graph_of_two_cliques(spark):
    pairs = [(a, b, 0.9) for c in (range(5), range(10, 15)) for a in c for b in c if a != b] + [(4, 10, 0.1), (10, 4, 0.1)]
    e = frame(spark, "src long, dst long, weight double", *pairs).cache()
    labels = graph.communities(e).cache()
    by = {x.node: x.label for x in labels.collect()}
    assert len({by[k] for k in range(5)}) == 1 and len({by[k] for k in range(10, 15)}) == 1 and by[0] != by[10]
    found = graph.modularity(e, labels).first()[0]
    assert found > graph.modularity(e, labels.withColumn("label", F.lit(0))).first()[0]
    assert all(x.connected for x in graph.well_connected(e, labels).collect())
    assert {x.size for x in graph.representatives(e, labels).collect()} == {5}
    em = graph.self_em(e, labels).collect()
    assert len(em) == 10 and all(0 < x.p <= 1 for x in em)
    flagged = graph.split_small(labels, 6, 10)
    assert flagged.filter("kept").count() == 0 and flagged.count() == 10
    assert {x.node: x.root for x in graph.components(e).collect()} == {k: 0 for k in (*range(5), *range(10, 15))}


def test_bad_partition_is_not_connected(spark):
    e = frame(spark, "src long, dst long, weight double", (1, 2, 1.0), (2, 1, 1.0), (3, 4, 1.0), (4, 3, 1.0))
    labels = frame(spark, "node long, label long", (1, 0), (2, 0), (3, 0), (4, 0), (5, 1))
    got = {x.label: (x.n_parts, x.connected) for x in graph.well_connected(e, labels).collect()}
    assert got == {0: (2, False), 1: (1, True)}
    assert {x.label: x.cohesion for x in graph.cohesion(e, labels).collect()} == {0: pytest.approx(1 / 3), 1: 1.0}


def test_knn_in_blocks_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    v = frame(spark, "id long, vector array<double>", *[(k, [float(c) for c in r]) for k, r in enumerate(x)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(k, int(j)) for k in range(60) for j in np.argsort(-s[k])[:4]}
    for block in (7, 1000):
        assert {(r.src, r.dst) for r in graph.knn(v, v, 4, block=block).collect()} == want
    hits = graph.recall(graph.knn_ivf(v, v, 4, lists=6, probes=6), graph.knn(v, v, 4)).first()
    assert hits.recall == 1.0


def test_posterior_and_missing_alleles(spark):
    sites = frame(spark, "psv_id long, paralog string, allele string, informativeness double", (1, "A", "A", 1.0), (1, "B", "C", 1.0), (2, "A", "G", 0.1), (3, "A", "T", 0.9))
    obs = frame(spark, "read_id long, psv_id long, base string, base_quality int", (1, 1, "A", 30), (1, 2, "G", 30), (2, 1, "A", 10), (3, 3, "C", 30))
    names = frame(spark, "paralog string", ("A",), ("B",))
    l = {(x.read_id, x.paralog): (round(x.log_likelihood, 4), x.support, x.conflict) for x in paralog.likelihoods(obs, sites, names).collect()}
    assert l == {(1, "A"): (-0.0101, 1, 0), (1, "B"): (-5.7038, 0, 1), (3, "A"): (-5.7038, 0, 1), (3, "B"): (0.0, 0, 0)}
    p = paralog.assignments(paralog.posteriors(paralog.likelihoods(obs, sites, names)))
    assert {x.read_id: x.paralog for x in p.collect()} == {1: "A", 3: "B"}


def test_shared_exon_is_ambiguous(spark):
    exon = "ACGTTGCAAGGCTTAACCGGATAT" * 2
    anchors = frame(spark, "gene string, copy string, exon string, anchor string", ("G1", "G1_A", "CH1", exon), ("G1", "G1_B", "CH1", exon), ("G1", "G1_A", "CH2", "GGGGGCCCCCTTTTTAAAAACGCGCG"))
    rc = exon[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = frame(spark, "read_id long, seq string", (1, "TT" + exon + "TT"), (2, rc), (3, exon + "GGGGGCCCCCTTTTTAAAAACGCGCG"), (4, "ACGT"), (5, ""))
    got = {x.read_id: x for x in paralog.best_copy(paralog.anchor_hits(reads, anchors, 20)).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].copy, got[1].ambiguous_copy, got[1].tied_copies, got[1].forward) == ("G1_A", True, "G1_A,G1_B", True)
    assert got[2].forward is False and (got[3].copy, got[3].n_exons, got[3].ambiguous_copy) == ("G1_A", 2, False)


def test_rules_from_json_and_order(spark):
    text = json.dumps({"rules": [
        {"region_name": "low", "priority": 1, "predicates": []}, {"region": "high", "priority": 5, "predicate": [{"feature": "gc", "op": "ge", "value": 0.6}]},
        {"region_name": "gone", "priority": 9, "feature_signature": [{"feature": "tandem_period", "op": "is_null"}, {"feature": "gc", "op": "le", "value": 0.1}]},
    ]})
    df = frame(spark, "id long, gc double, tandem_period int", (1, 0.7, 3), (2, 0.5, 3), (3, 0.05, -1), (4, None, None))
    got = {x.id: x.region for x in annotation.classify(df, annotation.load_rules(text)).collect()}
    assert got == {1: "high", 2: "low", 3: "gone", 4: "low"}
    assert {x.region for x in annotation.classify(df, []).collect()} == {None}


def test_highest_layer_wins(spark):
    p = frame(spark, "ref_id long, pos long", (1, 5))
    i = frame(spark, "ref_id long, start long, end long, layer int, lambda_scale double, weight_scale double, interval_id long", (1, 0, 9, 0, 1.0, 2.0, 1), (1, 4, 6, 2, 3.0, None, 2))
    r = annotation.parameters_at(p, i).first()
    assert (r.n_intervals, r.top_layer, r.lambda_scale, r.weight_scale) == (2, 2, 3.0, 2.0)


def test_lossless_and_flatten(spark):
    df = frame(spark, "read_id string, status string, has_primary boolean, n_targets int, reason string", ("a", "Mapped", True, 0, None), ("", "Mapped", True, 0, None), ("b", "Tentative", False, 0, "x"), ("c", "Unmapped", False, 0, "x"), ("d", "Other", False, 0, "x"), (None, "Unmapped", False, 0, "x"))
    assert [x.ok for x in df.select(records.is_lossless().alias("ok")).collect()] == [True, False, False, True, False, False]
    r = frame(spark, "read_id long, status string, confidence double, targets array<struct<bucket_id: string, p: double>>", (1, "Mapped", 0.9, [("b1", 0.1), ("b2", 0.1), ("b3", 0.1)]), (2, "Unmapped", None, None), (3, "Tentative", None, [("b1", 0.6), ("b2", 0.1)]), (4, "Unmapped", None, []))
    got = sorted((x.read_id, x.bucket_id, round(x.probability, 3), round(x.confidence, 3), x.is_collapsed) for x in records.flatten(r, min_probability=0.4).collect())
    assert got == [(1, "b1", 1.0, 0.9, True), (1, "b2", 0.45, 0.45, False), (2, "*", 0.0, 0.0, False), (3, "b1", 0.6, 0.6, False), (4, "*", 0.0, 0.0, False)]


def test_mapping_quality(spark):
    df = frame(spark, "s double, n int, i double, g double, k int", (100.0, 100, 0.95, 0.0, 2), (100.0, 100, 0.95, 100.0, 3), (0.0, 10, 0.9, 5.0, 1), (10.0, 100, 0.9, 1000.0, 1))
    got = df.select(records.unique_mapq(F.col("s"), F.col("n"), F.col("i")).alias("u"), records.multi_mapq(F.col("g"), F.col("k"), F.col("i")).alias("m")).collect()
    assert [x.u for x in got] == [50, 50, 0, 10] and [x.m for x in got] == [0, 12, 0, 60]


def test_barcodes(spark):
    seen = frame(spark, "barcode string", ("AAAA",), ("AAAT",), ("CCCC",), ("AAA",), ("",))
    white = frame(spark, "barcode string", ("AAAA",), ("AATT",), ("GGGG",))
    got = {x.barcode: (x.corrected, x.distance) for x in records.correct_barcodes(seen, white).collect()}
    assert got == {"AAAA": ("AAAA", 0), "AAAT": ("AAAA", 1)}
    aux = frame(spark, "aux string", ("NM:i:3\tCB:Z:ACGT\tUB:Z:TT",), ("XX:Z:1",))
    assert [x.cb for x in aux.select(records.tag(F.col("aux"), "CB").alias("cb")).collect()] == ["ACGT", None]


def test_single_cells(spark):
    c = frame(spark, "cell long, paralog string, prob double, conf double", (1, "a", 0.5, 0.5), (1, "a", 0.1, 0.0), (1, "b", 0.001, 1.0), (2, "b", 0.9, 0.0))
    m = singlecell.matrix(c, "weighted")
    assert {(x.cell, x.paralog): round(x.value, 4) for x in m.collect()} == {(1, "a"): 2.4, (2, "b"): 0.9}
    assert singlecell.matrix(c, min_reads_per_cell=2).count() == 1 and singlecell.matrix(c, min_reads_per_paralog=2).count() == 1
    assert [tuple(x) for x in singlecell.dense(m, ["a", "b"]).orderBy("cell").collect()] == [(1, 2.4, 0.0), (2, 0.0, 0.9)]
    assert singlecell.matrix_stats(m.limit(0)).first().nnz == 0


def test_evaluation_edges(spark):
    a = frame(spark, "read_id long, chrom long, pos long, mapped boolean", (1, 1, 100, True), (2, 1, 100, True), (3, 1, 5, False))
    b = frame(spark, "read_id long, chrom long, pos long, mapped boolean", (1, 1, 110, True), (2, 2, 100, True), (4, 1, 1, True), (3, 1, 1, False))
    got = {x.read_id: x.category for x in evaluation.concordance(a, b, 10).collect()}
    assert got == {1: "same_position", 2: "diff_chrom", 3: "both_unmapped", 4: "only_b"}
    e = evaluation.truth_evaluation(a, b, 10).first()
    assert (e.tp, e.fp, e.fn, e.recall) == (1, 1, 2, 0.25)
    assert evaluation.truth_evaluation(a.limit(0), b.limit(0), 10).first().f1 == 0.0


def test_stall_states(spark):
    flat = [(1, k, 2.0) for k in range(6)]
    swing = [(2, k, 2.0 + (k % 2)) for k in range(6)]
    down = [(3, k, 2.0 ** -k) for k in range(6)]
    s = stall.states(frame(spark, "run long, k long, e double", *flat, *swing, *down), "run", "k", "e")
    last = {x.run: x.state for x in s.filter("k = 5").collect()}
    assert last == {1: "NoProgress", 2: "Oscillating", 3: "Fine"}
    assert {x.state for x in s.filter("k < 4").collect()} == {"Warming"}
