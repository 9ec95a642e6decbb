"""Inputs on which an earlier form gave a wrong, cut or superlinear result."""

import pytest

from helixframe.operators import graph, seeding, wave
from helixframe.runtime import cut


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_limited_hits_of_a_frequent_key(spark):
    """A key of more postings than the occurrence bound keeps a read's first hits; only the first postings are joined."""
    queries = frame(spark, "read_id long, hash long, pos int, same_strand boolean", (1, 0, 4, True), (1, 0, 2, False), (2, 0, 9, True), (3, 5, 0, True))
    index = spark.range(6000).selectExpr("5999 - id as ref_id", "0L as hash", "7 as pos", "true as same_strand")
    got = sorted(tuple(x) for x in seeding.seed_join(queries, index, key="hash", max_occ=None, max_hits=3).select("read_id", "query_pos", "ref_id", "same_strand").collect())
    assert got == [(1, 2, 0, False), (1, 2, 1, False), (1, 2, 2, False), (2, 9, 0, True), (2, 9, 1, True), (2, 9, 2, True)]
    assert seeding.seed_join(queries, index, key="hash", max_hits=3).count() == 0


def test_refinement_leaves_no_child_out(spark):
    """More children than the fifty that were kept: all of them get their share, spelled out or by parent."""
    w = frame(spark, "read_id long, bucket_id long, p double", (1, 0, 0.5), (1, 1, 0.5), (2, 1, 1.0), (3, 0, 0.995), (3, 1, 0.005))
    children = spark.range(90).selectExpr("id div 60 as parent", "id as child")
    full = {(x.read_id, x.bucket_id): x.p for x in wave.refine(w, children).collect()}
    assert len(full) == 90 + 30 + 60
    shared = wave.refine_shared(w, children).collect()
    assert {(x.read_id, x.parent): x.n for x in shared} == {(1, 0): 60, (1, 1): 30, (2, 1): 30, (3, 0): 60}
    told = {(x.read_id, c): x.p for x in shared for c in range(90) if c // 60 == x.parent}
    assert told.keys() == full.keys() and all(abs(told[k] - full[k]) < 1e-12 for k in full)


def test_compact_levels_equal_the_spelled_out_ones(spark):
    """Parents of more than fifty buckets: rows for the read's own buckets and one for the rest say what a row for each bucket says."""
    from helixframe.operators import compact

    top = spark.range(3).selectExpr("id as bucket_id")
    down = [spark.range(6).selectExpr("id div 2 as parent", "id as child"), spark.range(363).selectExpr("least(id div 72, 5) as parent", "id as child")]
    fine = [(r, (r * 37 + 91 * k) % 363, 0.2 + 0.3 * k) for r in range(12) for k in range(2)]
    sums = {}
    for r, b, w in fine:
        for level, x in enumerate((min(b // 72, 5) // 2, min(b // 72, 5), b)):
            sums[level, r, x] = sums.get((level, r, x), 0) + w
    evidence = [frame(spark, "read_id long, bucket_id long, likelihood double", *[(r, x, w) for (k, r, x), w in sums.items() if k == level]) for level in range(3)]
    reads, config = spark.range(12).selectExpr("id as read_id"), wave.EmConfig(max_rounds=3, epsilon=0.0)
    full = {(x.read_id, x.bucket_id): x.p for x in wave.run_levels(reads, [top], down, config=config, evidence=evidence).collect()}
    got = compact.levels(reads, top, down, evidence, config).collect()
    spelled = {(x.read_id, x.bucket_id): x.p for x in got if x.bucket_id is not None}
    for x in got:
        if x.bucket_id is None:
            rest = [b for b in range(363) if min(b // 72, 5) == x.parent and (x.read_id, b) not in spelled]
            assert len(rest) == x.n
            spelled |= {(x.read_id, b): x.p for b in rest}
    assert spelled.keys() == full.keys() and max(x.n for x in got) > 50, (len(spelled), len(full))
    assert max(abs(spelled[k] - full[k]) for k in full) < 1e-9


def test_nearest_of_equal_vectors_are_the_smaller_ids(spark):
    """Copies of vectors over several blocks tie exactly; what is shuffled follows the rows, not the pairs of blocks."""
    rows = [(i, [float((i % 7) ** 2 % 5), float(i % 7), 1.0, 0.1 * (i % 3)]) for i in range(300)]
    v = frame(spark, "id long, vector array<double>", *rows)
    same = {}
    for i, x in rows:
        same.setdefault(tuple(x), []).append(i)
    for metric in graph.METRICS[::2]:
        found = graph.knn(v, v, 3, block=64, metric=metric)
        got = {}
        for x in found.orderBy("src", "rank").collect():
            got.setdefault(x.src, []).append(x.dst)
        assert got == {i: [j for j in same[tuple(x)] if j != i][:3] for i, x in rows}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" not in plan


def test_lists_are_assigned_some_rows_at_a_time():
    import numpy as np

    x, c = np.random.default_rng(1).normal(size=(2500, 8)), np.random.default_rng(2).normal(size=(40, 8))
    assert (graph.nearest_list(x, c) == (x @ c.T).argmax(axis=1)).all()


def test_short_ways_of_alignment_equal_the_matrices():
    """Gaps of few mismatches and ends without a difference take no matrices, with the same result."""
    import random

    import numpy as np

    from helixframe.functions import alignment as K

    rng, c = random.Random(5), K.Costs()
    for _ in range(300):
        n = rng.randrange(1, 30)
        ref = "".join(rng.choice("ACGT") for _ in range(n + rng.randrange(0, 20)))
        query = "".join(rng.choice("ACGT") if rng.random() < 0.1 else x for x in ref[:n])
        q, r = query.encode(), ref.encode()
        for target in (r[:n], r):
            mats = K._matrices(np.frombuffer(q, np.uint8), np.frombuffer(target, np.uint8), c)
            want = int(min(m[-1, -1] for m in mats)), K._trace(np.frombuffer(q, np.uint8), np.frombuffer(target, np.uint8), mats, n, len(target), c)
            assert K.global_align(q, target, c) == want
        gain = np.add.outer(np.arange(n + 1), np.arange(len(r) + 1)) - np.minimum(np.minimum(mats[0], mats[1]), mats[2])
        i, j = (int(x) for x in np.unravel_index(int(gain.argmax()), gain.shape))
        assert K.extend(q, r, c) == (i, j, K._trace(np.frombuffer(q, np.uint8), np.frombuffer(r, np.uint8), mats, i, j, c))


def test_minimizers_are_summed_up_where_reads_are(spark, small):
    """No row for each minimizer is shuffled; keys of several rows, null among them, are one group as before (F13)."""
    from pyspark.sql import functions as F

    import __spark_entry__
    from helixframe.functions import sequence as Q

    assert "Exchange" not in __spark_entry__.queries()["read_minimizers"](spark, small)._jdf.queryExecution().executedPlan().toString()
    text = "ACGTTGCATCCGATAGGCTTACGATCGGATTACACCGT"
    reads = frame(spark, "read_id long, seq string", (1, text), (2, text[3:]), (2, text[:30]), (None, text), (None, text[5:]), (3, "ACG"), (4, None))
    m = Q.coded_minimizers(reads, "read_id", "seq").groupBy("read_id")
    want = m.agg(F.count("*"), F.min("pos"), F.max("pos"), F.count_distinct("kmer")).collect()
    got = seeding.minimizer_summary(reads, "read_id", "seq").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want))) and len(got) == 3


def test_no_neighbours_below_the_least_similarity(spark):
    """What a graph would leave out is left out where neighbours are found, with the same rest; a row that isn't finite hides no other (F4)."""
    import numpy as np

    x = np.random.default_rng(3).normal(size=(200, 6))
    x[5] = np.nan
    ids, blocks = np.arange(200), [(np.arange(200)[i : i + 64], x[i : i + 64]) for i in range(0, 200, 64)]
    full, cut_ = graph.scan(x, ids, blocks, 7, "cosine"), graph.scan(x, ids, blocks, 7, "cosine", 0.8)
    keep = full[1] >= 0.8
    assert 0 < keep.sum() < len(keep) and all((a[keep] == b).all() for a, b in zip(full, cut_)) and len(set(full[0])) == 199


def test_rounds_keep_the_graph_and_send_nothing_through_the_driver(spark):
    """Rounds of communities and of self-EM shuffle labels and rows, not the kept edges, and broadcast nothing that grows (F14, F18)."""
    import random

    rng = random.Random(4)
    pairs = {(min(a, b), max(a, b)): 0.4 + rng.random() / 2 for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(200)) if a != b and (a // 12 == b // 12 or rng.random() < 0.1)}
    e = frame(spark, "src long, dst long, weight double", *[(x, y, w) for (a, b), w in pairs.items() for x, y in ((a, b), (b, a))])
    labels = graph.communities(e)
    assert graph.gains(e, labels).filter("gain > 1e-7").count() == 0
    plans, cut = [], graph.cut
    graph.cut = lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1]
    try:
        em = {x.node: x for x in graph.self_em(e, labels, rounds=4, epsilon=0.0).collect()}
        graph.communities(e, sweeps=1)
    finally:
        graph.cut = cut
    assert not any("Broadcast" in x for x in plans) and sum("InMemoryTableScan" in x for x in plans) == 6
    s, p = graph.self_em_start(e, labels)
    for _ in range(4):
        p = cut(graph.self_em_step(s, p))
    best = {}
    for x in p.collect():
        best[x.i] = max(best.get(x.i, 0.0), x.p)
    assert best.keys() == em.keys() and all(abs(best[i] - em[i].p) < 1e-9 for i in best)


def test_bases_at_sites_without_a_row_for_each_base(spark):
    """Hits that span several bins, deletions, clips and short texts: the looked-up bases are those of a walk over all of them (F16)."""
    from helixframe.functions import cigar
    from helixframe.operators import paralog

    rows = [(1, 1, 0, 250, "2S8M1D5=2I3X"), (1, 2, 0, 5, "600M"), (2, 1, 1, 250, "4M3N4M"), (3, 1, 0, 251, "*")]
    hits = frame(spark, "read_id long, hit int, chrom long, start long, end long, cigar string, seq string", *[(r, h, c, s, s + 700, g, ("ACGT" * 150)[: 12 if r == 2 else 599]) for r, h, c, s, g in rows])
    sites = spark.range(800).selectExpr("id + 1000 as psv_id", "id % 2 as chrom", "id as pos")
    walked = {(x.read_id, x.hit, x.ref_pos): x.read_pos for x in cigar.walk(hits, ["read_id", "hit"], "cigar", "start").collect()}
    text = {(x.read_id, x.hit): (x.chrom, x.seq) for x in hits.collect()}
    want = {(r, h, p + 1000, at, text[r, h][1][at]) for (r, h, p), at in walked.items() if p % 2 == text[r, h][0] and at < len(text[r, h][1])}
    assert {(x.read_id, x.hit, x.psv_id, x.read_pos, x.base) for x in paralog.observations(hits, sites).collect()} == want and len(want) > 250


def shuffled_rows(spark, run):
    """Rows that all stages of ``run`` write to shuffles."""
    sc, group = spark.sparkContext, f"counted-{id(run)}"
    sc.setJobGroup(group, group)
    try:
        run()
        sc._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    finally:
        for x in ("spark.jobGroup.id", "spark.job.description"):
            sc.setLocalProperty(x, None)
    return sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_what_a_graph_shuffles_follows_its_rows(spark):
    """Four times the vectors shuffle about four times the rows, whatever the number of blocks (F21 to F30); blocks are tasks of their own."""
    import numpy as np

    x, moved = np.random.default_rng(8).normal(size=(2400, 6)).tolist(), []
    for n in (600, 2400):
        v = cut(frame(spark, "id long, vector array<double>", *enumerate(x[:n])))
        moved.append(shuffled_rows(spark, lambda: graph.graph(graph.knn(v, v, 3, block=64)).collect()))
    assert 0 < moved[1] < 5 * moved[0], moved
    assert "REPARTITION_BY_NUM" in graph.knn(v, v, 3, block=64)._jdf.queryExecution().executedPlan().toString()


def test_nearest_over_tiles_of_a_block(spark):
    """Blocks of more columns than are multiplied at once, equal vectors far apart in them, none finite, none at all: as by brute force (F21 to F30)."""
    import numpy as np

    x = np.random.default_rng(9).normal(size=(1700, 5))
    x[1300], x[1699], x[20] = x[10], x[10] * 2, np.nan
    x[1] = 0.0
    ids = np.arange(1700) * 3
    blocks = [(ids[:1400], x[:1400]), (ids[20:21], x[20:21]), (ids[:0], x[:0]), (ids[1400:], x[1400:])]
    fine = np.flatnonzero(np.isfinite(x).all(axis=1))
    u = x[fine] / np.maximum(np.linalg.norm(x[fine], axis=1, keepdims=True), 1e-300)
    for least in (-np.inf, 0.9):
        rows, similarity, found = graph.scan(x, ids, blocks, 4, "cosine", least)
        got = {(int(ids[r]), int(j)): s for r, s, j in zip(rows, similarity, found)}
        want = {}
        for i in range(len(u)):
            s = (u * u[i]).sum(axis=1)
            order = [j for j in np.lexsort((ids[fine], -s)) if j != i][:4]
            want |= {(int(ids[fine][i]), int(ids[fine][j])): s[j] for j in order if s[j] >= least}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert {(30, 3900), (30, 5097), (3900, 30), (5097, 30)} <= got.keys()


def test_the_base_is_read_some_times_a_core(spark):
    """Queries are tasks of at most three a core, not one for each block: the base isn't read once for each 2,048 rows (F22 to F29); neighbours as by one block."""
    import re

    import numpy as np

    x = np.random.default_rng(10).normal(size=(1600, 4))
    x[900:1000] = x[:100]
    v = cut(frame(spark, "id long, vector array<double>", *enumerate(x.tolist())))
    found = graph.knn(v, v, 3, block=8)
    tasks = [int(n) for n in re.findall(r"(\d+)\), REPARTITION_BY_NUM", found._jdf.queryExecution().executedPlan().toString())]
    assert len(tasks) == 1 and 24 <= tasks[0] <= max(24, 3 * spark.sparkContext.defaultParallelism)
    got = sorted((r.src, r.rank, r.dst) for r in found.collect())
    assert got == sorted((r.src, r.rank, r.dst) for r in graph.knn(v, v, 3, least_tasks=1).collect()) and len(got) == 4800
    for metric in graph.METRICS:
        one, more = (graph.scan(x, np.arange(1600), [(np.arange(1600), x)], 3, metric, tall=t) for t in (1600, 77))
        assert all((a == b).all() for a, b in zip(one, more))


@pytest.mark.parametrize("name", ["modularity_by_label", "edge_list_export", "cluster_cohesion", "graph_stats", "graph_degree", "similarity_graph", "graph_edge_lookup", "self_em_summary"])
def test_what_a_graph_query_shuffles_follows_its_rows(spark, medium, name, monkeypatch):
    """A whole query over four times the vectors, in many blocks, shuffles about four times the rows (F22 to F29)."""
    import __spark_entry__

    own, moved = graph.knn, []
    monkeypatch.setattr(graph, "knn", lambda *a, **kw: own(*a, **{"block": 32} | kw))
    for d in (medium, f"{medium}/../sf0.1"):
        moved.append(shuffled_rows(spark, lambda d=d: __spark_entry__.queries()[name](spark, d).collect()))
    assert 0 < moved[1] < 6 * moved[0], moved
