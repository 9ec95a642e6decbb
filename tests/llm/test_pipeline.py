import corpus_pipeline
from helixframe.llm import decontaminate, jaccard, quality
from helixframe.llm.shared import LOWER


def test_pipeline_matches_brute_force(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    pieces = corpus_pipeline.run(spark, medium).collect()
    got = {r.doc_id for r in pieces}
    # Stage 1 by its scores, then plain Python.
    good = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    best = {}
    for i, t in texts.items():
        key = t.encode().translate(LOWER)
        best[key] = max(best.get(key, -1), i)
    texts = {i: texts[i] for i in best.values()}
    ids = sorted(texts)
    import pyarrow as pa

    from helixframe.llm.shared import texts_of

    sets = [frozenset(s.tolist()) for s in jaccard.gram_sets(*texts_of(pa.array([texts[i] for i in ids])))]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(sets):
        for y in range(x):
            b = sets[y]
            if (a or b) and len(a & b) >= 0.5 * len(a | b) or not a and not b:
                root[find(ids[min(x, y)])] = find(ids[max(x, y)])
    tops = {}
    for i in ids:
        tops[find(i)] = max(tops.get(find(i), -1), i)
    texts = {i: texts[i] for i in tops.values()}
    items = [r.text for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()]
    want = {i for i, t in texts.items() if not any(item in t for item in items)}
    assert len(want) > 500 and got == want
    used = {}
    for r in pieces:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 1024 for v in used.values())


def test_stages_keep_the_columns_and_take_odd_rows(spark, odd, none, small):
    for docs in (odd, none):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, small)
            assert now.columns == docs.columns, name
            now = spark.createDataFrame(now.collect(), now.schema)
        corpus_pipeline.STAGES[-1][1](spark, now, small).count()


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    assert decontaminate.WIDTH == 8
