"""A third of all rows share a source and a text; results are whole."""

import random

import pytest

from helixframe.llm import exact_dedup, jaccard, language, suffix_tree


@pytest.fixture(scope="module")
def hot(spark):
    g = random.Random(3)
    words = [f"word{k}" for k in range(400)]
    text = lambda: " ".join(g.choice(words) for _ in range(30))
    same = text()
    rows = [(k, same if k % 3 == 0 else text(), "en", "hot" if k % 3 == 0 else f"s{k % 50}", 1) for k in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)


def test_exact_groups(hot):
    rows = exact_dedup.exact_groups(hot, fold_bytes=4000, table_bytes=4000).collect()
    top = [r for r in rows if r.group_size > 1]
    assert len(rows) == 3000 and len(top) == 1000
    assert {(r.keep_id, r.group_size) for r in top} == {(2997, 1000)} and [r.doc_id for r in top if r.kept] == [2997]


def test_similar(hot):
    rows = jaccard.similar(hot).collect()
    assert len(rows) == 3000
    assert {(r.class_id, r.class_size, r.n_links) for r in rows if r.doc_id % 3 == 0} == {(2997, 1000, 0)}
    assert sum(r.kept for r in rows) == 2001


def test_models_see_every_row(hot):
    assert language.identify(hot, language.fit_on(hot)).count() == 3000
    rows = suffix_tree.lm_scores(hot).collect()
    assert len(rows) == 3000 and {r.n_tokens for r in rows} == {31}
    assert rows[0].train_tokens == 31 * sum(not r.held_out for r in rows)


def test_window_limit_in_the_language_sample(hot):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ranked = hot.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id")))).filter(F.col("rank") <= language.SAMPLE)
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()
