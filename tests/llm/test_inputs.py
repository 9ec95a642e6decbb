"""Operators give the same rows for files and for inputs whose rows move between scans, and leave all columns as they are."""

import pytest
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, exact_dedup, jaccard, quality, suffix_tree, warc
from helixframe.llm.shared import _is_scan, fresh, numbered, shared_dir

OWN = ("__row", "row_number", "row", "rid", "rep", "keep_id", "hash", "part", "scored_text")


@pytest.fixture(scope="module")
def docs(spark, medium):
    return spark.read.parquet(f"{medium}/documents.parquet")


@pytest.fixture(scope="module")
def moving(spark, docs):
    """The documents after a join, an aggregate and a repartition, with columns of the names that operators use themselves."""
    more = docs.groupBy(F.col("doc_id").alias("k")).agg(F.max("n_chars").alias("m"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    out = docs.join(more, docs["doc_id"] == more["k"]).drop("k", "m").withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in OWN})
    yield out.repartition(8)
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_scans_are_taken_as_they_are_and_others_written(docs, moving):
    assert numbered(docs) is docs
    plain = docs.filter("doc_id > 3").select("doc_id", F.upper("text").alias("t"))
    assert numbered(plain) is plain
    for df in (moving, docs.withColumn("x", F.rand()), docs.limit(5), docs.mapInArrow(lambda it: it, docs.schema), docs.orderBy("doc_id")):
        assert not _is_scan(df._jdf.queryExecution().analyzed())
        kept = numbered(df)
        assert kept is not df and _is_scan(kept._jdf.queryExecution().analyzed())
    assert docs.sparkSession.conf.get("spark.sql.files.minPartitionNum")


def test_names_that_are_free(docs):
    assert fresh(docs, "row") == "row" and fresh(docs, "TEXT") == "TEXT_2"
    assert fresh(docs.withColumn("text_2", F.lit(1)), "text") == "text_3"


@pytest.mark.parametrize("name", ["drop_exact", "one_of_each", "drop_leaks", "keep_good"])
def test_filters(spark, medium, docs, moving, name):
    bench, labels = (spark.read.parquet(f"{medium}/{t}.parquet") for t in ("benchmark", "labels"))
    run = {"drop_exact": exact_dedup.drop_exact, "one_of_each": jaccard.one_of_each, "drop_leaks": lambda d: decontaminate.drop_leaks(d, bench), "keep_good": lambda d: quality.keep_good(d, labels)}[name]
    want = sorted(r.doc_id for r in run(docs).select("doc_id").collect())
    got = run(moving)
    assert got.columns == moving.columns
    rows = got.select("doc_id", *OWN).collect()
    assert sorted(r.doc_id for r in rows) == want and 0 < len(want) < docs.count()
    assert all(r[c] == f"{c} {r.doc_id}" for r in rows for c in OWN)


@pytest.mark.parametrize("name", ["exact_groups", "similar", "leaks", "lm_scores"])
def test_results(spark, medium, docs, moving, name):
    bench = spark.read.parquet(f"{medium}/benchmark.parquet")
    run = {"exact_groups": exact_dedup.exact_groups, "similar": lambda d: jaccard.similar(d).drop("row"), "leaks": lambda d: decontaminate.leaks(d, bench).drop("row"), "lm_scores": suffix_tree.lm_scores}[name]
    rows = [sorted(str([round(x, 3) if isinstance(x, float) else x for x in r]) for r in run(d).collect()) for d in (docs, moving)]
    assert rows[0] and rows[0] == rows[1]


def test_archive(spark, medium, tmp_path):
    pages = spark.read.parquet(f"{medium}/pages.parquet")
    mixed = pages.join(pages.select("page_id").distinct(), "page_id").repartition(5)
    out = []
    for k, p in enumerate((pages, mixed)):
        at = warc.write_archive(p, f"{shared_dir(spark)}/inputs-{tmp_path.name}-{k}")
        out.append(sorted(str(r) for r in warc.read_records(spark, at).collect()))
    assert out[0] and out[0] == out[1]


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
