from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import records as X
from ..operators import relational as R
from ..operators import wave as W
from ..runtime import q, table
from .base import query
from .wave import wave


@query("contiguous_relabel", "WITH l AS (SELECT l_suppkey AS label, min(l_orderkey * 8 + l_linenumber) AS first FROM lineitem GROUP BY 1) SELECT label, row_number() OVER (ORDER BY first, label) - 1 AS new_label FROM l")
def contiguous_relabel(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("label"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"))
    return R.relabel(li, "label", "at", "new_label").select("label", "new_label").distinct()


@query(
    "best_fraction",
    "WITH s AS (SELECT l_orderkey AS read_id, l_linenumber::INT AS chain, l_quantity AS score, max(l_quantity) OVER (PARTITION BY l_orderkey) AS best FROM lineitem) SELECT read_id, chain, score FROM s WHERE score >= floor(best * 0.5e0)",
)
def best_fraction(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").cast("int").alias("chain"), F.col("l_quantity").alias("score"))
    return R.best_fraction(c, ["read_id"], "score", 0.5)


@query(
    "group_by_read",
    f"WITH {A.PROB_ROWS} SELECT read_id, string_agg(bucket_id || ':' || round(probability, 2)::DECIMAL(4, 2), ',' ORDER BY probability DESC, bucket_id) AS rows FROM prob_rows GROUP BY 1",
)
def group_by_read(spark, d):
    g = X.by_read(A.prob_rows(spark, d))
    text = F.transform("rows", lambda x: F.concat(x["bucket_id"].cast("string"), F.lit(":"), F.round(x["probability"], 2).cast("decimal(4,2)").cast("string")))
    return g.select("read_id", F.array_join(text, ",").alias("rows"))


@query(
    "extract_alignments",
    f"""WITH {A.WAVE}, {A.PYRAMID}, b AS (SELECT read_id, max(p) AS m, arg_min(bucket_id, -p * 1e6 + bucket_id * 1e-6) AS b FROM wave GROUP BY 1)
SELECT read_id, l1 AS target, pos AS position, round(m, 6) AS confidence FROM b JOIN pyramid ON l2 = b WHERE m >= 0.6e0""",
)
def extract_alignments(spark, d):
    buckets = A.pyramid(spark, d).select(F.col("l2").alias("bucket_id"), F.col("l1").alias("target"), F.col("pos").alias("start"))
    return W.extract(W.collapse(wave(spark, d), 0.6), buckets).withColumn("confidence", q("confidence"))


@query("bucket_estimate", f"WITH {A.REFS} SELECT sum(len(seq))::BIGINT AS total_length, sum(ceil(len(seq) / 50e0))::BIGINT AS n_buckets FROM refs")
def bucket_estimate(spark, d):
    return W.bucket_estimate(A.refs(spark, d).select(F.length("seq").cast("long").alias("length")), 50)


@query(
    "cache_keys",
    "SELECT l_orderkey AS read_id, sha256('v1|tie|' || l_orderkey || '|ref|' || min(l_shipdate)::DATE || '|' || string_agg(l_suppkey || ':' || l_quantity::INT, ';' ORDER BY l_suppkey || ':' || l_quantity::INT)) AS key FROM lineitem GROUP BY 1",
)
def cache_keys(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("read_id")).agg(F.min("l_shipdate").cast("date").alias("r"), F.collect_list(F.concat(F.col("l_suppkey").cast("string"), F.lit(":"), F.col("l_quantity").cast("int").cast("string"))).alias("c"))
    return g.select("read_id", X.cache_key(F.lit("tie"), F.col("read_id").cast("string"), F.lit("ref"), F.col("r").cast("string"), F.col("c")).alias("key"))


@query(
    "read_barcodes",
    """SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN 'M' || (user_id % 10) END, 'R' || (event_id % 7)) AS barcode,
  CASE WHEN event_type IN ('view', 'click') THEN event_type END AS gene FROM events""",
)
def read_barcodes(spark, d):
    """A map's barcode where the read is in it, else that in its name; the gene of its target."""
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", F.concat(F.lit("run CB:R"), (F.col("event_id") % 7).cast("string"), F.lit(" x")).alias("name"))
    known = e.filter("event_id % 2 = 0").select("event_id", F.concat(F.lit("M"), (F.col("user_id") % 10).cast("string")).alias("mapped"))
    j = e.join(known, "event_id", "left")
    barcode = F.coalesce(X.barcode_of(F.col("name"), mapped=F.col("mapped")), X.barcode_of(F.col("name"), prefix="CB:"))
    return j.select("event_id", barcode.alias("barcode"), X.gene_of(F.concat("event_type", F.lit("_A_CH1")), ("view", "click")).alias("gene"))


@query(
    "real_validation",
    f"""WITH {A.CALLS_A}, {A.CALLS_B}, j AS (SELECT coalesce(a.mapped, false) AS ma, coalesce(b.mapped, false) AS mb FROM calls_a a FULL JOIN calls_b b ON a.read_id = b.read_id),
c AS (SELECT NOT EXISTS (SELECT 1 FROM calls_b WHERE read_id NOT IN (SELECT read_id FROM calls_a)) AS complete)
SELECT count(*) AS n, round(count(*) FILTER (ma) / count(*) FILTER (mb)::DOUBLE, 6) AS ratio, (SELECT complete FROM c) AS complete, (SELECT complete FROM c) AND count(*) FILTER (ma) / count(*) FILTER (mb)::DOUBLE >= 0.995e0 AS passed FROM j""",
)
def real_validation(spark, d):
    return E.real_validation(A.calls_a(spark, d), A.calls_b(spark, d)).select("n", q("ratio").alias("ratio"), "complete", "passed")


@query(
    "interval_union",
    """WITH a AS (SELECT o_custkey % 50 AS cell, o_orderpriority AS kind FROM orders), b AS (SELECT l_suppkey % 50 AS cell, '1-URGENT' AS kind FROM lineitem)
SELECT cell, kind FROM a UNION SELECT cell, kind FROM b""",
)
def interval_union(spark, d):
    a = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("cell"), F.col("o_orderpriority").alias("kind"))
    b = table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("cell"), F.lit("1-URGENT").alias("kind"))
    return a.unionByName(b).distinct()


@query("missing_truth", f"WITH {A.CALLS_A}, {A.CALLS_B} SELECT read_id, chrom, pos FROM calls_a WHERE read_id NOT IN (SELECT read_id FROM calls_b)")
def missing_truth(spark, d):
    return A.calls_a(spark, d).join(A.calls_b(spark, d).select("read_id"), "read_id", "left_anti").select("read_id", "chrom", "pos")


@query(
    "vector_normalise",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v)
SELECT vec_id, round(n, 6) AS norm, round(list_sum([x / n FOR x IN e]), 6) + 0e0 AS sum_of_unit FROM n""",
)
def vector_normalise(spark, d):
    e = table(spark, d, "embeddings").withColumn("u", G.unit(F.col("embedding")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return e.select("vec_id", q(norm).alias("norm"), q(F.aggregate("u", F.lit(0.0), lambda a, x: a + x)).alias("sum_of_unit"))
