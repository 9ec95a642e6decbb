"""Vectors and graphs beyond the basic queries: metrics, indexes, communities and self-EM by unrolled rounds, representatives."""

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import compact as Z
from ..operators import graph as G
from ..operators import wave as W
from ..runtime import cut, q, table
from .base import query
from .graphs import _CLUSTER, _EDGES, _IN, edges, labels, vectors
from .wave import wave

_PAIRS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label::BIGINT AS label FROM embeddings)"


def _knn(similarity: str, k: int) -> str:
    return f"WITH {_PAIRS}, sim AS (SELECT a.id AS src, b.id AS dst, {similarity} AS similarity FROM v a JOIN v b ON a.id <> b.id) SELECT src, dst, round(similarity, 6) AS similarity FROM sim QUALIFY row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) <= {k}"


@query("knn_l2_top5", _knn("-(list_dot_product(a.e, a.e) + list_dot_product(b.e, b.e) - 2 * list_dot_product(a.e, b.e))", 5))
def knn_l2_top5(spark, d):
    v = vectors(spark, d)
    return G.knn(v, v, 5, metric="l2").select("src", "dst", q("similarity").alias("similarity"))


@query("knn_inner_top5", _knn("list_dot_product(a.e, b.e)", 5))
def knn_inner_top5(spark, d):
    v = vectors(spark, d)
    return G.knn(v, v, 5, metric="inner").select("src", "dst", q("similarity").alias("similarity"))


_MEANS = f"""{_PAIRS}, coords AS (SELECT label, id, i, e[i] AS x FROM v, unnest(range(1, len(e) + 1)) AS u(i)), mean AS (SELECT label, i, avg(x) FILTER (id % 3 <> 0) AS x FROM coords GROUP BY 1, 2),
pooled AS (SELECT label, list(x ORDER BY i) AS e FROM mean GROUP BY 1)"""


def pooled(spark, d):
    """Each label's mean vector; every third row is masked."""
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"), (F.col("vec_id") % 3 != 0).cast("int").alias("mask"))
    return G.mean_pool(e, "label")


@query("mean_pooling", f"WITH {_MEANS} SELECT label, len(e) AS n, round(list_sum(e), 6) AS total, round(e[1], 6) AS first FROM pooled")
def mean_pooling(spark, d):
    p = pooled(spark, d)
    return p.select("label", F.size("vector").cast("long").alias("n"), q(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)).alias("total"), q(F.col("vector")[0]).alias("first"))


@query("all_pairs_cosine", f"WITH {_MEANS} SELECT a.label AS a, b.label AS b, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 6) AS similarity FROM pooled a JOIN pooled b ON a.label < b.label")
def all_pairs_cosine(spark, d):
    """The whole matrix of a small set: the labels' mean vectors."""
    return G.all_pairs(pooled(spark, d).withColumnRenamed("label", "id")).select("a", "b", q("similarity").alias("similarity"))


_STATED = "SELECT count(*) * 10 AS n, true AS reached FROM {table} WHERE {key} % 50 = 0"


def _reached(found, v, stated):
    r = G.recall(found, G.knn(stated, v, 10))
    return r.select("n", (F.col("recall") >= 0.9).alias("reached"))


@query("knn_ivf_recall", _STATED.format(table="embeddings", key="vec_id"))
def knn_ivf_recall(spark, d):
    """The inverted lists find 0.9 of what brute force does: queries are the rows whose id is divisible by 50.

    These vectors have no clusters, so half of the lists have to be probed.
    """
    v = vectors(spark, d)
    stated = v.filter("id % 50 = 0")
    lists = max(1, min(1024, v.count() // 10 + 1))
    return _reached(G.knn_ivf(stated, v, 10, lists=lists, probes=max(1, -(-lists * 6 // 10))), v, stated)


def clustered(spark, d):
    """(id, vector) of every customer, one of a centre for every thirty of them and a little noise, and the number of centres."""
    t, k = table(spark, d, "customer"), F.col("c_custkey")
    n = max(1, t.count() // 30)
    x = lambda *key: F.xxhash64(*key) / F.lit(2.0**63)
    v = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: x(k % n, i) + 0.3 * x(k, i, F.lit(1)))
    return cut(t.select(k.alias("id"), v.alias("vector"))), n


def _clustered(spark, d, **kw):
    v, n = clustered(spark, d)
    stated = v.filter("id % 50 = 0")
    # Lists are fitted on at most 20,000 rows, so no more than 1,024 of them: some twenty rows of the sample a list.
    lists = min(2 * n, 1024)
    return _reached(G.knn_ivf(stated, v, 10, lists=lists, probes=max(2, -(-lists // 10)), **kw), v, stated)


@query("knn_ivf_clustered", _STATED.format(table="customer", key="c_custkey"))
def knn_ivf_clustered(spark, d):
    """With clusters a tenth of the lists is enough."""
    return _clustered(spark, d)


@query("knn_ivfpq_clustered", _STATED.format(table="customer", key="c_custkey"))
def knn_ivfpq_clustered(spark, d):
    """Lists of product-quantised vectors, the best ranked again by the vectors themselves."""
    return _clustered(spark, d, pq_parts=8)


@query("similarity_scales", "SELECT event_id, round(1 / (1 + abs(value) * 2e0), 6) AS from_distance, round(1 - value, 6) AS from_inner FROM events")
def similarity_scales(spark, d):
    return table(spark, d, "events").select("event_id", q(G.similarity_of(F.abs("value"), 2.0)).alias("from_distance"), q(G.distance_of_inner(F.col("value"))).alias("from_inner"))


@query(
    "graph_edge_lookup",
    f"WITH {_EDGES}, p AS (SELECT a.id AS src, (a.id * 7 + 3) % (SELECT count(*) FROM v) AS dst FROM v a UNION SELECT src, min(dst) FROM edges GROUP BY 1) SELECT p.src, p.dst, e.weight IS NOT NULL AS has_edge, round(coalesce(e.weight, 0), 6) AS weight FROM p LEFT JOIN edges e ON e.src = p.src AND e.dst = p.dst",
)
def graph_edge_lookup(spark, d):
    e, v = edges(spark, d), vectors(spark, d)
    n = v.count()
    pairs = v.select(F.col("id").alias("src"), ((F.col("id") * 7 + 3) % n).alias("dst")).unionByName(e.groupBy("src").agg(F.min("dst").alias("dst"))).distinct()
    return G.edge_weights(e, pairs).withColumn("weight", q("weight"))


@query(
    "graph_edge_cap",
    f"""WITH {_EDGES}, capped AS (SELECT * FROM raw WHERE weight >= 0.4e0 QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 3),
sym AS (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM capped UNION ALL SELECT dst, src, weight FROM capped) GROUP BY 1, 2) SELECT src, dst, round(weight, 6) AS weight FROM sym""",
)
def graph_edge_cap(spark, d):
    """The cap is the feature: three edges a node before they are made symmetric."""
    v = vectors(spark, d)
    return G.graph(G.knn(v, v, 8), least=0.4, most_edges=3).withColumn("weight", q("weight"))


def _communities(sweeps: int) -> str:
    out = [f"{_EDGES}, st AS MATERIALIZED (SELECT src AS node, sum(weight) AS k FROM edges GROUP BY 1), tot AS MATERIALIZED (SELECT sum(k) / 2 AS m FROM st), lab0 AS MATERIALIZED (SELECT node, node AS label FROM st)"]
    for r in range(2 * sweeps):
        t = r // 2
        out.append(f"""sig{r} AS MATERIALIZED (SELECT label, sum(k) AS sigma FROM lab{r} JOIN st USING (node) GROUP BY 1),
lk{r} AS MATERIALIZED (SELECT e.src AS node, l.label AS "to", sum(weight) AS w FROM edges e JOIN lab{r} l ON l.node = e.dst GROUP BY 1, 2),
g{r} AS (SELECT o.node, lk."to", round((lk.w - coalesce(h.w, 0)) / m - k * (s2.sigma - (s1.sigma - k)) / (2 * m * m), 9) AS gain FROM lab{r} o JOIN st USING (node) JOIN sig{r} s1 ON s1.label = o.label
  JOIN lk{r} lk ON lk.node = o.node AND lk."to" <> o.label JOIN sig{r} s2 ON s2.label = lk."to" LEFT JOIN lk{r} h ON h.node = o.node AND h."to" = o.label CROSS JOIN tot),
mv{r} AS MATERIALIZED (SELECT node, "to" FROM g{r} WHERE gain > 1e-7 AND ((node % 65537 + {t + 1}) * {7919 + 2 * t}) % 65537 % 2 = {r % 2} QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, "to") = 1),
lab{r + 1} AS MATERIALIZED (SELECT l.node, coalesce(mv."to", l.label) AS label FROM lab{r} l LEFT JOIN mv{r} mv USING (node))""")
    return ", ".join(out)


@query("communities_two_sweeps", f"WITH {_communities(2)} SELECT node, label FROM lab4")
def communities_two_sweeps(spark, d):
    return G.communities(cut(edges(spark, d)), sweeps=2)


@query("communities", f"WITH {_EDGES} SELECT count(DISTINCT src) AS n_nodes, 0 AS n_could_gain, true AS better FROM edges")
def communities(spark, d):
    """After all sweeps no node gains by moving, and modularity is above that of single nodes."""
    e = cut(edges(spark, d))
    found = cut(G.communities(e))
    alone = G.modularity(e, found.select("node", F.col("node").alias("label"))).select(F.col("modularity").alias("_m"))
    left = G.gains(e, found).filter(F.col("gain") > 1e-7).agg(F.count_distinct("node").cast("int").alias("n_could_gain"))
    return found.agg(F.count("*").alias("n_nodes")).join(F.broadcast(left)).join(F.broadcast(G.modularity(e, found))).join(F.broadcast(alone)).select("n_nodes", "n_could_gain", (F.col("modularity") > F.col("_m") + 0.1).alias("better"))


def _self_em(rounds: int) -> str:
    out = [f"{_IN}, s AS MATERIALIZED (SELECT src AS i, dst AS j, weight AS s FROM le WHERE la = lb UNION ALL SELECT id, id, 1 FROM v), p0 AS MATERIALIZED (SELECT i, j, s / sum(s) OVER (PARTITION BY i) AS p FROM s)"]
    for r in range(rounds):
        out.append(f"""r{r} AS (SELECT a.i, b.j, sum(a.s * b.p) AS r FROM s a JOIN p{r} b ON a.j = b.i GROUP BY 1, 2), u{r} AS (SELECT s.i, s.j, s.s * s.s * r AS u FROM s JOIN r{r} USING (i, j)),
x{r} AS (SELECT i, j, 0.7e0 * p + 0.3e0 * u / sum(u) OVER (PARTITION BY i) AS x FROM p{r} JOIN u{r} USING (i, j)), p{r + 1} AS MATERIALIZED (SELECT i, j, x / sum(x) OVER (PARTITION BY i) AS p FROM x{r})""")
    return ", ".join(out)


@query("self_em_three_rounds", f"WITH {_self_em(3)} SELECT i AS node, round(max(p), 6) AS p, max(p) >= 0.95 AS collapsed FROM p3 GROUP BY 1")
def self_em_three_rounds(spark, d):
    return G.self_em(cut(edges(spark, d)), labels(spark, d), rounds=3, epsilon=0.0).select("node", q("p").alias("p"), "collapsed")


@query("self_em", f"WITH {_IN} SELECT count(*) AS n_nodes, 0 AS n_foreign, true AS in_range FROM v")
def self_em(spark, d):
    """After all rounds each node's anchor is in its own cluster, and confidences are probabilities."""
    lab = labels(spark, d)
    r = G.self_em(cut(edges(spark, d)), lab).join(lab, "node").join(lab.select(F.col("node").alias("anchor"), F.col("label").alias("_a")), "anchor")
    return r.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("label") != F.col("_a")).cast("int").alias("n_foreign"), F.bool_and((F.col("p") > 0) & (F.col("p") <= 1.0 + 1e-9)).alias("in_range"))


_ASSIGNED = f"{_self_em(1)}, an AS (SELECT i AS node, arg_min(j, -round(p, 9) * 1e6 + j * 1e-9) AS anchor, max(p) AS p FROM p1 GROUP BY 1), asg AS (SELECT an.*, label FROM an JOIN v ON v.id = an.node)"


def assigned(spark, d):
    """(node, label, anchor, p, collapsed) after one round."""
    return G.self_em(cut(edges(spark, d)), labels(spark, d), rounds=1).join(labels(spark, d), "node")


@query("self_em_summary", f"WITH {_ASSIGNED}, c AS (SELECT label, count(*) AS n, sum(p) AS p, count(*) FILTER (p >= 0.95) AS k FROM asg GROUP BY 1) SELECT sum(n)::BIGINT AS n_nodes, count(*) AS n_clusters, sum(k)::BIGINT AS n_collapsed, round(sum(p) / sum(n), 6) AS mean_p, count(*) FILTER (n = 1) AS n_single, max(n) AS largest FROM c")
def self_em_summary(spark, d):
    return G.em_summary(assigned(spark, d)).withColumn("mean_p", q("mean_p"))


@query("cluster_anchors", f"WITH {_ASSIGNED}, c AS (SELECT label, anchor, sum(p) AS c, count(*) AS n FROM asg GROUP BY 1, 2) SELECT label, sum(n)::BIGINT AS size, arg_min(anchor, -round(c, 9) * 1e6 + anchor * 1e-9) AS anchor, round(max(c), 6) AS confidence FROM c GROUP BY 1")
def cluster_anchors(spark, d):
    return G.cluster_anchors(assigned(spark, d)).withColumn("confidence", q("confidence"))


@query(
    "community_size_filter",
    """WITH l AS (SELECT c_custkey AS node, (c_custkey * c_custkey) % 37 * 3 AS label FROM customer), n AS (SELECT label, count(*) AS n FROM l GROUP BY 1),
k AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM n WHERE n BETWEEN (SELECT min(n) + 1 FROM n) AND (SELECT max(n) - 1 FROM n))
SELECT node, coalesce(id, (SELECT count(*) FROM k)) AS label, CASE WHEN id IS NULL THEN 'FILTERED' ELSE 'C' || id END AS name FROM l LEFT JOIN k USING (label)""",
)
def community_size_filter(spark, d):
    k = F.col("c_custkey")
    l = table(spark, d, "customer").select(k.alias("node"), (k * k % 37 * 3).alias("label"))
    n = l.groupBy("label").count().agg(F.min("count"), F.max("count")).first()
    return G.filter_sizes(l, n[0] + 1, n[1] - 1)


@query(
    "representatives_by_method",
    f"""WITH {_CLUSTER}, deg AS (SELECT src AS node, count(*) AS n FROM le WHERE la = lb GROUP BY 1), conf AS (SELECT vec_id AS node, (vec_id % 7) / 7e0 AS p FROM embeddings),
told AS (SELECT node FROM ct QUALIFY row_number() OVER (PARTITION BY label ORDER BY node) <= 5), ap AS (SELECT ct.label, ct.node, round(coalesce((SELECT sum(weight) FROM le WHERE src = ct.node AND la = lb AND dst IN (SELECT node FROM told)), 0) + CASE WHEN ct.node IN (SELECT node FROM told) THEN 1 ELSE 0 END, 9) AS w FROM ct)
SELECT 'degree' AS method, label, node AS representative FROM (SELECT ct.label, ct.node, coalesce(n, 0) AS n FROM ct LEFT JOIN deg USING (node)) QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, node) = 1
UNION ALL SELECT 'confidence', label, node FROM (SELECT ct.*, floor(p * 1e6) AS f FROM ct JOIN conf USING (node)) QUALIFY row_number() OVER (PARTITION BY label ORDER BY f DESC, round(inside, 9) DESC, node) = 1
UNION ALL SELECT 'approximate', label, node FROM ap QUALIFY row_number() OVER (PARTITION BY label ORDER BY w DESC, node) = 1""",
)
def representatives_by_method(spark, d):
    e, l = cut(edges(spark, d)), labels(spark, d)
    c = l.select("node", (F.col("node") % 7 / 7).alias("p"))
    out = None
    for method, more in (("degree", {}), ("confidence", {"confidence": c}), ("approximate", {"sample": 5})):
        rows = G.representatives_by(e, l, method, **more).select(F.lit(method).alias("method"), "label", "representative")
        out = rows if out is None else out.unionByName(rows)
    return out


_HEX = "translate({x}, '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query("allpair_clusters", "SELECT c_custkey AS read_id, count(*) OVER (PARTITION BY c_custkey // 6) AS cluster_size, true AS own_family, 400 AS read_length FROM customer")
def allpair_clusters(spark, d):
    """Reads of planted families of six, a few bases apart: the clusters are the families."""
    k = F.col("c_custkey")
    family = F.floor(k / 6)
    seq = F.concat(*[F.translate(F.md5(F.concat(F.lit(f"{b}_"), family.cast("string")).cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT") for b in range(13)])
    at = (1 + k * 53 % 380).cast("int")
    made = F.concat(F.substr(seq, F.lit(1), at - 1), F.translate(F.substr(seq, at, F.lit(3)), "ACGT", "CGTA"), F.substr(seq, at + 3, F.lit(400) - at - 2))
    # Few bytes of a customer become a read of 400 bases: the rows of a small file are spread over the tasks first.
    own = table(spark, d, "customer").select("c_custkey").repartition(spark.sparkContext.defaultParallelism)
    reads = own.select(k.alias("read_id"), made.alias("seq"))
    c = G.allpair(cut(reads), least=0.5)
    own = c.groupBy("cluster_id").agg((F.count_distinct(F.floor(F.col("read_id") / 6)) == 1).alias("own_family"))
    return c.join(own, "cluster_id").select("read_id", "cluster_size", "own_family", F.col("read_length").cast("int").alias("read_length"))


# Waves


_PROPAGATED = f"""{A.WAVE}, top AS (SELECT read_id, bucket_id, p FROM wave QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY p DESC, bucket_id) <= 10), best AS (SELECT read_id AS rep_id, bucket_id, p / sum(p) OVER (PARTITION BY read_id) AS p FROM top),
mx AS (SELECT read_id AS rep_id, max(p) AS rep_p FROM wave GROUP BY 1), mem AS (SELECT o_orderkey AS read_id, o_orderkey - o_orderkey % 4 AS rep_id, (o_custkey % 10) / 10e0 AS s, (o_custkey % 5) / 5e0 AS c FROM orders),
pr AS (SELECT mem.read_id, bucket_id, p, greatest(0.1e0, least(0.95e0, rep_p * 0.8e0 * (0.5e0 + 0.5e0 * s) * (0.7e0 + 0.3e0 * c) * CASE WHEN s < 0.3e0 THEN 0.5e0 ELSE 1 END)) AS confidence FROM mem JOIN best USING (rep_id) JOIN mx USING (rep_id))"""


@query("propagation_stats", f"WITH {_PROPAGATED} SELECT count(DISTINCT read_id) AS n_members, count(*) AS n_entries, round(avg(confidence), 6) AS mean_confidence, round(min(confidence), 6) AS min_confidence, round(avg(p), 6) AS mean_p FROM pr")
def propagation_stats(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    members = o.select(k.alias("read_id"), (k - k % 4).alias("rep_id"), (F.col("o_custkey") % 5).alias("cluster_id"), (F.col("o_custkey") % 10 / 10).alias("similarity"))
    cohesion = o.select((F.col("o_custkey") % 5).alias("cluster_id")).distinct().withColumn("cohesion", F.col("cluster_id") / 5)
    s = W.propagation_stats(W.propagate(members, wave(spark, d), cohesion))
    return s.select("n_members", "n_entries", *[q(c).alias(c) for c in ("mean_confidence", "min_confidence", "mean_p")])


@query(
    "wave_em_ai_prior",
    f"""WITH {A.WAVE}, cov AS (SELECT bucket_id, greatest(sum(p), 0.001e0) AS c FROM wave GROUP BY 1), x AS (SELECT read_id, bucket_id, 0.7e0 * p + 0.3e0 * c * (1 + (bucket_id % 3) / 3e0) AS x FROM wave JOIN cov USING (bucket_id))
SELECT read_id, bucket_id, round(x / sum(x) OVER (PARTITION BY read_id), 6) AS p FROM x""",
)
def wave_em_ai_prior(spark, d):
    """A prior given as an expression over read and bucket."""
    return W.em_step(wave(spark, d), ai_prior=1 + F.col("bucket_id") % 3 / 3).withColumn("p", q("p"))


@query("wave_callbacks", f"WITH {A.WEIGHTS} SELECT count(DISTINCT read_id) AS n_reads, 3 AS rounds, true AS told FROM weights")
def wave_callbacks(spark, d):
    """Every round is told to the caller with its statistics."""
    seen = []
    active, done = W.run_em(wave(spark, d), config=W.EmConfig(max_rounds=3, epsilon=0.0), on_round=lambda k, s: seen.append((k, s["mean_entropy"])))
    told = [k for k, _ in seen] == [0, 1, 2] and all(e is not None for _, e in seen)
    reads = active.select("read_id").distinct().unionByName(done.select("read_id"))
    return reads.agg(F.count_distinct("read_id").alias("n_reads")).select("n_reads", F.lit(len(seen)).alias("rounds"), F.lit(told).alias("told"))


@query("wave_stall_callback", "SELECT 'NoProgress' AS state, 5 AS at_round, true AS ended")
def wave_stall_callback(spark, d):
    """A loop whose entropy stands still is told to the caller, who ends it; here a wave of two equal buckets."""
    flat = table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"), F.explode(F.array(F.lit(1), F.lit(2)).cast("array<long>")).alias("bucket_id"), F.lit(0.5).alias("p"))
    found = []

    def stalled(k, state):
        found.append((k + 1, state))
        return True

    W.run_em(flat, config=W.EmConfig(max_rounds=20, epsilon=-1.0), on_stall=stalled)
    return spark.range(1).select(F.lit(found[0][1] if found else "").alias("state"), F.lit(found[0][0] if found else 0).alias("at_round"), F.lit(len(found) == 1).alias("ended"))


def _stage2(rounds: int) -> str:
    out = [f"""{A.WAVE}, {A.PYRAMID}, b AS MATERIALIZED (SELECT read_id, l2, l1, l0, p FROM wave JOIN pyramid ON l2 = bucket_id),
ev0 AS MATERIALIZED (SELECT read_id, l0 AS bucket_id, sum(p) AS lik FROM b GROUP BY 1, 2), ev1 AS MATERIALIZED (SELECT read_id, l1 AS bucket_id, sum(p) AS lik FROM b GROUP BY 1, 2), ev2 AS MATERIALIZED (SELECT read_id, l2 AS bucket_id, sum(p) AS lik FROM b GROUP BY 1, 2),
dn0 AS (SELECT DISTINCT l0 AS parent, l1 AS child FROM pyramid), dn1 AS (SELECT DISTINCT l1 AS parent, l2 AS child FROM pyramid), top0 AS (SELECT DISTINCT l0 AS bucket_id FROM pyramid),
w0 AS MATERIALIZED (SELECT read_id, bucket_id, 1e0 / (SELECT count(*) FROM top0) AS p FROM (SELECT DISTINCT read_id FROM wave) CROSS JOIN top0)"""]
    for level in range(3):
        a = f"w{level}"
        fixed = []
        for r in range(rounds):
            t = f"{level}_{r}"
            out.append(f"""cv{t} AS (SELECT bucket_id, greatest(sum(p), 0.001e0) AS c FROM {a} GROUP BY 1), x{t} AS (SELECT read_id, bucket_id, 0.7e0 * p + 0.3e0 * c * coalesce(lik, 0) AS x FROM {a} JOIN cv{t} USING (bucket_id) LEFT JOIN ev{level} USING (read_id, bucket_id)),
af{t} AS MATERIALIZED (SELECT read_id, bucket_id, CASE WHEN sum(x) OVER o > 1e-10 THEN x / sum(x) OVER o ELSE 1e0 / count(*) OVER o END AS p FROM x{t} WINDOW o AS (PARTITION BY read_id)),
fx{t} AS MATERIALIZED (SELECT read_id, bucket_id, 1e0 AS p FROM af{t} QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY p DESC, bucket_id) = 1 AND p >= 0.99e0), ac{t} AS MATERIALIZED (SELECT * FROM af{t} WHERE read_id NOT IN (SELECT read_id FROM fx{t}))""")
            fixed.append(f"SELECT * FROM fx{t}")
            a = f"ac{t}"
        out.append(f"en{level} AS MATERIALIZED (SELECT * FROM {a} UNION ALL {' UNION ALL '.join(fixed)})")
        if level < 2:
            out.append(f"""sp{level} AS (SELECT parent, child, 1e0 / count(*) OVER (PARTITION BY parent) AS share FROM dn{level}), ch{level} AS (SELECT read_id, child AS bucket_id, sum(p * share) AS p FROM en{level} JOIN sp{level} ON parent = bucket_id WHERE p >= 0.01e0 GROUP BY 1, 2), w{level + 1} AS MATERIALIZED (SELECT read_id, bucket_id, p / sum(p) OVER (PARTITION BY read_id) AS p FROM ch{level})""")
    return ", ".join(out)


def _levels(spark, d, config):
    w, p = cut(wave(spark, d)), A.pyramid(spark, d)
    # A read's weight of a bucket is that of the finest buckets in it.
    below = w.withColumnRenamed("bucket_id", "l2").join(p.select("l2", "l1", "l0"), "l2")
    evidence = [cut(below.groupBy("read_id", F.col(level).alias("bucket_id")).agg(F.sum("p").alias("likelihood"))) for level in ("l0", "l1", "l2")]
    top = p.select(F.col("l0").alias("bucket_id")).distinct()
    down = [p.select(F.col("l0").alias("parent"), F.col("l1").alias("child")).distinct(), p.select(F.col("l1").alias("parent"), F.col("l2").alias("child")).distinct()]
    return Z.levels(w.select("read_id").distinct(), top, down, evidence, config)


_TOLD = """told AS (SELECT read_id, l1 AS parent, bucket_id, p, lik FROM en2 JOIN pyramid ON l2 = bucket_id LEFT JOIN ev2 USING (read_id, bucket_id)),
classes AS (SELECT read_id, parent, CASE WHEN lik IS NOT NULL THEN bucket_id END AS own, any_value(bucket_id) AS any_, count(*) AS n, max(p) AS p FROM told GROUP BY 1, 2, 3)"""


@query("stage2_two_rounds", f"WITH {_stage2(2)}, {_TOLD} SELECT read_id, parent, CASE WHEN n = 1 THEN any_ END AS bucket_id, n, round(p, 5) AS p FROM classes")
def stage2_two_rounds(spark, d):
    """The hierarchical loop with two rounds a level: the buckets with evidence one by one, the n others of a parent, all of the same p, in one row."""
    return _levels(spark, d, W.EmConfig(max_rounds=2, epsilon=0.0)).select("read_id", "parent", "bucket_id", "n", q("p", 5).alias("p"))


@query("stage2_levels", f"WITH {A.WAVE}, {A.PYRAMID} SELECT count(DISTINCT read_id) AS n_reads, 0 AS n_not_one, 0 AS n_strange, true AS settled FROM wave JOIN pyramid ON l2 = bucket_id")
def stage2_levels(spark, d):
    """The whole loop until it stands still: every read has a distribution over the finest buckets, with its mass where its evidence is."""
    p = A.pyramid(spark, d)
    r = cut(_levels(spark, d, W.EmConfig()))
    known = r.join(p.select(F.col("l2").alias("bucket_id"), F.lit(True).alias("_k")), "bucket_id", "left").join(p.groupBy(F.col("l1").alias("parent")).agg(F.count("*").alias("_c")), "parent", "left")
    evidence = wave(spark, d).select("read_id", "bucket_id", F.lit(True).alias("_e"))
    strange = F.when(F.col("bucket_id").isNull(), F.coalesce(F.col("n") > F.col("_c"), F.lit(True))).otherwise(F.col("_k").isNull())
    per = known.join(evidence, ["read_id", "bucket_id"], "left").groupBy("read_id").agg(F.sum(F.col("n") * F.col("p")).alias("s"), F.count_if(strange).alias("n"), F.sum(F.when(F.col("_e"), F.col("p")).otherwise(0.0)).alias("own"))
    return per.agg(F.count("*").alias("n_reads"), F.count_if(F.abs(F.col("s") - 1) > 1e-6).cast("int").alias("n_not_one"), F.sum("n").cast("int").alias("n_strange"), (F.avg("own") > 0.5).alias("settled"))
