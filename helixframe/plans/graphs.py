from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import graph as G
from ..runtime import cut, q, table
from .base import query

_VEC = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label::BIGINT AS label FROM embeddings),
n AS (SELECT id, e, label, sqrt(list_dot_product(e, e)) AS n FROM v),
sim AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.e, b.e) / (a.n * b.n) AS similarity FROM n a JOIN n b ON a.id <> b.id)"""
_KNN = "knn{k} AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) <= {k})"
_EDGES = f"""{_VEC}, {_KNN.format(k=8)}, raw AS (SELECT src, dst, 1 / (1 + sqrt(greatest(0, 2 - 2 * similarity))) AS weight FROM knn8),
edges AS (SELECT src, dst, max(weight) AS weight FROM (SELECT * FROM raw WHERE weight >= 0.4e0 UNION ALL SELECT dst, src, weight FROM raw WHERE weight >= 0.4e0) GROUP BY 1, 2)"""


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))


def labels(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("node"), F.col("label").cast("long").alias("label"))


def edges(spark, d):
    v = vectors(spark, d)
    return G.graph(G.knn(v, v, 8), least=0.4)


@query("knn_cosine_top5", f"WITH {_VEC}, {_KNN.format(k=5)} SELECT src, dst, round(similarity, 6) AS similarity FROM knn5")
def knn_cosine_top5(spark, d):
    v = vectors(spark, d)
    return G.knn(v, v, 5).select("src", "dst", q("similarity").alias("similarity"))


@query("similarity_graph", f"WITH {_EDGES} SELECT src, dst, round(weight, 6) AS weight FROM edges")
def similarity_graph(spark, d):
    return edges(spark, d).withColumn("weight", q("weight"))


@query("graph_degree", f"WITH {_EDGES} SELECT src AS node, count(*) AS degree, round(sum(weight), 6) AS strength, round(min(weight), 6) AS min_weight, round(max(weight), 6) AS max_weight FROM edges GROUP BY 1")
def graph_degree(spark, d):
    return G.degrees(edges(spark, d)).select("node", "degree", *[q(c).alias(c) for c in ("strength", "min_weight", "max_weight")])


@query(
    "graph_stats",
    f"""WITH {_EDGES}, g AS (SELECT src, count(*) AS degree, min(weight) AS lo, max(weight) AS hi FROM edges GROUP BY 1)
SELECT count(*) AS n_nodes, (sum(degree) / 2)::BIGINT AS n_edges, round(avg(degree), 6) AS avg_degree, max(degree) AS max_degree, round(min(lo), 6) AS min_weight, round(max(hi), 6) AS max_weight FROM g""",
)
def graph_stats(spark, d):
    return G.graph_stats(edges(spark, d)).select("n_nodes", "n_edges", q("avg_degree").alias("avg_degree"), "max_degree", q("min_weight").alias("min_weight"), q("max_weight").alias("max_weight"))


_IN = f"""{_EDGES}, le AS (SELECT e.*, a.label AS la, b.label AS lb FROM edges e JOIN v a ON a.id = src JOIN v b ON b.id = dst)"""


@query(
    "modularity_by_label",
    f"""WITH {_IN}, c AS (SELECT la, sum(CASE WHEN la = lb THEN weight ELSE 0 END) AS inside, sum(weight) AS total FROM le GROUP BY 1)
SELECT round(sum(inside / (SELECT sum(total) FROM c) - (total / (SELECT sum(total) FROM c)) ** 2), 6) AS modularity FROM c""",
)
def modularity_by_label(spark, d):
    return G.modularity(edges(spark, d), labels(spark, d)).select(q("modularity").alias("modularity"))


_CLUSTER = f"""{_IN}, w AS (SELECT src AS node, sum(weight) AS w FROM le WHERE la = lb GROUP BY 1),
ct AS (SELECT v.label, v.id AS node, count(*) OVER (PARTITION BY v.label) AS size, coalesce(w, 0) AS inside FROM v LEFT JOIN w ON w.node = v.id)"""


@query("representatives", f"WITH {_CLUSTER} SELECT label, any_value(size) AS size, arg_min(node, -inside * 1e6 + node * 1e-9) AS representative, round(CASE WHEN any_value(size) > 1 THEN (any_value(size) - 1 - max(inside)) / (any_value(size) - 1) ELSE 0 END, 6) AS mean_distance FROM ct GROUP BY 1")
def representatives(spark, d):
    return G.representatives(edges(spark, d), labels(spark, d)).withColumn("mean_distance", q("mean_distance"))


@query("cluster_cohesion", f"WITH {_CLUSTER} SELECT label, any_value(size) AS size, round(CASE WHEN any_value(size) > 1 THEN sum(inside) / (any_value(size) * (any_value(size) - 1)) ELSE 1 END, 6) AS cohesion FROM ct GROUP BY 1")
def cluster_cohesion(spark, d):
    return G.cohesion(edges(spark, d), labels(spark, d)).withColumn("cohesion", q("cohesion"))


@query(
    "self_em_step",
    f"""WITH {_IN}, s AS (SELECT src AS i, dst AS j, weight AS s FROM le WHERE la = lb UNION ALL SELECT id, id, 1 FROM v), p AS (SELECT i, j, s / sum(s) OVER (PARTITION BY i) AS p FROM s),
r AS (SELECT a.i, b.j, sum(a.s * b.p) AS r FROM s a JOIN p b ON a.j = b.i GROUP BY 1, 2), u AS (SELECT s.i, s.j, s.s * s.s * r AS u FROM s JOIN r USING (i, j)),
x AS (SELECT i, j, 0.7e0 * p + 0.3e0 * u / sum(u) OVER (PARTITION BY i) AS x FROM p JOIN u USING (i, j)) SELECT i, j, round(x / sum(x) OVER (PARTITION BY i), 6) AS p FROM x""",
)
def self_em_step(spark, d):
    s, p = G.self_em_start(edges(spark, d), labels(spark, d))
    return G.self_em_step(s, p).withColumn("p", q("p"))


@query(
    "well_connected",
    f"""WITH RECURSIVE {_IN}, reach AS (SELECT id AS node, id AS root, label FROM v UNION SELECT le.dst, reach.root, reach.label FROM reach JOIN le ON le.src = reach.node AND le.la = le.lb),
parts AS (SELECT node, min(root) AS root, any_value(label) AS label FROM reach GROUP BY 1) SELECT label, count(DISTINCT root) AS n_parts, count(DISTINCT root) = 1 AS connected FROM parts GROUP BY 1""",
)
def well_connected(spark, d):
    return G.well_connected(cut(edges(spark, d)), labels(spark, d))
