from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import singlecell as S
from ..runtime import q
from .base import query

EVENTS = ["view", "signup", "purchase", "error", "click"]
_V = {"mean": "sum(prob) / count(*)", "max": "max(prob)", "sum": "sum(prob)", "weighted": "CASE WHEN sum(conf * prob) > 0 THEN sum(prob) / sum(conf * prob) ELSE sum(prob) / count(*) END"}


def _m(method: str = "mean") -> str:
    return f"""{A.CELLS}, m AS (SELECT cell, paralog, {_V[method]} AS value, count(*) AS read_count, sum(conf * prob) / count(*) AS mean_confidence
  FROM cells WHERE prob >= 0.01e0 GROUP BY 1, 2)"""


for _method in S.METHODS:

    @query(
        f"sc_matrix_{_method}",
        f"""WITH {_m(_method)} SELECT cell, paralog, round(value, 6) AS value, read_count, round(mean_confidence, 6) AS mean_confidence,
  round(value / sum(value) OVER (PARTITION BY cell), 6) AS normalised FROM m""",
    )
    def sc_matrix(spark, d, method=_method):
        m = S.row_normalised(S.matrix(A.cells(spark, d), method))
        return m.select("cell", "paralog", q("value").alias("value"), "read_count", q("mean_confidence").alias("mean_confidence"), q("normalised").alias("normalised"))


@query("sc_matrix_dense", f"WITH {_m()} SELECT cell, " + ", ".join(f"round(coalesce(max(CASE WHEN paralog = '{e}' THEN value END), 0), 6) AS {e}" for e in EVENTS) + " FROM m GROUP BY cell")
def sc_matrix_dense(spark, d):
    return S.dense(S.matrix(A.cells(spark, d)), EVENTS).select("cell", *[q(e).alias(e) for e in EVENTS])


@query(
    "sc_matrix_stats",
    f"""WITH {_m()} SELECT count(DISTINCT cell) AS n_cells, count(DISTINCT paralog) AS n_paralogs, count(*) AS nnz, sum(read_count)::BIGINT AS total_reads,
  round(1 - count(*) / (count(DISTINCT cell) * count(DISTINCT paralog))::DOUBLE, 6) AS sparsity FROM m""",
)
def sc_matrix_stats(spark, d):
    return S.matrix_stats(S.matrix(A.cells(spark, d))).withColumn("sparsity", q("sparsity"))


_CELL_QC = f"""{_m()}, s AS (SELECT *, value / sum(value) OVER (PARTITION BY cell) AS share, row_number() OVER (PARTITION BY cell ORDER BY value DESC) AS k FROM m),
cell_qc AS (SELECT cell, sum(read_count)::BIGINT AS total_reads, sum(CASE WHEN value > 0 THEN read_count ELSE 0 END)::BIGINT AS assigned_reads,
  sum(CASE WHEN mean_confidence >= 0.5e0 THEN read_count ELSE 0 END)::BIGINT AS confident_reads, count(*) AS n_paralogs, avg(mean_confidence) AS mean_confidence,
  median(mean_confidence) AS median_confidence, -sum(CASE WHEN share > 1e-9 THEN share * log2(share) ELSE 0 END) AS entropy,
  CASE WHEN count(*) < 2 THEN 1e0 WHEN max(CASE WHEN k = 2 THEN value END) <= 1e-9 THEN 100e0 ELSE max(CASE WHEN k = 1 THEN value END) / max(CASE WHEN k = 2 THEN value END) END AS dominance,
  sum(CASE WHEN value > 0 THEN read_count ELSE 0 END) / sum(read_count) AS assignment_rate FROM s GROUP BY cell)"""
_QC_COLUMNS = "cell, total_reads, assigned_reads, confident_reads, n_paralogs, " + ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in ("assignment_rate", "mean_confidence", "median_confidence", "entropy", "dominance"))


def _rounded(qc):
    return qc.select("cell", "total_reads", "assigned_reads", "confident_reads", "n_paralogs", *[q(c).alias(c) for c in ("assignment_rate", "mean_confidence", "median_confidence", "entropy", "dominance")])


@query("sc_cell_qc", f"WITH {_CELL_QC} SELECT {_QC_COLUMNS} FROM cell_qc")
def sc_cell_qc(spark, d):
    return _rounded(S.cell_qc(S.matrix(A.cells(spark, d))))


@query("sc_pass_filter", f"WITH {_CELL_QC} SELECT {_QC_COLUMNS} FROM cell_qc WHERE total_reads >= 10 AND n_paralogs >= 1 AND assignment_rate >= 0.1 AND mean_confidence >= 0.45 AND entropy <= 2.5")
def sc_pass_filter(spark, d):
    return _rounded(S.passing(S.cell_qc(S.matrix(A.cells(spark, d))), confidence=0.45, most_entropy=2.5))


_PARALOG_QC = f"""{_m()}, paralog_qc AS (SELECT paralog, count(*) AS n_cells, sum(read_count)::BIGINT AS reads, avg(value) AS mean_p, median(value) AS median_p,
  coalesce(var_samp(value), 0) AS variance_p, CASE WHEN avg(value) > 0 THEN sqrt(coalesce(var_samp(value), 0)) / avg(value) ELSE 0 END AS cv,
  count(*) / (SELECT count(DISTINCT cell) FROM m)::DOUBLE AS detection_rate FROM m GROUP BY paralog)"""
_PQ = ("mean_p", "median_p", "variance_p", "cv", "detection_rate")


@query("sc_paralog_qc", f"WITH {_PARALOG_QC} SELECT paralog, n_cells, reads, {', '.join(f'round({c}, 6) AS {c}' for c in _PQ)} FROM paralog_qc")
def sc_paralog_qc(spark, d):
    return S.paralog_qc(S.matrix(A.cells(spark, d))).select("paralog", "n_cells", "reads", *[q(c).alias(c) for c in _PQ])


@query(
    "sc_global_qc",
    f"""WITH {_CELL_QC} SELECT count(*) AS n_cells, sum(total_reads)::BIGINT AS total_reads, sum(assigned_reads)::BIGINT AS assigned_reads,
  round(sum(assigned_reads) / sum(total_reads), 6) AS assignment_rate, round(avg(mean_confidence), 6) AS mean_confidence, round(avg(entropy), 6) AS mean_entropy,
  round(avg(n_paralogs), 6) AS mean_paralogs FROM cell_qc""",
)
def sc_global_qc(spark, d):
    return S.cell_qc(S.matrix(A.cells(spark, d))).agg(
        F.count("*").alias("n_cells"), F.sum("total_reads").alias("total_reads"), F.sum("assigned_reads").alias("assigned_reads"), q(F.sum("assigned_reads") / F.sum("total_reads")).alias("assignment_rate"),
        q(F.avg("mean_confidence")).alias("mean_confidence"), q(F.avg("entropy")).alias("mean_entropy"), q(F.avg("n_paralogs")).alias("mean_paralogs"),
    )


@query("sc_filtered_matrix", f"WITH {_CELL_QC} SELECT m.cell, m.paralog, round(m.value, 6) AS value, m.read_count FROM m JOIN cell_qc USING (cell) WHERE total_reads >= 60 AND entropy <= 2.33")
def sc_filtered_matrix(spark, d):
    m = S.matrix(A.cells(spark, d))
    good = S.passing(S.cell_qc(m), reads=60, rate=0.0, confidence=0.0, most_entropy=2.33).select("cell")
    return m.join(good, "cell", "left_semi").select("cell", "paralog", q("value").alias("value"), "read_count")


@query("confidence_histogram", f"WITH {A.CELLS} SELECT least(floor(conf / 0.1e0), 9)::INT AS bin, count(*) AS n FROM cells GROUP BY 1")
def confidence_histogram(spark, d):
    return S.histogram(A.cells(spark, d), "conf")


@query(
    "confidence_moments",
    f"""WITH {A.CELLS}, a AS (SELECT count(*) AS n, avg(conf) AS mean, median(conf) AS median, stddev_samp(conf) AS sd FROM cells)
SELECT a.n, round(any_value(mean), 6) AS mean, round(any_value(a.median), 6) AS median, round(any_value(sd), 6) AS sd, round(sum(((conf - mean) / sd) ** 3) / a.n, 6) AS skewness,
  count(*) FILTER (conf < 0.5e0) AS below, count(*) FILTER (conf >= 0.5e0) AS above FROM cells, a GROUP BY a.n""",
)
def confidence_moments(spark, d):
    return S.moments(A.cells(spark, d), "conf").select("n", *[q(c).alias(c) for c in ("mean", "median", "sd", "skewness")], "below", "above")
