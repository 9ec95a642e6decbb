from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import align as L
from ..runtime import cut, scratch, table
from ..sources import sequences as S
from ..sources import tables as T
from .base import query


@query(
    "chain_align",
    f"""WITH {A.READS}, {A.REFS} SELECT read_id, ref_id, 0 AS "start", len(f.seq) AS "end", NOT contains(r.seq, f.seq) AS is_reverse FROM reads r JOIN refs f ON contains(r.seq, f.seq) OR contains(r.seq, reverse(translate(f.seq, 'ACGT', 'TGCA'))) WHERE len(f.seq) >= 50""",
)
def chain_align(spark, d):
    """All reads against all references: the alignments without a difference over a whole reference are the contained ones."""
    refs = A.refs(spark, d)
    a = L.align(A.reads(spark, d), refs).filter("identity = 1").join(refs.select("ref_id", F.length("seq").cast("long").alias("n")), "ref_id")
    return a.filter("start = 0 and end = n").select("read_id", "ref_id", "start", "end", "is_reverse").distinct()


@query(
    "stall_detect",
    """WITH n AS (SELECT o_custkey % 10 AS run, datediff('day', DATE '1970-01-01', o_orderdate::DATE) // 30 AS round, avg(o_totalprice) AS entropy FROM orders GROUP BY 1, 2),
s AS (SELECT run, round, entropy, entropy - lag(entropy) OVER o AS delta FROM n WINDOW o AS (PARTITION BY run ORDER BY round)),
f AS (SELECT *, CASE WHEN delta * lag(delta) OVER (PARTITION BY run ORDER BY round) < 0 THEN 1 ELSE 0 END AS flip FROM s),
w AS (SELECT run, round, count(*) OVER o AS n, first_value(entropy) OVER o AS f0, entropy, sum(flip) OVER t AS flips, max(abs(delta)) OVER p AS biggest FROM f
  WINDOW o AS (PARTITION BY run ORDER BY round ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), t AS (PARTITION BY run ORDER BY round ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), p AS (PARTITION BY run ORDER BY round ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT run, round, CASE WHEN n < 5 THEN 'Warming' WHEN flips >= 2 AND biggest > 0.1 THEN 'Oscillating' WHEN abs(f0 - entropy) < 0.01 THEN 'NoProgress' WHEN entropy / f0 > 0.8 THEN 'HighUncertainty' ELSE 'Fine' END AS state FROM w""",
)
def stall_detect(spark, d):
    from ..operators.stall import states

    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    n = table(spark, d, "orders").groupBy((F.col("o_custkey") % 10).alias("run"), F.floor(day / 30).alias("round")).agg(F.avg("o_totalprice").alias("entropy"))
    return states(n, "run", "round", "entropy").select("run", "round", "state")


@query(
    "stream_event_counts",
    """SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
)
def stream_event_counts(spark, d):
    from ..streaming.counts import event_counts

    return event_counts(spark, f"{d}/events.parquet").select("event_type", "hour", "n", F.round("total", 4).alias("total"))


@query("synthetic_reads", f"WITH {A.REFS} SELECT 3 * count(*) AS n_reads, true AS placed, true AS lengths FROM refs WHERE len(seq) > 0")
def synthetic_reads(spark, d):
    """Simulated reads of the references with truth, written as FASTQ and a table, read back and aligned: nine of ten come back to where they came from."""
    from ..operators.synthetic import simulate

    refs = A.refs(spark, d)
    made = cut(simulate(refs, per_ref=3, length=120))
    fastq, truth = scratch(spark), scratch(spark)
    S.write_fastq(made.select(F.col("read_id").cast("string").alias("id"), F.col("seq").alias("sequence"), F.repeat(F.lit("I"), F.length("seq")).alias("quality")), fastq)
    T.write_truth(made, truth)
    reads = S.read_fastq(spark, fastq).select(F.col("id").cast("long").alias("read_id"), F.col("sequence").alias("seq"))
    aligned = L.align(reads, refs, min_bases=40).filter("is_primary").select("read_id", F.col("ref_id").alias("found"), F.col("start").alias("at"))
    j = T.read_truth(spark, truth).join(aligned, "read_id", "left").join(reads.select("read_id", F.length("seq").alias("n")), "read_id")
    right = (F.col("found") == F.col("ref_id")) & (F.abs(F.col("at") - F.col("start")) <= 10)
    long = F.col("end") - F.col("start") >= 60
    share = F.count_if(right & long) / F.greatest(F.count_if(long), F.lit(1))
    return j.agg(F.count("*").alias("n_reads"), (share >= 0.9).alias("placed"), F.bool_and(F.abs(F.col("n") - (F.col("end") - F.col("start"))) <= 20).alias("lengths"))
