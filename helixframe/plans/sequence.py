from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import sequence as Q
from ..operators import annotation as N
from ..operators import relational as R
from ..operators import seeding as S
from ..runtime import q, table
from .base import query

K, W = 11, 5


def _kmers(of: str, key: str, name: str) -> str:
    return f"""{name}k AS (SELECT {key}, len(seq) - {K} AS last, pos, substr(seq, pos + 1, {K}) AS f FROM {of}, unnest(range(len(seq) - {K - 1})) AS u(pos) WHERE len(seq) >= {K}),
{name}c AS (SELECT {key}, last, pos, f, least(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS c FROM {name}k),
{name}w AS (SELECT {key}, last, pos, min({{'c': c, 'p': pos, 'f': f}}) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS m FROM {name}c),
{name}s AS (SELECT *, lag(m.p) OVER (PARTITION BY {key} ORDER BY pos) AS before FROM {name}w WHERE pos >= {W - 1} OR pos = last),
{name} AS (SELECT {key}, m.p AS pos, m.c AS kmer, m.c = m.f AS same_strand FROM {name}s WHERE before IS NULL OR before <> m.p)"""


def ref_index(spark, d):
    return Q.minimizers(A.refs(spark, d), "ref_id", "seq", k=K, w=W)


@query("kmer_canonical", f"WITH {A.REFS}, {_kmers('refs', 'ref_id', 'm')} SELECT c AS kmer, count(*) AS n, count(DISTINCT ref_id) AS n_refs FROM mc GROUP BY 1")
def kmer_canonical(spark, d):
    k = Q.kmers(A.refs(spark, d), "ref_id", "seq", K)
    return k.groupBy(Q.canonical(F.col("kmer")).alias("kmer")).agg(F.count("*").alias("n"), F.count_distinct("ref_id").alias("n_refs"))


@query("minimizers", f"WITH {A.REFS}, {_kmers('refs', 'ref_id', 'm')} SELECT ref_id, pos::INT AS pos, kmer, same_strand FROM m")
def minimizers(spark, d):
    return ref_index(spark, d)


@query("read_minimizers", f"WITH {A.READS}, {_kmers('reads', 'read_id', 'm')} SELECT read_id, count(*) AS n, min(pos)::INT AS first_pos, max(pos)::INT AS last_pos, count(DISTINCT kmer) AS n_kmers FROM m GROUP BY 1")
def read_minimizers(spark, d):
    return S.minimizer_summary(A.reads(spark, d), "read_id", "seq", k=K, w=W)


@query("occurrence_filter", f"WITH {A.REFS}, {_kmers('refs', 'ref_id', 'm')}, o AS (SELECT kmer, count(*) AS n_occ FROM m GROUP BY 1) SELECT kmer, n_occ, n_occ <= 2 AS kept FROM o")
def occurrence_filter(spark, d):
    return S.occurrences(ref_index(spark, d)).withColumn("kept", F.col("n_occ") <= 2)


@query(
    "index_stats",
    f"""WITH {A.REFS}, {_kmers('refs', 'ref_id', 'm')} SELECT count(DISTINCT kmer) AS n_keys, count(*) AS n_minimizers, (SELECT sum(len(seq))::BIGINT FROM refs) AS total_bases,
  round((SELECT sum(len(seq)) FROM refs) / count(*)::DOUBLE, 6) AS spacing FROM m""",
)
def index_stats(spark, d):
    return S.index_stats(A.refs(spark, d), ref_index(spark, d)).withColumn("spacing", q("spacing"))


@query(
    "seed_join",
    f"""WITH {A.READS}, {A.REFS}, {_kmers('reads', 'read_id', 'qa')}, {_kmers('refs', 'ref_id', 'qb')}, o AS (SELECT kmer FROM qb GROUP BY 1 HAVING count(*) <= 20)
SELECT read_id, ref_id, count(*) AS n_hits, count(*) FILTER (a.same_strand = b.same_strand) AS n_same, min(b.pos)::INT AS first_ref_pos, max(a.pos)::INT AS last_query_pos
FROM qa a JOIN qb b USING (kmer) WHERE kmer IN (SELECT kmer FROM o) GROUP BY 1, 2""",
)
def seed_join(spark, d):
    sides = [Q.coded_minimizers(x, key, "seq", k=K, w=W) for x, key in ((A.reads(spark, d), "read_id"), (A.refs(spark, d), "ref_id"))]
    hits = S.seed_join(*sides, max_occ=20)
    return hits.groupBy("read_id", "ref_id").agg(F.count("*").alias("n_hits"), F.count_if("same_strand").alias("n_same"), F.min("ref_pos").cast("int").alias("first_ref_pos"), F.max("query_pos").cast("int").alias("last_query_pos"))


@query("gc_revcomp", f"WITH {A.READS} SELECT read_id, len(seq)::INT AS n, round(CASE WHEN len(seq) > 0 THEN len(regexp_replace(seq, '[^GC]', '', 'g')) / len(seq)::DOUBLE ELSE 0 END, 6) AS gc, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc_md5 FROM reads")
def gc_revcomp(spark, d):
    return A.reads(spark, d).select("read_id", F.length("seq").alias("n"), q(Q.gc_content(F.col("seq"))).alias("gc"), F.md5(Q.reverse_complement(F.col("seq")).cast("binary")).alias("rc_md5"))


@query(
    "nucleotide_tokens",
    f"""WITH {A.REFS}, t AS (SELECT ref_id, [2] || list_transform(string_split(substr(seq, 1, 510), ''), lambda x: CASE x WHEN 'A' THEN 4 WHEN 'C' THEN 5 WHEN 'G' THEN 6 WHEN 'T' THEN 7 ELSE 8 END) || [3] AS ids FROM refs WHERE len(seq) > 0)
SELECT ref_id, array_to_string(ids || list_transform(range(512 - len(ids)), lambda x: 0), ' ') AS ids FROM t UNION ALL SELECT ref_id, array_to_string([2, 3] || list_transform(range(510), lambda x: 0), ' ') FROM refs WHERE len(seq) = 0""",
)
def nucleotide_tokens(spark, d):
    return A.refs(spark, d).select("ref_id", F.array_join(F.transform(Q.tokens(F.col("seq")), lambda x: x.cast("string")), " ").alias("ids"))


def _windows(size: int, step: int) -> str:
    return f"win AS (SELECT read_id, s AS \"start\", least(s + {size}, len(seq)) AS \"end\", substr(seq, s + 1, {size}) AS w FROM reads, unnest(range(0, len(seq), {step})) AS u(s))"


@query("sequence_windows", f'WITH {A.READS}, {_windows(200, 200)} SELECT read_id, "start", "end", md5(w) AS md5 FROM win')
def sequence_windows(spark, d):
    return Q.windows(A.reads(spark, d), "read_id", "seq", 200, 200).select("read_id", "start", "end", F.md5(F.col("window").cast("binary")).alias("md5"))


@query(
    "sequence_chunks",
    f"""WITH {A.READS} SELECT read_id, (k * 896)::BIGINT AS "start", least(k * 896 + 1024, len(seq)) AS "end", md5(substr(seq, k * 896 + 1, 1024)) AS md5
FROM reads, unnest(range(greatest(0, ceil((len(seq) - 1024) / 896e0))::BIGINT + 1)) AS u(k) WHERE len(seq) > 0""",
)
def sequence_chunks(spark, d):
    return Q.chunks(A.reads(spark, d), "read_id", "seq").select("read_id", "start", "end", F.md5(F.col("chunk").cast("binary")).alias("md5"))


_FEATURES = f"""{A.READS}, {_windows(200, 200)}, km AS (SELECT read_id, "start", substr(w, p + 1, 3) AS k FROM win, unnest(range(len(w) - 2)) AS u(p) WHERE len(w) >= 3),
n AS (SELECT read_id, "start", k, count(*) AS n FROM km GROUP BY ALL), e AS (SELECT read_id, "start", log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM n GROUP BY ALL),
feat AS (SELECT read_id, "start", "end", len(regexp_replace(w, '[^GC]', '', 'g')) / len(w)::DOUBLE AS gc, coalesce(entropy, 0) AS entropy FROM win LEFT JOIN e USING (read_id, "start"))"""


def features(spark, d):
    w = Q.windows(A.reads(spark, d), "read_id", "seq", 200, 200)
    return Q.window_statistics(w.withColumn("gc", Q.gc_content(F.col("window"))), ["read_id", "start", "end", "gc"], "window").drop("density")


@query("window_features", f'WITH {_FEATURES} SELECT read_id, "start", "end", round(gc, 6) AS gc, round(entropy, 6) + 0e0 AS entropy FROM feat')
def window_features(spark, d):
    return features(spark, d).select("read_id", "start", "end", q("gc").alias("gc"), q("entropy").alias("entropy"))


@query(
    "palindrome_density",
    f"""WITH {A.READS}, {_windows(200, 200)}, km AS (SELECT read_id, "start", substr(w, p + 1, 6) AS k FROM win, unnest(range(len(w) - 5)) AS u(p) WHERE len(w) >= 6)
SELECT read_id, "start", round(count(*) FILTER (k = reverse(translate(k, 'ACGT', 'TGCA'))) / count(*)::DOUBLE, 6) AS density FROM km GROUP BY 1, 2""",
)
def palindrome_density(spark, d):
    s = Q.window_statistics(Q.windows(A.reads(spark, d), "read_id", "seq", 200, 200), ["read_id", "start"], "window")
    return s.filter("density is not null").select("read_id", "start", q("density").alias("density"))


@query(
    "tandem_period",
    f"""WITH {A.REFS}, pp AS (SELECT ref_id, p, list_avg([(substr(seq, i, 1) = substr(seq, i + p, 1))::INT FOR i IN range(1, len(seq) - p + 1)]) AS share FROM refs, unnest(range(2, least(1000, len(seq) // 2) + 1)) AS u(p)),
b AS (SELECT ref_id, arg_max(p, share * 1e9 - p) AS p, max(share) AS share FROM pp GROUP BY 1)
SELECT ref_id, (CASE WHEN coalesce(share, 0) >= 0.85 THEN p ELSE -1 END)::INT AS period FROM refs LEFT JOIN b USING (ref_id)""",
)
def tandem_period(spark, d):
    """Periods up to half of whole references (1,000 at most)."""
    return Q.tandem_period(A.refs(spark, d), ["ref_id"], "seq")


@query(
    "tandem_repeats",
    """WITH t AS (SELECT p_partkey, repeat(substr('ACGTTGCAAGCTACGGATTC', 1 + (p_partkey % 3)::INT, 2 + (p_partkey % 9)::INT), 12) AS seq FROM part),
pp AS (SELECT p_partkey, p, list_avg([(seq[i] = seq[i + p])::INT FOR i IN range(1, len(seq) - p + 1)]) AS share FROM t, unnest(range(2, len(seq) // 2 + 1)) AS u(p))
SELECT p_partkey, CASE WHEN max(share) >= 0.85 THEN arg_max(p, share * 1e9 - p)::INT ELSE -1 END AS period FROM pp GROUP BY 1""",
)
def tandem_repeats(spark, d):
    """Planted repeats of units of two to ten bases."""
    k = F.col("p_partkey")
    unit = F.substring(F.lit("ACGTTGCAAGCTACGGATTC"), (1 + k % 3).cast("int"), (2 + k % 9).cast("int"))
    return Q.tandem_period(table(spark, d, "part").select("p_partkey", F.repeat(unit, F.lit(12)).alias("seq")), ["p_partkey"], "seq")


RULES = [
    N.Rule("rich", 30, (N.Predicate("gc", "ge", 0.56), N.Predicate("entropy", "ge", 4.5))),
    N.Rule("poor", 20, (N.Predicate("gc", "le", 0.44),)),
    N.Rule("plain", 10, (N.Predicate("entropy", "range", 4.0, 5.2),)),
    N.Rule("never", 99, (N.Predicate("orf_density", "ge", 0.0),)),
]
_CLASSIFIED = f"""{_FEATURES}, cl AS (SELECT read_id, "start", "end", CASE WHEN gc >= 0.56e0 AND entropy >= 4.5e0 THEN 'rich' WHEN gc <= 0.44e0 THEN 'poor' WHEN entropy BETWEEN 4e0 AND 5.2e0 THEN 'plain' END AS region FROM feat)"""


@query("region_classify", f'WITH {_CLASSIFIED} SELECT read_id, "start", "end", region FROM cl')
def region_classify(spark, d):
    return N.classify(features(spark, d), RULES).select("read_id", "start", "end", "region")


@query(
    "region_merge_islands",
    f"""WITH {_CLASSIFIED}, f AS (SELECT *, CASE WHEN lag("end") OVER o = "start" AND lag(region) OVER o = region THEN 0 ELSE 1 END AS fresh FROM cl WHERE region IS NOT NULL WINDOW o AS (PARTITION BY read_id ORDER BY "start")),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id ORDER BY "start") AS island FROM f)
SELECT read_id, min("start") AS "start", max("end") AS "end", any_value(region) AS region, count(*) AS n_windows FROM i GROUP BY read_id, island""",
)
def region_merge_islands(spark, d):
    return N.merged(N.classify(features(spark, d), RULES), "read_id")


@query("point_in_interval", f"WITH {A.INTERVALS}, {A.POINTS} SELECT read_id, hit, interval_id, layer FROM points p JOIN intervals i ON p.ref_id = i.ref_id AND pos >= \"start\" AND pos < \"end\"")
def point_in_interval(spark, d):
    return R.points_in_intervals(A.points(spark, d), A.intervals(spark, d), on=["ref_id"]).select("read_id", "hit", "interval_id", "layer")


@query(
    "interval_overlap",
    f"""WITH {A.INTERVALS}, tiles AS (SELECT c_custkey % 7 AS ref_id, c_custkey * 100 AS ts, c_custkey * 100 + 60 AS te, c_custkey AS tile FROM customer)
SELECT tile, interval_id, (least("end", te) - greatest("start", ts)) AS overlap FROM tiles t JOIN intervals i ON t.ref_id = i.ref_id AND ts < "end" AND "start" < te""",
)
def interval_overlap(spark, d):
    from ..runtime import table

    k = F.col("c_custkey")
    tiles = table(spark, d, "customer").select((k % 7).alias("ref_id"), (k * 100).alias("ts"), (k * 100 + 60).alias("te"), k.alias("tile"))
    j = R.overlapping(tiles, A.intervals(spark, d), on=["ref_id"], a_span=("ts", "te"), b_span=("start", "end"))
    return j.select("tile", "interval_id", (F.least("end", "te") - F.greatest("start", "ts")).alias("overlap"))


@query(
    "annotation_params",
    f"""WITH {A.INTERVALS}, {A.POINTS}, h AS (SELECT p.*, layer, lambda_scale, weight_scale, row_number() OVER (PARTITION BY p.ref_id, pos, read_id, hit ORDER BY layer DESC, "start" DESC, interval_id DESC) AS k
  FROM points p JOIN intervals i ON p.ref_id = i.ref_id AND pos >= "start" AND pos < "end" QUALIFY k <= 32)
SELECT ref_id, pos, read_id, hit, count(*) AS n_intervals, max(layer) AS top_layer, arg_min(lambda_scale, k) FILTER (lambda_scale IS NOT NULL) AS lambda_scale,
  arg_min(weight_scale, k) FILTER (weight_scale IS NOT NULL) AS weight_scale FROM h GROUP BY 1, 2, 3, 4""",
)
def annotation_params(spark, d):
    return N.parameters_at(A.points(spark, d), A.intervals(spark, d))
