from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import cigar as C
from ..operators import evaluation as E
from ..operators import paralog as P
from ..operators import records as X
from ..runtime import q, table
from .base import query

_INFO = f"""{A.PSV_SITES}, al AS (SELECT psv_id, allele, count(*) AS n FROM psv_sites GROUP BY 1, 2),
info AS (SELECT psv_id, sum(n)::BIGINT AS n_paralogs, count(*) AS n_alleles, CASE WHEN count(*) > 1 AND sum(n) > 1 THEN (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(sum(n)) ELSE 0 END AS informativeness FROM al GROUP BY 1)"""


def sites(spark, d):
    s = A.psv_sites(spark, d)
    return s.join(P.informativeness(s).select("psv_id", "informativeness"), "psv_id")


def names(spark):
    return spark.createDataFrame([(p,) for p in A.PARALOGS], "paralog string")


def likelihoods(spark, d):
    return P.likelihoods(A.psv_obs(spark, d), sites(spark, d), names(spark))


@query("psv_informativeness", f"WITH {_INFO} SELECT psv_id, n_paralogs, n_alleles, round(informativeness, 6) + 0e0 AS informativeness FROM info")
def psv_informativeness(spark, d):
    return P.informativeness(A.psv_sites(spark, d)).withColumn("informativeness", q("informativeness"))


_POST = f"""{_INFO}, {A.PSV_OBS}, o AS (SELECT psv_obs.* FROM psv_obs JOIN info USING (psv_id) WHERE base_quality >= 20 AND informativeness >= 0.5e0),
known AS (SELECT read_id, paralog, sum(CASE WHEN base = allele THEN ln(0.99e0) ELSE ln(0.01e0 / 3) END) AS l, count(*) FILTER (base = allele) AS s, count(*) FILTER (base <> allele) AS c FROM o JOIN psv_sites USING (psv_id) GROUP BY 1, 2),
lik AS (SELECT r.read_id, p.paralog, coalesce(l, 0) AS log_likelihood, coalesce(s, 0) AS support, coalesce(c, 0) AS conflict
  FROM (SELECT DISTINCT read_id FROM o) r CROSS JOIN (VALUES ('P0'), ('P1'), ('P2'), ('P3')) p(paralog) LEFT JOIN known k ON k.read_id = r.read_id AND k.paralog = p.paralog),
e AS (SELECT *, exp(log_likelihood - max(log_likelihood) OVER (PARTITION BY read_id)) AS e FROM lik),
post AS (SELECT *, e / sum(e) OVER (PARTITION BY read_id) AS posterior FROM e)"""


@query("psv_posterior", f"WITH {_POST} SELECT read_id, paralog, round(log_likelihood, 6) + 0e0 AS log_likelihood, support, conflict, round(posterior, 6) AS posterior FROM post")
def psv_posterior(spark, d):
    return P.posteriors(likelihoods(spark, d)).select("read_id", "paralog", q("log_likelihood").alias("log_likelihood"), "support", "conflict", q("posterior").alias("posterior"))


_ASSIGNED = f"""{_POST}, asg AS (SELECT read_id, max(posterior) AS posterior, -sum(CASE WHEN posterior > 0 THEN posterior * log2(posterior) ELSE 0 END) AS entropy FROM post GROUP BY 1)"""


@query("psv_assign", f"WITH {_ASSIGNED} SELECT read_id, round(posterior, 6) AS posterior, round(entropy, 6) + 0e0 AS entropy, posterior >= 0.9e0 AS assigned FROM asg")
def psv_assign(spark, d):
    a = P.assignments(P.posteriors(likelihoods(spark, d)))
    return a.select("read_id", q("posterior").alias("posterior"), q("entropy").alias("entropy"), "assigned")


@query("psv_stats", f"WITH {_ASSIGNED} SELECT (SELECT count(DISTINCT read_id) FROM psv_obs) AS processed, count(*) AS with_psvs, count(*) FILTER (posterior >= 0.9e0) AS assigned, count(*) FILTER (posterior < 0.9e0) AS ambiguous FROM asg")
def psv_stats(spark, d):
    a = P.assignments(P.posteriors(likelihoods(spark, d)))
    s = a.agg(F.count("*").alias("with_psvs"), F.count_if("assigned").alias("assigned"), F.count_if("ambiguous").alias("ambiguous"))
    return s.join(F.broadcast(A.psv_obs(spark, d).agg(F.count_distinct("read_id").alias("processed")))).select("processed", "with_psvs", "assigned", "ambiguous")


@query(
    "psv_merge",
    f"""WITH {A.PSV_OBS}, c1 AS (SELECT read_id, 'P' || (psv_id % 4) AS paralog, count(*) / sum(count(*)) OVER (PARTITION BY read_id) AS p, sum(count(*)) OVER (PARTITION BY read_id)::BIGINT AS n_psvs FROM psv_obs WHERE base_quality >= 20 GROUP BY 1, 2),
c2 AS (SELECT read_id, 'P' || (base_quality % 4) AS paralog, count(*) / sum(count(*)) OVER (PARTITION BY read_id) AS p, CASE WHEN read_id % 3 = 0 THEN 0 ELSE 1 END AS n_psvs FROM psv_obs GROUP BY 1, 2),
j AS (SELECT coalesce(c1.read_id, c2.read_id) AS read_id, coalesce(c1.paralog, c2.paralog) AS paralog, coalesce(c1.p, 0) AS p, coalesce(c2.p, 0) AS r, c1.n_psvs AS n, c2.n_psvs AS m FROM c1 FULL JOIN c2 ON c1.read_id = c2.read_id AND c1.paralog = c2.paralog),
v AS (SELECT *, CASE WHEN coalesce(max(n) OVER w, 0) > 0 AND coalesce(max(m) OVER w, 0) > 0 THEN p * r ELSE 0.5e0 * p + 0.5e0 * r END AS v FROM j WINDOW w AS (PARTITION BY read_id))
SELECT read_id, paralog, round(CASE WHEN sum(v) OVER (PARTITION BY read_id) > 0 THEN v / sum(v) OVER (PARTITION BY read_id) ELSE 0 END, 6) AS p FROM v""",
)
def psv_merge(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("read_id")
    share = lambda o, k: o.groupBy("read_id", F.concat(F.lit("P"), (F.col(k) % 4).cast("string")).alias("paralog")).agg(F.count("*").alias("_k")).withColumn("p", F.col("_k") / F.sum("_k").over(w))
    o = A.psv_obs(spark, d)
    a = share(o.filter("base_quality >= 20"), "psv_id").withColumn("n_psvs", F.sum("_k").over(w))
    b = share(o, "base_quality").withColumn("n_psvs", F.when(F.col("read_id") % 3 == 0, 0).otherwise(1))
    return P.merge_calls(a, b).withColumn("p", q("p"))


@query(
    "psv_catalogue",
    f"""WITH {A.REFS}, n AS (SELECT min(len(seq)) AS n FROM refs), col AS (SELECT ref_id AS paralog, k - 1 AS pos, substr(seq, k, 1) AS allele FROM refs, n, unnest(range(1, n + 1)) AS u(k)),
al AS (SELECT pos, allele, count(*) AS c FROM col GROUP BY 1, 2), i AS (SELECT pos, CASE WHEN count(*) > 1 THEN (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(sum(c)) ELSE 0 END AS informativeness FROM al GROUP BY 1)
SELECT pos::INT AS pos, paralog, allele, round(informativeness, 6) AS informativeness FROM col JOIN i USING (pos) WHERE informativeness >= 0.34e0""",
)
def psv_catalogue(spark, d):
    c = P.catalogue(A.refs(spark, d).select(F.col("ref_id").alias("paralog"), "seq"), least=0.34)
    return c.select("pos", "paralog", "allele", q("informativeness").alias("informativeness"))


_CIGAR = """cig AS (SELECT l_orderkey AS read_id, l_linenumber::INT AS hit, l_partkey AS ref_start, (l_linenumber % 3)::VARCHAR || 'S' || l_quantity::INT || 'M' || (1 + l_suppkey % 4) || 'I' || (5 + l_partkey % 7) || '=' || (1 + l_linenumber % 2) || 'D' || '3X' AS cigar,
  l_linenumber % 3 AS s, l_quantity::BIGINT AS m, 1 + l_suppkey % 4 AS i, 5 + l_partkey % 7 AS e, 1 + l_linenumber % 2 AS dl FROM lineitem)"""


def cigars(spark, d):
    return cigars_of(table(spark, d, "lineitem"))


def cigars_of(lines, **more):
    return lines.select(
        F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").cast("int").alias("hit"), F.col("l_partkey").alias("ref_start"),
        F.concat((F.col("l_linenumber") % 3).cast("string"), F.lit("S"), F.col("l_quantity").cast("int").cast("string"), F.lit("M"), (1 + F.col("l_suppkey") % 4).cast("string"), F.lit("I"), (5 + F.col("l_partkey") % 7).cast("string"), F.lit("="), (1 + F.col("l_linenumber") % 2).cast("string"), F.lit("D3X")).alias("cigar"),
        *[c.alias(n) for n, c in more.items()],
    )


@query("cigar_stats", f"WITH {_CIGAR} SELECT read_id, hit, cigar, (s + m + i + e + 3)::BIGINT AS query_length, (m + e + dl + 3)::BIGINT AS ref_length, (m + e + 3)::BIGINT AS aligned, round((m + e) / (m + e + 3 + i + dl)::DOUBLE, 6) AS identity FROM cig")
def cigar_stats(spark, d):
    return C.stats(cigars(spark, d), "cigar").select("read_id", "hit", "cigar", "query_length", "ref_length", "aligned", q("identity").alias("identity"))


@query(
    "cigar_bases",
    f"""WITH {_CIGAR}, b AS (SELECT read_id, hit, ref_start + k AS ref_pos, s + k AS read_pos FROM cig, unnest(range(m)) AS u(k)
UNION ALL SELECT read_id, hit, ref_start + m + k, s + m + i + k FROM cig, unnest(range(e)) AS u(k) UNION ALL SELECT read_id, hit, ref_start + m + e + dl + k, s + m + i + e + k FROM cig, unnest(range(3)) AS u(k))
SELECT read_id, hit, count(*) AS n, min(ref_pos)::BIGINT AS first_ref, max(ref_pos)::BIGINT AS last_ref, min(read_pos)::BIGINT AS first_read, max(read_pos)::BIGINT AS last_read, sum(ref_pos * 31 + read_pos)::BIGINT AS checksum FROM b GROUP BY 1, 2""",
)
def cigar_bases(spark, d):
    b = C.walk(cigars(spark, d), ["read_id", "hit"], "cigar", "ref_start")
    return b.groupBy("read_id", "hit").agg(
        F.count("*").alias("n"), F.min("ref_pos").alias("first_ref"), F.max("ref_pos").alias("last_ref"), F.min("read_pos").alias("first_read"), F.max("read_pos").alias("last_read"), F.sum(F.col("ref_pos") * 31 + F.col("read_pos")).alias("checksum")
    )


_ANCHORS = f"""{A.REFS}, anchors AS (SELECT 'G' || (ref_id % 5) AS gene, 'G' || (ref_id % 5) || '_C' || ((ref_id // 5) % 4) AS copy, 'CH' || k AS exon, substr(seq, k * 40 + 1, 32) AS anchor FROM refs, range(4) AS u(k) WHERE len(seq) >= k * 40 + 32)"""


def anchors(spark, d):
    k = F.explode(F.sequence(F.lit(0), F.lit(3)))
    gene = F.concat(F.lit("G"), (F.col("ref_id") % 5).cast("string"))
    r = A.refs(spark, d).select("ref_id", "seq", k.alias("k")).filter(F.length("seq") >= F.col("k") * 40 + 32)
    return r.select(gene.alias("gene"), F.concat(gene, F.lit("_C"), (F.floor(F.col("ref_id") / 5) % 4).cast("string")).alias("copy"), F.concat(F.lit("CH"), F.col("k").cast("string")).alias("exon"), F.substr("seq", F.col("k") * 40 + 1, F.lit(32)).alias("anchor"))


_HITS = f"""{A.READS}, {_ANCHORS}, both_ AS (SELECT *, true AS forward FROM anchors UNION ALL SELECT gene, copy, exon, reverse(translate(anchor, 'ACGT', 'TGCA')), false FROM anchors),
hits AS (SELECT DISTINCT read_id, gene, copy, exon, forward FROM reads JOIN both_ ON contains(seq, anchor)),
cp AS (SELECT read_id, gene, copy, count(DISTINCT exon) AS n_exons, count(*) AS n_hits, bool_or(forward) AS forward FROM hits GROUP BY 1, 2, 3),
tied AS (SELECT * FROM cp QUALIFY rank() OVER (PARTITION BY read_id ORDER BY n_exons DESC, n_hits DESC) = 1),
best AS (SELECT read_id, arg_min(gene, copy) AS gene, min(copy) AS copy, arg_min(n_exons, copy) AS n_exons, arg_min(n_hits, copy) AS n_hits, arg_min(forward, copy) AS forward, count(DISTINCT gene) > 1 AS ambiguous_gene,
  count(*) > 1 AS ambiguous_copy, array_to_string(list_sort(list(DISTINCT copy)), ',') AS tied_copies FROM tied GROUP BY 1)"""


def best(spark, d):
    return P.best_copy(P.anchor_hits(A.reads(spark, d), anchors(spark, d), 24))


@query("igh_best_copy", f"WITH {_HITS} SELECT * FROM best")
def igh_best_copy(spark, d):
    return best(spark, d)


@query("igh_resort", f"WITH {_HITS} SELECT read_id, copy, n_exons >= 2 AND NOT ambiguous_gene AS relabelled, CASE WHEN n_exons >= 2 AND NOT ambiguous_gene THEN copy END AS target FROM best")
def igh_resort(spark, d):
    return P.resort(best(spark, d)).select("read_id", "copy", "relabelled", "target")


@query("igh_summary", f"WITH {_HITS} SELECT gene, copy, count(*) AS n_reads, count(*) FILTER (ambiguous_copy) AS n_ambiguous FROM best GROUP BY 1, 2")
def igh_summary(spark, d):
    return best(spark, d).groupBy("gene", "copy").agg(F.count("*").alias("n_reads"), F.count_if("ambiguous_copy").alias("n_ambiguous"))


_8MER = "array_to_string([substr('ACGT', 1 + ((({k}) >> (2 * i)) & 3)::INT, 1) for i in range(8)], '')"


def _mer(key):
    return F.concat(*[F.substring(F.lit("ACGT"), (1 + F.shiftright(key, 2 * i).bitwiseAND(F.lit(3))).cast("int"), F.lit(1)) for i in range(8)])


_WHITE = f"white AS (SELECT DISTINCT {_8MER.format(k='c_custkey * 13')} AS w FROM customer)"
_SEEN = f"""seen AS (SELECT DISTINCT substr(b, 1, p) || substr('ACGT', 1 + (event_id % 4)::INT, 1) || substr(b, p + 2) AS barcode FROM (SELECT event_id, (event_id % 8)::INT AS p, {_8MER.format(k='user_id * 13')} AS b FROM events))"""


@query(
    "barcode_correct",
    f"""WITH {_WHITE}, {_SEEN}, pairs AS (SELECT barcode, w, hamming(barcode, w) AS dist FROM seen JOIN white ON hamming(barcode, w) <= 1)
SELECT barcode, arg_min(w, dist * 10 + 0) AS corrected, min(dist)::INT AS distance FROM (SELECT barcode, min(w) AS w, dist FROM pairs GROUP BY 1, 3) GROUP BY 1""",
)
def barcode_correct(spark, d):
    white = table(spark, d, "customer").select(_mer(F.col("c_custkey") * 13).alias("barcode")).distinct()
    p = (F.col("event_id") % 8).cast("int")
    b = table(spark, d, "events").select("event_id", _mer(F.col("user_id") * 13).alias("b"), p.alias("p"))
    seen = b.select(F.concat(F.substr("b", F.lit(1), F.col("p")), F.substring(F.lit("ACGT"), (1 + F.col("event_id") % 4).cast("int"), F.lit(1)), F.substr("b", F.col("p") + 2)).alias("barcode"))
    return X.correct_barcodes(seen, white)


@query(
    "tags_from_name",
    f"""WITH n AS (SELECT event_id, 'run_' || event_type || '_' || {_8MER.format(k='user_id * 13')} || '_' || {_8MER.format(k='event_id * 7')} AS name FROM events)
SELECT event_id, string_split(name, '_')[-1] AS umi, string_split(name, '_')[-2] AS barcode, regexp_matches(string_split(name, '_')[-2], '^[ACGT]{{8}}$') AS valid FROM n""",
)
def tags_from_name(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("run_"), "event_type", F.lit("_"), _mer(F.col("user_id") * 13), F.lit("_"), _mer(F.col("event_id") * 7)).alias("name"))
    t = X.tags_from_name(F.col("name"))
    return e.select("event_id", t["umi"].alias("umi"), t["barcode"].alias("barcode"), X.valid_barcode(t["barcode"], 8).alias("valid"))


_RECORDS = """rec AS (SELECT l_orderkey AS read_id, CASE WHEN min(l_returnflag) = 'R' THEN 'Unmapped' WHEN max(l_linestatus) = 'O' THEN 'Tentative' ELSE 'Mapped' END AS status,
  1 - max(l_discount) AS confidence, list(l_suppkey::VARCHAR ORDER BY l_linenumber, l_suppkey) AS b, list(l_quantity / 100e0 ORDER BY l_linenumber, l_suppkey) AS p FROM lineitem GROUP BY 1)"""


def records(spark, d):
    t = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_quantity")))
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("read_id")).agg(F.min("l_returnflag").alias("_f"), F.max("l_linestatus").alias("_s"), (1 - F.max("l_discount")).alias("confidence"), t.alias("_t"))
    status = F.when(F.col("_f") == "R", "Unmapped").when(F.col("_s") == "O", "Tentative").otherwise("Mapped")
    return g.select("read_id", status.alias("status"), "confidence", F.transform("_t", lambda x: F.struct(x["l_suppkey"].cast("string").alias("bucket_id"), (x["l_quantity"] / 100).alias("p"))).alias("targets"))


_FLAT = f"""{_RECORDS}, ex AS (SELECT read_id, status, confidence, i, b[i] AS bucket_id, p[i] AS p FROM rec, unnest(range(1, len(b) + 1)) AS u(i)),
flat AS (SELECT read_id, CASE WHEN status = 'Unmapped' THEN '*' ELSE bucket_id END AS bucket_id, CASE WHEN status = 'Unmapped' THEN 0 WHEN status = 'Mapped' AND i = 1 THEN 1 WHEN status = 'Mapped' THEN 0.9e0 / i ELSE p END AS probability,
  CASE WHEN status = 'Unmapped' THEN 0 WHEN status = 'Mapped' AND i = 1 THEN confidence WHEN status = 'Mapped' THEN confidence / 2 ELSE p END AS confidence, status = 'Mapped' AND i = 1 AS is_collapsed FROM ex WHERE status <> 'Unmapped' OR i = 1),
flt AS (SELECT * FROM flat WHERE probability >= 0.2e0 OR is_collapsed OR bucket_id = '*')"""


@query("record_flatten", f"WITH {_FLAT} SELECT read_id, bucket_id, round(probability, 6) AS probability, round(confidence, 6) AS confidence, is_collapsed FROM flt")
def record_flatten(spark, d):
    return X.flatten(records(spark, d), min_probability=0.2).select("read_id", "bucket_id", q("probability").alias("probability"), q("confidence").alias("confidence"), "is_collapsed")


@query("record_flatten_stats", f"WITH {_FLAT} SELECT count(*) AS entries, count(DISTINCT read_id) AS reads, count(DISTINCT bucket_id) AS buckets, count(*) FILTER (is_collapsed) AS collapsed, count(*) FILTER (bucket_id = '*') AS unmapped FROM flt")
def record_flatten_stats(spark, d):
    return X.table_stats(X.flatten(records(spark, d), min_probability=0.2))


_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'Mapped' WHEN 'F' THEN 'Unmapped' ELSE 'Tentative' END"
_LOSSLESS = f"""lr AS (SELECT o_orderkey AS read_id, {_STATUS} AS status, o_orderstatus = 'O' AND o_custkey % 9 <> 0 AS has_primary, (o_custkey % 3)::INT AS n_targets,
  CASE WHEN o_orderstatus <> 'O' AND o_custkey % 7 <> 0 THEN 'NoSeeds' END AS reason, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS pos, 1000 + o_custkey AS read_len FROM orders)"""
_OK = "CASE status WHEN 'Mapped' THEN has_primary AND reason IS NULL WHEN 'Tentative' THEN NOT has_primary AND n_targets > 0 AND reason IS NOT NULL ELSE NOT has_primary AND reason IS NOT NULL END"


def lossless_records(spark, d):
    s = F.col("o_orderstatus")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("read_id"), F.when(s == "O", "Mapped").when(s == "F", "Unmapped").otherwise("Tentative").alias("status"), ((s == "O") & (F.col("o_custkey") % 9 != 0)).alias("has_primary"),
        (F.col("o_custkey") % 3).cast("int").alias("n_targets"), F.when((s != "O") & (F.col("o_custkey") % 7 != 0), "NoSeeds").alias("reason"), day.alias("pos"), (1000 + F.col("o_custkey")).alias("read_len"),
    )


@query("lossless_check", f"WITH {_LOSSLESS} SELECT read_id, status, {_OK} AS lossless FROM lr")
def lossless_check(spark, d):
    return lossless_records(spark, d).select("read_id", "status", X.is_lossless().alias("lossless"))


@query(
    "validator",
    f"""WITH {_LOSSLESS}, {A.CALLS_B}, j AS (SELECT coalesce(lr.read_id, b.read_id) AS id, lr.read_id AS r, b.read_id AS t, status, {_OK} AS ok, lr.pos, b.pos AS true_pos, read_len FROM lr FULL JOIN calls_b b ON lr.read_id = b.read_id)
SELECT count(*) AS n_ids, count(*) FILTER (r IS NULL) AS n_missing, count(*) FILTER (t IS NULL) AS n_extra, count(*) FILTER (r IS NOT NULL AND ok) AS n_lossless, count(*) FILTER (status = 'Mapped') AS n_mapped,
  count(*) FILTER (status = 'Tentative') AS n_tentative, count(*) FILTER (status = 'Unmapped') AS n_unmapped, count(*) FILTER (status = 'Mapped' AND abs(pos - true_pos) <= greatest(100, floor(read_len * 0.01e0))) AS n_correct,
  round(count(*) FILTER (status = 'Mapped' AND abs(pos - true_pos) <= greatest(100, floor(read_len * 0.01e0))) / count(*) FILTER (status = 'Mapped')::DOUBLE, 6) AS position_accuracy,
  count(*) FILTER (r IS NULL) = 0 AND count(*) FILTER (r IS NOT NULL AND ok) = count(*) AS passed FROM j""",
)
def validator(spark, d):
    return E.validation(lossless_records(spark, d), A.calls_b(spark, d)).withColumn("position_accuracy", q("position_accuracy"))


@query("prob_filter", f"WITH {A.PROB_ROWS} SELECT read_id, bucket_id, round(probability, 6) AS probability FROM prob_rows WHERE probability >= 0.5e0 AND NOT is_collapsed")
def prob_filter(spark, d):
    return A.prob_rows(spark, d).filter((F.col("probability") >= 0.5) & ~F.col("is_collapsed")).select("read_id", "bucket_id", q("probability").alias("probability"))


@query("prob_stats", f"WITH {A.PROB_ROWS} SELECT count(*) AS entries, count(DISTINCT read_id) AS reads, count(DISTINCT bucket_id) AS buckets, count(*) FILTER (is_collapsed) AS collapsed, 0::BIGINT AS unmapped FROM prob_rows")
def prob_stats(spark, d):
    return X.table_stats(A.prob_rows(spark, d))


_MAPQ = "CASE WHEN confidence >= 0.99e0 THEN 60 WHEN confidence >= 0.95e0 THEN 40 WHEN confidence >= 0.9e0 THEN 30 WHEN confidence >= 0.8e0 THEN 20 ELSE 10 END"


@query("mapq_writer", f"WITH {A.PROB_ROWS} SELECT read_id, bucket_id, iteration, {_MAPQ} AS mapq FROM prob_rows")
def mapq_writer(spark, d):
    c = F.round("confidence", 9)
    return A.prob_rows(spark, d).select("read_id", "bucket_id", "iteration", X.writer_mapq(c, F.lit(0)).alias("mapq"))


@query(
    "sam_lines",
    f"""WITH {_CIGAR} SELECT concat_ws(chr(9), read_id, CASE WHEN hit % 2 = 0 THEN 16 ELSE 0 END + CASE WHEN hit > 1 THEN 256 ELSE 0 END, 'chr' || (ref_start % 5), ref_start + 1, 60 - hit, cigar, '*', 0, 0, '*', '*', 'NM:i:' || (i + dl + 3)) AS line FROM cig""",
)
def sam_lines(spark, d):
    c = C.stats(cigars(spark, d), "cigar")
    nm = C.length_of(C.operations(F.col("cigar")), "XID")
    flag = F.when(F.col("hit") % 2 == 0, 16).otherwise(0) + F.when(F.col("hit") > 1, 256).otherwise(0)
    rows = c.select("read_id", flag.alias("flag"), F.concat(F.lit("chr"), (F.col("ref_start") % 5).cast("string")).alias("target"), F.col("ref_start").alias("pos"), (60 - F.col("hit")).alias("mapq"), "cigar", F.lit(None).cast("string").alias("seq"), F.concat(F.lit("NM:i:"), nm.cast("string")).alias("tags"))
    return X.sam_lines(rows)


@query(
    "mapping_summary",
    f"""WITH {A.CALLS_A} SELECT count(*) AS records, count(*) FILTER (mapped AND kind <= 3) AS "primary", count(*) FILTER (mapped AND kind = 4) AS secondary, count(*) FILTER (mapped AND kind = 5) AS supplementary, count(*) FILTER (NOT mapped) AS unmapped,
  round(count(*) FILTER (mapped AND kind <= 3) / count(*) FILTER (NOT mapped OR kind <= 3)::DOUBLE, 6) AS mapping_rate, round(count(*) FILTER (NOT mapped) / count(*) FILTER (NOT mapped OR kind <= 3)::DOUBLE, 6) AS drop_rate FROM calls_a""",
)
def mapping_summary(spark, d):
    return E.mapping_summary(A.calls_a(spark, d)).withColumn("mapping_rate", q("mapping_rate")).withColumn("drop_rate", q("drop_rate"))


@query("mapq_hist", f"WITH {A.CALLS_A} SELECT mapq, count(*) AS n FROM calls_a WHERE mapped GROUP BY 1")
def mapq_hist(spark, d):
    return E.mapq_histogram(A.calls_a(spark, d))


@query(
    "truth_eval",
    f"""WITH {A.CALLS_A}, {A.CALLS_B}, j AS (SELECT coalesce(a.mapped, false) AS found, coalesce(a.mapped, false) AND a.chrom = b.chrom AND abs(a.pos - b.pos) <= 400 AS ok FROM calls_b b LEFT JOIN calls_a a USING (read_id)),
s AS (SELECT count(*) AS n_truth, count(*) FILTER (ok) AS tp, count(*) FILTER (found AND NOT ok) AS fp, count(*) FILTER (NOT found) AS fn FROM j),
r AS (SELECT *, tp / (tp + fp)::DOUBLE AS precision_, tp / n_truth::DOUBLE AS recall_ FROM s)
SELECT n_truth, tp, fp, fn, round(precision_, 6) AS precision, round(recall_, 6) AS recall, round(2 * precision_ * recall_ / (precision_ + recall_), 6) AS f1 FROM r""",
)
def truth_eval(spark, d):
    e = E.truth_evaluation(A.calls_a(spark, d), A.calls_b(spark, d), 400)
    return e.select("n_truth", "tp", "fp", "fn", q("precision").alias("precision"), q("recall").alias("recall"), q("f1").alias("f1"))


_CONC = f"""{A.CALLS_A}, {A.CALLS_B}, j AS (SELECT coalesce(a.read_id, b.read_id) AS read_id, coalesce(a.mapped, false) AS ma, coalesce(b.mapped, false) AS mb, a.chrom = b.chrom AS same, abs(a.pos - b.pos) AS dist FROM calls_a a FULL JOIN calls_b b ON a.read_id = b.read_id),
conc AS (SELECT read_id, ma, mb, CASE WHEN ma AND mb AND same AND dist <= 200 THEN 'same_position' WHEN ma AND mb AND same THEN 'same_chrom_diff_pos' WHEN ma AND mb THEN 'diff_chrom' WHEN ma THEN 'only_a' WHEN mb THEN 'only_b' ELSE 'both_unmapped' END AS category FROM j)"""


@query("concordance", f"WITH {_CONC} SELECT read_id, category FROM conc")
def concordance(spark, d):
    return E.concordance(A.calls_a(spark, d), A.calls_b(spark, d), 200).select("read_id", "category")


@query("concordance_counts", f"WITH {_CONC} SELECT category, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM conc)::DOUBLE, 3) AS percent FROM conc GROUP BY 1")
def concordance_counts(spark, d):
    return E.concordance_counts(E.concordance(A.calls_a(spark, d), A.calls_b(spark, d), 200))


@query(
    "baseline_compare",
    f"""WITH {_CONC} SELECT count(*) AS n, count(*) FILTER (ma AND mb) AS n_both, count(*) FILTER (ma AND NOT mb) AS n_only_a, count(*) FILTER (mb AND NOT ma) AS n_only_b, count(*) FILTER (NOT ma AND NOT mb) AS n_neither,
  round(count(*) FILTER (ma AND mb) / count(*) FILTER (mb)::DOUBLE, 6) AS recall_a, round(count(*) FILTER (ma AND mb) / count(*) FILTER (ma)::DOUBLE, 6) AS recall_b, round(count(*) FILTER (ma) / count(*) FILTER (mb)::DOUBLE, 6) AS ratio FROM conc""",
)
def baseline_compare(spark, d):
    b = E.baseline(A.calls_a(spark, d), A.calls_b(spark, d))
    return b.select("n", "n_both", "n_only_a", "n_only_b", "n_neither", *[q(c).alias(c) for c in ("recall_a", "recall_b", "ratio")])


@query(
    "round_trip_check",
    f"""WITH {A.PROB_ROWS}, a AS (SELECT read_id, iteration, probability FROM prob_rows WHERE level <> 0), b AS (SELECT read_id, iteration, probability + CASE WHEN bucket_id % 10 = 0 THEN 0.5e0 ELSE 0e0 END AS probability FROM prob_rows WHERE level <> 1),
a1 AS (SELECT read_id, iteration, max(probability) AS x FROM a GROUP BY 1, 2), b1 AS (SELECT read_id, iteration, max(probability) AS y FROM b GROUP BY 1, 2)
SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND abs(x - y) <= 1e-6) AS matched, count(*) FILTER (abs(x - y) > 1e-6) AS different, count(*) FILTER (y IS NULL) AS only_a, count(*) FILTER (x IS NULL) AS only_b
FROM a1 FULL JOIN b1 ON a1.read_id = b1.read_id AND a1.iteration = b1.iteration""",
)
def round_trip_check(spark, d):
    p = A.prob_rows(spark, d)
    one = lambda df: df.groupBy("read_id", "iteration").agg(F.max("probability").alias("probability"))
    b = p.filter("level <> 1").withColumn("probability", F.col("probability") + F.when(F.col("bucket_id") % 10 == 0, 0.5).otherwise(0.0))
    return E.round_trip(one(p.filter("level <> 0")), one(b), ["read_id", "iteration"], "probability")


@query("replicate_stats", f"WITH {A.CALLS_A} SELECT chrom, mapped, count(*) AS n, round(avg(mapq), 6) AS mean, round(coalesce(stddev_samp(mapq), 0), 6) AS sd FROM calls_a GROUP BY 1, 2")
def replicate_stats(spark, d):
    return E.replicates(A.calls_a(spark, d), ["chrom", "mapped"], "mapq").select("chrom", "mapped", "n", q("mean").alias("mean"), q("sd").alias("sd"))


@query(
    "variant_buckets",
    """SELECT l_suppkey % 7 AS contig, (l_orderkey * 3) // 100 AS bucket, count(*) FILTER (l_linenumber <= 4) AS n_snv, round(coalesce(max(CASE WHEN l_linenumber <= 4 THEN l_discount END), 0), 6) AS snv_max_af,
  count(*) FILTER (l_linenumber > 4) AS n_sv, round(coalesce(max(CASE WHEN l_linenumber > 4 THEN l_tax END), 0), 6) AS sv_max_af, coalesce(bit_or(CASE WHEN l_linenumber > 4 THEN (1 << (l_linenumber - 4)::INT) END), 0)::BIGINT AS sv_type_bits FROM lineitem GROUP BY 1, 2""",
)
def variant_buckets(spark, d):
    from ..operators.variants import prior_buckets

    li = table(spark, d, "lineitem")
    sv = F.col("l_linenumber") > 4
    v = li.select((F.col("l_suppkey") % 7).alias("contig"), (F.col("l_orderkey") * 3).alias("pos"), sv.alias("is_sv"), F.when(sv, F.col("l_tax")).otherwise(F.col("l_discount")).alias("af"), F.when(sv, F.expr("shiftleft(1L, cast(l_linenumber - 4 as int))")).alias("type_bit"))
    return prior_buckets(v, 100).select("contig", "bucket", "n_snv", q("snv_max_af").alias("snv_max_af"), "n_sv", q("sv_max_af").alias("sv_max_af"), "sv_type_bits")


@query(
    "variant_lookup",
    f"""WITH {A.POINTS}, b AS (SELECT l_suppkey % 7 AS contig, (l_orderkey * 3) // 100 AS bucket, count(*) FILTER (l_linenumber <= 4) AS n_snv, count(*) FILTER (l_linenumber > 4) AS n_sv FROM lineitem GROUP BY 1, 2)
SELECT read_id, hit, coalesce(n_snv, 0) AS n_snv, coalesce(n_sv, 0) AS n_sv FROM points p LEFT JOIN b ON contig = ref_id AND bucket = pos // 100""",
)
def variant_lookup(spark, d):
    from ..operators.variants import lookup, prior_buckets

    li = table(spark, d, "lineitem")
    sv = F.col("l_linenumber") > 4
    v = li.select((F.col("l_suppkey") % 7).alias("contig"), (F.col("l_orderkey") * 3).alias("pos"), sv.alias("is_sv"), F.col("l_tax").alias("af"), F.when(sv, F.lit(1).cast("long")).alias("type_bit"))
    p = A.points(spark, d).withColumnRenamed("ref_id", "contig")
    return lookup(p, prior_buckets(v, 100), 100).select("read_id", "hit", "n_snv", "n_sv")
