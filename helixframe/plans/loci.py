"""Variants seen by alignments, exon anchors with mismatches, locus gates, and the alignment core against known truth."""

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import cigar as C
from ..functions import sequence as Q
from ..operators import align as L
from ..operators import annotation as N
from ..operators import evaluation as E
from ..operators import paralog as P
from ..operators import records as X
from ..operators import seeding as S
from ..operators import synthetic as Y
from ..runtime import cut, q, scratch, table
from ..sources import tables as T
from .base import query
from .calls import _CIGAR, _HITS, anchors, best, cigars, cigars_of


def s(c):
    return F.col(c).cast("string")


@query(
    "psv_sites_in_range",
    f"""WITH {A.INTERVALS}, sites AS (SELECT p_partkey AS psv_id, p_partkey % 7 AS ref_id, p_partkey * 25 AS pos FROM part)
SELECT interval_id, psv_id, pos FROM intervals i JOIN sites x ON i.ref_id = x.ref_id AND pos BETWEEN "start" AND "end\"""",
)
def psv_sites_in_range(spark, d):
    """Variant sites from a span's start to its end, both included."""
    k = F.col("p_partkey")
    sites = table(spark, d, "part").select(k.alias("psv_id"), (k % 7).alias("ref_id"), (k * 25).alias("pos"))
    return P.sites_in(A.intervals(spark, d), sites, on="ref_id").select("interval_id", "psv_id", "pos")


_SEQ = "translate(md5('a' || l_orderkey) || md5('b' || l_linenumber) || md5('c' || l_partkey), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query(
    "psv_observations",
    f"""WITH {_CIGAR.replace("FROM lineitem", "FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1)").replace("l_linenumber % 3 AS s", "l_linenumber % 3 AS s, l_suppkey % 5 AS chrom, " + _SEQ + " AS seq")}, h AS (SELECT * FROM cig),
b AS (SELECT read_id, hit, chrom, seq, ref_start + k AS ref_pos, s + k AS read_pos FROM h, unnest(range(m)) AS u(k) UNION ALL SELECT read_id, hit, chrom, seq, ref_start + m + k, s + m + i + k FROM h, unnest(range(e)) AS u(k)
  UNION ALL SELECT read_id, hit, chrom, seq, ref_start + m + e + dl + k, s + m + i + e + k FROM h, unnest(range(3)) AS u(k)),
o AS (SELECT read_id, hit, p_partkey AS psv_id, substr(seq, read_pos::INT + 1, 1) AS base, read_pos FROM b JOIN part ON p_partkey % 5 = chrom AND p_partkey = ref_pos)
SELECT read_id, hit, count(*) AS n, sum(read_pos * 7 + psv_id)::BIGINT AS checksum, count(*) FILTER (base = 'A') AS n_a, count(*) FILTER (base = 'G') AS n_g FROM o GROUP BY 1, 2""",
)
def psv_observations(spark, d):
    """The bases that alignments have at variant sites, by a walk along their CIGARs; told for each alignment.

    A line number may occur twice in an order; the line of the smallest part is the alignment then.
    """
    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity"))
    lines = table(spark, d, "lineitem").withColumn("_k", first).filter("_k = 1")
    hex_ = F.concat(*[F.md5(F.concat(F.lit(x), s(c)).cast("binary")) for x, c in (("a", "l_orderkey"), ("b", "l_linenumber"), ("c", "l_partkey"))])
    c = C.stats(cigars_of(lines, chrom=F.col("l_suppkey") % 5, seq=F.translate(hex_, "0123456789abcdef", "ACGTACGTACGTACGT")), "cigar")
    hits = c.select("read_id", "hit", "chrom", F.col("ref_start").alias("start"), (F.col("ref_start") + F.col("ref_length") - 1).alias("end"), "cigar", "seq")
    k = F.col("p_partkey")
    o = P.observations(hits, table(spark, d, "part").select(k.alias("psv_id"), (k % 5).alias("chrom"), k.alias("pos")))
    return o.groupBy("read_id", "hit").agg(F.count("*").alias("n"), F.sum(F.col("read_pos") * 7 + F.col("psv_id")).alias("checksum"), F.count_if(F.col("base") == "A").alias("n_a"), F.count_if(F.col("base") == "G").alias("n_g"))


@query(
    "psv_update",
    """WITH a AS (SELECT o_orderkey AS read_id, 'P' || k AS paralog, CASE k WHEN 0 THEN (o_custkey % 10) / 10e0 ELSE 1 - (o_custkey % 10) / 10e0 END AS p, o_custkey % 3 AS n FROM orders, range(2) AS t(k) WHERE o_orderkey % 2 = 0),
b AS (SELECT o_orderkey AS read_id, 'P' || k AS paralog, CASE k WHEN 0 THEN (o_orderkey % 7) / 7e0 ELSE 1 - (o_orderkey % 7) / 7e0 END AS p, o_orderkey % 4 AS n FROM orders, range(2) AS t(k) WHERE o_orderkey % 3 = 0),
j AS (SELECT a.read_id, a.paralog, CASE WHEN a.n > 0 AND b.n > 0 THEN a.p * b.p ELSE 0.5e0 * a.p + 0.5e0 * b.p END AS v FROM a JOIN b USING (read_id, paralog)),
m AS (SELECT read_id, paralog, CASE WHEN sum(v) OVER (PARTITION BY read_id) > 0 THEN v / sum(v) OVER (PARTITION BY read_id) ELSE 0 END AS p FROM j)
SELECT read_id, paralog, round(p, 6) + 0e0 AS p FROM m UNION ALL SELECT read_id, paralog, round(p, 6) + 0e0 FROM a WHERE read_id % 3 <> 0 UNION ALL SELECT read_id, paralog, round(p, 6) + 0e0 FROM b WHERE read_id % 2 <> 0""",
)
def psv_update(spark, d):
    """Records' calls after new observations: merged where there was a call, else taken or left as they are."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")

    def two(rows, x, n):
        each = rows.select(k.alias("read_id"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k"), x.alias("x"), n.alias("n_psvs"))
        return each.select("read_id", F.concat(F.lit("P"), s("k")).alias("paralog"), F.when(F.col("k") == 0, F.col("x")).otherwise(1 - F.col("x")).alias("p"), "n_psvs")

    called, new = two(o.filter(k % 2 == 0), F.col("o_custkey") % 10 / 10, F.col("o_custkey") % 3), two(o.filter(k % 3 == 0), k % 7 / 7, k % 4)
    return P.updated_calls(called, new).select("read_id", "paralog", q("p").alias("p"))


@query("allele_codes", """SELECT event_id, CASE b WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 WHEN '-' THEN 4 ELSE 5 END AS code, CASE WHEN b IN ('A', 'C', 'G', 'T', '-') THEN b ELSE 'N' END AS back FROM (SELECT event_id, upper(substr('ACgt-xN', 1 + (event_id % 7)::INT, 1)) AS b FROM events)""")
def allele_codes(spark, d):
    base = F.substring(F.lit("ACgt-xN"), (1 + F.col("event_id") % 7).cast("int"), F.lit(1))
    return table(spark, d, "events").select("event_id", P.allele_code(base).alias("code"), P.allele_of(P.allele_code(base)).alias("back"))


_MUTATED = f"""{A.REFS}, anchors AS (SELECT 'G' || (ref_id % 5) AS gene, 'G' || (ref_id % 5) || '_C' || ((ref_id // 5) % 4) AS copy, 'CH' || k AS exon,
  substr(seq, k * 40 + 1, 15) || translate(substr(seq, k * 40 + 16, 1), 'ACGT', 'CGTA') || substr(seq, k * 40 + 17, 16) AS anchor FROM refs, range(4) AS u(k) WHERE len(seq) >= k * 40 + 32)"""


@query(
    "igh_anchor_mismatch",
    f"""WITH {_MUTATED}, both_ AS (SELECT *, true AS forward FROM anchors UNION ALL SELECT gene, copy, exon, reverse(translate(anchor, 'ACGT', 'TGCA')), false FROM anchors), d AS (SELECT DISTINCT * FROM both_),
w AS (SELECT ref_id, substr(seq, p + 1, 32) AS w FROM refs, unnest(range(len(seq) - 31)) AS u(p) WHERE len(seq) >= 32)
SELECT DISTINCT ref_id AS read_id, gene, copy, exon, forward FROM w JOIN d ON hamming(w, anchor) <= 1""",
)
def igh_anchor_mismatch(spark, d):
    """Anchors with a changed base are found again within one mismatch, on either strand."""
    a = anchors(spark, d)
    changed = F.concat(F.substring("anchor", 1, 15), F.translate(F.substring("anchor", 16, 1), "ACGT", "CGTA"), F.substring("anchor", 17, 16))
    return P.anchor_hits_within(A.refs(spark, d).withColumnRenamed("ref_id", "read_id"), a.withColumn("anchor", changed), 1)


_GATE = """al AS (SELECT o_orderkey AS read_id, CASE o_orderkey % 5 WHEN 0 THEN 'chr14' WHEN 1 THEN 'hg#0#chr14' WHEN 2 THEN 'xchr14' WHEN 3 THEN 'IGHM' ELSE 'chr2' END AS target, o_orderkey * 10 AS "start", o_orderkey * 10 + 100 AS "end" FROM orders),
c AS (SELECT o_orderkey AS read_id, 'IGHG_C' || (o_custkey % 4) AS copy, 1 + o_custkey % 3 AS n_exons, o_orderkey % 6 = 0 AS ambiguous_gene FROM orders WHERE o_orderkey % 4 <> 0),
gated AS (SELECT al.*, copy, coalesce((target = 'IGHM' OR ((target = 'chr14' OR regexp_matches(target, '[#_.|/:]chr14$')) AND "start" >= 1000 AND "start" < 9000)) AND n_exons >= 2 AND NOT ambiguous_gene, false) AS ok
  FROM al LEFT JOIN c USING (read_id))"""


@query(
    "igh_resort_alignments",
    f"""WITH {_GATE} SELECT read_id, CASE WHEN ok THEN copy ELSE target END AS target, CASE WHEN ok AND copy <> 'IGHG_C3' THEN 500 + substr(copy, 7)::BIGINT ELSE "start" END AS "start",
  CASE WHEN ok AND copy <> 'IGHG_C3' THEN 900 + substr(copy, 7)::BIGINT ELSE "end" END AS "end", CASE WHEN ok THEN 1e0 END AS paralog_p, ok AS relabelled FROM gated""",
)
def igh_resort_alignments(spark, d):
    """Alignments in the locus or on its genes move to the place of their exon copy; a copy without a place keeps the coordinates."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    target = F.when(k % 5 == 0, "chr14").when(k % 5 == 1, "hg#0#chr14").when(k % 5 == 2, "xchr14").when(k % 5 == 3, "IGHM").otherwise("chr2")
    al = o.select(k.alias("read_id"), target.alias("target"), (k * 10).alias("start"), (k * 10 + 100).alias("end"))
    c = o.filter(k % 4 != 0).select(k.alias("read_id"), F.concat(F.lit("IGHG_C"), (F.col("o_custkey") % 4).cast("string")).alias("copy"), (1 + F.col("o_custkey") % 3).alias("n_exons"), (k % 6 == 0).alias("ambiguous_gene"))
    places = spark.range(3).select(F.concat(F.lit("IGHG_C"), s("id")).alias("copy"), (500 + F.col("id")).alias("start"), (900 + F.col("id")).alias("end"))
    return P.resort_alignments(al, c, places, locus=("chr14", 1000, 9000), genes=("IGHM",))


@query("igh_match_sink", f"WITH {_HITS} SELECT read_id, gene, copy, n_exons, CASE WHEN forward THEN '+' ELSE '-' END AS strand, ambiguous_gene::INT AS ambiguous_gene, ambiguous_copy::INT AS ambiguous_copy, tied_copies FROM best WHERE n_exons >= 1")
def igh_match_sink(spark, d):
    path = scratch(spark)
    T.write_matches(best(spark, d).filter("n_exons >= 1"), path)
    return spark.read.schema("read_id long, gene string, copy string, n_exons long, strand string, ambiguous_gene int, ambiguous_copy int, tied_copies string").option("sep", "\t").option("header", True).csv(path)


@query(
    "contig_suffix",
    """SELECT l_orderkey, l_linenumber, c = 'chr1' OR regexp_matches(c, '[#_.|/:]chr1$') AS in_locus, (c = 'chr1' OR regexp_matches(c, '[#_.|/:]chr1$')) AND l_partkey >= 50 AND l_partkey < 900 AS in_range
FROM (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 'chr1' WHEN 1 THEN 'hap' || ['#', '_', '.', '|', '/', ':', ''][1 + l_suppkey % 7] || 'chr1' WHEN 2 THEN 'chr11' ELSE 'chr1_alt' END AS c FROM lineitem)""",
)
def contig_suffix(spark, d):
    n = F.col("l_linenumber") % 4
    sep = F.element_at(F.array(*[F.lit(x) for x in ("#", "_", ".", "|", "/", ":", "")]), (1 + F.col("l_suppkey") % 7).cast("int"))
    c = F.when(n == 0, "chr1").when(n == 1, F.concat(F.lit("hap"), sep, F.lit("chr1"))).when(n == 2, "chr11").otherwise("chr1_alt")
    return table(spark, d, "lineitem").withColumn("c", c).select("l_orderkey", "l_linenumber", P.locus_matches(F.col("c"), "chr1").alias("in_locus"), P.in_locus(F.col("c"), F.col("l_partkey"), "chr1", 50, 900).alias("in_range"))


@query(
    "tags_merge",
    """WITH t AS (SELECT event_id, 'r' || event_id AS name, CASE WHEN event_id % 2 = 0 THEN 'c' || (user_id % 9) END AS cb1, CASE WHEN event_id % 3 = 0 THEN 'd' || (user_id % 5) END AS cb2, CASE WHEN event_id % 5 = 0 THEN 'U1' END AS ub, 'u' || (event_id % 4) AS ur FROM events)
SELECT event_id, coalesce(cb1, cb2) AS cb, coalesce(ub, ur) AS umi, concat_ws('_', name, coalesce(cb1, cb2), coalesce(ub, ur)) AS named FROM t""",
)
def tags_merge(spark, d):
    """Tags of two sources, the corrected ones first, and the read name that carries them."""
    e, k = table(spark, d, "events"), F.col("event_id")
    one = {"cb": F.when(k % 2 == 0, F.concat(F.lit("c"), (F.col("user_id") % 9).cast("string")))}
    two = {"cb": F.when(k % 3 == 0, F.concat(F.lit("d"), (F.col("user_id") % 5).cast("string"))), "ub": F.when(k % 5 == 0, "U1"), "ur": F.concat(F.lit("u"), (k % 4).cast("string"))}
    tags = X.merged_tags(one, two)
    umi = X.effective(tags["ub"], tags["ur"])
    return e.select("event_id", tags["cb"].alias("cb"), umi.alias("umi"), X.name_with_tags(F.concat(F.lit("r"), s("event_id")), tags["cb"], umi).alias("named"))


@query("nm_estimates", f"WITH {_CIGAR} SELECT read_id, hit, trunc((1 - round((m + e) / (m + e + 3 + i + dl)::DOUBLE, 6)) * (m + e + 3))::INT AS nm FROM cig")
def nm_estimates(spark, d):
    c = C.stats(cigars(spark, d), "cigar")
    return c.select("read_id", "hit", L.nm_estimate(F.round("identity", 6), F.col("aligned")).alias("nm"))


@query(
    "seed_join_limited",
    """WITH h AS (SELECT l_orderkey AS read_id, l_partkey AS ref_id, l_linenumber AS query_pos, l_suppkey AS ref_pos FROM lineitem)
SELECT q.k AS read_id, count(*) AS n FROM (SELECT o_orderkey AS k, o_custkey % 10 AS hash FROM orders) q JOIN (SELECT s_suppkey AS ref_id, s_suppkey % 10 AS hash FROM supplier) i USING (hash) GROUP BY 1 HAVING count(*) <= 0
UNION ALL SELECT o_orderkey, least(7, (SELECT count(*) FROM supplier WHERE s_suppkey % 10 = o_custkey % 10)) FROM orders WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 10 = o_custkey % 10)""",
)
def seed_join_limited(spark, d):
    """The limit is the feature: a read keeps its first seven hits."""
    queries = table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"), (F.col("o_custkey") % 10).alias("hash"), F.lit(0).alias("pos"), F.lit(True).alias("same_strand"))
    index = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ref_id"), (F.col("s_suppkey") % 10).alias("hash"), F.lit(5).alias("pos"), F.lit(True).alias("same_strand"))
    return S.seed_join(queries, index, key="hash", max_occ=None, max_hits=7).groupBy("read_id").agg(F.count("*").alias("n"))


# The alignment core. References are hex digits of MD5 as bases: random, and the same in both engines.

BLOCKS, LENGTH = 125, 200
_HEX = "translate({x}, '0123456789abcdef', 'ACGTACGTACGTACGT')"
_TRUTH = f"""g AS (SELECT s_suppkey AS ref_id, string_agg({_HEX.format(x="md5('g' || s_suppkey || '_' || b)")}, '' ORDER BY b) AS seq FROM supplier, range({BLOCKS}) AS t(b) WHERE s_suppkey < 20 GROUP BY 1),
truth AS (SELECT c_custkey AS read_id, c_custkey % (SELECT count(*) FROM g) AS ref_id, (c_custkey * 37) % {BLOCKS * 32 - LENGTH} AS "start", c_custkey % 2 = 1 AS is_reverse FROM customer)"""


def genomes(spark, d):
    """(ref_id, seq): up to twenty references of 4,000 bases."""
    refs = table(spark, d, "supplier").filter("s_suppkey < 20").select(F.col("s_suppkey").alias("ref_id"))
    each = lambda b: F.md5(F.concat(F.lit("g"), s("ref_id"), F.lit("_"), b.cast("string")).cast("binary"))
    return refs.select("ref_id", F.translate(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), each), ""), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))


def sampled_reads(spark, d):
    """(read_id, ref_id, start, is_reverse, seq): a read of every customer, with changed bases at 50 and 130, odd ones reversed."""
    g = genomes(spark, d)
    n, k = g.count(), F.col("c_custkey")
    t = table(spark, d, "customer").select(k.alias("read_id"), (k % n).alias("ref_id"), (k * 37 % (BLOCKS * 32 - LENGTH)).alias("start"), (k % 2 == 1).alias("is_reverse"))
    j = t.join(g, "ref_id").withColumn("w", F.substr("seq", (F.col("start") + 1).cast("int"), F.lit(LENGTH)))
    changed = lambda at: F.translate(F.substring("w", at + 1, 1), "ACGT", "CGTA")
    made = F.concat(F.substring("w", 1, 50), changed(50), F.substring("w", 52, 79), changed(130), F.substring("w", 132, LENGTH - 131))
    return j.select("read_id", "ref_id", "start", "is_reverse", F.when(F.col("is_reverse"), Q.reverse_complement(made)).otherwise(made).alias("seq"))


@query("align_truth", f"""WITH {_TRUTH} SELECT read_id, ref_id, "start", "start" + {LENGTH} AS "end", is_reverse, '50=1X79=1X69=' AS cigar, 0.99 AS identity, true AS sure FROM truth""")
def align_truth(spark, d):
    """Reads of known origin, seeded, chained, extended and scored: place, strand, CIGAR and quality are those of the truth."""
    a = L.align(sampled_reads(spark, d).select("read_id", "seq"), genomes(spark, d)).filter("is_primary")
    return a.select("read_id", "ref_id", "start", "end", "is_reverse", "cigar", q("identity").alias("identity"), (F.col("mapq") >= 40).alias("sure"))


@query("align_stats", f"""WITH {_TRUTH} SELECT count(*) AS reads, count(*) AS aligned_reads, 0.99 AS mean_identity, 1e0 AS mapping_rate, true AS all_chained, 0 AS n_low_identity FROM truth""")
def align_stats(spark, d):
    """Counters of the stages: every read has a chain, and none is filtered out."""
    reads, refs = sampled_reads(spark, d).select("read_id", "seq"), genomes(spark, d)
    # Each stage once, though both the counters and the alignments ask for it.
    found = cut(L.hits(reads, refs))
    chains = cut(L.chained(found))
    aligned = cut(L.extended(chains, reads, refs))
    counts = L.stage_counts(found, chains, aligned.filter("chain = 0"))
    totals = L.alignment_stats(L.passing(aligned), reads)
    j = totals.join(F.broadcast(counts))
    return j.select("reads", "aligned_reads", q("mean_identity").alias("mean_identity"), q("mapping_rate").alias("mapping_rate"), ((F.col("n_chains") >= F.col("reads")) & (F.col("n_hits") > F.col("n_chains"))).alias("all_chained"), F.col("n_low_identity").cast("int").alias("n_low_identity"))


_M64 = "18446744073709551616::HUGEINT"
_STEPS = f"""h0 AS (SELECT read_id, pos, fwd <= rev AS forward, least(fwd, rev)::HUGEINT AS x FROM codes),
h1 AS (SELECT read_id, pos, forward, xor((({_M64} - 1 - x) + (x << 21)) % {_M64}, {{seed}}::HUGEINT) AS x FROM h0),
h2 AS (SELECT read_id, pos, forward, xor(x, x >> 24) AS x FROM h1), h3 AS (SELECT read_id, pos, forward, (x + (x << 3) + (x << 8)) % {_M64} AS x FROM h2),
h4 AS (SELECT read_id, pos, forward, xor(x, x >> 14) AS x FROM h3), h5 AS (SELECT read_id, pos, forward, (x + (x << 2) + (x << 4)) % {_M64} AS x FROM h4),
h6 AS (SELECT read_id, pos, forward, xor(x, x >> 28) AS x FROM h5), hs AS (SELECT read_id, pos, forward, (x + (x << 31)) % {_M64} AS x FROM h6)"""


@query(
    "hashed_minimizer_index",
    f"""WITH {A.READS}, k AS (SELECT read_id, p AS pos, len(seq) - 15 AS last, translate(substr(seq, p + 1, 15), 'ACGT', '0123') AS f FROM reads, unnest(range(len(seq) - 14)) AS u(p) WHERE len(seq) >= 15),
codes AS (SELECT read_id, pos, list_sum([(ascii(f[i]) - 48)::BIGINT << (2 * (15 - i)) FOR i IN range(1, 16)])::BIGINT AS fwd, list_sum([(51 - ascii(f[i]))::BIGINT << (2 * (i - 1)) FOR i IN range(1, 16)])::BIGINT AS rev FROM k),
{_STEPS.format(seed=Q.HASH_SEED)}, w AS (SELECT read_id, pos, min({{'x': x, 'p': pos, 'f': forward}}) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m, max(pos) OVER (PARTITION BY read_id) AS last FROM hs),
e AS (SELECT read_id, m, lag(m.p) OVER (PARTITION BY read_id ORDER BY pos) AS before FROM w WHERE pos >= 9 OR pos = last)
SELECT read_id, count(*) AS n, sum(m.p)::BIGINT AS places, count(*) FILTER (m.f) AS n_forward, (bit_xor((m.x % 4294967296)::BIGINT))::BIGINT AS low_bits FROM e WHERE before IS NULL OR before <> m.p GROUP BY 1""",
)
def hashed_minimizer_index(spark, d):
    """Minimizers under the invertible 64-bit hash over whole reads, told for each read."""
    m = Q.hashed_minimizers(A.reads(spark, d), "read_id", "seq", k=15, w=10)
    return m.groupBy("read_id").agg(F.count("*").alias("n"), F.sum("pos").alias("places"), F.count_if("forward").alias("n_forward"), F.bit_xor(F.col("hash").bitwiseAND(F.lit(4294967295))).alias("low_bits"))


@query("rule_hints", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'rule' WHEN p_partkey % 3 = 1 THEN 'hint' END AS source, CASE WHEN p_partkey % 3 = 0 THEN 2e0 WHEN p_partkey % 3 = 1 THEN 1.5 ELSE 1e0 END AS weight FROM part""")
def rule_hints(spark, d):
    """Hints of region files below the rules: a rule wins where both say something."""
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    rules = p.filter(k % 3 == 0).select(k.alias("region"), F.lit(2.0).alias("weight"))
    hints = p.filter(k % 3 != 2).select(k.alias("region"), F.lit(1.5).alias("weight"))
    return N.overlay(p.select(k.alias("region")), rules, hints).select(F.col("region").alias("p_partkey"), "source", "weight")


@query("real_reads_accounted", f"WITH {A.CALLS_A}, {A.CALLS_B} SELECT (SELECT count(*) FROM calls_a) AS n_reads, (SELECT count(*) FROM calls_a) = (SELECT count(*) FROM calls_a WHERE mapped) + (SELECT count(*) FROM calls_a WHERE NOT mapped) AS complete, false AS complete_without_some")
def real_reads_accounted(spark, d):
    """Whether a mapper accounts for all input reads, and that it doesn't where calls are missing."""
    a, b = A.calls_a(spark, d), A.calls_b(spark, d)
    reads = a.select("read_id")
    full = E.real_validation(a, b, reads=reads).select("n_reads", "complete")
    less = E.real_validation(a.filter("read_id % 10 <> 0"), b, reads=reads).select(F.col("complete").alias("complete_without_some"))
    return full.join(F.broadcast(less))


def _h(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('_', {', '.join(parts)})), 1, 8))::BIGINT"


def _locus(c: Y.Locus, n: int) -> str:
    genes = "[" + ", ".join(f"'{g}'" for g in c.genes) + "]"
    a, b = c.same
    return f"""b0 AS MATERIALIZED (SELECT pos, substr('ACGT', ({_h("'base'", f"'{c.seed}'", "pos")} % 4 + 1)::INT, 1) AS base FROM range({c.length}) AS t(pos)),
ps AS MATERIALIZED (SELECT pos FROM b0 WHERE pos < {a} OR pos >= {b} ORDER BY {_h("'psv'", f"'{c.seed}'", "pos")}, pos LIMIT {c.n_psvs}),
bs AS MATERIALIZED (SELECT pos, base, CASE WHEN pos IN (SELECT pos FROM ps) THEN translate(base, 'ACGT', 'CGTA') ELSE base END AS dup_base, {genes}[least(pos // {c.length // len(c.genes)}, {len(c.genes) - 1}) + 1] AS gene, pos IN (SELECT pos FROM ps) AS is_psv FROM b0),
sq AS MATERIALIZED (SELECT string_agg(base, '' ORDER BY pos) AS can, string_agg(dup_base, '' ORDER BY pos) AS dup FROM bs),
r0 AS (SELECT i, greatest(100, least({c.length}, {c.read_length - c.spread} + {_h("'len'", f"'{c.seed}'", "i")} % {2 * c.spread + 1})) AS size FROM range({n}) AS t(i)),
r1 AS (SELECT i, size, {_h("'start'", f"'{c.seed}'", "i")} % ({c.length} - size + 1) AS s, {_h("'origin'", f"'{c.seed}'", "i")} < {int(c.share * 2**32)} AS d FROM r0),
rd AS MATERIALIZED (SELECT i AS read_id, CASE WHEN d THEN 'DUP' ELSE 'CAN' END AS origin, s AS "start", s + size AS "end", {genes}[least(s // {c.length // len(c.genes)}, {len(c.genes) - 1}) + 1] AS gene, substr(CASE WHEN d THEN dup ELSE can END, s::INT + 1, size::INT) AS seq FROM r1, sq)"""


_PLANTED = replace(Y.PRESETS["mosaic"], error=0.0)


@query("igh_locus_psvs", f"WITH {_locus(Y.PRESETS['identical_half'], 0)} SELECT pos, base, dup_base, gene FROM bs WHERE is_psv")
def igh_locus_psvs(spark, d):
    """The planted variants of a locus of which half is identical in both copies."""
    return Y.locus_bases(spark, Y.PRESETS["identical_half"]).filter("is_psv").drop("is_psv")


@query(
    "igh_synthetic_reads",
    f"""WITH {_locus(_PLANTED, _PLANTED.n_reads)} SELECT read_id, 'synth_' || read_id || '_' || origin || '_' || "start" || '-' || "end" || '_' || gene AS name, md5(seq) AS digest, (SELECT count(*) FROM ps WHERE pos >= "start" AND pos < "end") AS n_psvs FROM rd""",
)
def igh_synthetic_reads(spark, d):
    """Reads of a locus and its duplicate in equal parts, without errors, with the variants that each covers."""
    bases = cut(Y.locus_bases(spark, _PLANTED))
    reads = Y.locus_reads(spark, _PLANTED, bases)
    sites = bases.filter("is_psv").select(F.lit("locus").alias("chrom"), "pos")
    spans = reads.select("read_id", F.lit("locus").alias("chrom"), "start", (F.col("end") - 1).alias("end"))
    n = P.sites_in(spans, sites).groupBy("read_id").agg(F.count("*").alias("n_psvs"))
    return reads.join(n, "read_id", "left").select("read_id", "name", F.md5(F.col("seq").cast("binary")).alias("digest"), F.coalesce("n_psvs", F.lit(0)).alias("n_psvs"))


@query("igh_presets", "SELECT unnest(['canonical', 'mosaic', 'dup_5', 'dup_10', 'dup_30', 'dup_50', 'dup_100', 'identical_half', 'tiny']) AS preset, unnest([300, 300, 300, 300, 300, 300, 300, 300, 50])::BIGINT AS n_reads, true AS share_is_near, true AS truth_in_names")
def igh_presets(spark, d):
    """Every preset's reads, with errors: their number, the share of the duplicate, and truth that can be read from the names."""
    out = None
    for name, c in Y.PRESETS.items():
        reads = Y.locus_reads(spark, c, cut(Y.locus_bases(spark, c)))
        told = T.truth_from_name(F.col("name"))
        row = reads.agg(F.count("*").alias("n_reads"), F.avg(F.when(F.col("origin") == "DUP", 1.0).otherwise(0.0)).alias("_s"), F.bool_and((told["start"] == F.col("start")) & (told["end"] == F.col("end")) & (told["origin"] == F.col("origin")) & (told["gene"] == F.col("gene"))).alias("truth_in_names"))
        row = row.select(F.lit(name).alias("preset"), "n_reads", (F.abs(F.col("_s") - c.share) < 0.15).alias("share_is_near"), "truth_in_names")
        out = row if out is None else out.unionByName(row)
    return out


@query("paralog_families", "SELECT 'IGHG1' AS paralog, 50000 AS n, true AS near UNION ALL SELECT unnest(['IGHG2', 'IGHG3', 'IGHG4', 'IGHGP']), 50000, true UNION ALL SELECT unnest(['NPHP1', 'NPHP1B']), 80000, true UNION ALL SELECT unnest(['HLA-A', 'HLA-A-pseudo']), 30000, true")
def paralog_families(spark, d):
    """Members of the families against the first: as identical as the preset says."""
    out = None
    for name, (members, _, _, identity) in Y.FAMILIES.items():
        c = cut(Y.family_copies(spark, name))
        first = c.filter(F.col("paralog") == members[0]).select(F.col("seq").alias("_f"))
        share = 1 - Q.hamming(F.col("seq"), F.col("_f")) / F.length("seq")
        rows = c.join(F.broadcast(first)).select("paralog", F.length("seq").alias("n"), F.when(F.col("paralog") == members[0], share == 1).otherwise(F.abs(share - identity) < 0.01).alias("near"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("end_to_end_levels", "SELECT unnest(['minimal', 'standard']) AS level, unnest([10, 50])::BIGINT AS n_reads, true AS passed")
def end_to_end_levels(spark, d):
    """Generated, aligned and compared with the truth, at the two levels of seconds; the third takes minutes."""
    out = None
    for level in ("minimal", "standard"):
        row = cut(Y.end_to_end(spark, level).drop("accuracy"))
        out = row if out is None else out.unionByName(row)
    return out
