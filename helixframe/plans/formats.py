"""Every file format: tables are written to the shared folder, read back, and what was read is returned."""

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import graph as G
from ..operators import records as X
from ..operators import wave as W
from ..runtime import q, scratch, table
from ..sources import sequences as S
from ..sources import tables as T
from .base import query
from .graphs import _EDGES
from .graphs import edges as graph_edges
from .sequence import _kmers, ref_index


def _text(spark, df):
    """Lines (value) as a text file."""
    path = scratch(spark)
    df.write.text(path)
    return path


@query("fasta_round_trip", f"WITH {A.REFS} SELECT 'ref_' || ref_id AS name, len(seq) AS n, md5(seq) AS digest FROM refs")
def fasta_round_trip(spark, d):
    path = scratch(spark)
    S.write_fasta(A.refs(spark, d).select(F.concat(F.lit("ref_"), "ref_id", F.lit(" a described one")).alias("name"), F.lower("seq").alias("sequence")), path)
    return S.read_fasta(spark, path).select("name", F.length("sequence").cast("long").alias("n"), F.md5(F.col("sequence").cast("binary")).alias("digest"))


def _fastq(spark, d):
    """Reads with qualities; every tenth one's is a letter short."""
    r = A.reads(spark, d).filter("seq <> ''")
    n = F.length("seq") - F.when(F.col("read_id") % 10 == 0, 1).otherwise(0)
    return r.select(F.concat(F.lit("read/"), F.col("read_id").cast("string"), F.lit(" "), "lang").alias("id"), F.col("seq").alias("sequence"), F.repeat(F.lit("I"), n).alias("quality"))


_FASTQ = f"""{A.READS}, fq AS (SELECT 'read/' || read_id || ' ' || lang AS id, seq, repeat('I', (len(seq) - CASE WHEN read_id % 10 = 0 THEN 1 ELSE 0 END)::INT) AS quality FROM reads WHERE seq <> '' AND lang IS NOT NULL)"""


def _read_fastq(spark, d, compression=None, **kw):
    path = scratch(spark)
    S.write_fastq(_fastq(spark, d).filter("id is not null"), path, compression=compression)
    return S.read_fastq(spark, path, **kw)


@query("fastq_scan", f"WITH {_FASTQ} SELECT id, len(seq) AS n, md5(seq) AS digest, len(quality) AS q FROM fq")
def fastq_scan(spark, d):
    return _read_fastq(spark, d).select("id", F.length("sequence").cast("long").alias("n"), F.md5(F.col("sequence").cast("binary")).alias("digest"), F.length("quality").cast("long").alias("q"))


@query("fastq_gzip_length_filter", f"WITH {_FASTQ} SELECT id, len(seq) AS n FROM fq WHERE len(seq) BETWEEN 200 AND 3000")
def fastq_gzip_length_filter(spark, d):
    return _read_fastq(spark, d, "gzip", min_length=200, max_length=3000).select("id", F.length("sequence").cast("long").alias("n"))


@query("fastq_record_limit", f"WITH {_FASTQ} SELECT least(count(*), 25) AS n, true AS known FROM fq")
def fastq_record_limit(spark, d):
    """The limit is the feature: any 25 records, all of which are in the file."""
    some = _read_fastq(spark, d, max_records=25)
    return some.join(_fastq(spark, d).select("id", F.lit(True).alias("k")), "id", "left").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("k", F.lit(False))).alias("known"))


@query(
    "fastq_stats",
    f"""WITH {_FASTQ} SELECT count(*) AS records, sum(len(seq))::BIGINT AS bases, min(len(seq)) AS min_length, max(len(seq)) AS max_length, round(avg(len(seq)), 6) AS avg_length,
  count(*) FILTER (len(quality) <> len(seq)) AS invalid FROM fq""",
)
def fastq_stats(spark, d):
    s = S.fastq_stats(_read_fastq(spark, d))
    return s.select("records", "bases", F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"), q("avg_length").alias("avg_length"), "invalid")


@query("fastq_validate", f"WITH {_FASTQ} SELECT id, len(quality) = len(seq) AS valid FROM fq")
def fastq_validate(spark, d):
    return _read_fastq(spark, d).select("id", S.is_valid_fastq().alias("valid"))


@query("subsequences", f"WITH {A.REFS}, r AS (SELECT ref_id, seq, ref_id % 7 * 5 AS start, 20 + ref_id % 30 AS n FROM refs) SELECT ref_id, substr(seq, start + 1, n) AS part FROM r")
def subsequences(spark, d):
    r = A.refs(spark, d).withColumn("start", F.col("ref_id") % 7 * 5).withColumn("n", 20 + F.col("ref_id") % 30)
    return r.select("ref_id", F.substr("seq", (F.col("start") + 1).cast("int"), F.col("n").cast("int")).alias("part"))


@query("s3_urls", """SELECT p_partkey, 'https://' || CASE WHEN p_size % 2 = 0 THEN 'genomes.s3.amazonaws.com/' ELSE 'host/' END || p_partkey || '/a b.fa' AS url FROM part""")
def s3_urls(spark, d):
    p = table(spark, d, "part")
    raw = F.concat(F.when(F.col("p_size") % 2 == 0, "s3://genomes/").otherwise("https://host/"), F.col("p_partkey").cast("string"), F.lit("/a b.fa"))
    return p.select("p_partkey", T.s3_to_https(raw).alias("url"))


def _entries(spark, d):
    r = A.prob_rows(spark, d)
    bucket = F.when(F.col("bucket_id") % 11 == 0, "*").otherwise(F.concat(F.lit("b"), F.col("bucket_id").cast("string")))
    return r.select(
        F.concat(F.lit("r"), F.col("read_id").cast("string")).alias("read_id"), bucket.alias("bucket_id"), F.col("probability").cast("float"), F.col("confidence").cast("float"), F.col("level").cast("short"), F.col("iteration").cast("long"), "is_collapsed"
    )


_ENTRIES = f"""{A.PROB_ROWS}, entries AS (SELECT 'r' || read_id AS read_id, CASE WHEN bucket_id % 11 = 0 THEN '*' ELSE 'b' || bucket_id END AS bucket_id,
  probability::FLOAT AS probability, confidence::FLOAT AS confidence, level, iteration::BIGINT AS iteration, is_collapsed FROM prob_rows)"""


@query(
    "prob_parquet_round_trip",
    f"""WITH {_ENTRIES} SELECT read_id, bucket_id, round(probability::DOUBLE, 6) AS probability, round(confidence::DOUBLE, 6) AS confidence, level, iteration, is_collapsed FROM entries
WHERE bucket_id <> '*' AND probability >= 0.5""",
)
def prob_parquet_round_trip(spark, d):
    path = scratch(spark)
    T.write_probabilities(_entries(spark, d), path, min_probability=0.25)
    r = T.read_probabilities(spark, path, min_probability=0.5, skip_unmapped=True)
    return r.withColumns({"probability": q("probability"), "confidence": q("confidence"), "level": F.col("level").cast("int")})


@query("prob_write_filter", f"WITH {_ENTRIES} SELECT read_id, bucket_id, iteration FROM entries WHERE probability >= 0.25 OR bucket_id = '*'")
def prob_write_filter(spark, d):
    path = scratch(spark)
    T.write_probabilities(_entries(spark, d), path, min_probability=0.25)
    return T.read_probabilities(spark, path).select("read_id", "bucket_id", "iteration")


@query(
    "prob_csv_round_trip",
    f"""WITH {_ENTRIES} SELECT read_id, bucket_id, round(probability::DOUBLE, 5) AS probability, round(confidence::DOUBLE, 5) AS confidence, level, iteration, is_collapsed FROM entries""",
)
def prob_csv_round_trip(spark, d):
    path = scratch(spark)
    T.write_probability_csv(_entries(spark, d), path)
    r = T.read_probability_csv(spark, path)
    return r.withColumns({"probability": q("probability", 5), "confidence": q("confidence", 5), "level": F.col("level").cast("int")})


@query(
    "sam_header",
    f"""WITH {A.REFS} SELECT 1 AS "order", '@SQ' || chr(9) || 'SN:ref_' || ref_id || chr(9) || 'LN:' || len(seq) AS line FROM refs
UNION ALL SELECT 0, '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:unknown' UNION ALL SELECT 2, '@RG' || chr(9) || 'ID:s1' || chr(9) || 'SM:s1' UNION ALL SELECT 3, '@PG' || chr(9) || 'ID:helixframe' || chr(9) || 'PN:helixframe'""",
)
def sam_header(spark, d):
    refs = A.refs(spark, d).select(F.concat(F.lit("ref_"), F.col("ref_id").cast("string")).alias("name"), F.length("seq").alias("length"))
    return T.sam_header(spark, refs, sample="s1")


def _sam(spark, d):
    """SAM lines of one mapper's calls: every third is unmapped, every seventh secondary."""
    c = A.calls_a(spark, d)
    flag = F.when(F.col("read_id") % 3 == 0, 4).when(F.col("read_id") % 7 == 0, 256).otherwise(0)
    tags = F.when(F.col("read_id") % 2 == 0, F.concat(F.lit("CB:Z:c"), (F.col("read_id") % 10).cast("string"), F.lit("\tNM:i:1")))
    return X.sam_lines(c.select(F.concat(F.lit("r"), F.col("read_id").cast("string")).alias("read_id"), flag.alias("flag"), F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("target"), "pos", "mapq", F.lit("10M").alias("cigar"), F.lit("ACGTACGTAC").alias("seq"), tags.alias("tags")))


_SAM = f"""{A.CALLS_A}, sam AS (SELECT 'r' || read_id AS read_id, CASE WHEN read_id % 3 = 0 THEN 4 WHEN read_id % 7 = 0 THEN 256 ELSE 0 END AS flag, 'chr' || chrom AS target, pos, mapq,
  CASE WHEN read_id % 2 = 0 THEN 'CB:Z:c' || (read_id % 10) || chr(9) || 'NM:i:1' END AS tags, read_id AS k FROM calls_a)"""


@query("sam_scan", f"WITH {_SAM} SELECT read_id, flag, target, pos, mapq, CASE WHEN tags IS NOT NULL THEN 'c' || (k % 10) END AS cell FROM sam")
def sam_scan(spark, d):
    """Written and read SAM records with a tag out of the auxiliary fields."""
    path = _text(spark, _sam(spark, d).select(F.col("line").alias("value")))
    return T.read_sam(spark, path).select("read_id", "flag", "target", "pos", "mapq", X.tag(F.col("tags"), "CB").alias("cell"))


@query("mapped_reads", f"WITH {_SAM} SELECT read_id, bool_or(flag & 4 = 0) AS mapped FROM sam GROUP BY 1")
def mapped_reads(spark, d):
    path = _text(spark, _sam(spark, d).select(F.col("line").alias("value")))
    return T.read_to_mapped(T.read_sam(spark, path))


@query(
    "sam_tag_append",
    f"""WITH {_SAM} SELECT concat_ws(chr(9), read_id, flag, target, pos + 1, mapq, '10M', '*', '0', '0', 'ACGTACGTAC', '*', tags, CASE WHEN flag = 0 AND k % 5 = 0 THEN 'UB:Z:u' || (k % 4) END) AS value FROM sam
UNION ALL SELECT '@HD' || chr(9) || 'VN:1.6' """,
)
def sam_tag_append(spark, d):
    """Headers, unmapped and secondary lines pass through; primary ones get the tags of their read."""
    lines = _sam(spark, d).select(F.col("line").alias("value")).unionByName(spark.range(1).select(F.lit("@HD\tVN:1.6").alias("value")))
    k = F.col("read_id")
    tags = A.calls_a(spark, d).filter(k % 5 == 0).select(F.concat(F.lit("r"), k.cast("string")).alias("read_id"), F.concat(F.lit("UB:Z:u"), (k % 4).cast("string")).alias("tags"))
    return T.append_tags(lines, tags)


@query("bed_truth", f"""WITH {A.POINTS} SELECT 'chr' || ref_id AS chrom, pos AS "start", pos + 100 AS "end", 'r' || read_id AS read_id, CASE WHEN hit % 2 = 0 THEN hit::VARCHAR END AS score, CASE WHEN hit % 2 = 0 THEN '+' END AS strand, CASE WHEN hit % 2 = 0 THEN 'G' || hit END AS gene FROM points""")
def bed_truth(spark, d):
    p = A.points(spark, d)
    even = F.col("hit") % 2 == 0
    s = lambda c: F.col(c).cast("string")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), s("ref_id")), s("pos"), (F.col("pos") + 100).cast("string"), F.concat(F.lit("r"), s("read_id")), F.when(even, s("hit")), F.when(even, "+"), F.when(even, F.concat(F.lit("G"), s("hit"))))
    comment = spark.createDataFrame([("# a comment",), ("chr1\t5",)], "value string")
    return T.read_bed(spark, _text(spark, p.select(line.alias("value")).unionByName(comment)))


def _sites(spark, d):
    s = A.psv_sites(spark, d)
    return s.select("psv_id", F.concat(F.lit("chr"), (F.col("psv_id") % 3).cast("string")).alias("chrom"), (F.col("psv_id") * 25).alias("pos"), F.lit("A").alias("ref"), "paralog", "allele", (F.col("psv_id") % 4 / 4 + 0.25).alias("informativeness"))


@query("psv_bed_round_trip", f"WITH {A.PSV_SITES} SELECT 'chr' || (psv_id % 3) AS chrom, psv_id * 25 AS pos, 'A' AS ref, paralog, allele, round((psv_id % 4) / 4e0 + 0.25e0, 6) AS informativeness FROM psv_sites")
def psv_bed_round_trip(spark, d):
    path = scratch(spark)
    T.write_psv_bed(_sites(spark, d), path)
    return T.read_psv_bed(spark, path).select("chrom", "pos", "ref", "paralog", "allele", q("informativeness").alias("informativeness"))


@query("psv_vcf_scan", f"WITH {A.PSV_SITES} SELECT 'chr' || (psv_id % 3) AS chrom, psv_id * 25 AS pos, 'A' AS ref, 'C' AS alt, paralog, allele FROM psv_sites WHERE psv_id % 6 <> 0")
def psv_vcf_scan(spark, d):
    """Single-base variants with PSV alleles; every sixth is an insertion and left out."""
    pairs = F.array_join(F.array_sort(F.collect_list(F.concat("paralog", F.lit(":"), "allele"))), ",")
    g = _sites(spark, d).groupBy("psv_id", "chrom", "pos").agg(pairs.alias("a"))
    alt = F.when(F.col("psv_id") % 6 == 0, "CC").otherwise("C")
    line = F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), F.lit("."), F.lit("A"), alt, F.lit("."), F.lit("PASS"), F.concat(F.lit("DP=3;PSV="), "a", F.lit(";X=1")))
    head = spark.createDataFrame([("##fileformat=VCFv4.2",), ("chr1\t7\t.\tA\tC\t.\tPASS\tDP=1",)], "value string")
    return T.read_psv_vcf(spark, _text(spark, g.select(line.alias("value")).unionByName(head)))


@query(
    "annotation_round_trip",
    f"""WITH {A.INTERVALS} SELECT 'chr' || ref_id AS ref_name, "start", "end", 'reg' || interval_id AS region_name, 'src' AS source, layer, CASE WHEN lambda_scale IS NOT NULL THEN '1.5' END AS lambda_scale FROM intervals""",
)
def annotation_round_trip(spark, d):
    i = A.intervals(spark, d)
    params = F.when(F.col("lambda_scale").isNotNull(), F.create_map(F.lit("lambda"), F.col("lambda_scale").cast("string"), F.lit("mode"), F.lit("x")))
    rows = i.select(F.concat(F.lit("chr"), F.col("ref_id").cast("string")).alias("ref_name"), "start", "end", F.concat(F.lit("reg"), F.col("interval_id").cast("string")).alias("region_name"), F.lit("src").alias("source"), "layer", params.alias("params"))
    path = scratch(spark)
    T.write_annotations(rows, path)
    return T.read_annotations(spark, path).withColumn("lambda_scale", F.try_element_at("params", F.lit("lambda"))).drop("params")


@query(
    "annotation_layers",
    f"""WITH {A.INTERVALS} SELECT ref_id, "start", layer, lambda_scale, NULL::DOUBLE AS weight_scale FROM intervals WHERE layer < 3
UNION ALL SELECT ref_id, "start", layer, NULL, weight_scale FROM intervals WHERE layer >= 3""",
)
def annotation_layers(spark, d):
    i = A.intervals(spark, d)
    return T.concat_layers(i.filter("layer < 3").select("ref_id", "start", "layer", "lambda_scale"), i.filter("layer >= 3").select("ref_id", "start", "layer", "weight_scale"))


@query("loci_json", """SELECT p_name || p_partkey AS name, 'chr' || (p_size % 3) AS ref_name, p_partkey * 10 AS "start", p_partkey * 10 + p_size AS "end", 2 AS layer FROM part WHERE p_size % 3 = 1 AND p_partkey % 4 <> 0""")
def loci_json(spark, d):
    """Loci of one contig from JSON files; those without coordinates of the assembly are left out."""
    p = table(spark, d, "part")
    where = F.when(F.col("p_partkey") % 4 != 0, F.struct(F.struct(F.concat(F.lit("chr"), (F.col("p_size") % 3).cast("string")).alias("chr"), (F.col("p_partkey") * 10).alias("start"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("end")).alias("grch38")))
    path = scratch(spark)
    # A file a locus in the field; here a task writes an array into each of its files.
    rows = p.select(F.struct(F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), where.alias("coordinates")).alias("x"), (F.col("p_partkey") % 8).alias("f"))
    rows.groupBy("f").agg(F.to_json(F.collect_list("x")).alias("value")).write.partitionBy("f").text(path)
    return T.read_loci(spark, path, "chr1", glob="part-*")


@query(
    "anchor_fasta",
    """SELECT 'IGHG' AS gene, 'IGHG_' || p_size AS copy, 'CH' || (p_partkey % 4 + 1) AS exon, repeat('ACGT', 10) || repeat('C', p_size) AS anchor, 'chr14' AS contig, min(p_size * 10)::BIGINT AS "start", min(p_size * 10 + 50)::BIGINT AS "end" FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL""",
)
def anchor_fasta(spark, d):
    """Exon anchors; other genes are left out, equal sequences of a copy's exon are one."""
    p = table(spark, d, "part")
    s = lambda c: c.cast("string")
    gene = F.when(F.col("p_partkey") % 3 != 0, "IGHG").otherwise("ACTB")
    size = F.col("p_size")
    name = F.concat(gene, F.lit("_"), s(size), F.lit("_CH"), s(F.col("p_partkey") % 4 + 1), F.lit(" loc=chr14:"), s(size * 10), F.lit("-"), s(size * 10 + 50))
    path = scratch(spark)
    S.write_fasta(p.select(name.alias("name"), F.concat(F.repeat(F.lit("ACGT"), F.lit(10)), F.repeat(F.lit("C"), size)).alias("sequence")), path, width=30)
    return T.read_anchors(spark, path, ("IGHG",))


@query("whitelist_scan", "SELECT DISTINCT 'BC' || (user_id % 40) AS barcode FROM events")
def whitelist_scan(spark, d):
    return T.read_whitelist(spark, _text(spark, table(spark, d, "events").select(F.concat(F.lit(" BC"), (F.col("user_id") % 40).cast("string"), F.lit(" count 1")).alias("value"))))


@query("barcode_map_scan", "SELECT 'e' || event_id AS read_id, 'BC' || user_id AS barcode FROM events WHERE event_id % 3 <> 0")
def barcode_map_scan(spark, d):
    e = table(spark, d, "events")
    s = lambda c: F.col(c).cast("string")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("e"), s("event_id"))).otherwise(F.concat(F.lit("e"), s("event_id"), F.lit("\tBC"), s("user_id")))
    return T.read_barcode_map(spark, _text(spark, e.select(line.alias("value"))))


@query("cluster_tsv", f"WITH {A.CALLS_A} SELECT read_id, chrom AS cluster_id, round(mapq / 61e0, 6) AS confidence, read_id % 9 = 0 AS is_representative FROM calls_a")
def cluster_tsv(spark, d):
    path = scratch(spark)
    c = A.calls_a(spark, d).select("read_id", F.col("chrom").alias("cluster_id"), (F.col("mapq") / 61).alias("confidence"), (F.col("read_id") % 9 == 0).alias("is_representative"), F.lit(1).alias("cluster_size"), F.lit(10).alias("read_length"))
    T.write_clusters(c, path)
    back = spark.read.schema("read_id long, cluster_id long, confidence double, is_representative int, cluster_size long, read_length long").option("sep", "\t").option("header", True).csv(path)
    return back.select("read_id", "cluster_id", q("confidence").alias("confidence"), (F.col("is_representative") == 1).alias("is_representative"))


_MEAN = f"{A.CELLS}, m AS (SELECT cell, paralog, avg(prob) AS value, count(*) AS read_count, avg(conf) AS mean_confidence FROM cells GROUP BY 1, 2)"


def _matrix(spark, d):
    return A.cells(spark, d).groupBy("cell", "paralog").agg(F.avg("prob").alias("value"), F.count("*").alias("read_count"), F.avg("conf").alias("mean_confidence"))


@query("matrix_round_trip", f"WITH {_MEAN} SELECT 'c,\"' || cell AS cell, paralog, round(value, 6) AS value, read_count, round(mean_confidence, 6) AS mean_confidence FROM m")
def matrix_round_trip(spark, d):
    """Sparse triples as TSV; names with separators and quotes come back as they were."""
    path = scratch(spark)
    T.write_matrix(_matrix(spark, d).withColumn("cell", F.concat(F.lit('c,"'), F.col("cell").cast("string"))), path, sep="\t")
    return T.read_matrix(spark, path, sep="\t").withColumns({"value": q("value"), "mean_confidence": q("mean_confidence")})


@query("matrix_dense_sink", f"WITH {_MEAN}, p AS (SELECT DISTINCT paralog FROM m), c AS (SELECT DISTINCT cell FROM m) SELECT c.cell, p.paralog, round(coalesce(value, 0), 6) AS value FROM c CROSS JOIN p LEFT JOIN m USING (cell, paralog)")
def matrix_dense_sink(spark, d):
    path = scratch(spark)
    T.write_dense_matrix(_matrix(spark, d), path)
    back = spark.read.option("header", True).csv(path)
    names = [c for c in back.columns if c != "cell"]
    return back.select(F.col("cell").cast("long").alias("cell"), F.explode(F.array(*[F.struct(F.lit(n).alias("paralog"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("cell", "x.paralog", q("x.value").alias("value"))


@query(
    "qc_sinks",
    f"""WITH {_MEAN}, s AS (SELECT count(*)::DOUBLE AS entries, sum(read_count)::DOUBLE AS reads, avg(value) AS mean_value FROM m)
SELECT 'entries' AS metric, round(entries, 6) AS value FROM s UNION ALL SELECT 'reads', round(reads, 6) FROM s UNION ALL SELECT 'mean_value', round(mean_value, 6) FROM s""",
)
def qc_sinks(spark, d):
    """The summary as metric rows in a TSV."""
    s = _matrix(spark, d).agg(F.count("*").alias("entries"), F.sum("read_count").alias("reads"), F.avg("value").alias("mean_value"))
    path = scratch(spark)
    T.write_matrix(T.qc_summary_rows(s), path, sep="\t")
    return spark.read.schema("metric string, value double").option("sep", "\t").option("header", True).csv(path).withColumn("value", q("value"))


@query("qc_json", f"WITH {_MEAN} SELECT cell, count(*) AS n_paralogs, sum(read_count)::BIGINT AS n_reads, round(max(value), 6) AS top, CASE WHEN count(*) > 4 THEN 'full' END AS note FROM m GROUP BY 1")
def qc_json(spark, d):
    """Cells' figures as JSON objects, nulls included, and the cells table as TSV."""
    c = _matrix(spark, d).groupBy("cell").agg(F.count("*").alias("n_paralogs"), F.sum("read_count").alias("n_reads"), F.max("value").alias("top"), F.when(F.count("*") > 4, "full").alias("note"))
    path, tsv = scratch(spark), scratch(spark)
    T.write_json(c, path)
    T.write_matrix(c.select("cell", "n_paralogs"), tsv, sep="\t")
    text = spark.read.text(path)
    back = text.filter(F.contains("value", F.lit('"note":'))).select(F.from_json("value", "cell long, n_paralogs long, n_reads long, top double, note string").alias("x")).select("x.*")
    cells = spark.read.schema("cell long, n_paralogs long").option("sep", "\t").option("header", True).csv(tsv)
    return back.drop("n_paralogs").join(cells, "cell").withColumn("top", q("top"))


@query("index_persistence", f"WITH {A.REFS}, {_kmers('refs', 'ref_id', 'm')} SELECT kmer, count(*) AS n, min(pos)::INT AS first_pos FROM m GROUP BY 1")
def index_persistence(spark, d):
    path = scratch(spark)
    T.save(ref_index(spark, d), path, by="kmer")
    return spark.read.parquet(path).groupBy("kmer").agg(F.count("*").alias("n"), F.min("pos").cast("int").alias("first_pos"))


_TILES = """t AS (SELECT p_partkey AS ref_id, p_size * 100000 AS length FROM part WHERE p_partkey % 7 = 0),
tiles AS (SELECT 2 AS level, ref_id, s AS "start", least(s + 50000, length)::BIGINT AS "end" FROM t, range(0, length::BIGINT, 50000) AS r(s))"""


@query("pyramid_persistence", f"""WITH {_TILES} SELECT ref_id, count(*) AS n, max("end") AS last FROM tiles GROUP BY 1""")
def pyramid_persistence(spark, d):
    t = table(spark, d, "part").filter("p_partkey % 7 = 0").select(F.col("p_partkey").alias("ref_id"), (F.col("p_size") * 100000).cast("long").alias("length"))
    path = scratch(spark)
    T.save(W.pyramid_tiles(t), path, by="bucket_id")
    return spark.read.parquet(path).filter("level = 2").groupBy("ref_id").agg(F.count("*").alias("n"), F.max("end").alias("last"))


@query("edge_list_export", f"WITH {_EDGES} SELECT src, dst, round(weight, 6) AS weight FROM edges")
def edge_list_export(spark, d):
    path = scratch(spark)
    T.write_edges(graph_edges(spark, d), path)
    return T.read_edges(spark, path).withColumn("weight", q("weight"))


@query("graph_persistence", f"WITH {_EDGES} SELECT src, count(*) AS degree, round(sum(weight), 6) AS strength FROM edges GROUP BY 1")
def graph_persistence(spark, d):
    path = scratch(spark)
    T.save(graph_edges(spark, d), path, by="src")
    g = G.degrees(spark.read.parquet(path))
    return g.select(F.col("node").alias("src"), "degree", q("strength").alias("strength"))


@query("truth_names", """SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber % 3 <> 0 THEN CASE WHEN l_quantity > 25 THEN 'DUP' ELSE 'CAN' END END AS origin, CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey END AS "start", CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey + 150 END AS "end", CASE WHEN l_linenumber % 3 <> 0 THEN 'GENE_' || l_suppkey END AS gene FROM lineitem""")
def truth_names(spark, d):
    """Truth out of read names; names of another form have none."""
    l = table(spark, d, "lineitem")
    s = lambda c: F.col(c).cast("string")
    origin = F.when(F.col("l_quantity") > 25, "DUP").otherwise("CAN")
    name = F.concat(F.when(F.col("l_linenumber") % 3 != 0, "synth_").otherwise("real_"), s("l_orderkey"), F.lit("_"), origin, F.lit("_"), s("l_partkey"), F.lit("-"), (F.col("l_partkey") + 150).cast("string"), F.lit("_GENE_"), s("l_suppkey"))
    return l.withColumn("name", name).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), *[c.alias(n) for n, c in T.truth_from_name(F.col("name")).items()])


@query("sc_matrix_filters_sink", f"WITH {A.CELLS}, m AS (SELECT cell, paralog, avg(prob) AS value, count(*) AS n FROM cells GROUP BY 1, 2) SELECT paralog, count(*) AS cells, round(sum(value), 6) AS total FROM m GROUP BY 1")
def sc_matrix_filters_sink(spark, d):
    """A stored matrix is aggregated from its file: only the columns asked for are read."""
    path = scratch(spark)
    T.save(_matrix(spark, d), path, by="paralog")
    return spark.read.parquet(path).groupBy("paralog").agg(F.count("*").alias("cells"), F.sum("value").alias("total")).withColumn("total", q("total"))
