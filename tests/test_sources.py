"""Readers and writers: round trips and malformed input."""

import json
import os

from pyspark.sql import functions as F

from helixframe.sources import sequences as S
from helixframe.sources import tables as T


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_fasta(spark, tmp_path):
    p = write(f"{tmp_path}/a.fa", ">one desc >x\nACG\ntta \n>two\tmore\nNNN\n\n>three\n")
    got = {r.name: r.sequence for r in S.read_fasta(spark, p).collect()}
    assert got == {"one": "ACGTTA", "two": "NNN", "three": ""}
    assert {r.name for r in S.read_fasta(spark, p, skip_n_only=True).collect()} == {"one"}
    df = spark.createDataFrame([("x", "ACGT" * 50), ("y", "A")], "name string, sequence string")
    S.write_fasta(df, f"{tmp_path}/out")
    assert sorted(S.read_fasta(spark, f"{tmp_path}/out").collect()) == sorted(df.collect())
    assert max(len(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()) == 80


def test_fastq(spark, tmp_path):
    p = write(f"{tmp_path}/a.fq", "@r1 pos=3\nACGT\n+\n@III\n@r2\nac\n+x\nII\n@bad\nAC\n-\nII\n@r4\nNNNNN\n+\nIIIII\n")
    df = S.read_fastq(spark, p)
    assert {r.id: (r.sequence, r.quality) for r in df.collect()} == {"r1 pos=3": ("ACGT", "@III"), "r2": ("ac", "II"), "r4": ("NNNNN", "IIIII")}
    assert S.read_fastq(spark, p, min_length=3, max_length=4, uppercase=True).count() == 1
    s = S.fastq_stats(df).first()
    assert (s.records, s.bases, s.min_length, s.max_length) == (3, 11, 2, 5)
    assert df.filter(S.is_valid_fastq()).count() == 3
    S.write_fastq(df, f"{tmp_path}/out")
    assert sorted(S.read_fastq(spark, f"{tmp_path}/out").collect()) == sorted(df.collect())


def test_fastq_over_many_blocks(spark, tmp_path):
    text = "".join(f"@r{k}\n{'ACGT' * (k % 7 + 1)}\n+\n{'I@+I' * (k % 7 + 1)}\n" for k in range(3000))
    p = write(f"{tmp_path}/big.fq", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = {r.id: r.sequence for r in S.read_fastq(spark, p).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {f"r{k}": "ACGT" * (k % 7 + 1) for k in range(3000)}


def test_sam(spark, tmp_path):
    lines = ["@HD\tVN:1.6", "r1\t0\tchr1\t11\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:0\tXA:Z:b", "r2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII", "short\t0", "r1\t256\tchr2\t5\t0\t4M\t*\t0\t0\t*\t*"]
    p = write(f"{tmp_path}/a.sam", "\n".join(lines) + "\n")
    rows = T.read_sam(spark, p).collect()
    assert [(r.read_id, r.flag, r.pos, r.tags) for r in rows] == [("r1", 0, 10, "NM:i:0\tXA:Z:b"), ("r2", 4, -1, ""), ("r1", 256, 4, "")]
    assert {r.read_id: r.mapped for r in T.read_to_mapped(T.read_sam(spark, p)).collect()} == {"r1": True, "r2": False}
    tagged = [r.value for r in T.append_tags(spark.read.text(p), spark.createDataFrame([("r1", "ip:Z:P1")], "read_id string, tags string")).collect()]
    assert sorted(tagged) == sorted([lines[0], lines[1] + "\tip:Z:P1", *lines[2:]])
    header = T.sam_header(spark, spark.createDataFrame([("chr1", 500)], "name string, length long"), sample="s").orderBy("order").collect()
    assert [r.line[:3] for r in header] == ["@HD", "@SQ", "@RG", "@PG"]


def test_bed_and_vcf(spark, tmp_path):
    bed = write(f"{tmp_path}/t.bed", "#c\nchr1\t5\t9\tr1\t0\t+\tG\nchr1\t5\t9\nchr2\t1\t2\tr2\n")
    assert [(r.read_id, r.start, r.strand, r.gene) for r in T.read_bed(spark, bed).collect()] == [("r1", 5, "+", "G"), ("r2", 1, None, None)]
    psv = write(f"{tmp_path}/p.bed", "# x\nchr1 10 A P1:A,P2:C 0.7\nchr1\t20\tG\tP1:G\n")
    sites = T.read_psv_bed(spark, psv)
    assert sorted((r.psv_id, r.pos, r.paralog, r.allele, r.informativeness) for r in sites.collect()) == [(0, 10, "P1", "A", 0.7), (0, 10, "P2", "C", 0.7), (1, 20, "P1", "G", 1.0)]
    T.write_psv_bed(sites, f"{tmp_path}/out")
    assert sorted(r[1:] for r in T.read_psv_bed(spark, f"{tmp_path}/out").collect()) == sorted(r[1:] for r in sites.collect())
    vcf = write(f"{tmp_path}/v.vcf", "##h\nchr1\t11\t.\tA\tC\t.\tPASS\tDP=3;PSV=P1:A,P2:C\nchr1\t12\t.\tAT\tC\t.\t.\tPSV=P1:A\nchr1\t13\t.\tA\tC\t.\t.\tDP=1\n")
    assert sorted((r.pos, r.paralog, r.allele) for r in T.read_psv_vcf(spark, vcf).collect()) == [(10, "P1", "A"), (10, "P2", "C")]


def test_annotations_and_loci(spark, tmp_path):
    p = write(f"{tmp_path}/a.regann", "#h\nchr1\t0\t10\tr\ts\t2\ta=1,b=2\nchr1\t10\t20\tr\ts\tnope\t-\nchr1\t1\n")
    df = T.read_annotations(spark, p)
    assert [(r.start, r.layer, r.params) for r in df.collect()] == [(0, 2, {"a": "1", "b": "2"}), (10, 0, None)]
    T.write_annotations(df, f"{tmp_path}/out")
    assert sorted(map(str, T.read_annotations(spark, f"{tmp_path}/out").collect())) == sorted(map(str, df.collect()))
    write(f"{tmp_path}/loci/x/a.json", json.dumps({"name": "L", "coordinates": {"grch38": {"chr": "chr1", "start": 5, "end": 9}}}))
    write(f"{tmp_path}/loci/b.json", json.dumps({"name": "M", "coordinates": {"grch38": {"chr": "chr2:alt", "start": 5, "end": 9}}}))
    write(f"{tmp_path}/loci/c.json", json.dumps({"name": "N", "coordinates": {"grch38": {"chr": "chr1", "start": 9, "end": 9}}}))
    assert {r.name for r in T.read_loci(spark, f"{tmp_path}/loci").collect()} == {"L", "M"}
    assert {r.name for r in T.read_loci(spark, f"{tmp_path}/loci", "chr2").collect()} == {"M"}


def test_probability_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", "b1", 0.5, 0.25, 1, 3, True), ("a", "b2", 0.005, 0.0, 1, 3, False), ("c", "*", 0.0, 0.0, 0, 0, False)], T.PROBABILITIES)
    T.write_probabilities(df, f"{tmp_path}/p", min_probability=0.01)
    assert {(r.read_id, r.bucket_id) for r in T.read_probabilities(spark, f"{tmp_path}/p").collect()} == {("a", "b1"), ("c", "*")}
    q = T.read_probabilities(spark, f"{tmp_path}/p", min_probability=0.1, skip_unmapped=True)
    assert q.count() == 1 and "PushedFilters: [IsNotNull(probability)" in q._jdf.queryExecution().toString()
    T.write_probability_csv(df, f"{tmp_path}/c")
    assert sorted(map(str, T.read_probability_csv(spark, f"{tmp_path}/c").collect())) == sorted(map(str, df.collect()))


def test_small_tables(spark, tmp_path):
    m = spark.createDataFrame([("c,1", 'p"x', 0.5, 2, 0.1)], "cell string, paralog string, value double, read_count long, mean_confidence double")
    T.write_matrix(m, f"{tmp_path}/m")
    assert T.read_matrix(spark, f"{tmp_path}/m").collect() == m.collect()
    white = write(f"{tmp_path}/w.txt", "AAAA x\n\nCCCC\nAAAA\n")
    assert {r.barcode for r in T.read_whitelist(spark, white).collect()} == {"AAAA", "CCCC"}
    bm = write(f"{tmp_path}/b.tsv", "r1\tA\nr1\tB\nbad\n")
    assert [tuple(r) for r in T.read_barcode_map(spark, bm).collect()] == [("r1", "B")]
    assert {r.metric for r in T.qc_summary_rows(spark.createDataFrame([(1, 2.5)], "a long, b double")).collect()} == {"a", "b"}
    fa = write(f"{tmp_path}/x.fa", ">IGHG1_A_CH1 loc=chr14:10-50\nACG\nT\n>IGHG1_B_CH1\nACGT\n>OTHER_A_CH1\nA\n>IGHG1_A_Q\nAC\n")
    a = T.read_anchors(spark, fa, ("IGHG1",)).orderBy("copy").collect()
    assert [(r.copy, r.exon, r.anchor, r.contig, r.start) for r in a] == [("IGHG1_A", "CH1", "ACGT", "chr14", 10), ("IGHG1_B", "CH1", "ACGT", None, None)]
    d = spark.createDataFrame([("synth_3_CAN_10-90_G1",), ("other",)], "n string")
    t = T.truth_from_name(F.col("n"))
    assert [tuple(r) for r in d.select(*t.values()).collect()] == [("CAN", 10, 90, "G1"), (None, None, None, None)]
    assert spark.range(1).select(T.s3_to_https(F.lit("s3://b/k/x"))).first()[0] == "https://b.s3.amazonaws.com/k/x"


def test_cluster_table(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 0.5, True, 3, 100)], "read_id long, cluster_id long, confidence double, is_representative boolean, cluster_size long, read_length long")
    T.write_clusters(df, f"{tmp_path}/c")
    rows = {r.value for r in spark.read.text(f"{tmp_path}/c").collect()}
    assert rows == {"read_id\tcluster_id\tconfidence\tis_representative\tcluster_size\tread_length", "1\t2\t0.500000\t1\t3\t100"}


def test_file_drops_are_aligned_once(spark, tmp_path):
    from helixframe.streaming.counts import align_drops

    write(f"{tmp_path}/in/a.fa", ">1\nACGT\n>2\nGG\n")
    lengths = lambda reads: reads.select("read_id", F.length("seq").alias("n"))
    parse = lambda b: b.select(F.explode(F.split("value", ">")).alias("r")).filter("r <> ''").select(F.split("r", "\n")[0].cast("long").alias("read_id"), F.split("r", "\n")[1].alias("seq"))
    run = lambda: align_drops(spark, f"{tmp_path}/in", f"{tmp_path}/out", lengths, checkpoint=f"{tmp_path}/cp", read=parse).awaitTermination()
    run()
    write(f"{tmp_path}/in/b.fa", ">3\nA\n")
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 4), (2, 2), (3, 1)]
