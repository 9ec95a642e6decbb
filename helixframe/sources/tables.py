"""SAM, BED, VCF, annotation, probability and matrix tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAM_COLUMNS = ("read_id", "flag", "target", "pos", "mapq", "cigar", "mate", "mate_pos", "template", "seq", "quality")
PROBABILITIES = "read_id string, bucket_id string, probability float, confidence float, level short, iteration long, is_collapsed boolean"


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records with typed core columns, 0-based positions and ``tags`` as the remaining fields; headers are left out."""
    parts = F.split("value", "\t")
    raw = spark.read.text(path).filter(~F.startswith("value", F.lit("@")) & (F.size(parts) >= 11)).select(parts.alias("p"), "value")
    cols = [F.element_at("p", k + 1).alias(c) for k, c in enumerate(SAM_COLUMNS)]
    df = raw.select(*cols, F.array_join(F.slice("p", F.lit(12), F.size("p")), "\t").alias("tags"))
    return df.withColumns({"flag": F.col("flag").cast("int"), "pos": F.col("pos").cast("long") - 1, "mapq": F.col("mapq").cast("int"), "mate_pos": F.col("mate_pos").cast("long"), "template": F.col("template").cast("long")})


def sam_header(spark: SparkSession, refs: DataFrame, *, program: str = "helixframe", sample: str | None = None) -> DataFrame:
    """(order, line): @HD, @SQ for each (name, length), @RG and @PG."""
    sq = refs.select(F.lit(1).alias("order"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("length").cast("string")).alias("line"))
    fixed = [(0, "@HD\tVN:1.6\tSO:unknown"), (3, f"@PG\tID:{program}\tPN:{program}")] + ([(2, f"@RG\tID:{sample}\tSM:{sample}")] if sample else [])
    return sq.unionByName(spark.createDataFrame(fixed, "order int, line string"))


def read_to_mapped(sam: DataFrame) -> DataFrame:
    return sam.groupBy("read_id").agg(F.max(F.col("flag").bitwiseAND(F.lit(4)) == 0).alias("mapped"))


def append_tags(sam_lines: DataFrame, tags: DataFrame) -> DataFrame:
    """Lines (value) with ``tags`` (read_id, tags) appended; headers, short, unmapped and non-primary lines pass through."""
    p = F.split("value", "\t")
    flag = F.try_element_at(p, F.lit(2)).try_cast("int")
    plain = F.startswith("value", F.lit("@")) | (F.size(p) < 11) | (F.coalesce(flag, F.lit(4)).bitwiseAND(F.lit(0x904)) != 0)
    j = sam_lines.withColumn("_id", F.when(~plain, p[0])).join(tags.withColumnRenamed("read_id", "_id"), "_id", "left")
    return j.select(F.when(F.col("tags").isNull(), F.col("value")).otherwise(F.concat_ws("\t", "value", "tags")).alias("value"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, read_id, score, strand, gene); comments and lines of fewer than four fields are left out."""
    p = F.split("value", "\t")
    at = lambda k: F.try_element_at(p, F.lit(k))
    raw = spark.read.text(path).filter(~F.startswith("value", F.lit("#")) & (F.size(p) >= 4))
    return raw.select(at(1).alias("chrom"), at(2).cast("long").alias("start"), at(3).cast("long").alias("end"), at(4).alias("read_id"), at(5).alias("score"), at(6).alias("strand"), at(7).alias("gene"))


def _alleles(text):
    return F.explode(F.filter(F.transform(F.split(text, ","), lambda x: F.struct(F.substring_index(x, ":", 1).alias("paralog"), F.substring_index(x, ":", -1).alias("allele"))), lambda s: s["paralog"] != s["allele"]))


def read_psv_bed(spark: SparkSession, path: str) -> DataFrame:
    """(psv_id, chrom, pos, ref, paralog, allele, informativeness), numbered in the order of the lines of each file."""
    p = F.split(F.trim("value"), r"\s+")
    raw = spark.read.text(path).select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at"), "value").filter(~F.startswith(F.trim("value"), F.lit("#")) & (F.size(p) >= 4))
    n = raw.withColumn("psv_id", F.row_number().over(Window.partitionBy("f").orderBy("at")) - 1)
    d = n.select("psv_id", p[0].alias("chrom"), p[1].cast("long").alias("pos"), p[2].alias("ref"), p[3].alias("_a"), F.coalesce(F.try_element_at(p, F.lit(5)).try_cast("double"), F.lit(1.0)).alias("informativeness"))
    return d.select("psv_id", "chrom", "pos", "ref", _alleles(F.col("_a")).alias("x"), "informativeness").select("psv_id", "chrom", "pos", "ref", "x.paralog", "x.allele", "informativeness")


def write_psv_bed(sites: DataFrame, path: str) -> None:
    pairs = F.array_join(F.array_sort(F.collect_list(F.concat("paralog", F.lit(":"), "allele"))), ",")
    g = sites.groupBy("psv_id", "chrom", "pos", "ref", "informativeness").agg(pairs.alias("a"))
    g.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "ref", "a", F.col("informativeness").cast("string")).alias("value")).write.text(path)


def read_psv_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ref, alt, paralog, allele): single-base variants with INFO/PSV; positions become 0-based."""
    p = F.split("value", "\t")
    raw = spark.read.text(path).filter(~F.startswith("value", F.lit("#")) & (F.size(p) >= 8) & (F.length(p[3]) == 1) & (F.length(p[4]) == 1))
    d = raw.select(p[0].alias("chrom"), (p[1].cast("long") - 1).alias("pos"), p[3].alias("ref"), p[4].alias("alt"), F.regexp_extract(p[7], "(?:^|;)PSV=([^;]*)", 1).alias("_a")).filter("_a <> ''")
    return d.select("chrom", "pos", "ref", "alt", _alleles(F.col("_a")).alias("x")).select("chrom", "pos", "ref", "alt", "x.paralog", "x.allele")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(ref_name, start, end, region_name, source, layer, params map); lines of fewer than six fields are left out, unknown layers are 0."""
    p = F.split("value", "\t")
    raw = spark.read.text(path).filter(~F.startswith("value", F.lit("#")) & (F.size(p) >= 6))
    params = F.when(F.coalesce(F.try_element_at(p, F.lit(7)), F.lit("-")) != "-", F.str_to_map(F.try_element_at(p, F.lit(7)), F.lit(","), F.lit("=")))
    return raw.select(p[0].alias("ref_name"), p[1].cast("long").alias("start"), p[2].cast("long").alias("end"), p[3].alias("region_name"), p[4].alias("source"), F.coalesce(p[5].try_cast("int"), F.lit(0)).alias("layer"), params.alias("params"))


def write_annotations(df: DataFrame, path: str) -> None:
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    params = F.when(F.col("params").isNull() | (F.size("params") == 0), "-").otherwise(entries)
    df.select(F.concat_ws("\t", "ref_name", F.col("start").cast("string"), F.col("end").cast("string"), "region_name", "source", F.col("layer").cast("string"), params).alias("value")).write.text(path)


def read_loci(spark: SparkSession, path: str, contig: str | None = None, *, glob: str = "*.json") -> DataFrame:
    """(name, ref_name, start, end, layer 2) of JSON files below ``path`` (an object or an array each) that have coordinates of the assembly."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("multiLine", True).schema("name string, coordinates struct<grch38: struct<chr: string, start: long, end: long>>").json(path)
    c = d.select("name", F.col("coordinates.grch38.chr").alias("ref_name"), F.col("coordinates.grch38.start").alias("start"), F.col("coordinates.grch38.end").alias("end"), F.lit(2).alias("layer")).filter("end > start")
    return c.filter((F.col("ref_name") == contig) | F.startswith("ref_name", F.lit(f"{contig}:"))) if contig else c


def write_probabilities(df: DataFrame, path: str, *, compression: str = "zstd", min_probability: float = 0.0, include_unmapped: bool = True) -> None:
    kept = df.filter((F.col("probability") >= min_probability) | (F.col("bucket_id") == "*"))
    kept = kept if include_unmapped else kept.filter("bucket_id <> '*'")
    kept.write.option("compression", compression).parquet(path)


def read_probabilities(spark: SparkSession, path: str, *, min_probability: float = 0.0, skip_unmapped: bool = False) -> DataFrame:
    """All row groups; both predicates reach the Parquet scan."""
    d = spark.read.schema(PROBABILITIES).parquet(path)
    d = d.filter(F.col("probability") >= min_probability) if min_probability > 0 else d
    return d.filter("bucket_id <> '*'") if skip_unmapped else d


def write_probability_csv(df: DataFrame, path: str) -> None:
    p = lambda c: F.format_string("%.6f", F.col(c).cast("double")).alias(c)
    df.select("read_id", "bucket_id", p("probability"), p("confidence"), "level", "iteration", F.col("is_collapsed").cast("int").alias("is_collapsed")).write.option("header", True).csv(path)


def read_probability_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = PROBABILITIES.replace("is_collapsed boolean", "is_collapsed int")
    d = spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return d.withColumn("is_collapsed", F.col("is_collapsed") == 1)


def write_clusters(df: DataFrame, path: str) -> None:
    df.select("read_id", "cluster_id", F.format_string("%.6f", "confidence").alias("confidence"), F.col("is_representative").cast("int").alias("is_representative"), "cluster_size", "read_length").write.option("sep", "\t").option("header", True).csv(path)


def write_matrix(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.option("sep", sep).option("header", True).csv(path)


def read_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.schema("cell string, paralog string, value double, read_count long, mean_confidence double").option("sep", sep).option("header", True).option("mode", "DROPMALFORMED").csv(path)


def write_dense_matrix(df: DataFrame, path: str, sep: str = ",") -> None:
    """One row a cell and one column a paralog, absent pairs 0; paralogs are told first, so that no scan looks for them."""
    names = [r[0] for r in df.select("paralog").distinct().orderBy("paralog").limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("a dense matrix may have at most 10,000 paralogs")
    df.groupBy("cell").pivot("paralog", names).agg(F.sum("value")).na.fill(0.0).write.option("sep", sep).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row, absent values as null."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """``src dst weight`` with six digits, each undirected edge once."""
    edges.filter("src < dst").select(F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string"), F.format_string("%.6f", "weight")).alias("value")).write.text(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Symmetric (src, dst, weight) of an edge list; lines that aren't three fields are left out."""
    p = F.split("value", "\t")
    one = spark.read.text(path).filter(F.size(p) == 3).select(p[0].cast("long").alias("src"), p[1].cast("long").alias("dst"), p[2].cast("double").alias("weight"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def save(df: DataFrame, path: str, *, by: str | None = None) -> None:
    """An index, pyramid or graph as Parquet, clustered by the column it is looked up by, so that row groups can be skipped."""
    (df.repartition(by).sortWithinPartitions(by) if by else df).write.parquet(path)


def write_truth(reads: DataFrame, path: str) -> None:
    """``read_id ref_id start end strand`` of simulated reads, with a header."""
    strand = F.when(F.col("reverse"), "-").otherwise("+").alias("strand")
    reads.select("read_id", "ref_id", F.col("true_start").alias("start"), F.col("true_end").alias("end"), strand).write.option("sep", "\t").option("header", True).csv(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("read_id long, ref_id long, start long, end long, strand string").option("sep", "\t").option("header", True).csv(path)


def write_matches(calls: DataFrame, path: str) -> None:
    """Exon-copy calls: read_id, gene, copy, n_exons, strand, ambiguous_gene, ambiguous_copy, tied_copies."""
    flag = lambda c: F.col(c).cast("int").alias(c)
    calls.select("read_id", "gene", "copy", "n_exons", F.when(F.col("forward"), "+").otherwise("-").alias("strand"), flag("ambiguous_gene"), flag("ambiguous_copy"), "tied_copies").write.option("sep", "\t").option("header", True).csv(path)


def concat_layers(*layers: DataFrame) -> DataFrame:
    """Annotation layers as one table; a column that a layer lacks is null there."""
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer, allowMissingColumns=True)
    return out


def qc_summary_rows(summary: DataFrame) -> DataFrame:
    """(metric, value) rows of a one-row summary."""
    names = summary.columns
    return summary.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.metric", "x.value")


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+")[0].alias("barcode")).filter("barcode <> ''").distinct()


def read_barcode_map(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, barcode); the last line of a read wins."""
    p = F.split("value", "\t")
    d = spark.read.text(path).filter(F.size(p) >= 2).select(F.monotonically_increasing_id().alias("at"), p[0].alias("read_id"), p[1].alias("barcode"))
    return d.groupBy("read_id").agg(F.max_by("barcode", "at").alias("barcode"))


def read_anchors(spark: SparkSession, path: str, isotypes: tuple[str, ...]) -> DataFrame:
    """(gene, copy, exon, anchor, contig, start, end) of exon anchors; equal sequences of a copy are one."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r")).filter("r <> ''")
    head = F.substring_index(F.col("r"), "\n", 1)
    name = F.regexp_extract(head, r"^([^ \t\r]*)", 1)
    seq = F.upper(F.regexp_replace(F.substr("r", F.length(head) + 2), r"\s", ""))
    tokens = F.split(name, "_")
    exon = F.element_at(tokens, -1)
    where = lambda k: F.regexp_extract(head, r"loc=([^:\s]+):(\d+)-(\d+)", k)
    d = raw.select(tokens[0].alias("gene"), F.array_join(F.slice(tokens, 1, F.size(tokens) - 1), "_").alias("copy"), exon.alias("exon"), seq.alias("anchor"), F.nullif(where(1), F.lit("")).alias("contig"), where(2).try_cast("long").alias("start"), where(3).try_cast("long").alias("end"))
    return d.filter(F.col("gene").isin(*isotypes) & (F.startswith("exon", F.lit("CH")) | F.col("exon").isin("M1", "M2", "H"))).dropDuplicates(["copy", "exon", "anchor"])


def s3_to_https(url):
    return F.regexp_replace(url, "^s3://([^/]+)/", "https://$1.s3.amazonaws.com/")


def truth_from_name(name):
    """Columns origin, start, end, gene of ``synth_<i>_<CAN or DUP>_<s>-<e>_<gene>``; null where the name has another form."""
    part = lambda k: F.nullif(F.regexp_extract(name, r"^synth_\d+_(CAN|DUP)_(\d+)-(\d+)_(.+)$", k), F.lit(""))
    return {"origin": part(1), "start": part(2).cast("long"), "end": part(3).cast("long"), "gene": part(4)}


