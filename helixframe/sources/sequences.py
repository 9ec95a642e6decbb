"""FASTA and FASTQ as DataFrames; compressed files are read as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str, *, skip_n_only: bool = False, max_records: int | None = None) -> DataFrame:
    """(name, sequence): records are split at ``>`` by the text source, so a file is read in parallel by records.

    The name ends at the first space or tab; lines are joined and upper-cased.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r")).filter("r <> ''")
    head = F.substring_index(F.col("r"), "\n", 1)
    body = F.when(F.contains(F.col("r"), F.lit("\n")), F.substr("r", F.length(head) + 2)).otherwise("")
    out = raw.select(F.regexp_extract(F.rtrim(head), r"^([^ \t\r]*)", 1).alias("name"), F.upper(F.regexp_replace(body, r"\s", "")).alias("sequence"))
    out = out.filter(F.col("sequence").rlike("[^N]")) if skip_n_only else out
    return out.limit(max_records) if max_records is not None else out


def write_fasta(df: DataFrame, path: str, *, width: int = 80) -> None:
    lines = F.concat(F.lit(">"), "name", F.lit("\n"), F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n"))
    df.select(lines.alias("value")).write.text(path)


def read_fastq(spark: SparkSession, path: str, *, min_length: int = 0, max_length: int | None = None, uppercase: bool = False, max_records: int | None = None) -> DataFrame:
    """(id, sequence, quality) of well-formed records; the id is the whole header line without ``@``.

    A line's number in its file is that in its block plus the lines of the blocks before it; only blocks, not lines,
    are ranked. Malformed records are left out, later ones are read.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = lines.groupBy("f", "b").agg(F.count("*").alias("_c"), F.min("at").alias("_first"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = lines.join(blocks.select("f", "b", "_first", before.alias("_before")), ["f", "b"]).withColumn("n", F.col("_before") + F.col("at") - F.col("_first"))
    rec = n.groupBy("f", F.floor(F.col("n") / 4).alias("rec")).agg(*[F.max(F.when(F.col("n") % 4 == k, F.col("value"))).alias(c) for k, c in enumerate(("h", "s", "p", "q"))])
    ok = rec.filter(F.startswith("h", F.lit("@")) & F.startswith("p", F.lit("+")) & F.col("q").isNotNull())
    seq = F.upper("s") if uppercase else F.col("s")
    out = ok.select(F.substr("h", F.lit(2)).alias("id"), seq.alias("sequence"), F.col("q").alias("quality")).filter(F.length("sequence") >= min_length)
    out = out.filter(F.length("sequence") <= max_length) if max_length is not None else out
    return out.limit(max_records) if max_records is not None else out


def write_fastq(df: DataFrame, path: str, *, compression: str | None = None) -> None:
    df.select(F.concat(F.lit("@"), "id", F.lit("\n"), "sequence", F.lit("\n+\n"), "quality").alias("value")).write.text(path, compression=compression)


def fastq_stats(df: DataFrame) -> DataFrame:
    n = F.length("sequence")
    return df.agg(F.count("*").alias("records"), F.sum(n).alias("bases"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(n).alias("avg_length"), F.count_if(~F.coalesce(is_valid_fastq(), F.lit(False))).alias("invalid"))


def is_valid_fastq():
    return (F.length("id") > 0) & (F.length("sequence") > 0) & (F.length("quality") == F.length("sequence")) & F.col("sequence").rlike("^[ACGTNacgtn]+$")


def subsequence(seq, start, length):
    return F.substr(seq, F.lit(start) + 1, F.lit(length))
