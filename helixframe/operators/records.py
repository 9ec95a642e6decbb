"""Alignment records: flattening, the lossless invariant, SAM lines, mapping quality, tags and barcodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASONS = ("NoSeeds", "NoChains", "LowIdentity", "TooShort", "Ambiguous", "LowConfidence", "Orphaned", "Filtered")


def is_lossless() -> Column:
    """Over (read_id, status, has_primary, n_targets, reason): nothing about the read has been lost."""
    reason = F.col("reason").isNotNull()
    ok = F.when(F.col("status") == "Mapped", F.col("has_primary") & ~reason).when(F.col("status") == "Tentative", ~F.col("has_primary") & (F.col("n_targets") > 0) & reason)
    return F.coalesce((F.length(F.col("read_id").cast("string")) > 0) & ok.when(F.col("status") == "Unmapped", ~F.col("has_primary") & reason).otherwise(False), F.lit(False))


def flatten(records: DataFrame, *, min_probability: float = 0.0) -> DataFrame:
    """Probability rows (read_id, bucket_id, probability, confidence, is_collapsed) of records.

    ``records``: (read_id, status, confidence, targets array<struct<bucket_id string, p double>>). A mapped read's
    first target has probability 1, its i-th alternative 0.9 / (i + 2) with half the confidence; a tentative one's
    targets keep theirs; an unmapped read has the row '*'. First targets and '*' aren't filtered.
    """
    r = records.select("read_id", "status", F.coalesce("confidence", F.lit(0.0)).alias("c"), F.posexplode_outer("targets").alias("i", "t"))
    mapped, first = F.col("status") == "Mapped", F.col("i") == 0
    p = F.when(F.col("status") == "Unmapped", 0.0).when(mapped & first, 1.0).when(mapped, 0.9 / (F.col("i") + 1)).otherwise(F.col("t.p"))
    c = F.when(F.col("status") == "Unmapped", 0.0).when(mapped & first, F.col("c")).when(mapped, F.col("c") * 0.5).otherwise(F.col("t.p"))
    out = r.select("read_id", F.when(F.col("status") == "Unmapped", "*").otherwise(F.col("t.bucket_id")).alias("bucket_id"), p.alias("probability"), c.alias("confidence"), (mapped & first).alias("is_collapsed"), "i", "status")
    keep = (F.col("probability") >= min_probability) | F.col("is_collapsed") | (F.col("bucket_id") == "*")
    return out.filter(F.col("bucket_id").isNotNull() & ((F.col("status") != "Unmapped") | (F.coalesce("i", F.lit(0)) == 0)) & keep).drop("i", "status")


def table_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("entries"), F.count_distinct("read_id").alias("reads"), F.count_distinct("bucket_id").alias("buckets"), F.count_if("is_collapsed").alias("collapsed"), F.count_if(F.col("bucket_id").cast("string") == "*").alias("unmapped"))


def writer_mapq(confidence: Column, alternatives: Column) -> Column:
    """Mapping quality from the confidence, else from the number of alternatives."""
    by_c = F.when(confidence >= 0.99, 60).when(confidence >= 0.95, 40).when(confidence >= 0.90, 30).when(confidence >= 0.80, 20).otherwise(10)
    return F.when(confidence.isNotNull(), by_c).when(alternatives == 0, 60).when(alternatives == 1, 30).when(alternatives == 2, 20).otherwise(10)


def unique_mapq(score: Column, length: Column, identity: Column) -> Column:
    c = score / length * identity
    return (
        F.when((score <= 0) | (identity < 0.5), 0).when((c >= 1) & (identity >= 0.9), 60).when((c >= 0.7) & (identity >= 0.8), 50).when((c >= 0.5) & (identity >= 0.7), 40)
        .otherwise(F.least(F.lit(60), F.greatest(F.lit(10), F.floor(40 * c)))).cast("int")
    )


def multi_mapq(gap: Column, n: Column, identity: Column) -> Column:
    p = F.exp(-gap / 30)
    p = F.when(n > 1, F.least(F.lit(0.5), p * (1 + 0.3 * F.log2(n)))).otherwise(p)
    v = F.when(p < 1e-6, 60.0).otherwise(-10 * F.log10(p)) * F.when(identity < 0.9, identity).otherwise(1.0)
    return F.when(gap <= 0, 0).otherwise(F.least(F.lit(60), F.greatest(F.lit(0), F.floor(v)))).cast("int")


def sam_lines(df: DataFrame) -> DataFrame:
    """One SAM line for each of (read_id, flag, target, pos, mapq, cigar, seq, tags string or null); positions become 1-based."""
    cols = [F.col("read_id").cast("string"), F.col("flag").cast("string"), F.coalesce("target", F.lit("*")), (F.coalesce("pos", F.lit(-1)) + 1).cast("string"), F.col("mapq").cast("string"), F.coalesce("cigar", F.lit("*")), F.lit("*"), F.lit("0"), F.lit("0"), F.coalesce("seq", F.lit("*")), F.lit("*")]
    return df.select(F.concat_ws("\t", *cols, F.col("tags")).alias("line"))


def flag_is(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def tags_from_name(name: Column) -> dict[str, Column]:
    """UMI (last token after _ or, without one, :) and barcode (the token before)."""
    parts = F.when(F.contains(name, F.lit("_")), F.split(name, "_")).otherwise(F.split(name, ":"))
    n = F.size(parts)
    return {"umi": F.when(n >= 3, F.element_at(parts, -1)), "barcode": F.when(n >= 3, F.try_element_at(parts, F.lit(-2)))}


def tag(aux: Column, name: str) -> Column:
    """Value of ``XX:T:value`` in tab-separated auxiliary fields, else null."""
    return F.nullif(F.regexp_extract(aux, rf"(?:^|\t){name}:[A-Za-z]:([^\t]*)", 1), F.lit(""))


def name_with_tags(name: Column, barcode: Column, umi: Column, sep: str = "_") -> Column:
    """The read name that carries a barcode and a UMI, as :func:`tags_from_name` reads them; absent ones add nothing."""
    return F.concat_ws(sep, name, barcode, umi)


def merged_tags(first: dict, second: dict) -> dict:
    """Tags of two sources, the first's where it has them."""
    return {k: F.coalesce(*[s[k] for s in (first, second) if k in s]) for k in {**first, **second}}


def effective(corrected: Column, raw: Column) -> Column:
    return F.coalesce(corrected, raw)


def barcode_of(read: Column, *, mapped: Column | None = None, pattern: str | None = None, prefix: str | None = None) -> Column:
    """A read's barcode: from a joined map if there is one, else by a pattern's first group, else what follows a prefix."""
    if mapped is not None:
        return mapped
    if pattern is not None:
        return F.nullif(F.regexp_extract(read, pattern, 1), F.lit(""))
    return F.nullif(F.regexp_extract(read, rf"{prefix}([^ \t_]*)", 1), F.lit(""))


def gene_of(target: Column, isotypes: tuple[str, ...], mapped: Column | None = None) -> Column:
    """The gene that a map gives a target, else its first token where that is an isotype."""
    token = F.split(target, "_")[0]
    own = F.when(token.isin(*isotypes), token)
    return F.coalesce(mapped, own) if mapped is not None else own


def by_read(rows: DataFrame) -> DataFrame:
    """(read_id, rows): a read's probability rows, best first. A read's rows are its candidates, bounded by refinement."""
    each = F.array_sort(F.collect_list(F.struct((-F.col("probability")).alias("order"), "bucket_id", "probability")))
    return rows.groupBy("read_id").agg(F.transform(each, lambda x: F.struct(x["bucket_id"].alias("bucket_id"), x["probability"].alias("probability"))).alias("rows"))


def cache_key(kind: Column, read: Column, ref: Column, region: Column, candidates: Column) -> Column:
    """SHA-256 of a decision's inputs; ``candidates`` are ``pos:score`` strings, sorted here."""
    return F.sha2(F.concat_ws("|", F.lit("v1"), kind, read, ref, region, F.array_join(F.array_sort(candidates), ";")), 256)


def valid_barcode(barcode: Column, length: int, *, allow_n: bool = False) -> Column:
    return (F.length(barcode) == length) & barcode.rlike("^[ACGTN]+$" if allow_n else "^[ACGT]+$")


def correct_barcodes(observed: DataFrame, whitelist: DataFrame) -> DataFrame:
    """(barcode, corrected, distance): the whitelisted barcode itself, else the smallest at Hamming distance 1.

    Candidates meet on their deletion neighbourhoods: two equally long barcodes that differ in one place are equal
    without that place, so a barcode of length L makes L rows and no theta join is needed.
    """
    cut = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.lit("-"), F.substr(c, i + 1)))
    o = observed.select("barcode").distinct()
    exact = o.join(whitelist.select(F.col("barcode")).distinct(), "barcode", "left_semi").select("barcode", F.col("barcode").alias("corrected"), F.lit(0).alias("distance"))
    rest = o.join(whitelist.select("barcode").distinct(), "barcode", "left_anti").filter(F.length("barcode") > 0)
    left = rest.select("barcode", F.explode(cut(F.col("barcode"))).alias("_k"))
    right = whitelist.select(F.col("barcode").alias("_w")).distinct().filter(F.length("_w") > 0).select("_w", F.explode(cut(F.col("_w"))).alias("_k"))
    near = left.join(right, "_k").groupBy("barcode").agg(F.min("_w").alias("corrected")).withColumn("distance", F.lit(1))
    return exact.unionByName(near)
