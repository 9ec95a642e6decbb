"""All queries of the library, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import alignments, base, calls, extras, formats, graphs, loci, sequence, singlecell, vectors, wave  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLE_SQL)


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return base.QUERIES["wave_em_step3"](spark, sf_dir)
