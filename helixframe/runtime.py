"""Session-level helpers: table access and tables that cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(x: Column | str, digits: int = 6) -> Column:
    """A double as queries return it; adding 0.0 turns a negative zero positive."""
    return F.round((F.col(x) if isinstance(x, str) else x).cast("double"), digits) + F.lit(0.0)


def ratio(a: Column | str, b: Column | str) -> Column:
    """``a`` over ``b``; 0 where ``b`` is 0, as for empty tables."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def bounded(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast after its size has been checked; more than ``most`` rows are an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a table that all tasks get may have at most {most} rows")
    return F.broadcast(df)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a temporary folder only where it is unset on a local master (tests)."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("helixframe.shared.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("helixframe.shared.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder: iterations start from files, not from a growing plan."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def kept_by(df: DataFrame, key: str, rows: int = 1 << 18) -> Iterator[DataFrame]:
    """``df`` kept by a key for the rounds of an iteration, in the executors' memory and beyond it on their disks: joins on the key don't shuffle it."""
    kept = df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), key).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass
