"""Counts over an event stream, and file-drop alignment in micro-batches."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import remove, shared_dir


def hourly(events: DataFrame, *, late: str = "2 days") -> DataFrame:
    """Events by type and hour, with a watermark for late ones."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select("event_type", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n", "total")
    )


def event_counts(spark: SparkSession, path: str) -> DataFrame:
    """Runs :func:`hourly` over what lies at ``path`` until all is read; the sink holds each batch's updated rows."""
    schema = spark.read.parquet(path).schema
    # A stream reads folders; a single file is read by its name in its folder.
    folder, _, name = path.rpartition("/")
    single = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_file = single.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(single).isFile()
    reader = spark.readStream.schema(schema)
    events = reader.option("pathGlobFilter", name).parquet(folder) if is_file else reader.parquet(path)
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    atexit.register(remove, spark, base)
    kept: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        kept.append(f"{base}/out/batch={number}")

    q = hourly(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    updates = spark.read.option("basePath", f"{base}/out").parquet(*kept)
    # The last update of a window is its count.
    return updates.groupBy("event_type", "hour").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))


def align_drops(spark: SparkSession, folder: str, out: str, align: Callable[[DataFrame], DataFrame], *, checkpoint: str, read: Callable[[DataFrame], DataFrame]):
    """Aligns each micro-batch of text files that land in ``folder`` and appends the result to ``out``.

    ``read`` makes reads (read_id, seq) of the batch's lines; returns the query, which ends when all files are done.
    """
    lines = spark.readStream.format("text").option("wholetext", True).load(folder)
    write = lambda batch, _: align(read(batch)).write.mode("append").parquet(out)
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
