"""Incremental ingestion by Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the one that all executors share; a local one only in local mode without it."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="corpusmill-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def append_once(sink: str, keys: list[str]):
    """A batch writer that appends rows whose keys the sink has not: a batch that is retried adds nothing twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(sink)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.parquet(sink).select(*keys), keys, "left_anti")
        new.write.mode("append").parquet(sink)

    return write


def ingest_once(spark: SparkSession, source: str, keys: list[str], files_at_once: int = 1, sink: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Take all files of a folder that the checkpoint has not seen, a few at a time, and return what the sink holds.

    A stop between files loses nothing: the checkpoint knows the files done, and appends are keyed.
    """
    schema = spark.read.parquet(source).schema
    sink = sink or work_dir(spark, "sink")
    checkpoint = checkpoint or work_dir(spark, "progress")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        stream = reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    else:
        stream = reader.parquet(source)
    query = stream.writeStream.foreachBatch(append_once(sink, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(sink)


def until_budget(sink: str, tokens: Column, budget: int):
    """A batch writer that stops taking rows once the sink's tokens reach the budget; the batch that crosses is kept whole."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(sink)
        held = 0
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            held = spark.read.parquet(sink).where(F.col("__batch") < batch_id).agg(F.coalesce(F.sum("__tokens"), F.lit(0))).first()[0]
        if held < budget:
            batch.withColumn("__tokens", tokens).withColumn("__batch", F.lit(batch_id)).write.mode("append").parquet(sink)

    return write


def windowed_counts(events: DataFrame, ts: str, width: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Counts in tumbling windows; on a stream, late rows count until the watermark has passed."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark(ts, late)
    c = e.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return c.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n")
