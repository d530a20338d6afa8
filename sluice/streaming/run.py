"""Batch streams: the same query over files that arrive, by Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all machines see, under `spark.checkpoint.dir`. Where that is unset, a
    local one if all runs in this process; on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1, format: str = "parquet") -> DataFrame:
    """Files of one declared schema, `files_per_batch` resident at a time."""
    return spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_per_batch).load(path)


def drain(stream: DataFrame, folder: str | None = None, mode: str = "append") -> DataFrame:
    """Run a streaming query over all there is, and read its result.

    Appended rows go to Parquet files with a commit log; the whole state of an
    aggregation (mode "complete") replaces one table per batch, so a batch that is run
    again after a failure leaves the same result.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/log")
    if mode == "append":
        query = writer.format("parquet").start(f"{folder}/out")
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def split_files(df: DataFrame, path: str, files: int = 4, by: str | None = None) -> str:
    """A table as several files, to be read as a stream."""
    (df.repartition(files, by) if by else df.repartition(files)).write.mode("overwrite").parquet(path)
    return path


def over_stream(spark: SparkSession, table: DataFrame, query: Callable[[DataFrame], DataFrame], mode: str = "append", files: int = 4) -> DataFrame:
    """`query` over `table` arriving as `files` files, one at a time."""
    folder = shared_folder(spark)
    split_files(table, f"{folder}/in", files)
    return drain(query(read_stream(spark, f"{folder}/in", table.schema)), folder, mode)


def arrivals(spark: SparkSession, batches: list[DataFrame], folder: str | None = None) -> DataFrame:
    """A stream that gets these tables, a file each, one after another."""
    folder = folder or f"{shared_folder(spark)}/in"
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(folder)
    return read_stream(spark, folder, batches[0].schema)


def in_order(table: DataFrame, time: str, batches: int = 4) -> list[DataFrame]:
    """A table cut into batches of one span of time after another."""
    cuts = table.agg(F.percentile_approx(F.unix_micros(time), [k / batches for k in range(1, batches)])).first()[0] or []
    at = F.unix_micros(time)
    ends = [None, *cuts, None]
    return [table.where((at > a if a is not None else F.lit(True)) & (at <= b if b is not None else F.lit(True))) for a, b in zip(ends, ends[1:])]


def scalar_or_empty(result: DataFrame, empty: DataFrame) -> DataFrame:
    """A streamed scalar aggregate; where no batch ever came, the row of an empty input."""
    return result.unionByName(empty.join(result.limit(1).select(F.lit(1).alias("_some")), F.lit(True), "left_anti"))


def windowed(stream: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes", **aggs) -> DataFrame:
    """Event-time windows with a watermark. Appended, a window comes out once the
    watermark has passed its end, and rows of windows before that are dropped as late."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w.alias("window"), *keys).agg(*[c.alias(n) for n, c in aggs.items()])


def join_streams(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, within: str, late: str = "1 hour", how: str = "inner") -> DataFrame:
    """Rows of two streams with equal keys, the right one at most `within` after the left.
    Watermarks on both sides bound the state: a row is forgotten once no partner can come."""
    a, b = left.withWatermark(left_time, late), right.withWatermark(right_time, late)
    close = (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {within}"))
    for k in keys:
        close &= a[k] == b[k]
    return a.join(b, close, how)
