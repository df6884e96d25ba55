"""Indexing a folder as a stream: new files in micro-batches, each committed as one version."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import incremental


def follow(spark: SparkSession, root: str, checkpoint: str, batch: Callable[[DataFrame, int], None], per_batch: int = 50, minutes: float | None = None) -> StreamingQuery:
    """Calls batch(files, number) for files that come up under root, `per_batch` at a time; every `minutes`, or once for all that are there.

    The file source gives additions only; changes and deletions are found by comparing listings
    (incremental.classify), which a batch may do.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if minutes is None else writer.trigger(processingTime=f"{minutes * 60:g} seconds")
    return writer.start()


def _manifest(spark: SparkSession, table: str, before: int | None = None) -> tuple[int, dict[str, int]]:
    """The number of the last batch (before that one) and, by bucket, the batch that wrote it last; -1 and nothing if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(table).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(path(table))] if fs.exists(path(table)) else []
    last = max((n for n in (int(x[1:]) for x in names if x[:1] == "m") if before is None or n < before), default=-1)
    if last < 0:
        return -1, {}
    stream = fs.open(path(f"{table}/m{last}"))
    try:
        return last, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current(spark: SparkSession, table: str, schema) -> DataFrame:
    """The rows of a table that stream_rows() keeps, as its last whole batch has left them."""
    own = _manifest(spark, table)[1]
    paths = [f"{table}/v{v}/_lw_bucket={k}" for k, v in own.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stream_rows(spark: SparkSession, source: str, schema, checkpoint: str, table: str, key: str, order: str, per_batch: int = 1, buckets: int = 16) -> None:
    """Follows a folder of Parquet files, keeping the last row of each key in a table of buckets by a hash of the key.

    A batch writes the buckets anew that it has keys of, and then a manifest, which puts them in
    force together; the others stay as they are. A repeated batch writes the same again.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path

    def batch(df: DataFrame, number: int) -> None:
        of = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")
        own = _manifest(spark, table, number)[1]
        df = df.withColumn("_lw_bucket", of)
        there = [r[0] for r in df.select("_lw_bucket").distinct().collect()]  # `buckets` at most
        paths = [f"{table}/v{own[k]}/_lw_bucket={k}" for k in there if k in own]
        old = (spark.read.schema(schema).parquet(*paths) if paths else df.drop("_lw_bucket").limit(0)).withColumn("_lw_bucket", of)
        incremental.upsert(old, df, key, order).write.mode("overwrite").partitionBy("_lw_bucket").parquet(f"{table}/v{number}")
        fs = path(table).getFileSystem(spark._jsc.hadoopConfiguration())
        out = fs.create(path(f"{table}/.m{number}"), True)
        out.write(bytearray(json.dumps(own | {k: number for k in there}).encode()))
        out.close()
        fs.delete(path(f"{table}/m{number}"), False)
        fs.rename(path(f"{table}/.m{number}"), path(f"{table}/m{number}"))

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)
    rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by key and window of event time; works on streams (late rows within the watermark count) and tables alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
