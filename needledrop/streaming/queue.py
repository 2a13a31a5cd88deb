"""The work queue fed by a stream of found items, equal to the batch upsert of the same items."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEMS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType())])


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares; a local one only where none is set and the session is on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        base = "file://" + tempfile.mkdtemp(prefix="needledrop-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it is; nothing may read it any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def latest(items: DataFrame) -> DataFrame:
    """key, kind, at, item of the last item of each key (by time, then id). Partial results of it can be merged by it."""
    last = F.max(F.struct("at", "item", "kind")).alias("m")
    return items.groupBy("key").agg(last).select("key", "m.kind", "m.at", "m.item")


def items(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "new").otherwise("changed")
    return events.select(F.col("user_id").alias("key"), kind.alias("kind"), F.unix_timestamp("ts").alias("at"), F.col("event_id").alias("item"))


def stream_latest(spark: SparkSession, directory: str, pattern: str, home: str | None = None) -> DataFrame:
    """latest() of all items in the files of a directory, taken as a stream in micro-batches until none is left.

    Each batch adds its own last items to a table; a batch that runs again after a failure overwrites what it wrote.
    The read position and the table lie in the folder home (a new one if none is given), so a later call with the same
    home takes new files only and gives the last items of all.
    """
    home = home or folder(spark, "queue")
    target, state = f"{home}/table", f"{home}/checkpoint"

    def put(batch: DataFrame, number: int) -> None:
        latest(items(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    source = spark.readStream.schema(ITEMS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 8).parquet(directory)
    source.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return latest(spark.read.schema("key long, kind string, at long, item long, batch long").parquet(target).drop("batch"))


def hourly(events: DataFrame) -> DataFrame:
    """Items by hour and kind: the windowed aggregate that a watermark bounds when events is a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", "1 hour")
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("hour"), "event_type", "n")
