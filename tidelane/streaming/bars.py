"""Bars from a stream of events: a bar appears once the watermark has passed its end.

State is one row of running values for each open (symbol, bar); late events within the delay still
count, later ones are dropped. replay() reads all that is there in one batch, so that its closed bars
are the same as those of the batch reader in whatever order the files hold the events.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of the events table that make bars.
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_per_trigger: int | None = 1) -> DataFrame:
    """A stream of the Parquet file at path, or of those in a folder there (None: all that are there in one batch)."""
    # A pattern that only path itself fits: Spark takes any other path of a stream for a folder.
    only = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    stream = spark.readStream.schema(StructType.fromDDL(EVENTS))
    if files_per_trigger is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    return stream.parquet(only)


def closed_bars(stream: DataFrame, minutes: int = 15, delay: str = "20 minutes") -> DataFrame:
    """stream (event_type, ts, event_id, value) -> symbol, bar_ts, open, high, low, close, volume."""
    key = F.struct("ts", "event_id")
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    bars = timed.groupBy(F.window("at", f"{minutes} minutes").alias("w"), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", key).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", key).alias("close"),
        F.count("*").cast("double").alias("volume"),
    )
    return bars.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("bar_ts"), "open", "high", "low", "close", "volume")


def write(bars: DataFrame, path: str, checkpoint: str):
    """Append closed bars to path; stops when the input that is there now has been read."""
    return bars.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)


def scratch_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a session of one process may do without the setting."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="bars-")
    return folder


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Streams all events under path once and returns the bars that were closed by the end."""
    root = f"{scratch_folder(spark)}/bars-{uuid.uuid4().hex}"
    # One batch: the files may overlap in time, and the watermark moves only after all rows are in.
    bars = closed_bars(events(spark, path, files_per_trigger=None))
    write(bars, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema(bars.schema).parquet(f"{root}/out")
