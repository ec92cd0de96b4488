"""The job log as a Structured Streaming source: an addition of this engine, over the same operators.

Late events are bounded by a watermark; state is one row per job or window, never an unbounded list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import REFRESH_SECONDS

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", late: str = "1 day") -> DataFrame:
    """Events of a folder, one file a trigger, with the watermark that everything after it shares."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).option("maxFilesPerTrigger", 1).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)  # watermarks need an instant


def deduplicated(events: DataFrame) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(["event_id"])


def tumbling_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def session_counts(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append", seconds: int = 300) -> None:
    """Everything there is, batch after batch, one at a time; resumes at the checkpoint."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError("the stream didn't end in time")


def watched(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], every: int = REFRESH_SECONDS, mode: str = "append") -> StreamingQuery:
    """A running query that hands on what is new every few seconds, until it is stopped."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=f"{every} seconds").foreachBatch(each).start()


def to_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """The stream's result as a table, for tests and small reports."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
