"""The same operators on streams: assessments as they arrive, event rates by time, restrictions as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from wardflow.functions.config import Config
from wardflow.functions.runtime import shared_dir
from wardflow.plans.pipeline import assess


def read_stream(spark: SparkSession, folder: str, schema, source: str = "parquet", files: int = 100) -> DataFrame:
    """New files of a folder as a stream; ``files`` of them at most in a batch."""
    return spark.readStream.format(source).schema(schema).option("maxFilesPerTrigger", files).load(folder)


def assess_stream(inputs: DataFrame, policy: str = "effective", config: Config = Config()) -> DataFrame:
    """Assessments of a stream of inputs: a projection without state, so append mode and no watermark."""
    return assess(inputs, policy, config)


def event_rates(events: DataFrame, time_col: str = "logged_at", size: str = "5 minutes", late: str = "10 minutes", by: tuple[str, ...] = ("decision",), key: str | None = "event_id") -> DataFrame:
    """(window_start, window_end, by..., n_events) over event time; rows later than ``late`` are dropped on streams.

    Events of the same key and time count once. Null times are in no window. On a table it is a plain aggregation.
    """
    df = events.filter(F.col(time_col).isNotNull())
    if df.isStreaming:
        df = df.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    if key:
        df = df.dropDuplicates([key, time_col])
    counted = df.groupBy(F.window(time_col, size), *by).agg(F.count(F.lit(1)).alias("n_events"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n_events")


def latest_restrictions_stream(history: DataFrame) -> DataFrame:
    """The latest restriction of each session seen so far, given again with each batch that has rows of the session (update mode).

    State is one row a session, kept by a maximum in the JVM; of equal times the larger restriction_id stays. Rows without session
    or time are dropped.
    """
    order = F.struct("applied_at", "restriction_id")
    rows = history.filter("session_id IS NOT NULL AND applied_at IS NOT NULL")
    latest = rows.groupBy("session_id").agg(F.max_by(F.struct("restriction_id", "restriction_mode", "applied_at"), order).alias("r"))
    return latest.select("session_id", "r.restriction_id", "r.restriction_mode", F.col("r.applied_at").cast("timestamp").alias("applied_at"))


def write_stream(df: DataFrame, folder: str, name: str, sink: str = "json", mode: str = "append", once: bool = True) -> StreamingQuery:
    """Start writing a stream to files, with its offsets in the shared folder; ``once`` takes what is there and ends."""
    writer = df.writeStream.format(sink).outputMode(mode).option("checkpointLocation", f"{shared_dir(df.sparkSession)}/stream-{name}").queryName(name)
    return (writer.trigger(availableNow=True) if once else writer).start(folder)
