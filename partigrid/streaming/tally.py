"""District tallies that are kept up to date from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events from Parquet files as they arrive; event time as a zoned timestamp, which watermarks need."""
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def district_tally(events: DataFrame, window: str = "1 hour", late: str = "1 day", cells: int = 25, cols: int = 5) -> DataFrame:
    """(start, district, events, users): events per window and district, a user's cell being id % cells, its district the column.

    The same plan serves a stream (late rows beyond the watermark are dropped) and a table.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    district = F.pmod(F.pmod("user_id", F.lit(cells)), F.lit(cols)).cast("int")
    tally = rows.groupBy(F.window("ts", window).alias("w"), district.alias("district")).agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users"))
    return tally.select(F.col("w.start").alias("start"), "district", "events", "users")


def moved_cells(changes: DataFrame, late: str = "1 day") -> DataFrame:
    """(start, v, district): the last district of each cell per hour of reassignments (ts, seq, v, district); ``seq`` tells
    changes of one time apart. The same plan serves a stream and a table."""
    rows = changes.withWatermark("ts", late) if changes.isStreaming else changes
    last = rows.groupBy(F.window("ts", "1 hour").alias("w"), "v").agg(F.max_by("district", F.struct("ts", "seq")).alias("district"))
    return last.select(F.col("w.start").alias("start"), "v", "district")
