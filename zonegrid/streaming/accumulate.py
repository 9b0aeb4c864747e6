"""Matrices from streams: pairs counted as they come, and matrix files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from zonegrid.operators.reshape import KEYS


def windowed_pairs(trips: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours", value: str | None = None) -> DataFrame:
    """(window_start, Origin, Destination, TRIPS, VALUE) of a stream or table of trips, by event time.

    Trips that come later than `late` behind the newest are left out of a stream.
    """
    amount = F.col(value).cast("double") if value else F.lit(1.0)
    if trips.isStreaming:
        trips = trips.withWatermark(time, late)
    sums = trips.groupBy(F.window(time, window).alias("w"), *KEYS).agg(F.count(F.lit(1)).cast("double").alias("TRIPS"), F.sum(amount).alias("VALUE"))
    return sums.select(F.col("w.start").alias("window_start"), *KEYS, "TRIPS", "VALUE")


def running_pairs(trips: DataFrame, value: str | None = None) -> DataFrame:
    """(Origin, Destination, TRIPS, VALUE) over all that has come so far; for update or complete mode."""
    amount = F.col(value).cast("double") if value else F.lit(1.0)
    return trips.groupBy(*KEYS).agg(F.count(F.lit(1)).cast("double").alias("TRIPS"), F.sum(amount).alias("VALUE"))


def files_as_they_come(folder: DataFrame, decode: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that decodes matrix files of a binaryFile stream and appends their pairs to Parquet."""
    return folder.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: decode(batch).write.mode("append").parquet(out)).trigger(availableNow=True).start()
