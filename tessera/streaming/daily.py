"""Daily panels kept up to date from a stream.

The batch library needs none of this; it is for callers whose events arrive continuously. The stream keeps one running sum a unit and day, and
emits a day once the watermark has passed it, so what is published is complete and is never revised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def daily_panel(events: DataFrame, unit: str, ts: str, value: str, delay: str = "2 days") -> DataFrame:
    """(unit, day, n, total, mean) of a stream (or a batch) of events; rows later than the delay are not counted."""
    timely = events.withWatermark(ts, delay) if events.isStreaming else events
    days = timely.groupBy(F.window(ts, "1 day").alias("w"), unit).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return days.select(unit, F.to_date("w.start").alias("day"), "n", "total", "mean")


def append_daily(panel: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends finished days to a Parquet table; the checkpoint makes a restart go on where it stopped."""
    return panel.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day")
