"""Incremental variants: the click statistics of the query log over a stream of log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import normalize


def _timed(rows: DataFrame, event_time: str, late: str) -> DataFrame:
    """Event times as instants (a watermark takes no times without zone; these are read in the session's zone), with the watermark on a stream."""
    rows = rows.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return rows.withWatermark(event_time, late) if rows.isStreaming else rows


def query_counts(stream: DataFrame, *, event_time: str = "event_ts", late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Clicks per normalised query text and time window. Rows later than ``late`` are left out, as the watermark demands; works on batches too."""
    rows = _timed(stream, event_time, late)
    keyed = rows.select(F.col(event_time).alias("ts"), normalize(F.col("search_query")).alias("qn"))
    return keyed.groupBy(F.window("ts", window).alias("w"), "qn").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "qn", "n")


def first_deliveries(stream: DataFrame, *, keys: tuple[str, ...], event_time: str = "event_ts", late: str = "1 day") -> DataFrame:
    """Rows without redelivered copies, within the watermark."""
    rows = _timed(stream, event_time, late)
    return rows.dropDuplicatesWithinWatermark(list(keys)) if stream.isStreaming else rows.dropDuplicates(list(keys))
