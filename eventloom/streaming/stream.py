"""Programs on streams. remap() is a stateless projection, so it is legal in append mode on any streaming DataFrame; windows and
watermarks are Spark's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.plans.api import remap


def remap_stream(stream: DataFrame, program: str, **options) -> DataFrame:
    """remap() for a streaming DataFrame."""
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return remap(stream, program, **options)


def counted_windows(stream: DataFrame, time: str, by: list[str], size: str, late: str) -> DataFrame:
    """Rows a window of time and key, late rows waited for: a tumbling count on top of a remapped stream."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")
