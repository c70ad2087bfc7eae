"""Reading events and routing results. Spark's own readers and writers do the work; these add the conventions of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines as events. With a schema the columns are typed and only those asked for are parsed; without one each line
    is a VARIANT in column `event`, null where it is no JSON, beside the line itself."""
    lines = spark.read.text(path)
    if schema is not None:
        return lines.select(F.from_json("value", schema).alias("e")).where("e IS NOT NULL").select("e.*")
    return lines.select(F.col("value").alias("line"), F.try_parse_json("value").alias("event"))


def write_events(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def routed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of a remapped frame that came through, without the status columns, and those that aborted or failed, with them."""
    failed = F.col("_status").isin("aborted", "error")
    return df.where(~failed).drop("_status", "_message"), df.where(failed)
