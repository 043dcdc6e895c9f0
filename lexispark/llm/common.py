"""Small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.scratch import cut, fresh_folder, shared_folder

__all__ = ["ascii_lower", "broadcast_if_small", "cut", "fresh_folder", "shared_folder", "small_batches", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Send texts to Python in batches of ``rows`` where the session leaves Spark's default of 10,000.

    A batch is held as a whole by the JVM and by the worker, so with long texts its rows are what memory depends on.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def broadcast_if_small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """Marked for a broadcast if it has at most ``most`` rows, which are counted; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())
