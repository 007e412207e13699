"""Products that arrive as a stream.

Cleaning is a projection, so it serves streams as it is. New arrivals are told apart by id within a watermark, and
each batch can be matched against a table of products by blocking.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..sources.products import cleaned

SCHEMA = "product_id long, model_id string, shop string, title string, features map<string,string>, arrived timestamp"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Raw products from JSON lines that appear under a folder."""
    return spark.readStream.schema(SCHEMA).json(path)


def first_arrivals(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Clean products, each id once within the delay; state older than that goes."""
    return cleaned(stream).withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["product_id"])


def matched(stream: DataFrame, match: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends match(batch) of each micro-batch to Parquet under path, a folder a batch, so that a batch
    done again replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        match(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
