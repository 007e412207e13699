"""What the operators of this package share: tables and Arrow batches; kept tables are those of the storage module."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import checkpointed, written
from ..workers import tell_home

__all__ = ["BATCH_ROWS", "checkpointed", "small_batches", "table", "texts", "written"]

#: Rows of one Arrow batch; with texts of some kilobytes a batch stays at a few megabytes.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows, and where Spark knows the setting the bytes, of a batch sent to Python.

    Python workers are also told where this package lies, in case the driver found it by its own path only.
    """
    tell_home(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def texts(column: pa.Array) -> list[str]:
    """Texts of a string column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]
