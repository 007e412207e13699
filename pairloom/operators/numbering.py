"""Consecutive numbers without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed


def numbered(df: DataFrame, *order: str, name: str, start: int = 0) -> DataFrame:
    """df with name: start, start + 1, ... in the order of these columns.

    Rows are sorted over all partitions and kept; a partition's rows are numbered on from the sizes of those before,
    of which there is one figure a partition.
    """
    rows = checkpointed(df.sort(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.selectExpr("__part", "sum(__n) over (order by __part) - __n as __before")
    return rows.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at") + start).drop("__part", "__at", "__before")
