"""Where intermediate tables lie: the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Small rows of a file, and files at least, where their number is known.
ROWS, LEAST = 100_000, 16


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: that which the cluster names in spark.checkpoint.dir, or one that was set by hand.

    Only on one machine (tests) may a temporary folder serve; a cluster must name one that all its machines share.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def files(rows: int) -> int:
    """Files for so many small rows."""
    return max(LEAST, rows // ROWS)


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, written to the shared folder and cut from its lineage; of about so many small rows, in no more files than they fill."""
    shared_folder(df.sparkSession)
    return (df if rows is None else df.coalesce(files(rows))).checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as a Parquet table, of which only the columns needed are read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
