"""Connected components of an edge relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed


def connected_components(edges: DataFrame, a: str = "id_a", b: str = "id_b", rows: int | None = None) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable. rows: about how many edges
    there are, where the caller knows.

    Alternating large-star and small-star steps: each is a partial aggregate and a join on the node, so a
    hub's edges are split like any skewed join and no neighbourhood is gathered. The number of rounds grows
    with the logarithm of the diameter; every round is written to the checkpoint folder.
    """
    now = checkpointed(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(), rows
    )
    before = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == before:
            break
        before = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(lowest, "u")
        small = met.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        now = checkpointed(small.where("u <> v").distinct(), seen[0])
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
