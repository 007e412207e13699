"""Descriptive statistics of a set of products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset(products: DataFrame) -> DataFrame:
    """One row: products, models, duplicate pairs, titles without their model id (case counts), and attributes of a
    product. products: raw records, as cleaning changes titles and joins attributes."""
    n = F.size("features")
    own = products.select(
        F.count("*").alias("products"),
        F.sum(F.when(F.contains("title", "model_id"), 0).otherwise(1)).cast("long").alias("without_model_id"),
        F.avg(n).alias("attributes_mean"), F.stddev_pop(n).alias("attributes_std"), F.percentile(n, 0.5).alias("attributes_median"),
        F.min(n).cast("long").alias("attributes_min"), F.max(n).cast("long").alias("attributes_max"),
        (F.avg(F.when(n >= 20, 1.0).otherwise(0.0)) * 100).alias("rich_percent"),
    )
    models = products.groupBy("model_id").agg(F.count("*").alias("k")).agg(F.count("model_id").alias("models"), F.sum(F.expr("k * (k - 1) div 2")).alias("duplicate_pairs"))
    return own.crossJoin(F.broadcast(models))  # one row each


def by_shop(products: DataFrame) -> DataFrame:
    return products.groupBy("shop").agg(F.count("*").alias("products"))


def histogram(products: DataFrame) -> DataFrame:
    """(n_features, products), for a bin each number of attributes."""
    return products.groupBy(F.size("features").cast("long").alias("n_features")).agg(F.count("*").alias("products"))
