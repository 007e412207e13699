"""What Python workers need to know."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def tell_home(spark: SparkSession) -> None:
    """Tells Python workers where this package lies, in case the driver found it by its own path only."""
    environment = spark.sparkContext.environment
    home = str(Path(__file__).parents[1])
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in known:
        environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, known)])
