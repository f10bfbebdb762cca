"""Python workers of the executors."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster whose machines lack that path, pass the package with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        joined = os.pathsep.join([root, *filter(None, paths)])
        spark.sparkContext.environment["PYTHONPATH"] = joined
