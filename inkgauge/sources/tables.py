"""Parquet table access for the driver-provided datasets."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``spark.read.parquet`` of one table; column pruning and filters reach
    the scan because nothing here touches the columns."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
