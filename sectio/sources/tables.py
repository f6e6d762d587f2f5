"""Scans of the driver tables (parquet), with explicit schemas."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from sectio.sources import schemas

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; column pruning and filters push into the scan."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = schemas.TABLES.get(name)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def labels(spark, sf_dir):
    return table(spark, sf_dir, "labels")


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def benchmark(spark, sf_dir):
    return table(spark, sf_dir, "benchmark")
