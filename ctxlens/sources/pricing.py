"""Model prices in USD per million tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ctxlens import fixed_values as fv

SCHEMA = "model STRING, input DOUBLE, output DOUBLE"


def default_pricing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.PRICING_ROWS, SCHEMA)


def read_pricing(spark: SparkSession, path: str) -> DataFrame:
    """Prices from CSV with a header; a missing price takes the default."""
    rows = spark.read.schema(SCHEMA).option("header", "true").csv(path)
    return rows.na.fill({"input": fv.DEFAULT_PRICE[0], "output": fv.DEFAULT_PRICE[1]})
