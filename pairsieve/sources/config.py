"""Parameter bounds from JSON lines: one object per parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOUNDS_SCHEMA = "name string, lo double, hi double"


def write_lines(spark: SparkSession, path: str, bounds: dict[str, tuple[float, float]]) -> None:
    rows = [(n, float(lo), float(hi)) for n, (lo, hi) in bounds.items()]
    spark.createDataFrame(rows, BOUNDS_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BOUNDS_SCHEMA).json(path)


def write_distributions(spark: SparkSession, path: str, rows: list[tuple[str, int, float]]) -> None:
    spark.createDataFrame(rows, "rate string, degree int, probability double").coalesce(1).write.mode("overwrite").json(path)


def read_distributions(spark: SparkSession, path: str) -> DataFrame:
    """Degree distributions as JSON lines (rate, degree, probability)."""
    return spark.read.schema("rate string, degree int, probability double").json(path)
