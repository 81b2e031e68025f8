"""Candles as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depthlens.schemas import CANDLE


def read_candles(spark: SparkSession, path: str, schema=CANDLE) -> DataFrame:
    """Blank lines are skipped; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_candles(candles: DataFrame, path: str) -> None:
    candles.write.mode("overwrite").json(path)
