"""Instrument dimension: tick and lot sizes, precisions, fees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depthlens.schemas import INSTRUMENT

# Built-in instruments (exchange, symbol, tick, lot, price digits, quantity
# digits, contract multiplier, minimum notional, maker fee, taker fee).
BUILT_IN = [
    ("okx", "BTC-USDT-SWAP", 0.1, 0.01, 1, 2, 1.0, 5.0, 0.0002, 0.0005),
    ("okx", "ETH-USDT-SWAP", 0.01, 0.1, 2, 1, 1.0, 5.0, 0.0002, 0.0005),
    ("binance", "BTCUSDT", 0.1, 0.001, 1, 3, 1.0, 5.0, 0.0002, 0.0005),
]
KEY = ["exchange", "symbol"]


def built_in(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUILT_IN, INSTRUMENT)


def register(catalogue: DataFrame, more: DataFrame) -> DataFrame:
    """Add instruments; a new row replaces an old one of the same exchange and symbol."""
    return more.unionByName(catalogue.join(more.select(*KEY), KEY, "left_anti"))


def attach(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Left join of the dimension; the planner broadcasts it if it is small."""
    return rows.join(catalogue, KEY, "left")


def require_known(rows: DataFrame, catalogue: DataFrame) -> None:
    """Raise if any row refers to an instrument that is not in the catalogue."""
    missing = rows.select(*KEY).distinct().join(catalogue.select(*KEY), KEY, "left_anti").limit(5).collect()
    if missing:
        raise KeyError("unknown instruments: " + ", ".join(f"{r[0]}:{r[1]}" for r in missing))
