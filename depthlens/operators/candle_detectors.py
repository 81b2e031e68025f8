"""Rule detectors on candles: symbol, ts, detector, side (long/short), confidence, price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthlens.operators import candles as cn
from depthlens.operators.ordered import RN


def _out(df: DataFrame, name: str, side: Column, conf: Column) -> DataFrame:
    return df.withColumns({"__s": side, "__c": conf}).filter("__s is not null").select(
        "symbol", "ts", F.lit(name).alias("detector"), F.col("__s").alias("side"),
        F.col("__c").cast("double").alias("confidence"), F.col("c").alias("price"))


def mean_reversion(candles: DataFrame, n: int = 20, mult: float = 2.0) -> DataFrame:
    o = cn.bollinger(cn.ordered_candles(candles), n, mult)
    ready = F.col(RN) >= n - 1
    side = F.when(ready & (F.col("c") <= F.col("bb_lower")), "long").when(
        ready & (F.col("c") >= F.col("bb_upper")), "short")
    return _out(o.df, "mean_reversion", side, F.lit(0.7))


def momentum(candles: DataFrame, low: float = 30.0, high: float = 70.0) -> DataFrame:
    o = cn.rsi(cn.ordered_candles(candles), 14, "rsi")
    r, ready = F.col("rsi"), F.col(RN) >= 14
    side = F.when(ready & (r < low), "long").when(ready & (r > high), "short")
    return _out(o.df, "momentum", side, F.when(r < low, (low - r) / 30.0).otherwise((r - high) / 30.0))


def breakout(candles: DataFrame, n: int = 20) -> DataFrame:
    o = cn.ordered_candles(candles).frame(n, 0, lambda w: {
        "__hi": F.max("h").over(w.rowsBetween(-n, -1)), "__lo": F.min("l").over(w.rowsBetween(-n, -1))})
    ready = F.col(RN) >= n
    side = F.when(ready & (F.col("c") > F.col("__hi")), "long").when(ready & (F.col("c") < F.col("__lo")), "short")
    return _out(o.df, "breakout", side, F.lit(0.8))


def volume_spike(candles: DataFrame, warm: int = 10, multiple: float = 2.0) -> DataFrame:
    """Volume above ``multiple`` times the mean of all candles so far."""
    o = cn.ordered_candles(candles).running({"__v": ("sum", F.col("v"))})
    usual = F.col("__v") / (F.col(RN) + 1)
    hit = (F.col(RN) >= warm - 1) & (F.col("v") > usual * multiple)
    side = F.when(hit, F.when(F.col("c") > F.col("o"), "long").otherwise("short"))
    return _out(o.df, "volume_spike", side, F.least(F.col("v") / (usual * 2.0), F.lit(1.0)))
