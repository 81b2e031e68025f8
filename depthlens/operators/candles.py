"""Candle indicators.  Candles: symbol, ts, o, h, l, c, v with unique (symbol, ts)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthlens.operators.ordered import RN, Ordered, order_rows


def ordered_candles(candles: DataFrame) -> Ordered:
    return order_rows(candles, ["symbol"], ["ts"])


def _warm(n: int, value: Column, zero: bool = True) -> Column:
    return F.when(F.col(RN) >= n - 1, value).otherwise(F.lit(0.0) if zero else F.lit(None))


# ---- single indicators (Ordered in, Ordered out) -----------------------------------------------
def sma(o: Ordered, periods: Mapping[str, int], value: str = "c", warmup: str = "zero") -> Ordered:
    zero = warmup == "zero"
    return o.frame(max(periods.values()) - 1, 0, lambda w: {
        name: _warm(n, F.avg(value).over(w.rowsBetween(1 - n, 0)), zero)
        for name, n in periods.items()})


def ema(o: Ordered, periods: Mapping[str, int], value: str = "c") -> Ordered:
    return o.ema({name: (F.col(value), 2.0 / (n + 1)) for name, n in periods.items()},
                 seed_first=True)


def _rsi_steps(o: Ordered, n: int) -> tuple[Ordered, dict]:
    o = o.frame(1, 0, lambda w: {"__d": F.col("c") - F.lag("c").over(w)})
    o = o.cols({"__gain": F.greatest("__d", F.lit(0.0)), "__loss": F.greatest(-F.col("__d"), F.lit(0.0))})
    o = o.frame(n - 1, 0, lambda w: {
        "__g0": F.avg("__gain").over(w.rowsBetween(1 - n, 0)),
        "__l0": F.avg("__loss").over(w.rowsBetween(1 - n, 0))})
    steps = {}
    for out, seed, x in (("__ag", "__g0", "__gain"), ("__al", "__l0", "__loss")):
        steps[out] = (
            F.when(F.col(RN) > n, (n - 1) / n).otherwise(0.0),
            F.when(F.col(RN) < n, 0.0).when(F.col(RN) == n, F.col(seed)).otherwise(F.col(x) / n))
    return o, steps


def _rsi_value(n: int) -> Column:
    ratio = F.col("__ag") / F.nullif(F.col("__al"), F.lit(0.0))
    return F.when(F.col(RN) < n, 50.0).when(F.col("__al") == 0, 100.0).otherwise(
        100.0 - 100.0 / (1.0 + ratio))


_RSI_TEMP = ("__d", "__gain", "__loss", "__g0", "__l0", "__ag", "__al")


def rsi(o: Ordered, n: int = 14, name: str = "rsi") -> Ordered:
    """Wilder RSI; 50 during the first ``n`` rows, 100 without losses."""
    o, steps = _rsi_steps(o, n)
    return o.scan(steps).col(name, _rsi_value(n)).drop(*_RSI_TEMP)


def _true_range(o: Ordered) -> Ordered:
    return o.frame(1, 0, lambda w: {"__tr": F.greatest(
        F.col("h") - F.col("l"), F.abs(F.col("h") - F.lag("c").over(w)),
        F.abs(F.col("l") - F.lag("c").over(w)))})


def _atr_step(n: int) -> tuple[Column, Column]:
    first = F.col(RN) == 0
    return (F.when(first, 0.0).otherwise((n - 1) / n),
            F.when(first, F.col("__tr")).otherwise(F.col("__tr") / n))


def atr(o: Ordered, n: int = 14, name: str = "atr") -> Ordered:
    """Wilder ATR seeded with the first range; 0 for a series of one candle."""
    o = _true_range(o).scan({name: _atr_step(n)})
    o = o.frame(0, 1, lambda w: {"__more": F.lead("ts").over(w)})
    alone = (F.col(RN) == 0) & F.col("__more").isNull()
    return o.col(name, F.when(alone, 0.0).otherwise(F.col(name))).drop("__tr", "__more")


def vwap(o: Ordered, name: str = "vwap") -> Ordered:
    tripled = F.col("h") + F.col("l") + F.col("c")
    o = o.running({"__pv": ("sum", tripled * F.col("v")), "__v": ("sum", F.col("v"))})
    value = F.coalesce(F.col("__pv") / F.nullif(3.0 * F.col("__v"), F.lit(0.0)), F.col("c"))
    return o.col(name, value).drop("__pv", "__v")


def bollinger(o: Ordered, n: int = 20, mult: float = 2.0) -> Ordered:
    o = o.frame(n - 1, 0, lambda w: {
        "bb_middle": _warm(n, F.avg("c").over(w.rowsBetween(1 - n, 0))),
        "__sd": _warm(n, F.stddev_pop("c").over(w.rowsBetween(1 - n, 0)))})
    return o.cols({
        "bb_upper": F.col("bb_middle") + mult * F.col("__sd"),
        "bb_lower": F.col("bb_middle") - mult * F.col("__sd")}).drop("__sd")


def macd(o: Ordered, fast: int = 12, slow: int = 26, signal: int = 9) -> Ordered:
    o = ema(o, {"__fast": fast, "__slow": slow})
    o = o.col("macd", F.col("__fast") - F.col("__slow"))
    o = ema(o, {"macd_signal": signal}, "macd")
    return o.col("macd_hist", F.col("macd") - F.col("macd_signal")).drop("__fast", "__slow")


# ---- the indicator frame -------------------------------------------------------------------------
def indicator_frame(
    candles: DataFrame,
    causal: bool = False,
    custom: Mapping[str, Callable] | None = None,
) -> DataFrame:
    """All indicators of each candle plus ``label``, the next candle's return.

    ``volume_ratio`` and ``avg_range`` use means of the whole series, or with ``causal`` of
    the rows so far.  ``custom`` maps a name to a function of the ``Ordered`` candles that
    returns an ``Ordered`` with that column added.
    """
    o, steps = _rsi_steps(_true_range(ordered_candles(candles)), 14)
    first = F.col(RN) == 0
    for name, n in (("ema_9", 9), ("ema_21", 21), ("__fast", 12), ("__slow", 26)):
        k = 2.0 / (n + 1)
        steps[name] = (F.when(first, 0.0).otherwise(1.0 - k),
                       F.when(first, F.col("c")).otherwise(F.col("c") * k))
    steps["atr_14"] = _atr_step(14)
    o = o.scan(steps).col("rsi_14", _rsi_value(14)).drop(*_RSI_TEMP, "__tr")
    o = o.col("macd", F.col("__fast") - F.col("__slow")).drop("__fast", "__slow")
    o = ema(o, {"macd_signal": 9}, "macd").col("macd_hist", F.col("macd") - F.col("macd_signal"))
    o = o.frame(49, 1, lambda w: {
        "sma_20": _warm(20, F.avg("c").over(w.rowsBetween(-19, 0))),
        "sma_50": _warm(50, F.avg("c").over(w.rowsBetween(-49, 0))),
        "__sd": _warm(20, F.stddev_pop("c").over(w.rowsBetween(-19, 0))),
        "label": F.lead("c").over(w) / F.col("c") - 1.0,
    })
    alone = first & F.col("label").isNull()
    o = o.cols({
        "atr_14": F.when(alone, 0.0).otherwise(F.col("atr_14")),
        "bb_middle": F.col("sma_20"),
        "bb_upper": F.col("sma_20") + 2.0 * F.col("__sd"),
        "bb_lower": F.col("sma_20") - 2.0 * F.col("__sd"),
    }).drop("__sd")
    tripled = F.col("h") + F.col("l") + F.col("c")
    sums = {"__pv": ("sum", tripled * F.col("v")), "__v": ("sum", F.col("v")),
            "__r": ("sum", F.col("h") - F.col("l"))}
    o = o.running(sums)
    o = o.col("vwap", F.coalesce(F.col("__pv") / F.nullif(3.0 * F.col("__v"), F.lit(0.0)), F.col("c")))
    if causal:
        n = F.col(RN) + 1
        o = o.cols({"__avg_v": F.col("__v") / n, "avg_range": F.col("__r") / n})
    else:
        means = candles.groupBy("symbol").agg(
            F.avg("v").alias("__avg_v"), F.avg(F.col("h") - F.col("l")).alias("avg_range"))
        o = o.with_df(o.df.join(means, "symbol"))
    o = o.cols({
        "volume_ratio": F.when(F.col("__avg_v") > 0,
                               F.col("v") / F.nullif(F.col("__avg_v"), F.lit(0.0))).otherwise(0.0),
        "range": F.col("h") - F.col("l"),
        "body": F.abs(F.col("c") - F.col("o")),
        "upper_wick": F.col("h") - F.greatest("o", "c"),
        "lower_wick": F.least("o", "c") - F.col("l"),
    }).drop("__pv", "__v", "__r", "__avg_v")
    for name, fn in (custom or {}).items():
        o = fn(o)
        if name not in o.df.columns:
            raise ValueError(f"custom feature {name!r} did not add its column")
    return o.result()


def market_state(candles: DataFrame) -> DataFrame:
    """State after each candle: prices, averages, running extremes, return volatility."""
    o = _true_range(ordered_candles(candles))
    first = F.col(RN) == 0
    steps = {"atr14": _atr_step(14)}
    for name, n in (("ema9", 9), ("ema21", 21)):
        k = 2.0 / (n + 1)
        steps[name] = (F.when(first, 0.0).otherwise(1.0 - k),
                       F.when(first, F.col("c")).otherwise(F.col("c") * k))
    o = o.scan(steps).drop("__tr")
    o = o.frame(49, 0, lambda w: {
        "previous_price": F.coalesce(F.lag("c").over(w), F.lit(0.0)),
        "sma50": _warm(50, F.avg("c").over(w.rowsBetween(-49, 0)))})
    ret = F.when(F.col("previous_price") > 0, F.col("c") / F.col("previous_price") - 1.0)
    tripled = F.col("h") + F.col("l") + F.col("c")
    o = o.col("__ret", ret).running({
        "__pv": ("sum", tripled * F.col("v")), "__v": ("sum", F.col("v")),
        "high": ("max", F.col("h")), "low": ("min", F.col("l")),
        "__n": ("count", F.col("__ret")), "__s1": ("sum", F.col("__ret")),
        "__s2": ("sum", F.col("__ret") * F.col("__ret")),
    })
    mean = F.col("__s1") / F.nullif(F.col("__n"), F.lit(0))
    var = F.greatest(F.col("__s2") / F.nullif(F.col("__n"), F.lit(0)) - mean * mean, F.lit(0.0))
    return o.cols({
        "vwap": F.coalesce(F.col("__pv") / F.nullif(3.0 * F.col("__v"), F.lit(0.0)), F.col("c")),
        "avg_volume": F.col("__v") / (F.col(RN) + 1),
        "atr14": F.when(first, 0.0).otherwise(F.col("atr14")),
        "volatility": F.when(F.col("__n") >= 2, F.sqrt(var)).otherwise(0.0),
        "candle_count": F.col(RN) + 1,
    }).drop("__pv", "__v", "__n", "__s1", "__s2", "__ret").result()


def series_summary(candles: DataFrame) -> DataFrame:
    return candles.groupBy("symbol").agg(
        F.min_by("o", "ts").alias("open"), F.max("h").alias("high"), F.min("l").alias("low"),
        F.max_by("c", "ts").alias("close"), F.sum("v").alias("volume"),
        F.count("*").alias("candles"))


# ---- regimes ------------------------------------------------------------------------------------
def _regime_inputs(candles: DataFrame) -> Ordered:
    o = atr(ordered_candles(candles), 14, "atr_14")
    return o.frame(49, 0, lambda w: {
        "sma_20": _warm(20, F.avg("c").over(w.rowsBetween(-19, 0))),
        "sma_50": _warm(50, F.avg("c").over(w.rowsBetween(-49, 0))),
        "__first5": F.avg("c").over(w.rowsBetween(-19, -15)),
        "__last5": F.avg("c").over(w.rowsBetween(-4, 0)),
    })


def _regime() -> Column:
    s20, s50, c = F.col("sma_20"), F.col("sma_50"), F.col("c")
    change = (F.col("__last5") - F.col("__first5")) / F.when(
        F.col("__first5") == 0, 1.0).otherwise(F.col("__first5"))
    long_enough = F.col(RN) >= 49
    return (
        F.when(F.col(RN) < 29, "ranging")
        .when((c > 0) & (F.col("atr_14") / F.nullif(c, F.lit(0.0)) > 0.02), "volatile")
        .when(long_enough & (s20 > s50) & (c > s20), "trending_up")
        .when(long_enough & (s20 < s50) & (c < s20), "trending_down")
        .when(change > 0.005, "trending_up")
        .when(change < -0.005, "trending_down")
        .otherwise("ranging"))


def regimes(candles: DataFrame) -> DataFrame:
    """Market regime of every candle, judged on the candles up to it."""
    return _regime_inputs(candles).col("regime", _regime()).drop("__first5", "__last5").result()


def regime_probabilities(candles: DataFrame) -> DataFrame:
    o = _regime_inputs(candles)
    s20, s50, c = F.col("sma_20"), F.col("sma_50"), F.col("c")
    vol = F.when(c > 0, F.least(F.col("atr_14") / F.nullif(c, F.lit(0.0)) / 0.02, F.lit(1.0))
                 ).otherwise(0.0) * 0.6
    gap = F.abs(s20 - s50) / F.when(s50 == 0, 1.0).otherwise(s50) / 0.01
    trend = F.when(F.col(RN) >= 49, F.least(gap, F.lit(1.0))).otherwise(0.0) * 0.4
    o = o.cols({
        "__vol": vol,
        "__up": F.when(s20 > s50, trend).otherwise(0.0),
        "__down": F.when(s20 < s50, trend).otherwise(0.0),
        "__rest": F.greatest(1.0 - vol - trend, F.lit(0.0)),
    })
    total = F.col("__vol") + F.col("__up") + F.col("__down") + F.col("__rest")
    total = F.when(total == 0, 1.0).otherwise(total)
    short = F.col(RN) < 29
    return o.cols({
        name: F.when(short, 0.25).otherwise(F.col(part) / total)
        for name, part in (("p_trending_up", "__up"), ("p_trending_down", "__down"),
                           ("p_ranging", "__rest"), ("p_volatile", "__vol"))
    }).drop("__vol", "__up", "__down", "__rest", "__first5", "__last5").result()


def regime_transitions(candles: DataFrame) -> DataFrame:
    """Regime changes among samples taken every max(1, n/100) candles from the 21st on."""
    sizes = candles.groupBy("symbol").agg(F.count("*").alias("__n"))
    o = _regime_inputs(candles).col("regime", _regime())
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / 100)).cast("bigint")
    o = o.with_df(o.df.join(sizes, "symbol"))
    o = o.where((F.col(RN) >= 20) & ((F.col(RN) - 20) % step == 0))
    o = o.frame(1, 0, lambda w: {"__prev": F.lag("regime").over(w)})
    changed = F.col("__prev").isNull() | (F.col("__prev") != F.col("regime"))
    return o.df.filter(changed).select("symbol", "ts", "regime")
