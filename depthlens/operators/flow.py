"""Trade-flow features.  Trades: symbol, ts_ms, trade_id, price, qty, side ('buy'/'sell')."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthlens.functions.scalar import clamp, z_score
from depthlens.operators.fold import greedy_starts
from depthlens.operators.intervals import range_frame, range_table
from depthlens.operators.ordered import RN, Ordered, moving_deviation, order_rows, rolling_sum


def _is_buy() -> Column:
    return F.col("side") == "buy"


def _notional() -> Column:
    return F.col("price") * F.col("qty")


def ordered_trades(trades: DataFrame | Ordered) -> Ordered:
    if isinstance(trades, Ordered):
        return trades
    return order_rows(trades, ["symbol"], ["ts_ms", "trade_id"])


def _rows(trades: DataFrame | Ordered) -> DataFrame:
    return trades.result() if isinstance(trades, Ordered) else trades


# ---- running measures -----------------------------------------------------------------
def cumulative_delta(trades: DataFrame | Ordered) -> DataFrame:
    """Cumulative signed notional (``cvd``) after each trade."""
    signed = F.when(_is_buy(), _notional()).otherwise(-_notional())
    return ordered_trades(trades).running({"cvd": ("sum", signed)}).result()


def cvd_zscore(trades: DataFrame | Ordered, period: int = 20, history: int = 120) -> DataFrame:
    """z-score of the smoothed normalised volume delta, per distinct trade id.

    Like the other running features it also takes ``ordered_trades(...)``, so that several
    features share one ordering.
    """
    known = trades if isinstance(trades, Ordered) else None
    once = _first_per_id(_rows(trades))
    o = order_rows(once, ["symbol"], ["ts_ms", "trade_id"], within=known).running({
        "__buys": ("sum", F.when(_is_buy(), F.col("qty")).otherwise(0.0)),
        "__sells": ("sum", F.when(_is_buy(), 0.0).otherwise(F.col("qty"))),
    })
    o = o.where(F.col("__buys") + F.col("__sells") != 0)
    b, s = F.col("__buys"), F.col("__sells")
    o = o.col("cvd_norm", (b - s) / (b + s)).drop("__buys", "__sells")
    v = F.col("cvd_norm")
    alpha = 2.0 / (period + 1)
    o = o.scan({
        "ema_cvd": (F.lit(1.0 - alpha), v * alpha),
        "ema_mean": (F.lit(0.95), F.when(F.col(RN) == 0, 0.0).otherwise(v * 0.05)),
    })
    n = F.least(F.col(RN) + 1, F.lit(history))
    o = o.frame(history, 0, lambda w: {
        "__m1": rolling_sum(v, history, w) / n, "__m2": rolling_sum(v * v, history, w) / n})
    m = F.col("ema_mean")
    variance = F.greatest(F.col("__m2") - 2.0 * m * F.col("__m1") + m * m, F.lit(0.0))
    std = F.when(F.col(RN) == 0, 0.0).otherwise(F.sqrt(variance))
    warmup = F.least(F.col(RN) + 1, F.lit(60))
    return o.cols({"cvd_std": std, "warmup": warmup}).cols({
        "cvd_z": z_score(F.col("ema_cvd"), m, F.col("cvd_std")),
        "valid": F.col("warmup") >= 20,
    }).drop("__m1", "__m2").result()


def _first_per_id(trades: DataFrame) -> DataFrame:
    cols = [c for c in trades.columns if c not in ("symbol", "trade_id")]
    return trades.groupBy("symbol", "trade_id").agg(
        F.min(F.struct("ts_ms", *[c for c in cols if c != "ts_ms"])).alias("r")
    ).select("symbol", "trade_id", "r.*")


def price_velocity(trades: DataFrame | Ordered, period: int = 30, max_gap_ms: int = 10_000) -> DataFrame:
    """EMA of price speed in bps/s and its z-score over the last 30 values."""
    o = ordered_trades(trades).frame(1, 0, lambda w: {
        "__p": F.lag("price").over(w), "__t": F.lag("ts_ms").over(w)})
    dt = F.col("ts_ms") - F.col("__t")
    o = o.where((F.col("__p") > 0) & (dt > 0) & (dt <= max_gap_ms))
    speed = (F.col("price") - F.col("__p")) / F.col("__p") * 10_000.0 / (dt / 1000.0)
    alpha = 2.0 / (period + 1)
    o = o.col("bps_per_s", speed).ema({"velocity": (F.col("bps_per_s"), alpha)})
    o = o.frame(29, 0, lambda w: {
        "__m": F.avg("velocity").over(w.rowsBetween(-29, 0)),
        "__s": F.coalesce(F.stddev_samp("velocity").over(w.rowsBetween(-29, 0)), F.lit(0.0)),
    })
    enough = F.col(RN) >= 9
    return o.cols({
        "velocity_z": F.when(enough, z_score(F.col("velocity"), F.col("__m"), F.col("__s")))
        .otherwise(0.0),
        "valid": F.col(RN) >= 29,
    }).drop("__p", "__t", "__m", "__s").result()


def return_volatility(trades: DataFrame | Ordered, period: int = 20, history: int = 300) -> DataFrame:
    """EMA of the sample deviation of the last ``history`` simple returns, in bps."""
    o = ordered_trades(trades).frame(1, 0, lambda w: {"__p": F.lag("price").over(w)})
    o = o.where(F.col("__p") > 0)
    o = o.col("ret", (F.col("price") - F.col("__p")) / F.col("__p"))
    # centred moments per frame: differences of growing sums would cost digits here, and Spark takes a sliding frame row by row
    o = o.moving("__s", F.col("ret"), history - 1, lambda x: moving_deviation(x, history))
    o = o.ema({"__ema": (F.coalesce("__s", F.lit(0.0)), 2.0 / (period + 1))})
    # the first trade of a symbol has no return, so n returns mean n + 1 trades
    return o.cols({"volatility": F.col("__ema") * 10_000.0, "valid": F.col(RN) >= 28}).drop(
        "__p", "__s", "__ema").result()


def whale_tiers(trades: DataFrame | Ordered, bounds=(50_000.0, 200_000.0, 1_000_000.0)) -> DataFrame:
    """Size tier of each trade and running counts per tier."""
    n = _notional()
    tier = F.when(n > bounds[2], 3).when(n > bounds[1], 2).when(n > bounds[0], 1).otherwise(0)
    o = ordered_trades(trades).col("tier", tier)
    return o.running({
        f"tier{k}_count": ("sum", (F.col("tier") == k).cast("bigint")) for k in (1, 2, 3)
    }).result()


def trade_rates(trades: DataFrame | Ordered, windows_ms=(1000, 5000, 30_000)) -> DataFrame:
    """Trades of the symbol in the last windows (strictly younger than each window)."""
    trades = _rows(trades)
    key = ["symbol", "ts_ms"]
    rates = None
    for i, ms in enumerate(windows_ms):
        one = range_table(trades, ["symbol"], "ts_ms", ms - 1, 0, {f"rate_{i}": ("count", F.lit(1))})
        rates = one if rates is None else rates.join(one, key)
    return trades.join(rates, key, "left")


def recent_vwap(trades: DataFrame | Ordered, n: int = 100, at_least: int = 10) -> DataFrame:
    """Volume-weighted price of the last ``n`` trades; NULL below ``at_least`` trades."""
    o = ordered_trades(trades).frame(n, 0, lambda w: {
        "__pv": rolling_sum(_notional(), n, w), "__v": rolling_sum(F.col("qty"), n, w)})
    value = F.when((F.col(RN) + 1 >= at_least) & (F.col("__v") > 0), F.col("__pv") / F.col("__v"))
    return o.col("vwap", value).drop("__pv", "__v").result()


def liquidation_counts(liqs: DataFrame, window_ms: int = 60_000) -> DataFrame:
    return range_frame(liqs, ["symbol"], "ts_ms", window_ms, 0, {
        "long_count": ("sum", (F.col("side") == "long").cast("bigint")),
        "short_count": ("sum", (F.col("side") != "long").cast("bigint")),
    })


def liquidity_pools(vwaps: DataFrame, leverages=(10, 20, 50, 100)) -> DataFrame:
    """Price levels vwap +- vwap/leverage where leveraged positions would be closed."""
    v = F.col("vwap")
    rows = F.array(*[F.struct(
        F.lit(lev).alias("leverage"), (v + v / float(lev)).alias("upper"),
        (v - v / float(lev)).alias("lower")) for lev in leverages])
    return vwaps.filter(v.isNotNull()).select("*", F.inline(rows))


def pool_notional(pools: DataFrame, open_interest: DataFrame) -> DataFrame:
    """Split long / short open interest (symbol, oi_long, oi_short) evenly over the pools."""
    n = F.lit(4.0)
    return pools.join(open_interest, "symbol", "left").withColumns({
        "long_notional": F.col("oi_long") / n, "short_notional": F.col("oi_short") / n})


def latest_price(trades: DataFrame | Ordered, marks: DataFrame) -> DataFrame:
    """Last price per symbol from trades or mark prices (columns symbol, ts_ms, seq, price)."""
    trades = _rows(trades)
    both = trades.select("symbol", "ts_ms", F.col("trade_id").alias("seq"), "price", F.lit(
        "trade").alias("source")).unionByName(
        marks.select("symbol", "ts_ms", "seq", "price", F.lit("mark").alias("source")))
    at = F.struct("ts_ms", "seq")
    return both.groupBy("symbol").agg(
        F.max_by("price", at).alias("price"), F.max_by("source", at).alias("source"),
        F.max("ts_ms").alias("ts_ms"))


# ---- bars -----------------------------------------------------------------------------------
def _bar_columns():
    at = F.struct("ts_ms", "trade_id")
    return [
        F.min_by("price", at).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("qty").alias("volume"),
        F.sum(F.when(_is_buy(), F.col("qty")).otherwise(0.0)).alias("buy_volume"),
        F.sum(F.when(_is_buy(), 0.0).otherwise(F.col("qty"))).alias("sell_volume"),
    ]


def _bar_measures(bars: DataFrame) -> DataFrame:
    d, v = F.col("delta"), F.col("volume")
    return bars.withColumn("delta", F.col("buy_volume") - F.col("sell_volume")).withColumns({
        "pressure": F.when(v > 0, clamp(d / F.nullif(v, F.lit(0.0)), -1, 1)).otherwise(0.0),
        "absorption": F.when(v > 0, 1.0 - F.abs(d) / F.nullif(v, F.lit(0.0))).otherwise(0.0),
        "poc": (F.col("high") + F.col("low")) / 2.0,
    })


def time_bars(trades: DataFrame | Ordered, bucket_ms: int = 5000) -> DataFrame:
    """Flow bars on the aligned grid: symbol, bar_ts, OHLC, volumes, delta, pressure, ..."""
    trades = _rows(trades)
    grid = F.expr(f"ts_ms div {bucket_ms} * {bucket_ms}").alias("bar_ts")
    return _bar_measures(trades.groupBy("symbol", grid).agg(*_bar_columns()))


def idle_closes(trades: DataFrame | Ordered, bucket_ms: int = 5000) -> DataFrame:
    """Time bars with ``close_ts`` and whether silence (no trade for a bucket) closed them."""
    trades = _rows(trades)
    grid = F.expr(f"ts_ms div {bucket_ms} * {bucket_ms}").alias("bar_ts")
    bars = trades.groupBy("symbol", grid).agg(
        F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"))
    o = order_rows(bars, ["symbol"], ["bar_ts"]).frame(
        0, 1, lambda w: {"next_ts": F.lead("first_ts").over(w)})
    silent = F.col("next_ts") - F.col("last_ts") > bucket_ms
    return o.cols({
        "idle": F.coalesce(silent, F.lit(True)),
        "close_ts": F.when(F.coalesce(silent, F.lit(True)), F.col("last_ts") + bucket_ms)
        .otherwise(F.col("next_ts")),
    }).result()


def threshold_bars(trades: DataFrame | Ordered, size: float, measure: Column | None = None) -> DataFrame:
    """Bars that close with the trade at which ``measure`` (default qty) reaches ``size``."""
    measure = F.col("qty") if measure is None else measure
    o = ordered_trades(trades).col("__m", measure)
    o = o.running({"__before": ("sum", F.col("__m"))}, inclusive=False)
    o = o.col("__before", F.coalesce("__before", F.lit(0.0)))
    o = greedy_starts(o, "__before", size, "__start")
    o = o.running({"bar": ("sum", F.col("__start").cast("bigint"))})
    bars = o.df.groupBy("symbol", "bar").agg(
        F.min("ts_ms").alias("bar_ts"), *_bar_columns(), F.sum("__m").alias("measure"))
    return _bar_measures(bars).withColumn("complete", F.col("measure") >= size)


def signal_bars(
    trades: DataFrame | Ordered,
    liqs: DataFrame,
    mode: str = "aligned",
    bucket_ms: int = 5000,
    size: float = 1_000_000.0,
) -> DataFrame:
    """Notional flow bars with pressure / strength in percent and liquidation counts.

    mode: ``aligned`` (fixed grid), ``anchored`` (a bar starts at its first event) or
    ``notional`` (a bar closes when its notional reaches ``size``).
    """
    trades = _rows(trades)
    n = _notional()
    rows = trades.select("symbol", "ts_ms", "trade_id", "price", F.lit(0).alias("kind"),
                         F.when(_is_buy(), n).otherwise(0.0).alias("buys"),
                         F.when(_is_buy(), 0.0).otherwise(n).alias("sells"))
    rows = rows.unionByName(liqs.select("symbol", "ts_ms", "trade_id", F.lit(1).alias("kind")),
                            allowMissingColumns=True)
    if mode == "aligned":
        bars = rows.groupBy("symbol", F.expr(f"ts_ms div {bucket_ms}").alias("bar"))
    else:
        o = order_rows(rows, ["symbol"], ["ts_ms", "kind", "trade_id"])
        if mode == "anchored":
            o = greedy_starts(o, "ts_ms", bucket_ms, "__start")
        else:
            total = F.coalesce(F.col("buys") + F.col("sells"), F.lit(0.0))
            o = o.running({"__before": ("sum", total)}, inclusive=False)
            o = greedy_starts(o.col("__before", F.coalesce("__before", F.lit(0.0))),
                              "__before", size, "__start")
        bars = o.running({"bar": ("sum", F.col("__start").cast("bigint"))}).df.groupBy(
            "symbol", "bar")
    bars = bars.agg(
        F.min("ts_ms").alias("bar_ts"), F.max("ts_ms").alias("end_ts"),
        F.coalesce(F.sum("buys"), F.lit(0.0)).alias("buys"),
        F.coalesce(F.sum("sells"), F.lit(0.0)).alias("sells"),
        F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", F.when(F.col("kind") == 0, F.struct("ts_ms", "trade_id"))).alias("close"),
        F.sum(F.col("kind").cast("bigint")).alias("liq_count"),
    )
    d, v = F.col("delta"), F.col("volume")
    return bars.withColumns({
        "delta": F.col("buys") - F.col("sells"), "volume": F.col("buys") + F.col("sells"),
    }).filter("volume > 0").withColumns({
        "pressure": clamp(d / v * 100.0, -100, 100),
        "strength": clamp(F.abs(d) / v * 100.0, 0, 100),
    })


# ---- VPIN -------------------------------------------------------------------------------------
def volume_buckets(trades: DataFrame | Ordered, bucket: float) -> DataFrame:
    """Equal-volume buckets; a trade of any size is split where it crosses a bucket edge.

    Edges are multiples of ``bucket`` on the running volume; a bucket is complete once the running volume has reached
    its end.  Trades without a positive size fill nothing.
    """
    qty, size = F.col("qty").cast("double"), F.lit(float(bucket))
    if isinstance(trades, Ordered):
        o = trades.where(qty > 0)
    else:
        o = ordered_trades(trades.filter("qty > 0"))
    o = o.running({"__end": ("sum", qty)})
    lo, hi, k = F.col("__end") - qty, F.col("__end"), F.col("bucket").cast("double")
    first = F.floor(lo / size)
    parts = o.df.withColumn("bucket", F.explode(F.sequence(first, F.greatest(first, F.ceil(hi / size) - 1))))
    part = F.greatest(F.lit(0.0), F.least(hi, (k + 1) * size) - F.greatest(lo, k * size))
    return parts.groupBy("symbol", "bucket").agg(
        F.sum(F.when(_is_buy(), part).otherwise(0.0)).alias("buys"),
        F.sum(F.when(_is_buy(), 0.0).otherwise(part)).alias("sells"),
        F.max("ts_ms").alias("ts_ms"), F.max("trade_id").alias("trade_id"), F.max("__end").alias("__reached"),
    ).withColumn("complete", F.col("__reached") >= (k + 1) * size).drop("__reached")


def vpin(trades: DataFrame | Ordered, bucket: float = 100_000, keep: int = 50, warm: int = 20) -> DataFrame:
    """Mean order imbalance of the last ``keep`` full volume buckets, at each bucket close."""
    full = volume_buckets(trades, bucket).filter("complete").withColumn(
        "imbalance", F.abs(F.col("buys") - F.col("sells")) / F.lit(float(bucket)))
    return _mean_of_last(full, "imbalance", "bucket", keep, warm)


def notional_vpin(trades: DataFrame | Ordered, size: float = 500_000.0, keep: int = 50) -> DataFrame:
    """VPIN over unsplit notional buckets that close at ``size``."""
    by_value = trades.col("qty", _notional()) if isinstance(trades, Ordered) else trades.withColumn("qty", _notional())
    bars = threshold_bars(by_value, size, F.col("qty")).filter("complete")
    bars = bars.withColumn("imbalance", F.abs(F.col("delta")) / F.col("volume"))
    return _mean_of_last(bars, "imbalance", "bar", keep, 1)


def _mean_of_last(rows: DataFrame, value: str, order: str, keep: int, warm: int) -> DataFrame:
    o = order_rows(rows, ["symbol"], [order]).frame(keep - 1, 0, lambda w: {
        "vpin": F.avg(value).over(w.rowsBetween(1 - keep, 0))})
    warmup = F.least(F.col(RN) + 1, F.lit(keep))
    return o.cols({"warmup": warmup, "valid": warmup >= warm}).result()


def price_spread(trades: DataFrame | Ordered) -> DataFrame:
    """Median, sample deviation, MAD and scaled MAD of the price per symbol.

    Prices are first counted per distinct price (map-side), so a busy symbol reaches the
    exact percentile as a short histogram.
    """
    trades = _rows(trades)
    ticks = trades.groupBy("symbol", "price").agg(F.count("*").alias("n"))
    center = ticks.groupBy("symbol").agg(F.percentile("price", 0.5, F.col("n")).alias("median"))
    away = ticks.join(center, "symbol").withColumn("dev", F.abs(F.col("price") - F.col("median")))
    mads = away.groupBy("symbol").agg(
        F.first("median").alias("median"), F.percentile("dev", 0.5, F.col("n")).alias("mad"))
    stds = trades.groupBy("symbol").agg(F.stddev_samp("price").alias("std"))
    return mads.join(stds, "symbol").withColumn("robust_std", F.col("mad") * 1.4826)
