"""Replay summaries, parameter grids and walk-forward analysis over candles."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthlens.operators import candles as cn
from depthlens.operators.ordered import RN, order_rows
from depthlens.plans.performance import max_drawdown


# ---- replay -----------------------------------------------------------------------------------
def replay_snapshots(candles: DataFrame, outcomes: DataFrame, start_equity: float = 10_000.0,
                     start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Per candle: regime, open positions and equity from the outcomes closed by then.

    ``outcomes``: symbol, plan_id, submit_ms, exit_ms, pnl, closed.  Entries and exits join the candles as events of
    one running sum.
    """
    c = cn.regimes(candles).select("symbol", "ts", "c", "regime")
    if start_ms is not None:
        c = c.filter(F.col("ts") >= start_ms)
    if end_ms is not None:
        c = c.filter(F.col("ts") <= end_ms)
    rows = c.select("symbol", F.col("ts").alias("at"), F.lit(2).alias("k"), F.lit(0).cast("bigint").alias("id"), "c", "regime")
    opens = outcomes.select("symbol", F.col("submit_ms").alias("at"), F.lit(0).alias("k"), F.col("plan_id").alias("id"), F.lit(1).alias("n"))
    closes = outcomes.filter("closed").select(
        "symbol", F.col("exit_ms").alias("at"), F.lit(1).alias("k"), F.col("plan_id").alias("id"), F.lit(-1).alias("n"), "pnl")
    every = rows.unionByName(opens, allowMissingColumns=True).unionByName(closes, allowMissingColumns=True)
    o = order_rows(every, ["symbol"], ["at", "k", "id"]).running({"open_positions": ("sum", F.col("n")), "__pnl": ("sum", F.col("pnl"))})
    return o.df.filter("k = 2").select(
        "symbol", F.col("at").alias("ts"), "c", "regime", F.coalesce("open_positions", F.lit(0)).alias("open_positions"),
        (F.lit(float(start_equity)) + F.coalesce("__pnl", F.lit(0.0))).alias("equity"))


def replay_summary(snapshots: DataFrame, outcomes: DataFrame, start_equity: float = 10_000.0) -> DataFrame:
    """Return, drawdown, Sharpe (252) of candle returns, trades, win rate and a checksum per symbol.

    The checksum combines the CRC of every snapshot's JSON by XOR, so it does not depend on
    the order in which tasks finish.
    """
    o = order_rows(snapshots, ["symbol"], ["ts"]).running({"__peak": ("max", F.col("equity"))})
    o = o.frame(1, 0, lambda w: {"__p": F.lag("c").over(w)})
    ret = F.when(F.col("__p") > 0, F.col("c") / F.col("__p") - 1.0)
    peak = F.greatest("__peak", F.lit(float(start_equity)))
    crc = F.crc32(F.to_json(F.struct("symbol", "ts", "equity", "open_positions", "regime")).cast("binary"))
    agg = o.df.withColumn("__r", F.nullif(ret, F.lit(0.0))).groupBy("symbol").agg(
        F.max_by("equity", "ts").alias("final_equity"), F.max((peak - F.col("equity")) / peak).alias("max_drawdown"),
        F.avg("__r").alias("__m"), F.stddev_samp("__r").alias("__s"), F.count("*").alias("snapshots"),
        F.lower(F.lpad(F.hex(F.bit_xor(crc)), 8, "0")).alias("checksum"))
    closed = outcomes.filter("closed").groupBy("symbol").agg(
        F.count("*").alias("total_trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))
    return agg.join(closed, "symbol", "left").withColumns({
        "total_return": F.col("final_equity") / float(start_equity) - 1.0,
        "sharpe": F.coalesce(F.col("__m") / F.nullif(F.col("__s"), F.lit(0.0)) * (252.0 ** 0.5), F.lit(0.0)),
        "total_trades": F.coalesce("total_trades", F.lit(0)), "win_rate": F.coalesce("win_rate", F.lit(0.0)),
    }).drop("__m", "__s")


# ---- parameter grids ----------------------------------------------------------------------------
# A rule gives the side (1 long, -1 short, 0 none) from the indicator columns and parameters.
def band_rule(p: Mapping[str, Column]) -> Column:
    """Fade closes ``mult`` deviations away from the 20-candle mean."""
    far = F.col("sd_20") * p["mult"]
    ready = F.col(RN) >= 19
    return F.when(ready & (F.col("c") <= F.col("sma_20") - far), 1).when(
        ready & (F.col("c") >= F.col("sma_20") + far), -1).otherwise(0)


def rule_inputs(candles: DataFrame, hold: int = 5):
    """Indicators of the rules and the return of holding for ``hold`` candles."""
    o = cn.ordered_candles(candles)
    return o.frame(19, hold, lambda w: {
        "sma_20": F.avg("c").over(w.rowsBetween(-19, 0)), "sd_20": F.stddev_pop("c").over(w.rowsBetween(-19, 0)),
        "fwd": F.lead("c", hold).over(w) / F.col("c") - 1.0}).df


def grid(df: DataFrame, ranges: Mapping[str, tuple[float, float]], steps: int = 5) -> DataFrame:
    """Every row once per parameter combination (all parameters, evenly spaced steps)."""
    for name, (low, high) in ranges.items():
        step = (high - low) / max(steps - 1, 1)
        df = df.withColumn(name, F.explode(F.array(*[F.lit(low + step * i) for i in range(steps)])))
    return df


def _grid_trades(inputs: DataFrame, ranges, rule, steps: int) -> DataFrame:
    df = grid(inputs, ranges, steps)
    side = rule({n: F.col(n) for n in ranges})
    return df.withColumn("side", side).filter("side <> 0 and fwd is not null").withColumn("ret", F.col("side") * F.col("fwd"))


def _grid_metrics(trades: DataFrame, by: list[str], equity: float) -> DataFrame:
    r = F.col("ret")
    m = trades.groupBy(*by).agg(
        F.count("*").alias("total_trades"), F.avg((r > 0).cast("double")).alias("win_rate"),
        F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("__g"), F.coalesce(F.sum(F.when(r <= 0, -r)), F.lit(0.0)).alias("__l"),
        F.avg(r).alias("__m"), F.stddev_pop(r).alias("__s"))
    dd = max_drawdown(trades.withColumn("pnl", r * float(equity)), by, ["ts"], equity).drop("max_fall")
    return m.join(dd, by).withColumns({
        "sharpe": F.coalesce(F.col("__m") / F.nullif(F.col("__s"), F.lit(0.0)) * (252.0 ** 0.5), F.lit(0.0)),
        # NULL stands for "no losing trade"
        "profit_factor": F.col("__g") / F.nullif(F.col("__l"), F.lit(0.0)),
    }).drop("__g", "__l", "__m", "__s")


def calibrate(candles: DataFrame, ranges: Mapping[str, tuple[float, float]], rule: Callable = band_rule,
              steps: int = 5, hold: int = 5, equity: float = 10_000.0) -> DataFrame:
    """Back-test the rule for every parameter set: one row per symbol and set, zeros where it never traded."""
    trades = _grid_trades(rule_inputs(candles, hold), ranges, rule, steps)
    every = grid(candles.select("symbol").distinct(), ranges, steps)
    return _completed(every, _grid_metrics(trades, ["symbol", *ranges], equity), ["symbol", *ranges])


def _completed(every: DataFrame, metrics: DataFrame, by: list[str]) -> DataFrame:
    """All rows of ``every`` with their metrics; without a trade counts, rates and drawdowns are 0."""
    zero = ["win_rate", "sharpe", "max_drawdown", "profit_factor"]
    none = F.col("total_trades").isNull()
    out = every.join(metrics, by, "left")
    out = out.withColumns({c: F.when(none, 0.0).otherwise(F.col(c)) for c in zero})
    return out.na.fill(0, ["total_trades"])


def best_result(results: DataFrame, by: list[str], params: list[str]) -> DataFrame:
    """Highest Sharpe per group; the smallest parameters win a tie."""
    rest = [c for c in results.columns if c not in by]
    key = F.struct("sharpe", *[(-F.col(p)).alias(f"__{p}") for p in params])
    return results.groupBy(*by).agg(F.max_by(F.struct(*rest), key).alias("b")).select(*by, "b.*")


# ---- walk-forward ----------------------------------------------------------------------------------
def walk_forward(candles: DataFrame, ranges: Mapping[str, tuple[float, float]], size: int, step: int,
                 train_ratio: float = 0.7, rule: Callable = band_rule, steps: int = 3, hold: int = 5,
                 equity: float = 10_000.0) -> DataFrame:
    """Per symbol and window: the best parameters on the train part and their result on the test part.

    A candle's windows follow from its row number.  Every window and parameter set has a result; without trades it is
    zero, and among equal results the first parameters win.
    """
    train = int(size * train_ratio)
    if train < 20 or size - train < 5:
        raise ValueError("window too short: needs 20 train and 5 test candles")
    params = list(ranges)
    inputs = rule_inputs(candles, hold)
    n = candles.groupBy("symbol").agg(F.count("*").alias("__n"))
    trades = _grid_trades(inputs, ranges, rule, steps).join(n, "symbol")
    first = F.greatest(F.lit(0), F.ceil((F.col(RN) - size + 1) / step)).cast("bigint")
    last = F.least(F.floor(F.col(RN) / step), F.floor((F.col("__n") - size) / step)).cast("bigint")
    placed = trades.filter((F.col("__n") >= size) & (first <= last)).withColumn(
        "window", F.explode(F.sequence(first, last)))
    offset = F.col(RN) - F.col("window") * step
    # a holding period must end inside its part
    ends_in = F.when(offset < train, offset + hold < train).otherwise(offset + hold < size)
    placed = placed.withColumn("part", F.when(offset < train, "train").otherwise("test")).filter(ends_in)
    windows = n.filter(F.col("__n") >= size).select(
        "symbol", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - size) / step).cast("bigint"))).alias("window"))
    every = grid(windows, ranges, steps).withColumn("part", F.explode(F.array(F.lit("train"), F.lit("test"))))
    by = ["symbol", "window", "part", *params]
    m = _completed(every, _grid_metrics(placed, by, equity), by)
    best = best_result(m.filter("part = 'train'").drop("part"), ["symbol", "window"], params)
    best = best.select("symbol", "window", *params, F.col("sharpe").alias("train_sharpe"))
    test = m.filter("part = 'test'").select("symbol", "window", *params, F.col("sharpe").alias("test_sharpe"),
                                            F.col("win_rate").alias("test_win_rate"), F.col("max_drawdown").alias("test_drawdown"),
                                            F.col("total_trades").alias("test_trades"))
    return best.join(test, ["symbol", "window", *params], "left").na.fill(
        0.0, ["test_sharpe", "test_win_rate", "test_drawdown"]).na.fill(0, ["test_trades"])


def walk_forward_summary(windows: DataFrame) -> DataFrame:
    """Mean out-of-sample Sharpe and win rate, worst drawdown, and whether it is robust."""
    a = windows.groupBy("symbol").agg(
        F.count("*").alias("windows"), F.avg("test_sharpe").alias("sharpe"), F.stddev_pop("test_sharpe").alias("__s"),
        F.max("test_drawdown").alias("max_drawdown"), F.avg("test_win_rate").alias("win_rate"))
    robust = (F.col("sharpe") > 0) & (F.col("__s") < F.abs("sharpe") * 0.5) & (F.col("windows") >= 3)
    return a.withColumn("robust", robust).drop("__s")


def export_report(df: DataFrame, path: str) -> None:
    """Write report rows as JSON lines."""
    df.write.mode("overwrite").json(path)
