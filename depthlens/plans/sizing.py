"""Position size, leverage and portfolio limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthlens.functions.scalar import money_sum


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def fixed_fraction(equity, risk_fraction, entry: Column, stop: Column, win_rate=0.5, win_loss=2.0,
                   max_fraction=1.0) -> Column:
    """Struct(qty, notional, risk_amount, kelly): fixed-fraction size with a notional cap."""
    eq, p, b = _c(equity), _c(win_rate), _c(win_loss)
    risk = eq * _c(risk_fraction)
    unit = F.abs(entry - stop)
    cap = eq * _c(max_fraction)
    qty = F.least(risk / F.nullif(unit, F.lit(0.0)), cap / entry)
    kelly = F.when(b > 0, F.greatest((p * b - (1.0 - p)) / F.nullif(b, F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    some = unit > 0
    return F.struct(F.when(some, qty).otherwise(0.0).alias("qty"), F.when(some, qty * entry).otherwise(0.0).alias("notional"),
                    risk.alias("risk_amount"), F.when(some, kelly).otherwise(0.0).alias("kelly"))


def kelly_chain(win_rate, rr: Column, conf: Column, capital, max_risk: float = 0.02) -> Column:
    """Struct of the steps: kelly, half, scaled by confidence, capped, and the amount."""
    w = _c(win_rate)
    kelly = F.greatest(w - (1.0 - w) / rr, F.lit(0.0))
    scaled = kelly / 2.0 * (conf / 100.0)
    final = F.least(scaled, F.lit(max_risk))
    return F.struct(kelly.alias("kelly"), (kelly / 2.0).alias("half"), scaled.alias("scaled"),
                    final.alias("fraction"), (final * _c(capital)).alias("amount"))


# Maintenance margin by position notional (above the bound).
MARGIN_TIERS = ((1_000_000.0, 0.025), (250_000.0, 0.01), (50_000.0, 0.005), (0.0, 0.004))


def maintenance_margin(notional: Column) -> Column:
    out = F.lit(MARGIN_TIERS[-1][1])
    for bound, rate in reversed(MARGIN_TIERS[:-1]):
        out = F.when(notional > bound, rate).otherwise(out)
    return out


def leveraged_positions(plans: DataFrame, balance: float = 1000.0, risk_pct: float = 2.0, max_leverage: float = 20.0,
                        fee_bps: float = 4.0, funding: float = 0.0, win_rate: float = 0.55) -> DataFrame:
    """Half-Kelly leveraged position of each plan (direction, entry, stop, rr, conf [, vpin]).

    Plans with a negative Kelly fraction or no risk are dropped.
    """
    entry, long = F.col("entry"), F.col("direction") == "LONG"
    unit = F.abs(entry - F.col("stop"))
    raw = F.lit(win_rate) - (1.0 - win_rate) / F.col("rr")
    df = plans.withColumn("__raw", raw).filter((F.col("__raw") >= 0) & (unit > 0))
    df = df.withColumn("kelly", F.col("__raw") * (F.col("conf") / 100.0))
    df = df.withColumn("risk_pct", F.least(F.col("kelly") * 100.0 / 2.0, F.lit(risk_pct)))
    df = df.withColumn("qty", F.col("risk_pct") / 100.0 * balance / unit)
    df = df.withColumn("notional", F.col("qty") * entry)
    df = df.withColumn("leverage", F.greatest(F.least(F.col("notional") / balance, F.lit(max_leverage)), F.lit(1.0)))
    n, lev, mmr = F.col("notional"), F.col("leverage"), maintenance_margin(F.col("notional"))
    toxic = (F.col("vpin") > 0.7) if "vpin" in plans.columns else F.lit(False)
    return df.withColumns({
        "margin": n / lev,
        "breakeven": F.when(F.col("qty") > 0, n * (fee_bps / 10_000.0) * 2.0 / F.nullif(F.col("qty"), F.lit(0.0))).otherwise(0.0),
        "liquidation": F.when(long, entry * (1.0 - 1.0 / lev + mmr)).otherwise(entry * (1.0 + 1.0 / lev - mmr)),
        "funding_cost": n * abs(funding),
        "order_type": F.when(toxic, "LIMIT ONLY").otherwise("MARKET"),
    }).drop("__raw")


# ---- candle-strategy sizing ----------------------------------------------------------------
def risk_size(equity, risk_fraction, entry: Column, stop: Column) -> Column:
    none = (entry == stop) | (entry == 0)
    return F.when(none, 0.0).otherwise(_c(equity) * _c(risk_fraction) / F.nullif(F.abs(entry - stop), F.lit(0.0)))


def atr_stop(side: Column, price: Column, atr: Column, multiple: float) -> Column:
    return F.when(side == "long", price - atr * multiple).otherwise(price + atr * multiple)


def r_targets(side: Column, price: Column, stop: Column, tp1_r: float, tp2_r: float) -> Column:
    risk = F.abs(price - stop)
    sign = F.when(side == "long", 1.0).otherwise(-1.0)
    return F.struct((price + sign * risk * tp1_r).alias("tp1"), (price + sign * risk * tp2_r).alias("tp2"))


# ---- portfolio limits -------------------------------------------------------------------------
def portfolio_check(plans: DataFrame, accounts: DataFrame) -> DataFrame:
    """Adds allowed, reason and adjustment (the factor to scale the risk by), in rule order.

    ``plans``: account, risk_amount.  ``accounts`` (one row per account): open_positions,
    total_risk, daily_pnl, max_daily_loss, max_positions, equity, max_risk_per_trade,
    max_correlation, correlation_exposure.  ``sized_risk`` is the risk after adjustment.
    """
    j = plans.join(accounts, "account", "left")
    risk, cap = F.col("risk_amount"), F.col("equity") * 0.1
    room = cap - F.col("total_risk")
    single = F.col("equity") * F.col("max_risk_per_trade")
    over_all, over_one = F.col("total_risk") + risk > cap, risk > single
    reason = (F.when(F.col("open_positions") >= F.col("max_positions"), "max_positions")
              .when(F.col("daily_pnl") <= -F.col("max_daily_loss"), "daily_loss_limit")
              .when(over_all & (room <= 0), "portfolio_risk_full")
              .when(over_all, "portfolio_risk_reduced")
              .when(over_one, "risk_capped")
              .when(F.col("correlation_exposure") > F.col("max_correlation"), "correlation_exceeded"))
    j = j.withColumn("reason", reason)
    allowed = F.col("reason").isNull() | F.col("reason").isin("portfolio_risk_reduced", "risk_capped")
    factor = F.when(F.col("reason") == "portfolio_risk_reduced", room / risk).when(
        F.col("reason") == "risk_capped", single / risk)
    return j.withColumns({"allowed": allowed, "adjustment": factor}).withColumn(
        "sized_risk", F.when(F.col("allowed"), risk * F.coalesce("adjustment", F.lit(1.0))).otherwise(0.0))


def open_positions_at(positions: DataFrame, probes: DataFrame, probe_id: str) -> DataFrame:
    """Positions open when each probe arrives: count, longs, shorts, realised pnl so far and ``day_pnl`` (that of the
    probe's UTC day alone).

    ``positions``: symbol, entry_ms, exit_ms (NULL = open), side (long/short), pnl, position_id.
    Opens and closes become +1/-1 events in one running sum: no join of positions with probes.
    """
    from depthlens.operators.ordered import order_rows
    money = "decimal(28,10)"  # summed exactly, whatever the order
    one = F.when(F.col("side") == "long", 1).otherwise(0)
    opens = positions.select("symbol", F.col("entry_ms").alias("ts_ms"), F.lit(1).alias("__k"), F.col("position_id").alias("__id"),
                             F.lit(1).alias("__n"), one.alias("__l"), F.lit(0).cast(money).alias("__p"))
    closes = positions.filter("exit_ms is not null").select(
        "symbol", F.col("exit_ms").alias("ts_ms"), F.lit(0).alias("__k"), F.col("position_id").alias("__id"),
        F.lit(-1).alias("__n"), (-one).alias("__l"), F.col("pnl").cast(money).alias("__p"))
    asks = probes.select("symbol", "ts_ms", F.lit(2).alias("__k"), F.col(probe_id).alias("__id"),
                         F.struct(*[c for c in probes.columns if c not in ("symbol", "ts_ms")]).alias("__row"))
    rows = opens.unionByName(closes).unionByName(asks, allowMissingColumns=True)
    o = order_rows(rows, ["symbol"], ["ts_ms", "__k", "__id"]).running({
        "open_count": ("sum", F.col("__n")), "open_longs": ("sum", F.col("__l")), "realized_pnl": ("sum", F.col("__p"))})
    out = o.df.filter("__k = 2").select("symbol", "ts_ms", "__row.*", *[
        F.coalesce(c, F.lit(0)).alias(c) for c in ("open_count", "open_longs")],
        F.coalesce(F.col("realized_pnl").cast("double"), F.lit(0.0)).alias("realized_pnl"))
    out = out.withColumn("open_shorts", F.col("open_count") - F.col("open_longs"))
    keep = ["symbol", "ts_ms", "__k", "__id", "__p"]
    today = closes.select(keep).unionByName(asks.withColumn("__p", F.lit(0).cast(money)).select(keep))
    today = today.withColumn("__day", F.floor(F.col("ts_ms") / 86_400_000))
    day = order_rows(today, ["symbol", "__day"], ["ts_ms", "__k", "__id"], within=o).running({"day_pnl": ("sum", F.col("__p"))})
    day = day.df.filter("__k = 2").select("symbol", F.col("__id").alias(probe_id), F.col("day_pnl").cast("double").alias("day_pnl"))
    return out.join(day, ["symbol", probe_id])


def risk_check(probes: DataFrame, equity: float = 10_000.0, max_open: int = 5, max_daily_loss: float = 0.03,
               max_correlation: float = 0.5) -> DataFrame:
    """Allowed unless too many positions are open, the day's loss limit is hit, or one side is full.

    ``probes``: rows of open_positions_at with side (long/short).
    """
    import math
    limit = math.ceil(max_correlation * max_open)
    same = F.when(F.col("side") == "long", F.col("open_longs")).otherwise(F.col("open_shorts"))
    reason = (F.when(F.col("open_count") >= max_open, "max_open")
              .when(F.col("day_pnl") <= -equity * max_daily_loss, "daily_loss")
              .when(same >= limit, "same_direction"))
    return probes.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def portfolio_heat(positions: DataFrame, equity: float) -> DataFrame:
    """Open risk over equity per account (account, entry, stop, size)."""
    risk = money_sum(F.abs(F.col("entry") - F.col("stop")) * F.col("size"))
    return positions.groupBy("account").agg(
        (F.when(F.lit(equity) == 0, 0.0).otherwise(risk / F.nullif(F.lit(float(equity)), F.lit(0.0)))).alias("heat"))
