"""What became of plans and signals: bracket exits and forward returns.

Plans are never walked price by price: each barrier is found by a first-touch search in nodes of ordered prices and their extremes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthlens.functions.scalar import MAKER_FEE, TAKER_FEE, money_sum, r_multiple
from depthlens.operators.intervals import PriceTree, first_touch, last_price, price_tree, range_frame, task_count
from depthlens.operators.ordered import top_k
from depthlens.session import write_table


def _sided(side: Column, stop: Column, target: Column) -> dict[str, Column]:
    buy = side.isin("BUY", "long")
    return {"lo": F.when(buy, stop).otherwise(target), "hi": F.when(buy, target).otherwise(stop)}


def _sign(side: Column) -> Column:
    return F.when(side.isin("BUY", "long"), 1.0).otherwise(-1.0)


def _touch(df: DataFrame, prices: PriceTree, stop: str, target: str, prefix: str) -> DataFrame:
    t = first_touch(df.withColumns(_sided(F.col("side"), F.col(stop), F.col(target))), prices, "symbol", "plan_id")
    at_target = (F.col("touched") == "hi") == F.col("side").isin("BUY", "long")
    return t.withColumns({
        f"{prefix}_ts": F.col("touch_ts"), f"{prefix}_id": F.col("touch_id"), f"{prefix}_price": F.col("touch_price"),
        f"{prefix}_target": F.when(F.col("touched").isNotNull(), at_target),
    }).drop("lo", "hi", "touch_ts", "touch_id", "touch_price", "touched")


def _last_price(df: DataFrame, prices: PriceTree) -> DataFrame:
    """Last price of each plan's interval, NULL if none came after its start."""
    j = last_price(df, prices, "end_ms", "last_price", "last_ts")
    later = F.col("last_ts") > F.col("submit_ms")
    return j.withColumn("last_price", F.when(later, F.col("last_price"))).drop("last_ts")


def bracket_outcomes(plans: DataFrame, prices: DataFrame, max_hold_ms: int, tp1_share: float = 0.5,
                     fee: float = TAKER_FEE) -> DataFrame:
    """Outcome of bracket orders with a partial exit.

    ``plans``: symbol, plan_id, ts_ms, side (BUY/SELL), entry, stop, tp1, tp2, qty.  The order fills
    at its entry with the first later price.  Stops exit at the stop price, targets at the
    observed price; TP1 closes ``tp1_share`` and moves the stop to the entry.  One change per
    price.  R counts the initial risk.  Orders still open after ``max_hold_ms`` are valued at the last price.
    """
    tree = price_tree(prices, "symbol")
    base = plans.withColumns({"submit_ms": F.col("ts_ms"), "start_ms": F.col("ts_ms"),
                              "end_ms": F.col("ts_ms") + max_hold_ms}).drop("ts_ms")
    one = _touch(base, tree, "stop", "tp1", "a")
    # the second leg exists only after a first target; other plans get barriers of NULL
    hit = F.col("a_target")
    two = one.withColumns({
        "start_ms": F.coalesce("a_ts", "start_ms"), "start_id": F.col("a_id"),
        "__stop2": F.when(hit, F.col("entry")), "__tp2": F.when(hit, F.col("tp2"))})
    two = _touch(two, tree, "__stop2", "__tp2", "b")
    df = _last_price(two, tree)
    s, q, e = _sign(F.col("side")), F.col("qty"), F.col("entry")
    q1 = F.when(hit, q * tp1_share).otherwise(0.0)
    left = q - q1
    status = F.when(F.col("last_price").isNull(), "pending").when(~hit, "stopped_out").when(
        F.col("b_target"), "tp2_hit").when(~F.col("b_target"), "stopped_out").when(hit, "tp1_hit").otherwise("filled")
    exit_price = F.when(~hit, F.col("stop")).when(F.col("b_target"), F.col("b_price")).when(~F.col("b_target"), e)
    df = df.withColumns({"status": status, "exit_price": exit_price,
                         "exit_ms": F.when(~hit, F.col("a_ts")).otherwise(F.col("b_ts"))})
    mark = F.coalesce("exit_price", "last_price", F.col("entry"))
    done = F.col("exit_price").isNotNull()
    fees = F.when(F.col("status") == "pending", 0.0).otherwise(fee * (
        q * e + q1 * F.coalesce("a_price", F.lit(0.0)) + F.when(done, left * F.col("exit_price")).otherwise(0.0)))
    gross = s * (F.coalesce("a_price", F.lit(0.0)) - e) * q1 + s * (mark - e) * left
    df = df.withColumns({"fees": fees, "tp1_ms": F.when(hit, F.col("a_ts")), "tp1_price": F.when(hit, F.col("a_price"))})
    df = df.withColumn("pnl", F.when(F.col("status") == "pending", 0.0).otherwise(gross - F.col("fees")))
    df = df.withColumn("r_multiple", r_multiple(F.col("pnl"), F.abs(e - F.col("stop")) * q))
    return df.withColumn("closed", done).drop(
        "a_ts", "a_id", "a_price", "a_target", "b_ts", "b_id", "b_price", "b_target", "__stop2", "__tp2",
        "start_ms", "start_id", "end_ms")


def candle_positions(signals: DataFrame, equity: float = 10_000.0, risk: float = 0.01, stop_atr: float = 1.5,
                     tp1_r: float = 1.0, tp2_r: float = 2.0, slippage_bps: float = 1.0) -> DataFrame:
    """Positions opened by candle signals (symbol, plan_id, ts_ms, side long/short, price, atr)."""
    s, p = _sign(F.col("side")), F.col("price")
    df = signals.withColumn("stop", p - s * F.col("atr") * stop_atr)
    dist = F.abs(p - F.col("stop"))
    return df.filter(dist > 0).withColumns({
        "tp1": p + s * dist * tp1_r, "tp2": p + s * dist * tp2_r, "size": F.lit(equity * risk) / dist,
        "entry": p + s * p * (slippage_bps / 10_000.0)})


def position_outcomes(positions: DataFrame, prices: DataFrame, max_hold_ms: int) -> DataFrame:
    """Outcome without partial exits: stop / TP2 at the observed price; TP1 arms a breakeven exit
    at entry plus (minus) twice the entry fee per unit.  Maker fee in, taker fee out.
    """
    tree = price_tree(prices, "symbol")
    s, e, size = _sign(F.col("side")), F.col("entry"), F.col("size")
    base = positions.withColumns({"submit_ms": F.col("ts_ms"), "start_ms": F.col("ts_ms"),
                                  "end_ms": F.col("ts_ms") + max_hold_ms}).drop("ts_ms")
    base = base.withColumn("entry_fee", size * e * MAKER_FEE)
    base = base.withColumn("breakeven", e + s * (F.col("entry_fee") * 2.0 / size))
    one = _touch(base, tree, "stop", "tp1", "a")
    hit = F.col("a_target")
    # a first target that does not even cover the fees closes at once
    flat = hit & (s * (F.col("a_price") - F.col("breakeven")) <= 0)
    two = one.withColumns({
        "start_ms": F.coalesce("a_ts", "start_ms"), "start_id": F.col("a_id"), "__flat": F.coalesce(flat, F.lit(False)),
        "__be2": F.when(hit, F.col("breakeven")), "__tp2": F.when(hit, F.col("tp2"))})
    df = _last_price(_touch(two, tree, "__be2", "__tp2", "b"), tree)
    b = F.col("b_target")
    status = F.when(~hit, "stopped_out").when(F.col("__flat"), "breakeven").when(b, "tp2_hit").when(
        ~b, "breakeven").when(hit, "tp1_hit").otherwise("open")
    first = ~hit | F.col("__flat")
    df = df.withColumns({
        "status": status, "exit_price": F.when(first, F.col("a_price")).otherwise(F.col("b_price")),
        "exit_ms": F.when(first, F.col("a_ts")).otherwise(F.col("b_ts"))})
    exit_fee = F.coalesce(size * F.col("exit_price") * TAKER_FEE, F.lit(0.0))
    mark = F.coalesce("exit_price", "last_price", "entry")
    df = df.withColumns({"fee": F.col("entry_fee") + exit_fee, "closed": F.col("exit_price").isNotNull()})
    df = df.withColumn("pnl", s * (mark - e) * size - F.col("fee"))
    df = df.withColumn("r_multiple", r_multiple(F.col("pnl"), F.abs(e - F.col("stop")) * size))
    return df.drop("a_ts", "a_id", "a_price", "a_target", "b_ts", "b_id", "b_price", "b_target",
                   "__be2", "__tp2", "__flat", "start_ms", "start_id", "end_ms")


def account_equity(outcomes: DataFrame, start_equity: float) -> DataFrame:
    """Open / closed counts and equity = start + closed pnl + open pnl, per symbol."""
    closed = F.col("closed")
    return outcomes.groupBy("symbol").agg(
        F.count_if(closed).alias("closed_orders"), F.count_if(~closed).alias("open_orders"),
        F.coalesce(money_sum(F.when(closed, F.col("pnl"))), F.lit(0.0)).alias("closed_pnl"),
        F.coalesce(money_sum(F.when(~closed, F.col("pnl"))), F.lit(0.0)).alias("open_pnl"),
    ).withColumn("equity", F.lit(float(start_equity)) + F.col("closed_pnl") + F.col("open_pnl"))


# Horizons of the forward returns.
HORIZONS_MS = (15_000, 30_000, 60_000, 300_000, 900_000)


def forward_returns(signals: DataFrame, prices: DataFrame, signal_id: str, horizons=HORIZONS_MS,
                    keep: int | None = None) -> DataFrame:
    """Signed return, best and worst move of each signal within each horizon.

    ``signals``: symbol, ts_ms, side (BUY/SELL), price.  The return is that of the last price
    strictly before the horizon (NULL without any); ``realized`` once a later price exists.
    ``keep`` the newest signals per horizon (None: all).
    """
    newest = prices.groupBy("symbol").agg(F.max("ts_ms").alias("__end"))
    # one row a symbol: joined to the signals once, written, and not after each horizon has shuffled them
    ends = write_table(newest, "ends")
    signals = signals.join(ends, "symbol", "left")
    tasks, parts = task_count(signals), []
    for h in horizons:
        f = range_frame(prices, ["symbol"], "ts_ms", 0, h - 1, {
            "__last": ("last", F.col("price")), "__hi": ("max", F.col("price")), "__lo": ("min", F.col("price")),
        }, probes=signals, order=["ts_ms", "trade_id"], tasks=tasks)
        parts.append(f.withColumn("horizon_ms", F.lit(h).cast("bigint")))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    if keep is not None:
        df = top_k(df, ["horizon_ms"], [F.desc("ts_ms"), F.desc("symbol"), F.desc(signal_id)], keep, "__rank").drop("__rank")
    s, e = _sign(F.col("side")), F.col("price")
    best = F.when(s > 0, F.col("__hi")).otherwise(F.col("__lo"))
    worst = F.when(s > 0, F.col("__lo")).otherwise(F.col("__hi"))
    return df.withColumns({
        "ret": s * (F.col("__last") - e) / e,
        "mfe": F.greatest(s * (best - e) / e, F.lit(0.0)), "mae": F.least(s * (worst - e) / e, F.lit(0.0)),
        "realized": F.coalesce(F.col("__end") >= F.col("ts_ms") + F.col("horizon_ms"), F.lit(False)),
    }).drop("__last", "__hi", "__lo", "__end")
