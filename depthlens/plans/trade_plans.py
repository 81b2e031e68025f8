"""Trade plans: levels, net reward, admission and life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthlens.functions import books as bk
from depthlens.functions.scalar import round_half_up
from depthlens.operators import signals as sg
from depthlens.operators.fold import greedy_starts
from depthlens.operators.intervals import asof
from depthlens.operators.ordered import RN, order_rows


def trade_plan(
    side: Column, entry: Column, spread: Column, wall: Column, slippage_bps: float = 1.0,
    tp1_r: float = 1.5, tp2_r: float = 2.5, min_rr: float = 2.0,
) -> Column:
    """Struct(entry, stop, tp1, tp2, rr), NULL when the risk is zero or rr below ``min_rr``.

    The stop lies beyond the wall by one spread, or three spreads away without a wall.
    """
    sign = F.when(side == "BUY", 1.0).otherwise(-1.0)
    at = entry + sign * (entry * (slippage_bps / 10_000.0))
    distance = F.when(F.coalesce(wall, F.lit(0.0)) > 0, F.abs(entry - wall) + spread).otherwise(spread * 3.0)
    stop = at - sign * distance
    risk = F.abs(at - stop)
    plan = F.struct(
        at.alias("entry"), stop.alias("stop"), (at + sign * risk * tp1_r).alias("tp1"),
        (at + sign * risk * tp2_r).alias("tp2"), F.lit(tp2_r).alias("rr"))
    return F.when((risk > 0) & F.lit(tp2_r >= min_rr), plan)


def relevant_wall(signals: DataFrame, walls: DataFrame, signal_id: str, max_age_ms: int = 30_000) -> DataFrame:
    """Latest wall price opposing each signal: an ask wall for BUY, a bid wall for SELL.

    ``walls``: symbol, ts_ms, seq, side (bid/ask), price.  Adds ``wall_price`` (NULL if none).
    """
    per_time = walls.groupBy("symbol", "ts_ms").agg(
        F.max("seq").alias("__wseq"), F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("__bid"),
        F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("__ask"), ).withColumn("__wts", F.col("ts_ms"))
    j = asof(signals, per_time, ["symbol"], "ts_ms", ["__bid", "__ask", "__wts"], signal_id, "__wseq")
    price = F.when(F.col("side") == "BUY", F.col("__ask")).otherwise(F.col("__bid"))
    fresh = F.col("ts_ms") - F.col("__wts") <= max_age_ms
    return j.withColumn("wall_price", F.when(fresh, price)).drop("__bid", "__ask", "__wts")


def signal_plans(
    books: DataFrame, walls: DataFrame, recent: DataFrame, tick: float = 0.01,
    memory_ms: int = 30_000, min_rr: float = 2.5, margin: float = 50.0,
) -> DataFrame:
    """A plan at each book from the direction vote of the remembered signals.

    ``recent``: rows of signals.recent_signals; ``walls``: rows of book.wall_levels.  The stop
    lies at the best opposing wall (times 0.999 / 1.001) or 7.5 spreads away; the target is the
    price of a recent void signal when it pays at least ``min_rr``, else ``min_rr`` times the risk.
    """
    first = walls.groupBy("symbol", "ts_ms", "seq").agg(
        F.min(F.when(F.col("side") == "ask", F.struct("rank", "price"))).alias("__wa"),
        F.min(F.when(F.col("side") == "bid", F.struct("rank", "price"))).alias("__wb"))
    b = books.select("symbol", "ts_ms", "seq", bk.mid().alias("mid"), bk.spread().alias("spread"))
    b = b.join(first, ["symbol", "ts_ms", "seq"], "left")
    j = asof(b, recent, ["symbol"], "ts_ms", ["recent"], "seq", "signal_no")
    now = F.col("ts_ms")
    j = j.filter("mid is not null and recent is not null").withColumn(
        "__v", sg.direction_vote(F.col("recent"), now, margin, memory_ms))
    j = j.withColumns({"direction": F.col("__v.direction"), "conf": F.col("__v.conf"),
                       "confluence": F.col("__v.confluence")}).filter("direction <> 'NEUTRAL'")
    long, mid = F.col("direction") == "LONG", F.col("mid")
    wall = F.when(long, F.col("__wa.price") * 0.999).otherwise(F.col("__wb.price") * 1.001)
    away = F.when(long, mid - F.col("spread") * 7.5).otherwise(mid + F.col("spread") * 7.5)
    j = j.withColumn("__sl", F.coalesce(wall, away))
    risk = F.abs(mid - F.col("__sl"))
    live = sg.in_memory(F.slice("recent", -F.least(F.size("recent"), F.lit(15)), 15), now, memory_ms)
    kind = F.when(long, "VOID_ASK").otherwise("VOID_BID")
    voids = F.filter(live, lambda s: s["type"] == kind)
    void = F.get(voids, F.size(voids) - 1)["price"]
    pays = F.abs(void - mid) / F.nullif(risk, F.lit(0.0)) >= min_rr
    tp = F.when(pays, void).otherwise(F.when(long, mid + risk * min_rr).otherwise(mid - risk * min_rr))
    j = j.withColumns({"__risk": risk, "__tp": tp})
    rr = F.coalesce(F.abs(F.col("__tp") - mid) / F.nullif(F.col("__risk"), F.lit(0.0)), F.lit(0.0))
    # rr is min_rr up to float error when the target was derived from it
    j = j.withColumn("rr", rr).filter(F.col("rr") >= min_rr - 1e-9)
    grid = (lambda c: round_half_up(F.col(c) / tick) * tick)
    return j.select("symbol", "ts_ms", "seq", "direction", round_half_up(F.col("conf")).cast("double").alias("conf"),
                    mid.alias("entry"), grid("__sl").alias("stop"), grid("__tp").alias("target"), "rr", "confluence")


def net_rr(rr: Column, entry: Column, stop: Column, fee_bps: float = 4.0, slip: float = 0.0005,
           funding: Column | float = 0.0, hold_s: float = 300.0) -> Column:
    """Reward/risk after fees, slippage and funding."""
    risk = F.abs(entry - stop) / entry
    cost = F.coalesce(F.lit(fee_bps * 2 / 10_000.0 + slip) / F.nullif(risk, F.lit(0.0)), F.lit(0.0))
    rate = funding if isinstance(funding, Column) else F.lit(float(funding))
    return rr - cost - F.abs(rate) * min(hold_s / 3600.0, 8.0)


def admit_plans(plans: DataFrame, cooldown_ms: int = 30_000, min_confluence: int = 3,
                min_net_rr: float = 2.0, ttl_ms: int = 30_000) -> DataFrame:
    """Candidates: gate passed, enough confluence and net RR, and no candidate of the same
    direction within ``cooldown_ms``.

    ``plans``: rows of signal_plans with net_rr and ``blocked`` (reason of the risk gate or NULL).
    A change of direction restarts the cool-down, so it is counted within runs of one direction.
    """
    ok = plans.filter(F.col("blocked").isNull() & (F.col("confluence") >= min_confluence)
                      & (F.col("net_rr") >= min_net_rr))
    o = order_rows(ok, ["symbol"], ["ts_ms", "seq"]).frame(
        1, 0, lambda w: {"__pd": F.lag("direction").over(w)})
    turn = F.coalesce(F.col("__pd") != F.col("direction"), F.lit(True))
    o = o.running({"__run": ("sum", turn.cast("bigint"))})
    runs = order_rows(o.df.drop(RN, "__pd"), ["symbol", "__run"], ["ts_ms", "seq"], within=o)
    out = greedy_starts(runs, "ts_ms", cooldown_ms, "__in").df.filter("__in")
    plan_id = F.concat(F.lit("plan_"), F.sha2(F.concat_ws("|", "symbol", "ts_ms", "seq", "direction"), 256).substr(1, 16))
    return out.drop("__in", "__run", RN).withColumns({
        "plan_id": plan_id, "state": F.lit("CANDIDATE"), "expires_ms": F.col("ts_ms") + ttl_ms})


def plan_states(candidates: DataFrame, commands: DataFrame) -> DataFrame:
    """Life of each plan: arm (only before expiry) -> ARMED, cancel -> NEUTRAL, else EXPIRED at
    its time to live.  ``commands``: plan_id, ts_ms, command ('arm' / 'cancel').
    """
    c = commands.groupBy("plan_id").agg(
        F.min(F.when(F.col("command") == "arm", F.col("ts_ms"))).alias("__arm"),
        F.min(F.when(F.col("command") == "cancel", F.col("ts_ms"))).alias("__cancel"))
    j = candidates.join(c, "plan_id", "left")
    late = F.lit(2**62)
    arm = F.when(F.col("__arm") <= F.col("expires_ms"), F.col("__arm"))
    cancel = F.col("__cancel")
    armed = arm.isNotNull() & (arm < F.coalesce(cancel, late))
    off = cancel.isNotNull() & (armed | (cancel <= F.col("expires_ms")))
    return j.withColumns({
        "armed_ms": F.when(armed, arm), "state": F.when(off, "NEUTRAL").when(armed, "ARMED").otherwise("EXPIRED"),
    }).drop("__arm", "__cancel")
