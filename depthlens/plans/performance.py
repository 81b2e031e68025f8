"""Statistics over outcomes and verified signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthlens.functions.scalar import money_sum
from depthlens.operators.ordered import RN, order_rows
from depthlens.session import write_table


def confidence_bins(verified: DataFrame) -> DataFrame:
    """Verification by confidence bin (60-70, 70-80, 80-90, 90+, and below 60)."""
    c, v = F.col("conf"), F.col("verification")
    bin_ = F.when(c >= 90, "90+").when(c >= 80, "80-90").when(c >= 70, "70-80").when(
        c >= 60, "60-70").otherwise("<60")
    wins, missed = F.count_if(v == "VERIFIED"), F.count_if(v == "MISSED")
    return verified.groupBy(bin_.alias("bin")).agg(
        F.count("*").alias("total"), wins.alias("wins"), missed.alias("missed"),
    ).withColumns({
        "win_rate": F.col("wins") / F.col("total"),
        "verified_rate": F.col("wins") / F.nullif(F.col("wins") + F.col("missed"), F.lit(0)),
    })


def horizon_metrics(returns: DataFrame) -> DataFrame:
    """Count, win rate, mean and upper median of the realised returns per horizon.

    The median is picked by its rank in a distributed ordering, not from a collected list.
    """
    # written: counted, ordered and averaged below, but computed once
    real = write_table(returns.filter("realized").select("horizon_ms", F.coalesce("ret", F.lit(0.0)).alias("ret")), "returns")
    stats = real.groupBy("horizon_ms").agg(
        F.count("*").alias("count"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"),
        F.avg("ret").alias("avg_return"), F.avg("ret").alias("expectancy"))
    o = order_rows(real.select("horizon_ms", "ret", F.monotonically_increasing_id().alias("__id")),
                   ["horizon_ms"], ["ret", "__id"])
    # one row a horizon; left to the planner, all returns of a horizon would be sorted in one task
    mid = o.df.join(F.broadcast(stats.select("horizon_ms", "count")), "horizon_ms").filter(F.expr(f"{RN} = `count` div 2"))
    return stats.join(mid.select("horizon_ms", F.col("ret").alias("median_return")), "horizon_ms")


def trade_metrics(trades: DataFrame, by: list[str], risk_free: float = 0.0, original_sharpe: bool = False) -> DataFrame:
    """Win rate, R, expectancy, profit factor, Sharpe and Wilson interval of closed trades.

    ``trades``: by..., entry_ms, exit_ms, pnl, r_multiple.  Profit factor is infinite without losses.
    Sharpe is annualised as mean / std * sqrt(trades per year); ``original_sharpe`` divides by
    std * sqrt(trades per year) instead.
    """
    p = F.col("pnl")
    win, loss = p > 0, p < 0
    df = trades.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(win).alias("wins"), F.count_if(loss).alias("losses"),
        F.coalesce(money_sum(F.when(win, p)), F.lit(0.0)).alias("gross_profit"),
        F.coalesce(money_sum(F.when(~win, -p)), F.lit(0.0)).alias("gross_loss"),
        F.avg("r_multiple").alias("avg_r"), F.sum("r_multiple").alias("net_r"), F.avg("pnl").alias("mean_pnl"),
        F.stddev_samp("pnl").alias("std_pnl"), (F.max("exit_ms") - F.min("entry_ms")).alias("span_ms"),
        F.avg(F.col("exit_ms") - F.col("entry_ms")).alias("avg_hold_ms"))
    n, wins = F.col("n"), F.col("wins")
    z2 = 1.96 * 1.96
    rate = wins / n
    margin = 1.96 * F.sqrt((rate * (1.0 - rate) + z2 / (4.0 * n)) / n)
    scale = 1.0 + F.lit(z2) / n
    center = (rate + F.lit(z2) / (2.0 * n)) / scale
    year = F.lit(365.25 * 24 * 3600 * 1000)
    per_year = n / F.nullif(F.col("span_ms"), F.lit(0)) * year
    excess = F.col("mean_pnl") - F.lit(risk_free / 100.0) / per_year
    std = F.nullif(F.col("std_pnl"), F.lit(0.0))
    sharpe = excess / (std * F.sqrt(per_year)) if original_sharpe else excess / std * F.sqrt(per_year)
    avg_win = F.coalesce(F.col("gross_profit") / F.nullif(wins, F.lit(0)), F.lit(0.0))
    avg_loss = F.coalesce(F.col("gross_loss") / F.nullif(F.col("losses"), F.lit(0)), F.lit(0.0))
    return df.withColumns({
        "win_rate": rate,
        "expectancy": rate * avg_win - F.col("losses") / n * avg_loss,
        "profit_factor": F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.nullif(F.col("gross_loss"), F.lit(0.0)))
        .when(F.col("gross_profit") > 0, float("inf")).otherwise(0.0),
        "sharpe": F.when(F.col("span_ms") > 0, F.coalesce(sharpe, F.lit(0.0))).otherwise(0.0),
        "wilson_low": F.greatest(center - margin / scale, F.lit(0.0)),
        "wilson_high": F.least(center + margin / scale, F.lit(1.0)),
    })


def max_drawdown(trades: DataFrame, by: list[str], order: list[str], start_equity: float, value: str = "pnl") -> DataFrame:
    """Largest fall of the equity path from its peak, as a fraction of the peak and in R."""
    o = order_rows(trades, by, order).running({"__eq": ("sum", F.col(value))})
    o = o.col("equity", F.col("__eq") + float(start_equity)).running({"__top": ("max", F.col("equity"))})
    peak = F.greatest(F.col("__top"), F.lit(float(start_equity)))
    dd = (peak - F.col("equity")) / F.nullif(peak, F.lit(0.0))
    return o.df.groupBy(*by).agg(F.greatest(F.max(dd), F.lit(0.0)).alias("max_drawdown"),
                                 F.max(peak - F.col("equity")).alias("max_fall"))


def trade_quality(outcomes: DataFrame, returns: DataFrame, by: list[str]) -> DataFrame:
    """Averages of adverse and favourable moves and their ratio, per group."""
    return returns.groupBy(*by).agg(
        F.avg("mae").alias("avg_mae"), F.avg("mfe").alias("avg_mfe"),
    ).withColumn("mae_mfe_ratio", F.abs("avg_mae") / F.nullif(F.col("avg_mfe"), F.lit(0.0))).join(
        outcomes.groupBy(*[b for b in by if b in outcomes.columns]).agg(
            F.avg(F.col("exit_ms") - F.col("submit_ms")).alias("avg_hold_ms"),
            F.avg("r_multiple").alias("avg_r")), [b for b in by if b in outcomes.columns], "left")


def session_rollup(positions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Metrics per session (session_id, start_equity) from its positions (status, pnl, fee)."""
    p, closed = F.col("pnl"), F.col("status") != "open"
    agg = positions.groupBy("session_id").agg(
        F.count_if(closed).alias("trades"), F.count_if(closed & (p > 0)).alias("wins"),
        F.coalesce(money_sum(F.when(closed & (p > 0), p)), F.lit(0.0)).alias("__gain"),
        F.abs(F.coalesce(money_sum(F.when(closed & (p <= 0), p)), F.lit(0.0))).alias("__loss"),
        F.avg(F.when(closed, p)).alias("__mean"), F.stddev_samp(F.when(closed, p)).alias("__std"),
        money_sum(p).alias("__all"), money_sum(F.col("fee")).alias("total_fees"))
    j = sessions.join(agg, "session_id", "left").na.fill(0.0).na.fill(0)
    equity = F.col("start_equity") + F.col("__all")
    peak = F.greatest(F.col("start_equity"), equity)
    return j.withColumns({
        "win_rate": F.coalesce(F.col("wins") / F.nullif(F.col("trades"), F.lit(0)), F.lit(0.0)),
        "profit_factor": F.when(F.col("__loss") > 0, F.col("__gain") / F.nullif(F.col("__loss"), F.lit(0.0))).when(
            F.col("__gain") > 0, float("inf")).otherwise(0.0),
        "sharpe": F.coalesce(F.col("__mean") / F.nullif(F.col("__std"), F.lit(0.0)) * (252.0 ** 0.5), F.lit(0.0)),
        "current_equity": equity, "peak_equity": peak,
        "max_drawdown": F.when(peak > 0, (peak - equity) / F.nullif(peak, F.lit(0.0))).otherwise(0.0),
    }).drop("__gain", "__loss", "__mean", "__std", "__all")


def keep_last_sessions(sessions: DataFrame, n: int, order: str = "started_ms") -> DataFrame:
    """The ``n`` latest sessions: an ordered limit, which Spark runs as a distributed top-n."""
    return sessions.orderBy(F.desc(order), F.desc("session_id")).limit(n)
