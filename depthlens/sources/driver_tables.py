"""Market tables derived from the ``events`` and ``orders`` parquet tables.

Prices are whole ticks and quantities whole lots, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000
DAY = 24 * HOUR
_EPOCH_MS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c}) div 1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts_ms, trade_id, price, qty, side, event_type."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('U', cast(user_id % 10 as string)) as symbol",
        f"{_EPOCH_MS.format(c='ts')} as ts_ms",
        "event_id as trade_id",
        "cast(1000 + floor(value * 10) as double) as price",
        "cast(1 + event_id % 17 as double) as qty",
        "case when event_type in ('purchase', 'signup', 'view') then 'buy' else 'sell' end as side",
        "event_type",
    )


def liquidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).filter("event_type = 'error'").selectExpr(
        "symbol", "ts_ms", "trade_id", "price", "qty",
        "case when trade_id % 2 = 0 then 'long' else 'short' end as side",
    )


def candles(spark: SparkSession, sf_dir: str, interval_ms: int = 6 * HOUR) -> DataFrame:
    """symbol, ts, o, h, l, c, v per interval that has trades."""
    t = trades(spark, sf_dir).withColumn("ts", F.expr(f"ts_ms div {interval_ms} * {interval_ms}"))
    at = F.struct("ts_ms", "trade_id")
    return t.groupBy("symbol", "ts").agg(
        F.min_by("price", at).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"),
        F.max_by("price", at).alias("c"), F.sum("qty").alias("v"),
    )


def order_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles of order totals per priority."""
    return table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("symbol"),
        F.expr(_EPOCH_MS.format(c="o_orderdate")).alias("ts"),
    ).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("o"), F.max("o_totalprice").alias("h"),
        F.min("o_totalprice").alias("l"), F.max_by("o_totalprice", "o_orderkey").alias("c"),
        F.count("*").cast("double").alias("v"),
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book per symbol and day: symbol, ts_ms (end of day), seq, bids, asks (best first)."""
    t = trades(spark, sf_dir).withColumn("day", F.expr(f"ts_ms div {DAY}"))
    middle = t.groupBy("symbol", "day").agg(F.floor(F.median("price")).alias("m"))
    # quantities are summed per tick before the join, so a busy day meets it as a few ticks
    ticks = t.groupBy("symbol", "day", "price").agg(F.sum("qty").alias("qty"))
    levels = ticks.join(middle, ["symbol", "day"]).selectExpr(
        "symbol", "day", "price <= m as is_bid",
        "floor(price / 5) * 5 + case when price <= m then 0 else 5 end as level", "qty",
    ).groupBy("symbol", "day", "is_bid", "level").agg(F.sum("qty").alias("qty"))
    level = F.struct(F.col("level").cast("double").alias("price"), "qty")
    sides = levels.groupBy("symbol", "day").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_bid"), level)), asc=False).alias("bids"),
        F.sort_array(F.collect_list(F.when(~F.col("is_bid"), level))).alias("asks"),
    )
    return sides.selectExpr(
        "symbol", f"(day + 1) * {DAY} as ts_ms", "day as seq", "bids", "asks")


def book_levels(books_df: DataFrame) -> DataFrame:
    """One row per book level: symbol, ts_ms, seq, side, rank (0 = best), price, qty."""
    def one(side, col):
        return books_df.select(
            "symbol", "ts_ms", "seq", F.lit(side).alias("side"), F.posexplode(col)
        ).select("symbol", "ts_ms", "seq", "side", F.col("pos").alias("rank"), "col.*")
    return one("bid", "bids").unionByName(one("ask", "asks"))
