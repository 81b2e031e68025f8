"""Column layouts of the tables the operators exchange.

Times are epoch milliseconds (``ts_ms bigint``); only event time drives a computation.
"""

from pyspark.sql import types as T

LEVEL = T.StructType([T.StructField("price", T.DoubleType()), T.StructField("qty", T.DoubleType())])
LEVELS = T.ArrayType(LEVEL)

CANDLE = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in ("o", "h", "l", "c", "v")],
])

TRADE = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts_ms", T.LongType()),
    T.StructField("trade_id", T.LongType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("qty", T.DoubleType()),
    T.StructField("side", T.StringType()),
])

# one wide row per market event; ``kind`` tells which of the columns are filled
MARKET_EVENT = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("exchange", T.StringType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("ts_ms", T.LongType()),
    T.StructField("receive_ms", T.LongType()),
    T.StructField("trade_id", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("qty", T.DoubleType()),
    T.StructField("side", T.StringType()),
    T.StructField("first_seq", T.LongType()),
    T.StructField("last_seq", T.LongType()),
    T.StructField("bids", LEVELS),
    T.StructField("asks", LEVELS),
])

INSTRUMENT = T.StructType([
    T.StructField("exchange", T.StringType()),
    T.StructField("symbol", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in ("tick_size", "lot_size")],
    T.StructField("price_precision", T.IntegerType()),
    T.StructField("qty_precision", T.IntegerType()),
    *[T.StructField(c, T.DoubleType())
      for c in ("contract_multiplier", "min_notional", "maker_fee", "taker_fee")],
])
