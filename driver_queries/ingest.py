from __future__ import annotations

from pyspark.sql import functions as F

from depthlens.session import checkpoint_dir
from depthlens.sources import candle_files, exchange_feed, instruments, sessions
from depthlens.sources import driver_tables as src
from driver_queries.common import BOOKS, HOUR, TRADES, candles

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def _path(spark, name):
    import uuid
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s01_s02_candle_files", f"WITH {candles(HOUR)} SELECT symbol, ts, o, h, l, c, v FROM cd")
def _(spark, d):
    path = _path(spark, "candles")
    candle_files.write_candles(src.candles(spark, d, HOUR), path)
    return candle_files.read_candles(spark, path)


@query("s03_exchange_candles", f"WITH {candles(HOUR)} SELECT symbol, ts, o, h, l, c, v FROM cd")
def _(spark, d):
    raw = src.candles(spark, d, HOUR).select("symbol", F.to_json(F.array(*[
        F.col(c).cast("string") for c in ("ts", "o", "h", "l", "c", "v")])).alias("value"))
    return exchange_feed.parse_candle_rows(raw)


def _trade_json():
    return F.struct(F.col("price").cast("string").alias("px"), F.col("qty").cast("string").alias("sz"), "side",
                    F.col("ts_ms").cast("string").alias("ts"), F.col("trade_id").cast("string").alias("tradeId"))


@query("s04_exchange_trades", f"WITH {TRADES} SELECT symbol, ts_ms, price, qty, side FROM trades")
def _(spark, d):
    raw = src.trades(spark, d).select("symbol", F.to_json(_trade_json()).alias("value"))
    return exchange_feed.parse_trades(raw)


def _feed(spark, d):
    """Messages of both channels (a trade message holds a symbol's minute), acks and noise."""
    def message(channel, data):
        return F.to_json(F.struct(F.struct(F.lit(channel).alias("channel"), F.col("symbol").alias("instId")).alias("arg"), data.alias("data")))
    t = src.trades(spark, d)
    trades = t.groupBy("symbol", F.expr("ts_ms div 60000").alias("m")).agg(
        F.collect_list(_trade_json()).alias("ts"), F.min("trade_id").alias("arrival"))
    trades = trades.select("arrival", message("trades", F.col("ts")).alias("value"))
    side = (lambda c: F.transform(c, lambda l: F.array(l["price"].cast("string"), l["qty"].cast("string"))))
    books = src.books(spark, d).select(F.col("seq").alias("arrival"), message("books5", F.array(F.struct(
        side("bids").alias("bids"), side("asks").alias("asks"), F.col("ts_ms").cast("string").alias("ts")))).alias("value"))
    noise = t.filter("trade_id % 50 = 0").select(F.col("trade_id").alias("arrival"), F.when(
        F.col("trade_id") % 100 == 0, '{"event":"subscribe","arg":{"channel":"trades"}}').otherwise("pong").alias("value"))
    return trades.unionByName(books).unionByName(noise)


@query("s05_feed_trades", f"WITH {TRADES} SELECT symbol, ts_ms, trade_id, price, qty, side FROM trades")
def _(spark, d):
    return exchange_feed.feed_trades(_feed(spark, d)).drop("arrival")


@query("s05_feed_book_levels", f"WITH {BOOKS} SELECT symbol, seq, side, rank, price, qty FROM levels")
def _(spark, d):
    b = exchange_feed.feed_books(_feed(spark, d), "arrival")
    return src.book_levels(b).select("symbol", "seq", "side", F.col("rank").cast("bigint").alias("rank"), "price", "qty")


@query("s06_checksums", f"WITH {TRADES} SELECT trade_id, trade_id%3<>0 AS checksum_ok FROM trades")
def _(spark, d):
    raw = src.trades(spark, d).select("trade_id", F.to_json(_trade_json()).alias("payload"))
    good = exchange_feed.checksum(F.col("payload"))
    raw = raw.withColumn("expected", F.when(F.col("trade_id") % 3 == 0, F.reverse(F.concat(good, F.lit("!")))).otherwise(good))
    return exchange_feed.verify_checksums(raw, "payload", "expected").select("trade_id", "checksum_ok")


@query("s07_session_round_trip", f"WITH {TRADES} SELECT symbol||'-'||(ts_ms//86400000) AS session_id, count(*) AS trades, sum(qty) AS volume FROM trades GROUP BY 1")
def _(spark, d):
    s = src.trades(spark, d).groupBy(F.concat_ws("-", "symbol", F.expr("ts_ms div 86400000")).alias("session_id")).agg(
        F.count("*").alias("trades"), F.sum("qty").alias("volume"))
    path = _path(spark, "sessions")
    sessions.export_sessions(s, path)
    good, _ = sessions.import_sessions(spark, path, s.schema)
    return good


DIM = """im(exchange, symbol2, tick_size, lot_size, contract_multiplier) AS (VALUES ('okx','BTC-USDT-SWAP',0.1::DOUBLE,0.01::DOUBLE,1.0::DOUBLE),
 ('okx','ETH-USDT-SWAP',0.01,0.1,1.0), ('binance','BTCUSDT',0.1,0.001,1.0))"""


def _listed(spark, d):
    return src.trades(spark, d).select(
        "trade_id", "price", "qty", F.when(F.col("symbol").isin("U0", "U1"), "binance").otherwise("okx").alias("exchange"),
        F.expr("case symbol when 'U0' then 'BTCUSDT' when 'U2' then 'BTC-USDT-SWAP' when 'U3' then 'ETH-USDT-SWAP' else symbol end").alias("symbol"))


@query("s09_j0_instruments", f"""WITH {TRADES}, {DIM}, t AS (SELECT trade_id, price, qty, CASE WHEN symbol IN ('U0','U1') THEN 'binance' ELSE 'okx' END AS exchange,
 CASE symbol WHEN 'U0' THEN 'BTCUSDT' WHEN 'U2' THEN 'BTC-USDT-SWAP' WHEN 'U3' THEN 'ETH-USDT-SWAP' ELSE symbol END AS symbol FROM trades)
SELECT t.trade_id, t.exchange, t.symbol, tick_size, price*qty*contract_multiplier AS notional FROM t LEFT JOIN im ON im.exchange=t.exchange AND im.symbol2=t.symbol""")
def _(spark, d):
    j = instruments.attach(_listed(spark, d), instruments.built_in(spark))
    return j.select("trade_id", "exchange", "symbol", "tick_size", (F.col("price") * F.col("qty") * F.col("contract_multiplier")).alias("notional"))


@query("j07_unknown_instruments", f"""WITH {TRADES} SELECT CASE WHEN symbol='U1' THEN 'binance' ELSE 'okx' END AS exchange, symbol, count(*) AS n FROM trades WHERE symbol NOT IN ('U0','U2','U3') GROUP BY ALL""")
def _(spark, d):
    known = instruments.built_in(spark).select("exchange", "symbol")
    return _listed(spark, d).join(known, ["exchange", "symbol"], "left_anti").groupBy("exchange", "symbol").agg(F.count("*").alias("n"))


@query("s10_events_by_kind", f"WITH {TRADES} SELECT CASE WHEN event_type='error' THEN 'liquidation' WHEN event_type='view' THEN 'markPrice' ELSE 'trade' END AS kind, count(*) AS n, sum(qty) AS qty FROM trades GROUP BY 1")
def _(spark, d):
    wide = src.trades(spark, d).withColumn("kind", F.when(F.col("event_type") == "error", "liquidation").when(
        F.col("event_type") == "view", "markPrice").otherwise("trade"))
    parts = [exchange_feed.events_of(wide, k).select("kind", "qty") for k in exchange_feed.KINDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))
