import random
import zlib

import pytest
from pyspark.sql import functions as F

from depthlens.operators.fold import decision_fires
from depthlens.operators.flow import threshold_bars, time_bars
from depthlens.operators.ordered import order_rows
from depthlens.sources import candle_files, exchange_feed, instruments, sessions
from depthlens.streaming import streams


def test_candle_files(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"symbol":"X","ts":1,"o":1,"h":2,"l":0.5,"c":103,"v":10}\n\n{"symbol":"X","ts":2,"o":1,"h":2,"l":0.5,"c":1,"v":1200}\n')
    df = candle_files.read_candles(spark, str(p))
    assert [(r["c"], r["v"]) for r in df.orderBy("ts").collect()] == [(103.0, 10.0), (1.0, 1200.0)]
    candle_files.write_candles(df, str(tmp_path / "out"))
    assert candle_files.read_candles(spark, str(tmp_path / "out")).count() == 2
    p.write_text('{"symbol":"X","ts":1}\nnot json\n')
    with pytest.raises(Exception):
        candle_files.read_candles(spark, str(p)).collect()


def test_exchange_rows_and_feed(spark):
    c = exchange_feed.parse_candle_rows(spark.createDataFrame(
        [("[1597026383085,9300,9350,9250,9320,100]",)], "value string")).first()
    assert (c["ts"], c["o"], c["c"], c["v"]) == (1597026383085, 9300.0, 9320.0, 100.0)
    t = exchange_feed.parse_trades(spark.createDataFrame(
        [('{"ts":"1597026383085","px":"9320.5","sz":"1.5","side":"buy"}',)], "value string")).first()
    assert (t["price"], t["qty"], t["side"]) == (9320.5, 1.5, "buy")
    raw = spark.createDataFrame([
        (1, '{"event":"subscribe","arg":{"channel":"trades"}}'), (2, "pong"),
        (3, '{"arg":{"channel":"trades","instId":"B"},"data":[{"px":"1","sz":"2","side":"sell","ts":"5","tradeId":"7"},{"px":"3","sz":"4","side":"buy","ts":"6","tradeId":"8"}]}'),
        (4, '{"arg":{"channel":"books5","instId":"B"},"data":[{"bids":[["10","1"]],"asks":[["11","2"],["12","3"]],"ts":"9"}]}'),
        (5, '{"arg":{"channel":"books5","instId":"B"},"data":[]}'),
    ], "arrival long, value string")
    trades = exchange_feed.feed_trades(raw).orderBy("trade_id").collect()
    assert [(r["symbol"], r["ts_ms"], r["price"], r["side"]) for r in trades] == [("B", 5, 1.0, "sell"), ("B", 6, 3.0, "buy")]
    books = exchange_feed.feed_books(raw, "arrival").collect()
    assert len(books) == 1 and books[0]["seq"] == 4 and [tuple(l) for l in books[0]["asks"]] == [(11.0, 2.0), (12.0, 3.0)]


def test_checksums_and_sessions(spark, tmp_path):
    df = spark.createDataFrame([("hello world", "0d4a1185"), ("x", "00000000")], "p string, e string")
    assert [r["checksum_ok"] for r in exchange_feed.verify_checksums(df, "p", "e").orderBy("p").collect()] == [True, False]
    assert df.select(exchange_feed.checksum(F.col("p"))).first()[0] == f"{zlib.crc32(b'hello world'):08x}"
    s = spark.createDataFrame([("s1", 100.0), ("s2", 200.0)], "session_id string, start_equity double")
    path = str(tmp_path / "ses")
    sessions.export_sessions(s, path)
    good, bad = sessions.import_sessions(spark, path, s.schema)
    assert {tuple(r) for r in good.collect()} == {("s1", 100.0), ("s2", 200.0)} and bad.count() == 0
    raw = spark.read.json(path).withColumn("session", F.regexp_replace("session", "200", "201"))
    raw.write.mode("overwrite").json(str(tmp_path / "bad"))
    good, bad = sessions.import_sessions(spark, str(tmp_path / "bad"), s.schema)
    assert good.count() == 1 and bad.count() == 1


def test_instruments(spark):
    cat = instruments.built_in(spark)
    rows = spark.createDataFrame([("okx", "BTC-USDT-SWAP"), ("okx", "NOPE")], "exchange string, symbol string")
    assert [r["tick_size"] for r in instruments.attach(rows, cat).orderBy("symbol").collect()] == [0.1, None]
    with pytest.raises(KeyError, match="okx:NOPE"):
        instruments.require_known(rows, cat)
    more = cat.limit(1).withColumn("tick_size", F.lit(0.5))
    assert instruments.register(cat, more).count() == 3


# ---- streams ------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    rnd = random.Random(4)
    rows, t = [], 0
    for i in range(400):
        t += rnd.choice([50, 300, 1500])
        rows.append((rnd.choice("ab"), t, i, 100.0 + rnd.randrange(20), float(1 + rnd.randrange(9)), rnd.choice(["buy", "sell"]),
                     rnd.uniform(-1, 1)))
    path = str(tmp_path_factory.mktemp("feed"))
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, trade_id long, price double, qty double, side string, score double")
    # three files in time order: three micro-batches
    for k in range(3):
        df.filter(F.col("trade_id").between(k * 140, k * 140 + 139)).coalesce(1).write.mode("append").parquet(path)
    return df, path


def _stream(spark, feed):
    df, path = feed
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _collect(spark, df, tmp_path, name):
    q = streams.run_to_table(df, str(tmp_path / name), str(tmp_path / f"{name}-ckpt"))
    assert q.awaitTermination(180)
    return spark.read.parquet(str(tmp_path / name))


def test_stream_bars_equal_batch(spark, feed, tmp_path):
    s = streams.time_bars(streams.drop_repeated_trades(streams.with_event_time(_stream(spark, feed), "1 minute")))
    got = {(r["symbol"], r["bar_ts"]): (r["open"], r["close"], r["delta"]) for r in _collect(spark, s, tmp_path, "bars").collect()}
    want = {(r["symbol"], r["bar_ts"]): (r["open"], r["close"], r["delta"]) for r in time_bars(feed[0]).collect()}
    assert len(got) > 20 and got.items() <= want.items()


def test_stream_volume_bars_equal_batch(spark, feed, tmp_path):
    got = {(r["symbol"], r["bar"]): (r["bar_ts"], r["open"], r["close"], r["volume"], r["delta"])
           for r in _collect(spark, streams.volume_bars(_stream(spark, feed), 40.0), tmp_path, "vol").collect()}
    want = {(r["symbol"], r["bar"]): (r["bar_ts"], r["open"], r["close"], r["volume"], r["delta"])
            for r in threshold_bars(feed[0], 40.0).filter("complete").collect()}
    assert got == want and len(want) > 10


def test_stream_decisions_equal_batch(spark, feed, tmp_path):
    got = {(r["symbol"], r["ts_ms"], r["fired_side"])
           for r in _collect(spark, streams.decisions(_stream(spark, feed), 0.1, 300, 2000), tmp_path, "dec").collect()}
    o = order_rows(feed[0], ["symbol"], ["ts_ms", "trade_id"])
    fires = o.df.join(decision_fires(o, "score", "ts_ms", 0.1, 300, 2000), ["symbol", "rn"])
    assert got == {(r["symbol"], r["ts_ms"], r["fired_side"]) for r in fires.collect()} and got


def test_other_stream_shapes(spark, feed, tmp_path):
    src = streams.with_event_time(_stream(spark, feed), "1 minute")
    n = _collect(spark, streams.sliding_counts(src), tmp_path, "slide")
    assert n.count() > 50
    chains = _collect(spark, streams.liquidation_sessions(src), tmp_path, "chains")
    assert chains.agg(F.max("chain_len")).first()[0] > 1
    sig = _stream(spark, feed).withColumns({"type": F.lit("T"), "conf": F.lit(60.0)})
    kept = _collect(spark, streams.cooldown(sig, 8000), tmp_path, "cool").orderBy("symbol", "ts_ms").collect()
    for a, b in zip(kept, kept[1:]):
        assert a["symbol"] != b["symbol"] or b["ts_ms"] - a["ts_ms"] >= 8000
    left = streams.with_event_time(_stream(spark, feed).filter("trade_id % 50 = 0"), "1 minute").withColumn("signal_id", F.col("trade_id"))
    joined = _collect(spark, streams.forward_prices(left, src), tmp_path, "fwd")
    df = feed[0]
    s, p = df.filter("trade_id % 50 = 0").alias("s"), df.alias("p")
    want = s.join(p, F.expr("s.symbol = p.symbol and p.ts_ms > s.ts_ms and p.ts_ms <= s.ts_ms + 30000")).count()
    assert joined.count() == want
