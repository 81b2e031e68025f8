"""Volume buckets of any trade size, complete parameter grids and windows, admission of duplicates."""

from depthlens.operators import flow, signals
from depthlens.plans import backtest


def trades(spark, sizes):
    rows = [("A", 1000 + i, i, 10.0, q, "buy" if i % 3 else "sell") for i, q in enumerate(sizes)]
    return spark.createDataFrame(rows, "symbol string, ts_ms long, trade_id long, price double, qty double, side string")


def test_volume_buckets_keep_all_volume(spark):
    sizes = [0.5, 1.5] * 50 + [0.1, 0.3, 25.25, 7.0, 0.0] * 10
    got = flow.volume_buckets(trades(spark, sizes), 10).collect()
    assert abs(sum(r.buys + r.sells for r in got) - sum(sizes)) < 1e-6
    assert all(abs(r.buys + r.sells - 10) < 1e-6 for r in got if r.complete)
    assert sorted(r.bucket for r in got) == list(range(len(got))) and [r.bucket for r in got if not r.complete] == [len(got) - 1]


def test_flat_series_gives_every_set_and_window(spark):
    rows = [("A", i, 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(200)]
    candles = spark.createDataFrame(rows, "symbol string, ts long, o double, h double, l double, c double, v double")
    never = lambda p: backtest.F.lit(0)
    got = backtest.calibrate(candles, {"mult": (1.0, 2.0)}, never).collect()
    assert sorted(r.mult for r in got) == [1.0, 1.25, 1.5, 1.75, 2.0]
    assert all((r.total_trades, r.win_rate, r.sharpe, r.max_drawdown, r.profit_factor) == (0, 0, 0, 0, 0) for r in got)
    windows = backtest.walk_forward(candles, {"mult": (1.0, 2.0)}, 100, 50, rule=never).collect()
    assert sorted((r.window, r.mult, r.train_sharpe, r.test_trades) for r in windows) == [(w, 1.0, 0.0, 0) for w in range(3)]


def test_admission_takes_the_strongest_of_equal_signals(spark):
    rows = [("A", 1, "X", "bullish", c, 5.0) for c in (61.0, 90.0, 75.0)]
    df = spark.createDataFrame(rows, "symbol string, ts_ms long, type string, direction string, conf double, price double")
    assert [r.conf for r in signals.admit(df).collect()] == [90.0]


def test_every_trade_feature_takes_an_ordering(spark):
    """``ordered_trades`` instead of trades gives the same rows, for each feature and for the frames built of them."""
    import random

    from depthlens.operators import book, flow, strategy

    rnd, rows, t = random.Random(2), [], 0
    for i in range(400):
        t += rnd.choice([0, 200, 900])
        rows.append((rnd.choice("ab"), t, i, 100.0 + rnd.randrange(9), rnd.choice([0.0, 1.0, 2.5, 7.25]), rnd.choice(["buy", "sell"])))
    trades = spark.createDataFrame(rows, "symbol string, ts_ms long, trade_id long, price double, qty double, side string")
    liqs = trades.filter("trade_id % 9 = 0")
    marks = trades.select("symbol", "ts_ms", "trade_id", "price").withColumnRenamed("trade_id", "seq").limit(5)
    calls = {
        "cumulative_delta": {}, "cvd_zscore": {}, "price_velocity": {}, "return_volatility": {}, "whale_tiers": {}, "trade_rates": {}, "recent_vwap": {},
        "time_bars": {}, "idle_closes": {}, "threshold_bars": {"size": 20.0}, "volume_buckets": {"bucket": 30.0}, "vpin": {"bucket": 30.0, "warm": 2},
        "notional_vpin": {"size": 900.0}, "price_spread": {}, "latest_price": {"marks": marks}, "signal_bars": {"liqs": liqs, "mode": "notional", "size": 900.0},
    }
    show = lambda df: sorted(str(r) for r in df.select(*sorted(df.columns)).collect())
    for name, more in calls.items():
        f = getattr(flow, name)
        got = show(f(flow.ordered_trades(trades), **more))
        assert got == show(f(trades, **more)) and got, name
    books = spark.createDataFrame(
        [("a", 4000 * k, k, [(100.0 - j, 2.0 + j) for j in range(6)], [(101.0 + j, 1.0 + (j + k) % 4) for j in range(6)]) for k in range(1, 40)],
        "symbol string, ts_ms long, seq long, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>")
    frames = strategy.feature_frames(books, trades, bucket=5).collect()
    assert len(frames) == 39 and {r["data_quality"] for r in frames} and any(r["vpin"] is not None for r in frames)


def test_admission_and_verification_run_the_detectors_once(spark):
    """Every ordering of the admission and both sides of the verification's join ran the detectors again."""
    F, calls = backtest.F, spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        calls.add(1)
        return x

    rows = [("A", 10_000 * i, "XY"[i % 2], "bullish", 70.0, 100.0) for i in range(40)]
    found = spark.createDataFrame(rows, "symbol string, ts_ms long, type string, direction string, conf double, price double")
    prices = spark.createDataFrame(
        [("A", 5000 + 10_000 * i, i, 101.0 if i % 2 else 100.0) for i in range(40)], "symbol string, ts_ms long, trade_id long, price double")
    kept = signals.recent_signals(signals.admit(found.withColumn("ts_ms", counted("ts_ms"))))
    got = {r.ts_ms: r.verification for r in signals.verify(kept, prices, "signal_no").collect()}
    # a price above lies in the next 5 to 30 seconds of each signal
    assert got == {10_000 * i: "VERIFIED" for i in range(40)}
    assert calls.value == len(rows)


def test_bar_detectors_share_written_bars(spark):
    F, calls = backtest.F, spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        calls.add(1)
        return x

    sizes = [float(1 + i % 7) for i in range(60)]
    bars = flow.signal_bars(trades(spark, sizes), trades(spark, sizes).limit(0), "aligned", 4)
    alone = [f(bars).collect() for f in (signals.flow_sustained, signals.flow_exhaustion, signals.delta_expansion)]
    one = signals.ordered_bars(bars.withColumn("delta", counted("delta")))
    shared = [f(one).collect() for f in (signals.flow_sustained, signals.flow_exhaustion, signals.delta_expansion)]
    assert [sorted(map(str, x)) for x in shared] == [sorted(map(str, x)) for x in alone]
    assert calls.value == bars.count()
