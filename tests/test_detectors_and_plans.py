import random

import pytest
from pyspark.sql import functions as F

from depthlens.functions import scalar
from depthlens.operators import candles as cn
from depthlens.operators import detectors, signals, strategy
from depthlens.operators.flow import cvd_zscore
from depthlens.plans import backtest, outcomes, sizing, trade_plans

BOOK = "symbol string, ts_ms long, seq long, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>"


def book(spark, *rows):
    return spark.createDataFrame([("X", ts, i, b, a) for i, (ts, b, a) in enumerate(rows)], BOOK)


def side_of(start, step, qtys):
    return [(start + step * i, float(q)) for i, q in enumerate(qtys)]


def one(df):
    return {r["seq"]: (r["detector"], r["side"], round(r["confidence"], 6)) for r in df.collect()}


def test_wall_and_compression(spark):
    plain, wall = [100] * 5, [100, 50000, 100, 100, 100]
    b = book(spark, (0, side_of(100.0, -0.5, wall), side_of(101.0, 0.5, plain)),
             (1000, side_of(100.0, -0.5, wall), side_of(101.0, 0.5, plain)),
             (40_000, side_of(100.0, -0.5, wall), side_of(101.0, 0.5, wall)))
    got = one(detectors.wall(b))
    assert got == {0: ("wall", "bullish", 0.7), 2: ("compression", "neutral", 0.49)}
    tight = book(spark, (0, side_of(100.0, -0.5, wall), side_of(100.01, 0.5, wall)))
    assert one(detectors.compression(tight))[0] == ("compression", "neutral", 0.85)


def test_void_ladder_skew(spark):
    bids, asks = side_of(100.0, -1.0, [10] * 5), [(101.0, 10.0), (120.0, 10.0), (121.0, 10.0), (122.0, 10.0)]
    assert one(detectors.liquidity_void(book(spark, (0, bids, asks))))[0][1] == "bullish"
    low = [(99.0, 10.0), (80.0, 10.0), (79.0, 10.0), (78.0, 10.0)]
    assert one(detectors.liquidity_void(book(spark, (0, low, side_of(101.0, 1.0, [10] * 5)))))[0][1] == "bearish"
    steps = [10, 90, 10, 90, 10, 90, 10]
    flat = side_of(101.0, 1.0, [10] * 7)
    assert one(detectors.ladder(book(spark, (0, side_of(100.0, -1.0, steps), flat))))[0] == ("ladder", "bullish", 0.6)
    assert one(detectors.skew(book(spark, (0, side_of(100.0, -1.0, [10000]), side_of(101.0, 1.0, [100])))))[0][1] == "bullish"


def test_quote_manipulation_against_loop(spark):
    rnd = random.Random(11)
    rows, t = [], 0
    for _ in range(120):
        t += rnd.choice([100, 300, 700, 2000])
        bids = sorted({(100.0 - rnd.randrange(6), float(rnd.choice([50, 200, 400, 900]))) for _ in range(4)}, reverse=True)
        asks = sorted({(101.0 + rnd.randrange(6), float(rnd.choice([50, 200, 400, 900]))) for _ in range(4)})
        rows.append((t, list(dict(bids[::-1]).items())[::-1], list(dict(asks[::-1]).items())[::-1]))
    rows = [(t, sorted(b, reverse=True), sorted(a)) for t, b, a in rows]
    got = {r["seq"]: (r["side"], r["confidence"]) for r in detectors.quote_manipulation(book(spark, *rows)).collect()}
    obs, checked = {}, 0
    for seq, (now, bids, asks) in enumerate(rows):
        obs = {k: o for k, o in obs.items() if now - o["last"] <= 20_000}
        for side, levels in (("bid", bids), ("ask", asks)):
            seen = set()
            for p, q in levels[:15]:
                seen.add((side, p))
                o = obs.get((side, p))
                if o is None:
                    if p * q >= 30_000:
                        obs[(side, p)] = {"first": now, "last": now, "n": 0, "max": q, "pulled": False}
                else:
                    o["last"], o["n"], o["max"] = now, o["n"] + 1, max(o["max"], q)
                    o["pulled"] |= q < o["max"] * 0.6
            for k, o in obs.items():
                if k[0] == side and k not in seen and not o["pulled"]:
                    o["pulled"], o["last"] = True, now
        best, sides = 0.0, set()
        for (side, _), o in obs.items():
            if not 500 <= now - o["first"] <= 20_000:
                continue
            dt = (o["last"] - o["first"]) / 1000
            rate = o["n"] / dt if dt > 0 else 0
            if o["pulled"]:
                conf, way = min(rate / 5, 1) * 0.8, "bullish" if side == "bid" else "bearish"
            elif rate > 5:
                conf, way = min((rate - 5) / 5, 0.6), "bearish" if side == "bid" else "bullish"
            else:
                continue
            if conf > best + 1e-12:
                best, sides = conf, {way}
            elif abs(conf - best) <= 1e-12:
                sides.add(way)
        if best > 0:
            assert got[seq][1] == pytest.approx(best), seq
            assert got[seq][0] in sides
            checked += 1
        else:
            assert seq not in got
    assert checked > 30


def test_liquidations_and_expansion(spark):
    liqs = spark.createDataFrame([("X", i * 500, i, 1000.0, 200.0, "long") for i in range(6)],
                                 "symbol string, ts_ms long, trade_id long, price double, qty double, side string")
    got = one(detectors.liquidation_cluster(liqs))
    assert got[3][1] == "neutral" and got[5] == ("liquidation_cluster", "bearish", round(1_200_000 / 1_500_000, 6))
    bars = spark.createDataFrame([("X", 0, 50000.0, 150000.0), ("X", 1, 100000.0, 200000.0)],
                                 "symbol string, bar_ts long, delta double, volume double")
    assert one(detectors.flow_expansion(bars))[1] == ("flow_expansion", "bullish", 0.8)
    chains = signals.cascade_chains(liqs.filter("trade_id < 5"), 2000)
    assert [r["chain_len"] for r in chains.orderBy("ts_ms").collect()] == [1, 2, 3, 4, 1]


def test_cvd_counts_a_trade_id_once(spark):
    rows = [("X", 1000 + i * 50, i, 100.0, 100.0 if i % 2 == 0 else 50.0, "buy" if i % 2 == 0 else "sell") for i in range(60)]
    cols = "symbol string, ts_ms long, trade_id long, price double, qty double, side string"
    last = cvd_zscore(spark.createDataFrame(rows, cols)).orderBy(F.desc("ts_ms")).first()
    assert last["valid"] and last["cvd_z"] != 0 and last["cvd_std"] > 0
    same = [("X", 1000 + i, 7, 100.0, 5.0, "buy") for i in range(10)]
    assert [r["warmup"] for r in cvd_zscore(spark.createDataFrame(same, cols)).collect()] == [1]


def test_vetoes_score_and_weights(spark):
    cols = "symbol string, cvd_z double, obi double, velocity_z double, micro_dev double, vpin double, detector_score double, volatility double, data_quality string"
    good = ("X", 1.5, -0.3, 2.1, -0.5, 0.1, 0.8, 0.01, "good")
    cases = [good, good[:7] + (0.0001, "good"), good[:2] + (0.01,) + good[3:], good[:5] + (0.9,) + good[6:], good[:8] + ("invalid",)]
    df = strategy.scored_frames(spark.createDataFrame(cases, cols))
    ids = [[v["id"] for v in r["vetoes"]] for r in df.collect()]
    assert ids == [[], ["flat_market"], ["obi_confluence"], ["vpin_veto"], ["data_quality"]]
    assert 0 < df.first()["score"] <= 1
    assert sum(strategy.normalized({"cvd_z": 2.0, "obi": 1.0}).values()) == pytest.approx(1)
    assert strategy.normalized({"cvd_z": 0.0}) == strategy.WEIGHTS
    filters = F.array(F.struct(F.lit("soft-penalty").alias("mode"), F.lit(False).alias("pass"), F.lit(-0.2).alias("adjustment")))
    r = spark.range(1).select(scalar.has_hard_veto(filters).alias("v"), scalar.soft_penalty_sum(filters).alias("p"),
                              scalar.is_expired(F.lit(0), F.lit(60_001)).alias("e")).first()
    assert tuple(r) == (False, -0.2, True)


def test_plans_sizing_and_fees(spark):
    r = spark.range(1)
    p = r.select(trade_plans.trade_plan(F.lit("BUY"), F.lit(100.0), F.lit(0.5), F.lit(None).cast("double")).alias("p"),
                 trade_plans.trade_plan(F.lit("SELL"), F.lit(100.0), F.lit(0.5), F.lit(102.0)).alias("s"),
                 trade_plans.trade_plan(F.lit("BUY"), F.lit(100.0), F.lit(0.5), F.lit(None).cast("double"), tp2_r=1.0).alias("n")).first()
    assert p["p"]["stop"] < p["p"]["entry"] < p["p"]["tp1"] < p["p"]["tp2"] and p["p"]["rr"] == 2.5
    assert p["s"]["tp2"] < p["s"]["entry"] < p["s"]["stop"] and p["n"] is None
    v = r.select(sizing.risk_size(10_000.0, 0.01, F.lit(100.0), F.lit(98.0)).alias("size"),
                 sizing.atr_stop(F.lit("long"), F.lit(100.0), F.lit(2.0), 1.5).alias("stop"),
                 scalar.fee(F.lit(10.0), F.lit(100.0), True).alias("maker"), scalar.fee(F.lit(10.0), F.lit(100.0), False).alias("taker"),
                 scalar.r_multiple(F.lit(200.0), F.lit(100.0)).alias("r")).first()
    assert (v["size"], v["stop"], round(v["maker"], 9), round(v["taker"], 9), v["r"]) == (50.0, 97.0, 0.2, 0.5, 2.0)


def test_bracket_exits(spark):
    cols = "symbol string, plan_id long, ts_ms long, side string, entry double, stop double, tp1 double, tp2 double, qty double"
    plans = spark.createDataFrame([("A", 1, 0, "BUY", 100.0, 98.0, 103.0, 105.0, 10.0), ("B", 2, 0, "BUY", 100.0, 98.0, 103.0, 105.0, 10.0),
                                   ("C", 3, 0, "SELL", 100.0, 102.0, 97.0, 95.0, 10.0), ("D", 4, 0, "BUY", 100.0, 98.0, 103.0, 105.0, 10.0)], cols)
    paths = {"A": [100, 103.5, 104, 106], "B": [100, 97], "C": [100, 96, 100.5], "D": []}
    prices = [(s, 10 * (i + 1), i, float(p)) for s, ps in paths.items() for i, p in enumerate(ps)]
    o = {r["symbol"]: r for r in outcomes.bracket_outcomes(plans, spark.createDataFrame(
        prices, "symbol string, ts_ms long, trade_id long, price double"), 1000).collect()}
    assert [o[s]["status"] for s in "ABCD"] == ["tp2_hit", "stopped_out", "stopped_out", "pending"]
    fees = 0.0005 * (1000 + 5 * 103.5 + 5 * 106)
    assert o["A"]["pnl"] == pytest.approx(5 * 3.5 + 5 * 6 - fees)
    assert o["B"]["pnl"] < 0 and o["B"]["exit_price"] == 98.0
    assert o["C"]["exit_price"] == 100.0 and o["C"]["tp1_price"] == 96.0 and o["C"]["pnl"] > 0


def test_regimes_frame_and_replay_checksum(spark):
    rising = [("X", i * 60_000, 100.0 + i, 101.0 + i, 99.5 + i, 100.5 + i, 500.0) for i in range(60)]
    cols = "symbol string, ts long, o double, h double, l double, c double, v double"
    df = spark.createDataFrame(rising, cols)
    assert cn.regimes(df).orderBy(F.desc("ts")).first()["regime"] == "trending_up"
    p = cn.regime_probabilities(df).orderBy(F.desc("ts")).first()
    assert sum(p[c] for c in p.asDict() if c.startswith("p_")) == pytest.approx(1)
    frame = cn.indicator_frame(df, custom={"double_close": lambda o: o.col("double_close", F.col("c") * 2)})
    rows = frame.orderBy("ts").collect()
    assert len(rows) == 60 and all(r["double_close"] == 2 * r["c"] for r in rows) and rows[-1]["label"] is None
    none = spark.createDataFrame([], "symbol string, plan_id long, submit_ms long, exit_ms long, pnl double, closed boolean")
    sums = {backtest.replay_summary(backtest.replay_snapshots(df.repartition(n), none), none).first()["checksum"] for n in (1, 4)}
    assert len(sums) == 1


def test_plan_states(spark):
    c = spark.createDataFrame([("p1", 0, 30), ("p2", 0, 30), ("p3", 0, 30), ("p4", 0, 30)], "plan_id string, ts_ms long, expires_ms long")
    k = spark.createDataFrame([("p1", 10, "arm"), ("p2", 40, "arm"), ("p3", 5, "cancel"), ("p3", 9, "arm")],
                              "plan_id string, ts_ms long, command string")
    got = {r["plan_id"]: r["state"] for r in trade_plans.plan_states(c, k).collect()}
    assert got == {"p1": "ARMED", "p2": "EXPIRED", "p3": "NEUTRAL", "p4": "EXPIRED"}
