from __future__ import annotations

from pyspark.sql import functions as F

from depthlens.functions import scalar
from depthlens.operators import flow, quality
from depthlens.sources import driver_tables as src
from driver_queries.common import DAY, HOUR, LIQS, ORDERED, TRADES, recursive, rounded, rsql

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


BAR = """min(ts_ms) AS first_ts, arg_min(price, trade_id) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, trade_id) AS close, sum(qty) AS volume, sum(qty) FILTER (side='buy') AS b,
  sum(qty) FILTER (side='sell') AS s"""
BAR_OUT = """open, high, low, close, volume, coalesce(b,0) AS buy_volume, coalesce(s,0) AS sell_volume,
  coalesce(b,0)-coalesce(s,0) AS delta, round((coalesce(b,0)-coalesce(s,0))/volume,6) AS pressure,
  round(1-abs(coalesce(b,0)-coalesce(s,0))/volume,6) AS absorption, round((high+low)/2,6) AS poc"""
BAR_COLS = "open high low close volume buy_volume sell_volume delta"


@query("f01_cumulative_delta", f"""WITH {ORDERED}
SELECT symbol, ts_ms, trade_id, sum(sgn*notional) OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id) AS cvd
FROM tr""")
def _(spark, d):
    return flow.cumulative_delta(src.trades(spark, d)).select("symbol", "ts_ms", "trade_id", "cvd")


@query("f02_cvd_zscore", recursive(
    ORDERED + """, n AS (SELECT symbol, rn, ts_ms, trade_id,
      sum(sgn*qty) OVER w / sum(qty) OVER w AS v FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY rn))""",
    "n", {"e": ("x.v*2.0::DOUBLE/21", "p.e*(1-2.0::DOUBLE/21)+x.v*2.0::DOUBLE/21"),
          "m": ("0", "p.m*0.95::DOUBLE+x.v*0.05::DOUBLE")},
    """, j AS (SELECT n.*, e, m, avg(v) OVER w AS m1, avg(v*v) OVER w AS m2 FROM n JOIN rec USING (symbol, rn)
  WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)),
 k AS (SELECT *, CASE WHEN rn=0 THEN 0 ELSE sqrt(greatest(m2-2*m*m1+m*m,0)) END AS sd FROM j)
SELECT symbol, trade_id, round(v,6) AS cvd_norm, round(e,6) AS ema_cvd, round(m,6) AS ema_mean,
 round(sd,6) AS cvd_std, round(CASE WHEN sd=0 THEN 0 ELSE (e-m)/sd END,6) AS cvd_z,
 least(rn+1,60) AS warmup, rn>=19 AS valid FROM k"""))
def _(spark, d):
    return rounded(flow.cvd_zscore(src.trades(spark, d)), "symbol trade_id warmup valid",
                   "cvd_norm ema_cvd ema_mean cvd_std cvd_z")


@query("f03_time_bars", f"""WITH {TRADES}, g AS (SELECT symbol, ts_ms//{HOUR}*{HOUR} AS bar_ts, {BAR}
FROM trades GROUP BY ALL) SELECT symbol, bar_ts, {BAR_OUT} FROM g""")
def _(spark, d):
    bars = flow.time_bars(src.trades(spark, d), HOUR)
    return rounded(bars, "symbol bar_ts " + BAR_COLS, "pressure absorption poc")


# a chain of greedy bar starts, written as a recursion over the bars
def _chain_bars(source_measure: str, size: float, final: str, rows: str = "tr", order: str = "rn") -> str:
    return f"""WITH RECURSIVE {ORDERED}, c AS (
  SELECT *, sum({source_measure}) OVER (PARTITION BY symbol ORDER BY {order}) AS hi,
    sum({source_measure}) OVER (PARTITION BY symbol ORDER BY {order}) - {source_measure} AS lo FROM {rows}),
 s AS (SELECT symbol, 0::BIGINT AS bar, 0.0::DOUBLE AS start FROM (SELECT DISTINCT symbol FROM tr)
  UNION ALL
  SELECT symbol, bar, start FROM (
    SELECT s.symbol, s.bar + 1 AS bar, min(c.lo) AS start FROM s JOIN c
    ON c.symbol = s.symbol AND c.lo >= s.start + {size} GROUP BY s.symbol, s.bar) z),
 b AS (SELECT c.*, s.bar FROM c ASOF JOIN s ON c.symbol = s.symbol AND c.lo >= s.start)
{final}"""


@query("f04_volume_bars", _chain_bars("qty", 200.0, f""", g AS (SELECT symbol, bar+1 AS bar, {BAR} FROM b GROUP BY ALL)
SELECT symbol, bar, first_ts AS bar_ts, volume AS measure, volume>=200 AS complete, {BAR_OUT} FROM g"""))
def _(spark, d):
    bars = flow.threshold_bars(src.trades(spark, d), 200.0)
    return rounded(bars, "symbol bar bar_ts measure complete " + BAR_COLS, "pressure absorption poc")


@query("f05_idle_closes", f"""WITH {TRADES}, g AS (SELECT symbol, ts_ms//{HOUR}*{HOUR} AS bar_ts,
 min(ts_ms) AS first_ts, max(ts_ms) AS last_ts FROM trades GROUP BY ALL),
n AS (SELECT *, lead(first_ts) OVER (PARTITION BY symbol ORDER BY bar_ts) AS next_ts FROM g)
SELECT symbol, bar_ts, coalesce(next_ts-last_ts>{HOUR}, true) AS idle,
 CASE WHEN coalesce(next_ts-last_ts>{HOUR}, true) THEN last_ts+{HOUR} ELSE next_ts END AS close_ts FROM n""")
def _(spark, d):
    return flow.idle_closes(src.trades(spark, d), HOUR).select("symbol", "bar_ts", "idle", "close_ts")


@query("f06_signal_bars", f"""WITH {TRADES}, {LIQS}, r AS (
 SELECT symbol, ts_ms, trade_id, price, CASE WHEN side='buy' THEN price*qty ELSE 0 END AS buys,
  CASE WHEN side='buy' THEN 0 ELSE price*qty END AS sells, 0 AS kind FROM trades
 UNION ALL SELECT symbol, ts_ms, trade_id, NULL, 0, 0, 1 FROM liqs),
g AS (SELECT symbol, ts_ms//{HOUR} AS bar, min(ts_ms) AS bar_ts, sum(buys) AS buys, sum(sells) AS sells,
  max(price) AS high, min(price) AS low, arg_max(price, trade_id) FILTER (kind=0) AS close, sum(kind)::BIGINT AS liq_count
 FROM r GROUP BY ALL)
SELECT symbol, bar_ts, buys, sells, high, low, close, liq_count, buys-sells AS delta, buys+sells AS volume,
 round((buys-sells)/(buys+sells)*100,6) AS pressure, round(abs(buys-sells)/(buys+sells)*100,6) AS strength
FROM g WHERE buys+sells>0""")
def _(spark, d):
    bars = flow.signal_bars(src.trades(spark, d), src.liquidations(spark, d), "aligned", HOUR)
    return rounded(bars, "symbol bar_ts buys sells high low close liq_count delta volume",
                   "pressure strength")


WITH_LIQS = """(SELECT symbol, ts_ms, trade_id, 0 AS kind, price, side, notional FROM tr UNION ALL
 SELECT symbol, ts_ms, trade_id, 1, NULL, NULL, 0.0::DOUBLE FROM trades WHERE event_type='error')"""


@query("f06b_notional_signal_bars", _chain_bars("notional", 300000.0, """, g AS (
 SELECT symbol, bar+1 AS bar, min(ts_ms) AS bar_ts, coalesce(sum(notional) FILTER (side='buy'),0) AS buys,
 coalesce(sum(notional) FILTER (side='sell'),0) AS sells, max(price) AS high, min(price) AS low, CAST(sum(kind) AS BIGINT) AS liq_count FROM b GROUP BY ALL)
SELECT symbol, bar, bar_ts, buys, sells, high, low, liq_count FROM g WHERE buys+sells>0""", WITH_LIQS, "ts_ms, kind, trade_id"))
def _(spark, d):
    bars = flow.signal_bars(src.trades(spark, d), src.liquidations(spark, d), "notional", size=300_000.0)
    return bars.select("symbol", "bar", "bar_ts", "buys", "sells", "high", "low", "liq_count")


@query("f06c_anchored_signal_bars", f"""WITH RECURSIVE {ORDERED},
 s AS (SELECT symbol, 1::BIGINT AS bar, min(ts_ms) AS start FROM tr GROUP BY symbol
  UNION ALL
  SELECT symbol, bar, start FROM (SELECT s.symbol, s.bar+1 AS bar, min(t.ts_ms) AS start FROM s JOIN tr t
   ON t.symbol=s.symbol AND t.ts_ms >= s.start + {3*HOUR} GROUP BY s.symbol, s.bar) z),
 b AS (SELECT t.*, s.bar FROM tr t ASOF JOIN s ON t.symbol=s.symbol AND t.ts_ms >= s.start)
SELECT symbol, bar, min(ts_ms) AS bar_ts, coalesce(sum(notional) FILTER (side='buy'),0) AS buys,
 coalesce(sum(notional) FILTER (side='sell'),0) AS sells,
 (count(*) FILTER (event_type='error'))::BIGINT AS liq_count FROM b GROUP BY ALL""")
def _(spark, d):
    bars = flow.signal_bars(src.trades(spark, d), src.liquidations(spark, d), "anchored", 3 * HOUR)
    return bars.select("symbol", "bar", "bar_ts", "buys", "sells", "liq_count")


def _buckets(qty: str) -> str:
    return f"""{ORDERED}, sized AS (SELECT * REPLACE ({qty} AS qty) FROM tr),
 c AS (SELECT *, sum(qty) OVER (PARTITION BY symbol ORDER BY rn) AS hi FROM sized),
 p AS (SELECT *, unnest(range(floor((hi-qty)/100)::BIGINT, greatest(floor((hi-qty)/100), ceil(hi/100)-1)::BIGINT+1)) AS bucket FROM c),
 q AS (SELECT symbol, bucket, ts_ms, side, hi, greatest(0, least(hi,(bucket+1)*100)-greatest(hi-qty,bucket*100)) AS part FROM p),
 g AS (SELECT symbol, bucket, max(ts_ms) AS ts_ms, coalesce(sum(part) FILTER (side='buy'),0)::DOUBLE AS buys,
  coalesce(sum(part) FILTER (side='sell'),0)::DOUBLE AS sells, max(hi)>=(bucket+1)*100 AS complete FROM q GROUP BY symbol, bucket)"""


def _vpin_sql(qty: str) -> str:
    return f"""WITH {_buckets(qty)}, f AS (SELECT *, abs(buys-sells)/100.0::DOUBLE AS imbalance,
  row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS n FROM g WHERE complete)
SELECT symbol, bucket, ts_ms, round(imbalance,6) AS imbalance, round(avg(imbalance) OVER (PARTITION BY symbol
 ORDER BY bucket ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),6) AS vpin, least(n,50) AS warmup, n>=20 AS valid FROM f"""


@query("f07_volume_buckets", f"WITH {_buckets('qty')} SELECT symbol, bucket, ts_ms, buys, sells, complete FROM g")
def _(spark, d):
    return flow.volume_buckets(src.trades(spark, d), 100).select(
        "symbol", "bucket", "ts_ms", "buys", "sells", "complete")


@query("f07_fractional_buckets", f"WITH {_buckets('qty/4')} SELECT symbol, bucket, ts_ms, buys, sells, complete FROM g")
def _(spark, d):
    trades = src.trades(spark, d).withColumn("qty", F.col("qty") / 4)
    return flow.volume_buckets(trades, 100).select("symbol", "bucket", "ts_ms", "buys", "sells", "complete")


@query("f07_vpin", _vpin_sql("qty"))
def _(spark, d):
    return rounded(flow.vpin(src.trades(spark, d), 100), "symbol bucket ts_ms warmup valid",
                   "imbalance vpin")


@query("f07_fractional_vpin", _vpin_sql("qty/4"))
def _(spark, d):
    trades = src.trades(spark, d).withColumn("qty", F.col("qty") / 4)
    return rounded(flow.vpin(trades, 100), "symbol bucket ts_ms warmup valid", "imbalance vpin")


@query("f08_notional_vpin", _chain_bars("notional", 250000.0, """, g AS (SELECT symbol, bar+1 AS bar,
 sum(notional) AS total, abs(sum(sgn*notional)) AS d FROM b GROUP BY ALL),
 f AS (SELECT symbol, bar, d/total AS imbalance FROM g WHERE total>=250000)
SELECT symbol, bar, round(imbalance,6) AS imbalance, round(avg(imbalance) OVER (PARTITION BY symbol ORDER BY bar
 ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),6) AS vpin FROM f"""))
def _(spark, d):
    return rounded(flow.notional_vpin(src.trades(spark, d), 250_000.0), "symbol bar", "imbalance vpin")


@query("f09_price_velocity", recursive(
    ORDERED + f""", l AS (SELECT *, lag(price) OVER w AS pp, ts_ms-lag(ts_ms) OVER w AS dt FROM tr
   WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
   n AS (SELECT symbol, trade_id, (price-pp)/pp*10000/(dt/1000.0::DOUBLE) AS v,
    row_number() OVER (PARTITION BY symbol ORDER BY rn)-1 AS rn FROM l WHERE pp>0 AND dt>0 AND dt<={2*HOUR})""",
    "n", {"e": ("x.v*2.0::DOUBLE/31", "p.e*(1-2.0::DOUBLE/31)+x.v*2.0::DOUBLE/31")},
    """, k AS (SELECT n.*, e, avg(e) OVER w AS m, coalesce(stddev_samp(e) OVER w,0) AS s FROM n JOIN rec USING (symbol, rn)
  WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT symbol, trade_id, round(v,6) AS bps_per_s, round(e,6) AS velocity,
 round(CASE WHEN rn<9 OR s=0 THEN 0 ELSE (e-m)/s END,6) AS velocity_z, rn>=29 AS valid FROM k"""))
def _(spark, d):
    return rounded(flow.price_velocity(src.trades(spark, d), max_gap_ms=2 * HOUR),
                   "symbol trade_id valid", "bps_per_s velocity velocity_z")


@query("f10_return_volatility", recursive(
    ORDERED + """, l AS (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY rn) AS pp FROM tr),
   n0 AS (SELECT symbol, trade_id, (price-pp)/pp AS ret, rn-1 AS rn FROM l WHERE pp>0),
   n AS (SELECT *, coalesce(stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 299 PRECEDING
    AND CURRENT ROW),0) AS s FROM n0)""",
    "n", {"e": ("x.s*2.0::DOUBLE/21", "p.e*(1-2.0::DOUBLE/21)+x.s*2.0::DOUBLE/21")},
    """SELECT symbol, trade_id, round(ret,6) AS ret, round(e*10000,6) AS volatility, rn>=28 AS valid
FROM n JOIN rec USING (symbol, rn)"""))
def _(spark, d):
    trades = src.trades(spark, d).select("symbol", "ts_ms", "trade_id", "price")
    return rounded(flow.return_volatility(trades), "symbol trade_id valid", "ret volatility")


@query("f11_whale_tiers", f"""WITH {ORDERED}, t AS (SELECT *, CASE WHEN notional>60000 THEN 3 WHEN notional>40000 THEN 2
 WHEN notional>20000 THEN 1 ELSE 0 END AS tier FROM tr)
SELECT symbol, trade_id, tier, (count(*) FILTER (tier=1) OVER w)::BIGINT AS tier1_count,
 (count(*) FILTER (tier=2) OVER w)::BIGINT AS tier2_count, (count(*) FILTER (tier=3) OVER w)::BIGINT AS tier3_count
FROM t WINDOW w AS (PARTITION BY symbol ORDER BY rn)""")
def _(spark, d):
    return flow.whale_tiers(src.trades(spark, d), (20_000.0, 40_000.0, 60_000.0)).select(
        "symbol", "trade_id", "tier", "tier1_count", "tier2_count", "tier3_count")


@query("f12_trade_rates", f"""WITH {TRADES} SELECT symbol, trade_id,
 """ + ", ".join(f"""count(*) OVER (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN {w - 1} PRECEDING
 AND CURRENT ROW) AS rate_{i}""" for i, w in enumerate((HOUR, 5 * HOUR, 30 * HOUR))) + " FROM trades")
def _(spark, d):
    return flow.trade_rates(src.trades(spark, d), (HOUR, 5 * HOUR, 30 * HOUR)).select(
        "symbol", "trade_id", "rate_0", "rate_1", "rate_2")


@query("f13_recent_vwap", f"""WITH {ORDERED} SELECT symbol, trade_id, round(CASE WHEN rn>=9 THEN sum(notional) OVER w
 / sum(qty) OVER w END,6) AS vwap FROM tr
 WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return rounded(flow.recent_vwap(src.trades(spark, d)), "symbol trade_id", "vwap")


@query("f14_liquidation_counts", f"""WITH {TRADES}, {LIQS} SELECT symbol, trade_id,
 (count(*) FILTER (side='long') OVER w)::BIGINT AS long_count, (count(*) FILTER (side='short') OVER w)::BIGINT AS short_count
FROM liqs WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return flow.liquidation_counts(src.liquidations(spark, d), DAY).select(
        "symbol", "trade_id", "long_count", "short_count")


POOLS = f"""{ORDERED}, v AS (SELECT symbol, trade_id, CASE WHEN rn>=9 THEN sum(notional) OVER w / sum(qty) OVER w END AS vwap
 FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
 pools AS (SELECT symbol, trade_id, leverage::INTEGER AS leverage, vwap+vwap/leverage AS upper, vwap-vwap/leverage AS lower
 FROM v, unnest([10,20,50,100]) AS u(leverage) WHERE vwap IS NOT NULL)"""


@query("f15_liquidity_pools", f"WITH {POOLS} SELECT symbol, trade_id, leverage, {rsql('upper lower')} FROM pools")
def _(spark, d):
    pools = flow.liquidity_pools(flow.recent_vwap(src.trades(spark, d)))
    return rounded(pools, "symbol trade_id leverage", "upper lower")


@query("n11_pool_open_interest", f"""WITH {POOLS}, oi AS (SELECT symbol, sum(notional) FILTER (side='buy') AS oi_long,
  sum(notional) FILTER (side='sell') AS oi_short FROM tr GROUP BY symbol)
SELECT symbol, trade_id, leverage, {rsql('upper lower')}, round(oi_long/4,6) AS long_notional,
 round(oi_short/4,6) AS short_notional FROM pools LEFT JOIN oi USING (symbol)""")
def _(spark, d):
    trades = src.trades(spark, d)
    n = F.col("price") * F.col("qty")
    oi = trades.groupBy("symbol").agg(
        F.sum(F.when(F.col("side") == "buy", n)).alias("oi_long"),
        F.sum(F.when(F.col("side") == "sell", n)).alias("oi_short"))
    pools = flow.pool_notional(flow.liquidity_pools(flow.recent_vwap(trades)), oi)
    return rounded(pools, "symbol trade_id leverage", "upper lower long_notional short_notional")


@query("f17_latest_price", f"""WITH {TRADES}, u AS (
 SELECT symbol, ts_ms, trade_id AS seq, price, 'trade' AS source FROM trades WHERE event_type<>'view'
 UNION ALL SELECT symbol, ts_ms, trade_id, price+0.5, 'mark' FROM trades WHERE event_type='view')
SELECT symbol, arg_max(price, seq) AS price, arg_max(source, seq) AS source, max(ts_ms) AS ts_ms FROM u GROUP BY symbol""")
def _(spark, d):
    t = src.trades(spark, d)
    marks = t.filter("event_type = 'view'").selectExpr(
        "symbol", "ts_ms", "trade_id as seq", "price + 0.5D as price")
    return flow.latest_price(t.filter("event_type <> 'view'"), marks)


# ---- scalar vocabulary over the trades -------------------------------------------------------
@query("x_scalar_measures", f"""WITH {TRADES} SELECT trade_id,
 floor(price/7+0.5)*7 AS price_rounded, CAST(floor(price/7+0.5) AS BIGINT) AS ticks, floor(qty/3+1e-9)*3 AS qty_lot,
 CASE WHEN price*floor(qty/3+1e-9)*3<9000 THEN ceil(9000/price/3-1e-9)*3 ELSE floor(qty/3+1e-9)*3 END AS qty_enforced,
 least(greatest(price,1500),3000) AS clamped, round(0.1::DOUBLE*price+2000*0.9::DOUBLE,6) AS ema_step,
 round(qty*price*0.0002::DOUBLE,6) AS maker_fee, round(qty*price*0.0005::DOUBLE,6) AS taker_fee,
 round(CASE WHEN side='buy' THEN price*0.0003::DOUBLE ELSE -price*0.0003::DOUBLE END,6) AS slip,
 round(CASE WHEN side='buy' THEN price+12/qty ELSE price-12/qty END,6) AS breakeven,
 round(qty*price*0.0002::DOUBLE+qty*price*0.0005::DOUBLE+price*0.0003::DOUBLE,6) AS total_cost,
 round(CASE WHEN qty=5 THEN 0 ELSE price/(qty-5) END,6) AS r_multiple,
 round(80*exp(-(CASE event_type WHEN 'purchase' THEN 0.0002 WHEN 'error' THEN 0.003 WHEN 'view' THEN 0.0008 ELSE 0.0005 END)::DOUBLE*qty*100),6) AS decayed,
 printf('%.2f', price/4) AS fixed, printf('%.2f%%', qty/4*100) AS pct FROM trades""")
def _(spark, d):
    t = src.trades(spark, d).withColumns({
        "dir": F.when(F.col("side") == "buy", "long").otherwise("short"),
        "type": F.when(F.col("event_type") == "purchase", "BID_WALL").when(
            F.col("event_type") == "error", "CASCADE_CHAIN").when(
            F.col("event_type") == "view", "VOID_ASK").otherwise("TAPE_SPIKE")})
    p, q, lit = F.col("price"), F.col("qty"), F.lit
    slip = scalar.slippage(p, F.col("dir"), 3)
    maker, taker = scalar.fee(q, p, True), scalar.fee(q, p, False)
    out = t.select(
        "trade_id", scalar.round_price(p, lit(7.0)).alias("price_rounded"),
        scalar.price_to_ticks(p, lit(7.0)).alias("ticks"),
        scalar.floor_qty(q, lit(3.0)).alias("qty_lot"),
        scalar.enforce_min_notional(p, q, lit(3.0), lit(9000.0)).alias("qty_enforced"),
        scalar.clamp(p, 1500, 3000).alias("clamped"),
        scalar.ema_step(lit(2000.0), p, 0.1).alias("ema_step"),
        maker.alias("maker_fee"), taker.alias("taker_fee"), slip.alias("slip"),
        scalar.breakeven_price(p, lit(12.0), q, F.col("dir")).alias("breakeven"),
        scalar.total_cost(maker, taker, slip).alias("total_cost"),
        scalar.r_multiple(p, q - 5.0).alias("r_multiple"),
        scalar.decayed(lit(80.0), F.col("type"), q * 100.0).alias("decayed"),
        scalar.format_fixed(p / 4.0).alias("fixed"), scalar.format_pct(q / 4.0).alias("pct"))
    return rounded(out, "trade_id price_rounded ticks qty_lot qty_enforced clamped fixed pct",
                   "ema_step maker_fee taker_fee slip breakeven total_cost r_multiple decayed")


@query("x_grouped_spread", f"""WITH {TRADES}, m AS (SELECT symbol, median(price) AS med, stddev_samp(price) AS sd FROM trades GROUP BY symbol)
SELECT t.symbol, round(any_value(med),6) AS median, round(any_value(sd),6) AS std,
 round(median(abs(price-med)),6) AS mad, round(median(abs(price-med))*1.4826,6) AS robust_std
FROM trades t JOIN m USING (symbol) GROUP BY t.symbol""")
def _(spark, d):
    return rounded(flow.price_spread(src.trades(spark, d)), "symbol", "median std mad robust_std")


@query("x_ages_and_vetoes", f"""WITH {TRADES}, f AS (SELECT *, trade_id%5=0 AS hard, trade_id%3=0 AS soft, trade_id%2=0 AS soft2 FROM trades)
SELECT trade_id, ts_ms%90000>60000 AS expired, ts_ms%90000>30000 AS stale, hard AS vetoed,
 round(CASE WHEN soft THEN qty/10 ELSE 0 END+CASE WHEN soft2 THEN 0.5::DOUBLE ELSE 0 END,6) AS penalty FROM f""")
def _(spark, d):
    t = src.trades(spark, d)

    def rule(mode, every, adjustment):
        return F.struct(F.lit(mode).alias("mode"), (F.col("trade_id") % every != 0).alias("pass"), adjustment.cast("double").alias("adjustment"))
    filters = F.array(rule("hard-veto", 5, F.lit(9)), rule("soft-penalty", 3, F.col("qty") / 10), rule("soft-penalty", 2, F.lit(0.5)))
    then = F.col("ts_ms") - F.col("ts_ms") % 90_000
    out = t.select(
        "trade_id", scalar.is_expired(then, F.col("ts_ms")).alias("expired"), quality.is_stale(then, F.col("ts_ms"), 30_000).alias("stale"),
        scalar.has_hard_veto(filters).alias("vetoed"), scalar.soft_penalty_sum(filters).alias("penalty"))
    return rounded(out, "trade_id expired stale vetoed", "penalty")
