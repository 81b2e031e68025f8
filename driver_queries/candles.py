from __future__ import annotations

from pyspark.sql import functions as F

from depthlens.operators import candles as cn
from depthlens.operators import quality
from depthlens.sources import driver_tables as src
from driver_queries.common import HOUR, ORDERED, TRADES, candles, recursive, rounded

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


# hourly candles give enough rows for the long averages
CD = candles(HOUR)
INPUTS = CD + """, tr1 AS (
 SELECT *, greatest(h-l, abs(h-lag(c) OVER w), abs(l-lag(c) OVER w)) AS tr, c-lag(c) OVER w AS dc,
  count(*) OVER (PARTITION BY symbol) AS n FROM cd WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
 src AS (SELECT *, avg(greatest(dc,0)) OVER w AS g0, avg(greatest(-dc,0)) OVER w AS l0,
   avg(c) OVER w20 AS m20, stddev_pop(c) OVER w20 AS sd20, avg(c) OVER w50 AS m50,
   avg(c) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 19 PRECEDING AND 15 PRECEDING) AS first5,
   avg(c) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS last5
  FROM tr1 WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
  w20 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
  w50 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""


def _ema(n, x="x.c", name="p"):
    k = f"(2.0::DOUBLE/{n + 1})"
    return f"{x}*{k}+{name}*(1-{k})"


STEPS = {
    "e9": ("x.c", _ema(9, name="p.e9")), "e21": ("x.c", _ema(21, name="p.e21")),
    "e12": ("x.c", _ema(12, name="p.e12")), "e26": ("x.c", _ema(26, name="p.e26")),
    "sg": ("0", f"({_ema(12, name='p.e12')}-({_ema(26, name='p.e26')}))*0.2::DOUBLE+p.sg*0.8::DOUBLE"),
    "atr": ("x.tr", "p.atr*(13.0::DOUBLE/14)+x.tr/14"),
    "ag": ("0", "CASE WHEN x.rn<14 THEN 0 WHEN x.rn=14 THEN x.g0 ELSE p.ag*(13.0::DOUBLE/14)+greatest(x.dc,0)/14 END"),
    "al": ("0", "CASE WHEN x.rn<14 THEN 0 WHEN x.rn=14 THEN x.l0 ELSE p.al*(13.0::DOUBLE/14)+greatest(-x.dc,0)/14 END"),
}
RSI = "CASE WHEN rn<14 THEN 50 WHEN al=0 THEN 100 ELSE 100-100/(1+ag/al) END"


def cset(spark, d):
    return src.candles(spark, d, HOUR)


def pick(*names):
    return {n: STEPS[n] for n in names}


@query("c01_sma", f"""WITH {INPUTS} SELECT symbol, ts, round(CASE WHEN rn>=19 THEN m20 ELSE 0 END,6) AS sma_20,
 round(CASE WHEN rn>=49 THEN m50 ELSE 0 END,6) AS sma_50 FROM src""")
def _(spark, d):
    o = cn.sma(cn.ordered_candles(cset(spark, d)), {"sma_20": 20, "sma_50": 50})
    return rounded(o.df, "symbol ts", "sma_20 sma_50")


@query("c02_ema", recursive(INPUTS, "src", pick("e9", "e21"),
                            "SELECT symbol, ts, round(e9,6) AS ema_9, round(e21,6) AS ema_21 FROM rec JOIN src USING (symbol, rn)"))
def _(spark, d):
    o = cn.ema(cn.ordered_candles(cset(spark, d)), {"ema_9": 9, "ema_21": 21})
    return rounded(o.df, "symbol ts", "ema_9 ema_21")


@query("c03_rsi", recursive(INPUTS, "src", pick("ag", "al"),
                            f"SELECT symbol, ts, round({RSI},6) AS rsi FROM rec JOIN src USING (symbol, rn)"))
def _(spark, d):
    return rounded(cn.rsi(cn.ordered_candles(cset(spark, d))).df, "symbol ts", "rsi")


@query("c04_atr", recursive(INPUTS, "src", pick("atr"),
                            "SELECT symbol, ts, round(atr,6) AS atr FROM rec JOIN src USING (symbol, rn)"))
def _(spark, d):
    return rounded(cn.atr(cn.ordered_candles(cset(spark, d))).df, "symbol ts", "atr")


VWAP = "sum((h+l+c)*v) OVER (PARTITION BY symbol ORDER BY rn)/(3*sum(v) OVER (PARTITION BY symbol ORDER BY rn))"


@query("c05_vwap", f"WITH {CD} SELECT symbol, ts, round({VWAP},6) AS vwap FROM cd")
def _(spark, d):
    return rounded(cn.vwap(cn.ordered_candles(cset(spark, d))).df, "symbol ts", "vwap")


@query("c06_bollinger", f"""WITH {INPUTS} SELECT symbol, ts, round(CASE WHEN rn>=19 THEN m20 ELSE 0 END,6) AS bb_middle,
 round(CASE WHEN rn>=19 THEN m20+2*sd20 ELSE 0 END,6) AS bb_upper,
 round(CASE WHEN rn>=19 THEN m20-2*sd20 ELSE 0 END,6) AS bb_lower FROM src""")
def _(spark, d):
    return rounded(cn.bollinger(cn.ordered_candles(cset(spark, d))).df, "symbol ts",
                   "bb_middle bb_upper bb_lower")


@query("c07_macd", recursive(INPUTS, "src", pick("e12", "e26", "sg"), """SELECT symbol, ts, round(e12-e26,6) AS macd,
 round(sg,6) AS macd_signal, round(e12-e26-sg,6) AS macd_hist FROM rec JOIN src USING (symbol, rn)"""))
def _(spark, d):
    return rounded(cn.macd(cn.ordered_candles(cset(spark, d))).df, "symbol ts",
                   "macd macd_signal macd_hist")


FRAME = f"""SELECT symbol, ts, round(CASE WHEN rn>=19 THEN m20 ELSE 0 END,6) AS sma_20,
 round(CASE WHEN rn>=49 THEN m50 ELSE 0 END,6) AS sma_50, round(e9,6) AS ema_9, round(e21,6) AS ema_21,
 round({RSI},6) AS rsi_14, round(atr,6) AS atr_14, round({VWAP},6) AS vwap,
 round(CASE WHEN rn>=19 THEN m20+2*sd20 ELSE 0 END,6) AS bb_upper,
 round(CASE WHEN rn>=19 THEN m20-2*sd20 ELSE 0 END,6) AS bb_lower, round(e12-e26,6) AS macd, round(sg,6) AS macd_signal,
 round(e12-e26-sg,6) AS macd_hist, h-l AS range, abs(c-o) AS body, h-greatest(o,c) AS upper_wick, least(o,c)-l AS lower_wick,
 round(lead(c) OVER (PARTITION BY symbol ORDER BY rn)/c-1,6) AS label, 2*c AS double_close, """
FRAME_COLS = ("sma_20 sma_50 ema_9 ema_21 rsi_14 atr_14 vwap bb_upper bb_lower macd macd_signal "
              "macd_hist label volume_ratio avg_range")


def _frame(spark, d, causal):
    double = {"double_close": lambda o: o.col("double_close", F.col("c") * 2.0)}
    frame = cn.indicator_frame(cset(spark, d), causal, double)
    return rounded(frame, "symbol ts range body upper_wick lower_wick double_close", FRAME_COLS)


@query("c08_indicator_frame", recursive(INPUTS, "src", STEPS, FRAME + """
 round(v/avg(v) OVER (PARTITION BY symbol),6) AS volume_ratio, round(avg(h-l) OVER (PARTITION BY symbol),6) AS avg_range
FROM rec JOIN src USING (symbol, rn)"""))
def _(spark, d):
    return _frame(spark, d, False)


@query("c09_causal_custom_frame", recursive(INPUTS, "src", STEPS, FRAME + """
 round(v/(sum(v) OVER w/(rn+1)),6) AS volume_ratio, round(sum(h-l) OVER w/(rn+1),6) AS avg_range
FROM rec JOIN src USING (symbol, rn) WINDOW w AS (PARTITION BY symbol ORDER BY rn)"""))
def _(spark, d):
    return _frame(spark, d, True)


@query("c10_market_state", recursive(INPUTS, "src", pick("e9", "e21", "atr"), f""", j AS (
 SELECT src.*, e9, e21, atr, coalesce(lag(c) OVER w,0) AS pp, {VWAP} AS vw, sum(v) OVER w/(rn+1) AS av,
  max(h) OVER w AS high, min(l) OVER w AS low FROM rec JOIN src USING (symbol, rn) WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
 k AS (SELECT *, CASE WHEN pp>0 THEN c/pp-1 END AS ret FROM j)
SELECT symbol, ts, c, pp AS previous_price, high, low, rn+1 AS candle_count, round(vw,6) AS vwap, round(e9,6) AS ema9,
 round(e21,6) AS ema21, round(CASE WHEN rn>=49 THEN m50 ELSE 0 END,6) AS sma50, round(CASE WHEN rn=0 THEN 0 ELSE atr END,6) AS atr14,
 round(av,6) AS avg_volume, round(CASE WHEN count(ret) OVER w>=2 THEN stddev_pop(ret) OVER w ELSE 0 END,6) AS volatility
FROM k WINDOW w AS (PARTITION BY symbol ORDER BY rn)"""))
def _(spark, d):
    return rounded(cn.market_state(cset(spark, d)),
                   "symbol ts c previous_price high low candle_count",
                   "vwap ema9 ema21 sma50 atr14 avg_volume volatility")


@query("c11_series_summary", f"""WITH {CD} SELECT symbol, arg_min(o,ts) AS open, max(h) AS high, min(l) AS low,
 arg_max(c,ts) AS close, sum(v) AS volume, count(*) AS candles FROM cd GROUP BY symbol""")
def _(spark, d):
    return cn.series_summary(cset(spark, d))


@query("c11_order_summary", """WITH cd AS (SELECT o_orderpriority AS symbol, epoch_us(o_orderdate)//1000 AS ts,
 arg_min(o_totalprice,o_orderkey) AS o, max(o_totalprice) AS h, min(o_totalprice) AS l, arg_max(o_totalprice,o_orderkey) AS c,
 count(*)::DOUBLE AS v FROM orders GROUP BY ALL)
SELECT symbol, arg_min(o,ts) AS open, max(h) AS high, min(l) AS low, arg_max(c,ts) AS close, sum(v) AS volume,
 count(*) AS candles FROM cd GROUP BY symbol""")
def _(spark, d):
    return cn.series_summary(src.order_candles(spark, d))


# prices of the event table jump, so ATR/price is scaled down to reach every regime branch
SCALED = INPUTS.replace("arg_min(price, trade_id) AS o, max(price) AS h, min(price) AS l, arg_max(price, trade_id) AS c",
                        "arg_min(p, trade_id) AS o, max(p) AS h, min(p) AS l, arg_max(p, trade_id) AS c").replace(
    "FROM trades GROUP BY ALL), cd", "FROM (SELECT *, 20000+price*0.5::DOUBLE AS p FROM trades) GROUP BY ALL), cd")
REGIME = """CASE WHEN rn<29 THEN 'ranging' WHEN c>0 AND atr/c>0.02 THEN 'volatile'
 WHEN rn>=49 AND m20>m50 AND c>m20 THEN 'trending_up' WHEN rn>=49 AND m20<m50 AND c<m20 THEN 'trending_down'
 WHEN (last5-first5)/first5>0.005 THEN 'trending_up' WHEN (last5-first5)/first5< -0.005 THEN 'trending_down' ELSE 'ranging' END"""


def calm(spark, d):
    c = cset(spark, d)
    return c.withColumns({k: F.col(k) * 0.5 + 20000.0 for k in "ohlc"})


@query("c12_regimes", recursive(SCALED, "src", pick("atr"),
                                f"SELECT symbol, ts, {REGIME} AS regime FROM rec JOIN src USING (symbol, rn)"))
def _(spark, d):
    return cn.regimes(calm(spark, d)).select("symbol", "ts", "regime")


@query("c13_regime_probabilities", recursive(SCALED, "src", pick("atr"), """, k AS (SELECT *,
 least(atr/c/0.02::DOUBLE,1)*0.6::DOUBLE AS vol, CASE WHEN rn>=49 THEN least(abs(m20-m50)/m50/0.01::DOUBLE,1) ELSE 0 END*0.4::DOUBLE AS tr0,
 CASE WHEN rn>=49 THEN m50 ELSE 0 END AS s50 FROM rec JOIN src USING (symbol, rn)),
 q AS (SELECT *, CASE WHEN m20>s50 THEN tr0 ELSE 0 END AS up, CASE WHEN m20<s50 THEN tr0 ELSE 0 END AS dn,
  greatest(1-vol-tr0,0) AS rest FROM k)
SELECT symbol, ts, round(CASE WHEN rn<29 THEN 0.25 ELSE up/(vol+up+dn+rest) END,6) AS p_trending_up,
 round(CASE WHEN rn<29 THEN 0.25 ELSE dn/(vol+up+dn+rest) END,6) AS p_trending_down,
 round(CASE WHEN rn<29 THEN 0.25 ELSE rest/(vol+up+dn+rest) END,6) AS p_ranging,
 round(CASE WHEN rn<29 THEN 0.25 ELSE vol/(vol+up+dn+rest) END,6) AS p_volatile FROM q"""))
def _(spark, d):
    return rounded(cn.regime_probabilities(calm(spark, d)), "symbol ts",
                   "p_trending_up p_trending_down p_ranging p_volatile")


@query("c14_regime_transitions", recursive(SCALED, "src", pick("atr"), f""", k AS (
 SELECT symbol, ts, rn, {REGIME} AS regime FROM rec JOIN src USING (symbol, rn)
 WHERE rn>=20 AND (rn-20) % greatest(1, n//100)=0),
 l AS (SELECT *, lag(regime) OVER (PARTITION BY symbol ORDER BY rn) AS prev FROM k)
SELECT symbol, ts, regime FROM l WHERE prev IS NULL OR prev<>regime"""))
def _(spark, d):
    return cn.regime_transitions(calm(spark, d))


# ---- quality -------------------------------------------------------------------------------
DIRTY = TRADES + """, dirty AS (SELECT symbol, trade_id AS seq, CASE WHEN trade_id%7=0 THEN ts_ms//600000*600000 ELSE ts_ms//60000*60000 END AS ts,
 CASE WHEN trade_id%19=0 THEN -price ELSE price END AS o, price+5 AS h, CASE WHEN trade_id%23=0 THEN price+2 ELSE price-5 END AS l,
 price+trade_id%4 AS c, qty AS v FROM trades)"""


def dirty(spark, d):
    """Candle-like rows in arrival order with repeated stamps, bad prices and bad shapes."""
    return src.trades(spark, d).selectExpr(
        "symbol", "trade_id as seq",
        "case when trade_id % 7 = 0 then ts_ms div 600000 * 600000 else ts_ms div 60000 * 60000 end as ts",
        "case when trade_id % 19 = 0 then -price else price end as o", "price + 5 as h",
        "case when trade_id % 23 = 0 then price + 2 else price - 5 end as l",
        "price + trade_id % 4 as c", "qty as v")


@query("q01_candle_quality", f"""WITH {DIRTY}, l AS (SELECT *, lag(ts) OVER w AS pt, lag(c) OVER w AS pc,
  count(*) OVER (PARTITION BY symbol, ts) AS same FROM dirty WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
 m AS (SELECT *, lag(same) OVER (PARTITION BY symbol ORDER BY seq) AS psame,
  (least(o,h,l,c)<=0 OR v<0 OR h<l) AS broken, (h<greatest(o,c) OR l>least(o,c)) AS shape FROM l),
 g AS (SELECT symbol, count(*) AS total_rows, count(*) FILTER (broken OR shape) AS invalid_rows,
 count(*) FILTER (NOT broken AND ts>0 AND ts-pt > CASE WHEN pt>0 AND psame>1 THEN 0 ELSE 120000 END) AS gaps,
 count(*) FILTER (NOT broken AND ts=pt) AS duplicates,
 count(*) FILTER (NOT broken AND pc>0 AND abs(c-pc)/pc>0.2) AS outliers FROM m GROUP BY symbol)
SELECT *, total_rows-invalid_rows AS valid_rows, greatest(0,100-(invalid_rows*3+gaps*2+duplicates+outliers*2)) AS score FROM g""")
def _(spark, d):
    return quality.candle_quality(dirty(spark, d))


@query("q02_sort_deduplicate", f"""WITH {DIRTY}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq) AS k FROM dirty)
SELECT symbol, ts, seq, o, h, l, c, v FROM r WHERE k=1""")
def _(spark, d):
    return quality.sort_and_deduplicate(dirty(spark, d)).select(
        "symbol", "ts", "seq", "o", "h", "l", "c", "v")


@query("q03_fill_gaps", f"""WITH {CD}, n AS (SELECT *, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS nx FROM cd),
 e AS (SELECT *, unnest(CASE WHEN nx IS NULL THEN [ts] ELSE range(ts, nx, {HOUR // 2}) END) AS t FROM n)
SELECT symbol, t AS ts, o, h, l, c, CASE WHEN t=ts THEN v ELSE 0 END AS v, t<>ts AS filled FROM e""")
def _(spark, d):
    return quality.fill_gaps(cset(spark, d), HOUR // 2).select(
        "symbol", "ts", "o", "h", "l", "c", "v", "filled")


@query("q04_first_per_trade_id", f"""WITH {TRADES}, r AS (SELECT symbol, ts_ms, trade_id//3 AS trade_id, price,
 row_number() OVER (PARTITION BY symbol, trade_id//3 ORDER BY ts_ms) AS k FROM trades)
SELECT symbol, ts_ms, trade_id, price FROM r WHERE k=1""")
def _(spark, d):
    t = src.trades(spark, d).selectExpr("symbol", "ts_ms", "trade_id div 3 as trade_id", "price")
    return quality.first_per_trade_id(t).select("symbol", "ts_ms", "trade_id", "price")


# a feed of sequence ranges: snapshots now and then, a few lost and repeated deltas
FEED = ORDERED + """, feed AS (SELECT symbol, trade_id AS arrival, rn,
 CASE WHEN rn%97=3 THEN 'snapshot' ELSE 'delta' END AS kind, CASE WHEN rn%41=5 THEN rn*2+4 WHEN rn%53=9 THEN rn*2-6 ELSE rn*2+1 END AS first_seq,
 CASE WHEN rn%41=5 THEN rn*2+4 WHEN rn%53=9 THEN rn*2-2 ELSE rn*2+2 END AS last_seq FROM tr)"""


def feed(spark, d):
    from depthlens.operators.flow import ordered_trades
    return ordered_trades(src.trades(spark, d)).df.selectExpr(
        "symbol", "trade_id as arrival", "case when rn % 97 = 3 then 'snapshot' else 'delta' end as kind",
        "case when rn % 41 = 5 then rn*2+4 when rn % 53 = 9 then rn*2-6 else rn*2+1 end as first_seq",
        "case when rn % 41 = 5 then rn*2+4 when rn % 53 = 9 then rn*2-2 else rn*2+2 end as last_seq")


@query("q05_strict_delta_chain", f"""WITH RECURSIVE {FEED}, w AS (
 SELECT symbol, arrival, rn, true AS accepted, last_seq AS m, CASE WHEN kind='snapshot' THEN 1 ELSE 0 END::BIGINT AS epoch FROM feed WHERE rn=0
 UNION ALL SELECT f.symbol, f.arrival, f.rn, f.kind='snapshot' OR f.first_seq=w.m+1,
  CASE WHEN f.kind='snapshot' OR f.first_seq=w.m+1 THEN f.last_seq ELSE w.m END,
  w.epoch+CASE WHEN f.kind='snapshot' THEN 1 ELSE 0 END FROM w JOIN feed f ON f.symbol=w.symbol AND f.rn=w.rn+1)
SELECT symbol, arrival, epoch, accepted, CASE WHEN epoch=0 THEN 'disconnected' WHEN accepted THEN 'connected' ELSE 'resyncing' END AS state FROM w""")
def _(spark, d):
    return quality.strict_delta_chain(feed(spark, d)).select(
        "symbol", "arrival", "epoch", "accepted", "state")


@query("q06_sequence_status", f"""WITH RECURSIVE {FEED}, w AS (
 SELECT symbol, arrival, rn, kind='snapshot' AS init, last_seq AS m, CASE WHEN kind='snapshot' THEN 'snapshot' ELSE 'stale' END AS status
  FROM feed WHERE rn=0
 UNION ALL SELECT f.symbol, f.arrival, f.rn, w.init OR f.kind='snapshot',
  CASE WHEN f.kind='snapshot' OR (w.init AND f.last_seq>w.m AND f.first_seq<=w.m+1) THEN f.last_seq ELSE w.m END,
  CASE WHEN f.kind='snapshot' THEN 'snapshot' WHEN NOT w.init THEN 'stale' WHEN f.last_seq<=w.m THEN 'duplicate'
   WHEN f.first_seq>w.m+1 THEN 'gap' ELSE 'ok' END FROM w JOIN feed f ON f.symbol=w.symbol AND f.rn=w.rn+1)
SELECT symbol, arrival, status FROM w""")
def _(spark, d):
    return quality.sequence_status(feed(spark, d)).select("symbol", "arrival", "status")
