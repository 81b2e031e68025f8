from __future__ import annotations

from pyspark.sql import functions as F

from depthlens.operators import book, detectors, flow, signals, strategy
from depthlens.operators.ordered import RN
from depthlens.sources import driver_tables as src
from driver_queries.books import SUMS, WALL_MULT, WALLS
from driver_queries.common import BOOKS, DAY, HOUR, LIQS, ORDERED, TRADES, rounded

QUERIES, SQL = {}, {}
BAR = 6 * HOUR


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def bars(spark, d):
    return flow.signal_bars(src.trades(spark, d), src.liquidations(spark, d), "aligned", BAR)


def sig(df):
    return rounded(df, "symbol ts_ms type direction price", "conf")


BARS = f"""bars AS (SELECT *, buys-sells AS delta, buys+sells AS volume, (buys-sells)/(buys+sells)*100 AS pressure,
  row_number() OVER (PARTITION BY symbol ORDER BY bar)-1 AS bn FROM (
  SELECT symbol, ts_ms//{BAR} AS bar, max(ts_ms) AS ts_ms, coalesce(sum(price*qty) FILTER (side='buy'),0) AS buys,
  coalesce(sum(price*qty) FILTER (side='sell'),0) AS sells, max(price) AS high, min(price) AS low, arg_max(price, trade_id) AS close FROM trades GROUP BY ALL))"""
OUT = "symbol, ts_ms, type, direction, price, round(conf,6) AS conf"


def S(kind, cond, source, conf, price="close", bull="delta>0"):
    """SELECT of one signal type."""
    d = f"CASE WHEN {bull} THEN 'bullish' ELSE 'bearish' END"
    k = kind if kind.startswith("CASE") else f"'{kind}'"
    return (f"SELECT symbol, ts_ms, {k} AS type, {d} AS direction, ({conf})::DOUBLE AS conf, {price} AS price "
            f"FROM {source} WHERE {cond}")


def clamp(x, a, b):
    return f"least(greatest({x},{a}),{b})"


LAGGED = """lb AS (SELECT *, lag(delta) OVER w AS pd, lag(pressure) OVER w AS pp, min(sign(delta)) OVER w5 AS lo5, max(sign(delta)) OVER w5 AS hi5,
  max(abs(delta)) OVER (PARTITION BY symbol ORDER BY bn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m20 FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY bn), w5 AS (PARTITION BY symbol ORDER BY bn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
 ls AS (SELECT *, abs(delta)/m20 AS st, lag(abs(delta)/m20) OVER (PARTITION BY symbol ORDER BY bn) AS ps FROM lb)"""
FLOW = f"{TRADES}, {BARS}, {LAGGED}"
SUSTAINED = S("FLOW_SUSTAINED", "bn>=4 AND lo5=hi5 AND lo5<>0", "lb", "60")
EXHAUSTION = S("FLOW_EXHAUSTION", "bn>=2 AND abs(pressure)>40 AND abs(pressure)>abs(pp)*0.8::DOUBLE", "lb", "70", bull="delta<=0")
EXPANSION = S("DELTA_EXPANSION", "abs(delta)>abs(pd)*2 AND volume>100000", "lb", clamp("abs(pressure)*0.3::DOUBLE+60", 60, 90))
ABSORB = S("ABSORPTION", "abs(delta)>10000 AND (high-low)/close<0.5", "bars", "75")
BYSTRENGTH = S("FLOW_EXHAUSTION", "st>0.5 AND sign(delta)=sign(pd) AND abs(st-ps)<0.2", "ls", "70", bull="delta<=0")


@query("g09_absorption", f"WITH {FLOW}, z AS ({ABSORB}) SELECT {OUT} FROM z")
def _(spark, d):
    return sig(signals.absorption(bars(spark, d), 10_000.0, 0.5))


@query("g10_flow_sustained", f"WITH {FLOW}, z AS ({SUSTAINED}) SELECT {OUT} FROM z")
def _(spark, d):
    return sig(signals.flow_sustained(bars(spark, d)))


@query("g11_flow_exhaustion", f"WITH {FLOW}, z AS ({EXHAUSTION}) SELECT {OUT} FROM z")
def _(spark, d):
    return sig(signals.flow_exhaustion(bars(spark, d), 40.0))


@query("n03_flow_exhaustion_by_strength", f"WITH {FLOW}, z AS ({BYSTRENGTH}) SELECT {OUT} FROM z")
def _(spark, d):
    return sig(signals.flow_exhaustion_by_strength(bars(spark, d), 20, 0.5))


@query("g12_delta_expansion", f"WITH {FLOW}, z AS ({EXPANSION}) SELECT {OUT} FROM z")
def _(spark, d):
    return sig(signals.delta_expansion(bars(spark, d)))


CVDIV = """cv AS (SELECT symbol, ts_ms, cvd, lag(cvd,9) OVER (PARTITION BY symbol ORDER BY rn) AS back FROM (
   SELECT *, sum(sgn*notional) OVER (PARTITION BY symbol ORDER BY rn) AS cvd FROM tr)),
 cj AS (SELECT b.*, c.cvd, c.back FROM bars b ASOF JOIN cv c ON b.symbol=c.symbol AND b.ts_ms>=c.ts_ms WHERE bn>=4)"""


@query("g13_cvd_divergence", f"WITH {ORDERED}, {BARS}, {CVDIV}, z AS (" + S(
    "CASE WHEN pressure>0 THEN 'CVD_BEAR_DIV' ELSE 'CVD_BULL_DIV' END", "(pressure>5 AND cvd<back) OR (pressure< -5 AND cvd>back)",
    "cj", "70", bull="pressure<0") + f") SELECT {OUT} FROM z")
def _(spark, d):
    return sig(signals.cvd_divergence(bars(spark, d), flow.cumulative_delta(src.trades(spark, d))))


@query("g14_tape_spikes", f"""WITH {TRADES}, k AS (SELECT *, count(*) OVER s AS n, count(*) FILTER (side='buy') OVER s AS nb, count(*) OVER (PARTITION BY symbol ORDER BY ts_ms
  RANGE BETWEEN {5 * HOUR - 1} PRECEDING AND CURRENT ROW) AS l FROM trades WINDOW s AS (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW)),
 z AS (""" + S("TAPE_SPIKE", "n>l*0.2::DOUBLE*2 AND n>=3", "k", "65", "price", "nb*2>=n") + f") SELECT {OUT} FROM z")
def _(spark, d):
    return sig(signals.tape_spikes(src.trades(spark, d), HOUR, 5 * HOUR, 2.0, 3))


# anchored chains: recursion over chain starts inside runs of one side
CHAINS = f"""{ORDERED}, {LIQS}, lr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms)-1 AS ln,
   lag(side) OVER (PARTITION BY symbol ORDER BY ts_ms) AS ps, ts_ms-lag(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms) AS dt FROM liqs),
 ru AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps<>side THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ln) AS run FROM lr),
 cs AS (SELECT symbol, run, min(ts_ms) AS t FROM ru GROUP BY ALL UNION ALL
  SELECT symbol, run, t FROM (SELECT cs.symbol, cs.run, min(ru.ts_ms) AS t FROM cs JOIN ru ON ru.symbol=cs.symbol AND ru.run=cs.run AND ru.ts_ms>=cs.t+{DAY} GROUP BY cs.symbol, cs.run, cs.t) z0),
 chj AS (SELECT ru.*, cs.t AS chain_ts FROM ru ASOF JOIN cs ON ru.symbol=cs.symbol AND ru.run=cs.run AND ru.ts_ms>=cs.t),
 chains AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY chain_ts) AS chain,
  row_number() OVER (PARTITION BY symbol, chain_ts ORDER BY ts_ms) AS chain_len FROM chj)"""


def chains(spark, d):
    return signals.cascade_chains(src.liquidations(spark, d), DAY)


@query("g15_cascade_chains", f"WITH RECURSIVE {CHAINS} SELECT symbol, trade_id, side, chain_ts, chain_len, chain FROM chains")
def _(spark, d):
    return chains(spark, d).select("symbol", "trade_id", "side", "chain_ts", "chain_len", "chain")


@query("g15_gap_chains", f"""WITH {TRADES}, {LIQS}, l AS (SELECT *, lag(side) OVER w AS ps, ts_ms-lag(ts_ms) OVER w AS dt FROM liqs WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)),
 m AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps<>side OR dt>={8 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts_ms) AS c FROM l)
SELECT symbol, trade_id, c::BIGINT AS chain, row_number() OVER (PARTITION BY symbol, c ORDER BY ts_ms) AS chain_len FROM m""")
def _(spark, d):
    return signals.cascade_chains(src.liquidations(spark, d), 8 * HOUR, anchored=False).select(
        "symbol", "trade_id", "chain", "chain_len")


CASCADE = S("CASCADE_CHAIN", "chain_len>=3", "chains", clamp("chain_len*8+60", 60, 92), "price", "side='short'")


@query("g15_cascade_signals", f"WITH RECURSIVE {CHAINS}, z AS ({CASCADE}) SELECT {OUT} FROM z")
def _(spark, d):
    return sig(signals.cascade_signals(chains(spark, d)))


def near(source, ref):
    """Near depth of the as-of book for liquidation rows; books come from SUMS."""
    return f"""nd AS (SELECT q.symbol, q.trade_id, any_value(q.ts_ms) AS ts_ms, any_value(q.price) AS price, any_value(q.qty) AS qty, any_value(q.side) AS side,
  any_value(q.seq) AS seq, any_value(q.mid) AS mid, any_value(q.chain) AS chain, count(l.price) AS levels,
  coalesce(sum(l.price*l.qty) FILTER ((q.side='long' AND l.price>={ref}*0.999::DOUBLE) OR (q.side='short' AND l.price<={ref}*1.001::DOUBLE)),0) AS near
 FROM (SELECT x.*, b.seq, b.mid FROM {source} x ASOF LEFT JOIN bk b ON x.symbol=b.symbol AND x.ts_ms>=b.ts_ms) q
 LEFT JOIN levels l ON l.symbol=q.symbol AND l.seq=q.seq AND l.side=CASE WHEN q.side='long' THEN 'bid' ELSE 'ask' END GROUP BY q.symbol, q.trade_id)"""


@query("g16_cascade_exhaustion", f"""WITH RECURSIVE {CHAINS}, {BOOKS[len(TRADES) + 2:]}, c3 AS (SELECT * FROM chains WHERE chain_len>=3), {near('c3', 'q.mid')},
 f AS (SELECT symbol, chain, min(ts_ms) AS ts_ms, arg_min(side, ts_ms) AS side, arg_min(mid, ts_ms) AS mid FROM nd WHERE levels>=3 AND near>price*qty*0.01::DOUBLE GROUP BY ALL),
 z AS (""" + S("CASCADE_EXHAUSTED", "true", "f", "85", "mid", "side='long'") + f") SELECT {OUT} FROM z")
def _(spark, d):
    return sig(signals.cascade_exhaustion(chains(spark, d), src.books(spark, d), 0.01))


@query("g17_cascade_squeeze", f"""WITH {BOOKS}, {LIQS}, big AS (SELECT *, 0 AS chain FROM liqs WHERE notional>=20000), {near('big', 'q.price')},
 z AS (""" + S("CASCADE_SQUEEZE", "price*qty>near*1.5::DOUBLE", "nd", "88", "price", "side='short'") + f") SELECT {OUT} FROM z")
def _(spark, d):
    return sig(signals.cascade_squeeze(src.liquidations(spark, d), src.books(spark, d), 20_000.0))


LIQK = f"""lk AS (SELECT *, count(*) OVER w AS n, sum(notional) OVER w AS tot, count(*) FILTER (side='long') OVER w AS nl FROM liqs
  WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW))"""
LIQ_CLUSTER = S("LIQ_CLUSTER", "n>=5 AND tot>50000", "lk", clamp("n*5+50", 50, 95), "price", "nl*2<=n")


@query("g18_liquidation_clusters", f"WITH {TRADES}, {LIQS}, {LIQK}, z AS ({LIQ_CLUSTER}) SELECT {OUT} FROM z")
def _(spark, d):
    return sig(signals.liquidation_clusters(src.liquidations(spark, d), DAY, 5, 50_000.0))


# ---- walls ------------------------------------------------------------------------------------
def walls(spark, d):
    return book.wall_levels(src.books(spark, d), WALL_MULT)


def executions(spark, d):
    trades = src.trades(spark, d).withColumn("price", (F.floor(F.col("price") / 5) * 5).cast("double"))
    return book.wall_executions(walls(spark, d), trades)


@query("g01_wall_signals", f"WITH {WALLS}, z AS (" + S(
    "CASE WHEN side='bid' THEN 'BID_WALL' ELSE 'ASK_WALL' END", "is_new AND qty*price>20000", "walls",
    clamp("55+4*(qty/med)", 55, 92), "price", "side='bid'") + f") SELECT {OUT} FROM z")
def _(spark, d):
    return sig(signals.wall_signals(walls(spark, d), 20_000.0))


EXEC = f"""{WALLS}, tt AS (SELECT symbol, floor(price/5)*5 AS price, ts_ms, qty AS tq FROM trades),
 ex AS (SELECT w.symbol, w.ts_ms, w.seq, w.side, w.price, any_value(w.qty) AS qty, any_value(w.mid) AS mid, any_value(w.pulled) AS pulled, any_value(w.first_ts) AS first_ts, coalesce(sum(tq),0) AS done
 FROM walls w LEFT JOIN tt ON tt.symbol=w.symbol AND tt.price=w.price AND tt.ts_ms>w.first_ts AND tt.ts_ms<=w.ts_ms GROUP BY w.symbol, w.ts_ms, w.seq, w.side, w.price)"""


@query("g02_wall_consumed", f"WITH {EXEC}, z AS (" + S("WALL_CONSUMED", "done/qty>0.1", "ex", "75", "price", "side='bid'") + f") SELECT {OUT} FROM z")
def _(spark, d):
    return sig(signals.wall_consumed(executions(spark, d), 0.1))


@query("g03_spoofing", f"WITH {EXEC}, z AS (" + S(
    "SPOOFING", f"pulled AND ts_ms-first_ts<{4 * DAY} AND abs(price-mid)/mid<0.9::DOUBLE AND done<qty*50", "ex", "85", "mid", "side='ask'") + f") SELECT {OUT} FROM z")
def _(spark, d):
    return sig(signals.spoofing(executions(spark, d), 0.9, 50.0, 4 * DAY))


@query("g04_compression", f"""WITH {WALLS}, nw AS (SELECT symbol, seq, bool_or(side='bid' AND (mid-price)/mid<0.05::DOUBLE) AS hb, bool_or(side='ask' AND (price-mid)/mid<0.05::DOUBLE) AS ha FROM walls GROUP BY ALL),
 a AS (SELECT b.*, coalesce(hb AND ha, false) AS walled, coalesce(hb AND ha, false) AND spread/mid*10000/100<5 AS tight FROM bk b LEFT JOIN nw USING (symbol, seq)),
 e AS (SELECT *, max(CASE WHEN NOT walled THEN rn END) OVER w AS r0, max(CASE WHEN tight THEN rn END) OVER w AS r1 FROM a WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT symbol, ts_ms, 'COMPRESSION' AS type, 'warning' AS direction, mid AS price, 74.0::DOUBLE AS conf FROM e WHERE tight AND (r1 IS NULL OR coalesce(r1<r0,false))""")
def _(spark, d):
    return sig(signals.compression_onsets(walls(spark, d), src.books(spark, d), 0.05, 5.0))


@query("g05_wall_ladders", f"""WITH {WALLS}, g AS (SELECT *, price-lead(price) OVER w AS g1, lead(price) OVER w-lead(price,2) OVER w AS g2 FROM walls WHERE side='bid'
  WINDOW w AS (PARTITION BY symbol, seq ORDER BY price DESC)),
 c AS (SELECT symbol, ts_ms, seq, max(price) AS price, count(*) FILTER (g1>0 AND g2>0 AND abs(g1-g2)/g1<0.3::DOUBLE) AS c FROM g GROUP BY ALL HAVING count(*)>=3),
 m AS (SELECT *, max(c) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM c)
SELECT symbol, ts_ms, 'LADDER' AS type, 'bullish' AS direction, price, {clamp('60.0::DOUBLE+8*c', 60, 88)}::DOUBLE AS conf FROM m WHERE c>=1 AND c>coalesce(best,0)""")
def _(spark, d):
    return sig(signals.wall_ladders(walls(spark, d)))


# ---- single books ---------------------------------------------------------------------------------
SK = "(b10-a10)/(b10+a10)"


@query("g06_book_skew", f"WITH {SUMS}, z AS (" + S("BOOK_SKEW", f"nb>=10 AND na>=10 AND abs({SK})>0.2", "(SELECT *, (seq+1)*86400000 AS ts_ms FROM s)",
       clamp(f"abs({SK})*50+50", 50, 85), "mid", f"{SK}>0") + f") SELECT {OUT} FROM z")
def _(spark, d):
    return sig(signals.book_skews(src.books(spark, d), 10, 0.2))


O5, O20 = "(b5-a5)/(b5+a5)", "(b20-a20)/(b20+a20)"


@query("g06_skew_divergence", f"WITH {SUMS}, z AS (" + S("SKEW_DIVERGENCE", f"nb>=10 AND na>=10 AND abs({O5}-{O20})>0.3", "(SELECT *, (seq+1)*86400000 AS ts_ms FROM s)",
       "70", "mid", f"{O5}>{O20}") + f") SELECT {OUT} FROM z")
def _(spark, d):
    return sig(signals.skew_divergence(src.books(spark, d)))


@query("n07_skew_traps", f"""WITH {SUMS}, k AS (SELECT symbol, seq, {O5} AS o5, {O20} AS o20 FROM s),
 t AS (SELECT *, CASE WHEN o5>0.2 AND o20< -0.05 THEN 'surface_bullish_deep_bearish' WHEN o5< -0.2 AND o20>0.05 THEN 'surface_bearish_deep_bullish' END AS trap FROM k)
SELECT symbol, seq, round(o5,6) AS obi5, round(o20,6) AS obi20, round(abs(o5-o20),6) AS divergence, trap,
 CASE WHEN trap='surface_bearish_deep_bullish' THEN 'bullish' ELSE 'bearish' END AS direction FROM t WHERE trap IS NOT NULL""")
def _(spark, d):
    return rounded(signals.skew_traps(src.books(spark, d), 0.2, 0.05), "symbol seq trap direction", "obi5 obi20 divergence")


VOIDS = f"""{BOOKS}, gp AS (SELECT l.*, abs(price-lag(price) OVER (PARTITION BY l.symbol, l.seq, l.side ORDER BY rank)) AS gap, lag(price) OVER (PARTITION BY l.symbol, l.seq, l.side ORDER BY rank) AS near,
   abs(max(price) OVER (PARTITION BY l.symbol, l.seq, l.side)-min(price) OVER (PARTITION BY l.symbol, l.seq, l.side))/9 AS ag
  FROM levels l JOIN bk USING (symbol, seq) WHERE rank<10 AND nb>=10 AND na>=10),
 vo AS (SELECT symbol, ts_ms, seq, side, arg_min(price, rank) AS price, arg_min(near, rank) AS near, arg_min(gap, rank) AS gap, any_value(ag) AS ag
  FROM gp WHERE ag>0 AND gap>ag*2 GROUP BY ALL),
 voids AS (SELECT *, CASE WHEN side='ask' THEN 'VOID_ASK' ELSE 'VOID_BID' END AS type, {clamp('60+8*least(3,floor(gap/ag))', 60, 85)}::DOUBLE AS conf FROM vo)"""


@query("g07_book_voids", f"WITH {VOIDS} SELECT symbol, ts_ms, type, CASE WHEN side='ask' THEN 'bullish' ELSE 'bearish' END AS direction, price, near, conf FROM voids")
def _(spark, d):
    return signals.book_voids(src.books(spark, d), 2.0).select("symbol", "ts_ms", "type", "direction", "price", "near", "conf")


@query("g08_n05_void_states", f"""WITH {VOIDS}, hit AS (SELECT v.symbol, v.seq, v.side, l.ts_ms AS t, l.price AS p, least(v.near,v.price) AS lo, greatest(v.near,v.price) AS hi
  FROM voids v JOIN levels l ON l.symbol=v.symbol AND l.side=v.side AND l.ts_ms>v.ts_ms AND l.ts_ms<=v.ts_ms+{3 * DAY} AND l.price>least(v.near,v.price) AND l.price<greatest(v.near,v.price)),
 ed AS (SELECT DISTINCT symbol, seq, side, t, lo, hi, p FROM hit UNION SELECT DISTINCT symbol, seq, side, t, lo, hi, lo FROM hit UNION SELECT DISTINCT symbol, seq, side, t, lo, hi, hi FROM hit),
 ho AS (SELECT *, p-lag(p) OVER (PARTITION BY symbol, seq, side, t ORDER BY p) AS hole FROM ed),
 fi AS (SELECT symbol, seq, side, t, 1-max(hole)/any_value(hi-lo) AS f FROM ho GROUP BY ALL),
 fm AS (SELECT symbol, seq, side, max(f) AS fill FROM fi GROUP BY ALL)
SELECT v.symbol, v.seq, v.type, round(coalesce(fill,0),6) AS fill, CASE WHEN coalesce(fill,0)>=0.8 THEN 'FILLED' WHEN coalesce(fill,0)>0 THEN 'FILLING' ELSE 'DETECTED' END AS state,
 v.ts_ms+{3 * DAY} AS expires_ms FROM voids v LEFT JOIN fm USING (symbol, seq, side)""")
def _(spark, d):
    b = src.books(spark, d)
    return rounded(signals.void_states(signals.book_voids(b, 2.0), b, 3 * DAY), "symbol seq type state expires_ms", "fill")


# ---- icebergs ------------------------------------------------------------------------------------------
ICE = f"""{BOOKS}, tb AS (SELECT x.*, b.seq, b.mid FROM (SELECT * FROM trades WHERE price*qty>=10000) x ASOF JOIN bk b ON x.symbol=b.symbol AND x.ts_ms>=b.ts_ms),
 hl AS (SELECT tb.symbol, tb.trade_id, any_value(tb.ts_ms) AS ts_ms, any_value(tb.price*tb.qty) AS notional, any_value(tb.mid) AS mid, any_value(l.side) AS book_side,
  arg_min(l.price, l.rank) AS level, arg_min(l.qty, l.rank) AS displayed FROM tb JOIN levels l ON l.symbol=tb.symbol AND l.seq=tb.seq AND l.side=CASE WHEN tb.side='buy' THEN 'ask' ELSE 'bid' END
  AND l.rank<20 AND abs(l.price-tb.price)/tb.price<0.01::DOUBLE GROUP BY tb.symbol, tb.trade_id),
 h2 AS (SELECT *, coalesce(ts_ms-lag(ts_ms) OVER (PARTITION BY symbol, book_side, level ORDER BY ts_ms)>{7 * DAY}, true) AS cut FROM hl),
 h3 AS (SELECT *, sum(cut::INT) OVER (PARTITION BY symbol, book_side, level ORDER BY ts_ms) AS life FROM h2),
 h4 AS (SELECT *, row_number() OVER w AS hits, sum(notional) OVER w AS absorbed FROM h3 WINDOW w AS (PARTITION BY symbol, book_side, level, life ORDER BY ts_ms)),
 h5 AS (SELECT *, absorbed/hits/mid/greatest(displayed,0.001::DOUBLE) AS ratio FROM h4),
 ice AS (SELECT *, CASE WHEN bool_or(hits>=3 AND ratio>0.4) OVER (PARTITION BY symbol, book_side, level, life ORDER BY ts_ms) THEN 'CONFIRMED' ELSE 'FORMING' END AS state FROM h5)"""


def ice(spark, d):
    return signals.iceberg_hits(src.trades(spark, d), src.books(spark, d), 10_000.0, 0.01, 7 * DAY, 0.4)


@query("g19_iceberg_hits", f"WITH {ICE} SELECT symbol, trade_id, book_side, level, displayed, hits, absorbed, round(ratio,6) AS ratio, state FROM ice")
def _(spark, d):
    return rounded(ice(spark, d), "symbol trade_id book_side level displayed hits absorbed state", "ratio")


@query("g19_iceberg_signals", f"""WITH {ICE} SELECT symbol, ts_ms, 'ICEBERG_CONFIRMED' AS type, CASE WHEN book_side='ask' THEN 'bullish' ELSE 'bearish' END AS direction,
 round({clamp('60+5*ratio', 60, 88)},6) AS conf FROM ice WHERE hits>=3 AND ratio>0.4""")
def _(spark, d):
    return rounded(signals.iceberg_signals(ice(spark, d), 0.4), "symbol ts_ms type direction", "conf")


@query("n04_iceberg_states", f"""WITH {ICE}, la AS (SELECT symbol, book_side, level, life, max(ts_ms) AS hit_ts, arg_max(state, ts_ms) AS state, arg_max(displayed, ts_ms) AS displayed FROM ice GROUP BY ALL),
 pr AS (SELECT la.*, hit_ts+{2 * DAY} AS ts_ms FROM la), pb AS (SELECT pr.*, b.seq FROM pr ASOF JOIN bk b ON pr.symbol=b.symbol AND pr.ts_ms>=b.ts_ms),
 lf AS (SELECT pb.*, l.qty AS left_qty FROM pb LEFT JOIN levels l ON l.symbol=pb.symbol AND l.seq=pb.seq AND l.side=pb.book_side AND l.price=pb.level)
SELECT symbol, book_side, level, life::BIGINT AS life, hit_ts, left_qty, CASE WHEN state<>'CONFIRMED' THEN 'NONE' WHEN left_qty IS NULL THEN 'PULLED' WHEN left_qty<displayed*0.5 THEN 'CONSUMED' ELSE 'CONFIRMED' END AS final_state FROM lf""")
def _(spark, d):
    return signals.iceberg_states(ice(spark, d), src.books(spark, d), 2 * DAY).select(
        "symbol", "book_side", "level", "life", "hit_ts", "left_qty", "final_state")


# ---- regimes ------------------------------------------------------------------------------------------------
@query("g20_flow_regimes", f"""WITH RECURSIVE {CHAINS}, {BOOKS[len(TRADES) + 2:]}, cvx AS (SELECT symbol, ts_ms, cvd, abs(cvd-lag(cvd,9) OVER (PARTITION BY symbol ORDER BY rn)) AS mv FROM (
   SELECT *, sum(sgn*notional) OVER (PARTITION BY symbol ORDER BY rn) AS cvd FROM tr)),
 rt AS (SELECT b.symbol, b.seq, count(t.ts_ms) AS r FROM bk b LEFT JOIN trades t ON t.symbol=b.symbol AND t.ts_ms<=b.ts_ms AND t.ts_ms>b.ts_ms-{DAY // 4} GROUP BY ALL),
 j1 AS (SELECT b.*, c.mv FROM bk b ASOF LEFT JOIN cvx c ON b.symbol=c.symbol AND b.ts_ms>=c.ts_ms),
 j2 AS (SELECT j1.*, CASE WHEN j1.ts_ms-ch.ts_ms<{DAY // 4} THEN ch.chain_len ELSE 0 END AS cl FROM j1 ASOF LEFT JOIN chains ch ON j1.symbol=ch.symbol AND j1.ts_ms>=ch.ts_ms),
 j3 AS (SELECT j2.*, spread/mid*10000*greatest(r,1) AS v, coalesce(mv,0) AS dd FROM j2 JOIN rt USING (symbol, seq)),
 j4 AS (SELECT *, avg(v) OVER w AS av, avg(dd) OVER w AS ad FROM j3 WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
 j5 AS (SELECT *, CASE WHEN coalesce(cl,0)>=2 THEN 'CHAOS' WHEN spread<=5 AND av<2 THEN 'COILING' WHEN av>5 AND ad>100000 THEN 'TRENDING' WHEN av>5 AND ad<50000 THEN 'CHOPPY' ELSE 'DEAD' END AS regime FROM j4)
SELECT symbol, seq, round(av,6) AS avg_vol, round(ad,6) AS avg_dir, regime, CASE regime WHEN 'CHAOS' THEN 90 WHEN 'COILING' THEN 70 WHEN 'TRENDING' THEN 80 WHEN 'CHOPPY' THEN 60 ELSE 30 END::INTEGER AS regime_score FROM j5""")
def _(spark, d):
    b = src.books(spark, d)
    tight = book.book_measures(b).select("symbol", "ts_ms", "seq", (F.col("spread") <= 5).alias("compression"))
    inputs = strategy.regime_inputs(b, src.trades(spark, d), chains(spark, d), tight, rate_ms=DAY // 4, chain_ms=DAY // 4)
    return rounded(signals.flow_regimes(inputs), "symbol seq regime regime_score", "avg_vol avg_dir")


# ---- admission and algebra ------------------------------------------------------------------------------------
ALL = f"""{CHAINS}, {BARS}, {LAGGED}, {LIQK}, raw AS ({SUSTAINED} UNION ALL {EXHAUSTION} UNION ALL {EXPANSION} UNION ALL {CASCADE} UNION ALL {LIQ_CLUSTER})"""


def registry(spark, d):
    b, l = signals.ordered_bars(bars(spark, d)), src.liquidations(spark, d)
    reg = detectors.DetectorRegistry()
    reg.register("sustained", lambda: signals.flow_sustained(b))
    reg.register("exhaustion", lambda: signals.flow_exhaustion(b, 40.0))
    reg.register("expansion", lambda: signals.delta_expansion(b))
    reg.register("cascade", lambda: signals.cascade_signals(signals.cascade_chains(l, DAY)))
    reg.register("cluster", lambda: signals.liquidation_clusters(l, DAY, 5, 50_000.0))
    reg.register("never", lambda: signals.flow_sustained(b, 3), enabled=False)
    return reg


def raw(spark, d):
    return registry(spark, d).run()


NAMED = dict(sustained=SUSTAINED, exhaustion=EXHAUSTION, expansion=EXPANSION, cascade=CASCADE, cluster=LIQ_CLUSTER)


@query("d24_detector_counts", f"WITH RECURSIVE {CHAINS}, {BARS}, {LAGGED}, {LIQK} " + " UNION ALL ".join(
    f"SELECT '{name}' AS detector, count(*) AS rows FROM ({sql}) {name}" for name, sql in NAMED.items()))
def _(spark, d):
    return registry(spark, d).row_counts()


COOL, MEM = DAY // 2, 2 * DAY
ADMIT = f"""{ALL}, rw AS (SELECT DISTINCT * FROM raw), gs AS (SELECT symbol, type, min(ts_ms) AS t FROM rw GROUP BY ALL UNION ALL
  SELECT symbol, type, t FROM (SELECT gs.symbol, gs.type, min(rw.ts_ms) AS t FROM gs JOIN rw ON rw.symbol=gs.symbol AND rw.type=gs.type AND rw.ts_ms>=gs.t+{COOL} GROUP BY gs.symbol, gs.type, gs.t) z1),
 kp AS (SELECT rw.*, row_number() OVER (PARTITION BY symbol, type, ts_ms ORDER BY direction, price) AS k FROM rw JOIN gs USING (symbol, type) WHERE rw.ts_ms=gs.t),
 ka AS (SELECT symbol, ts_ms, type, direction, conf, price, list({{'t': ts_ms, 'd': direction}}) OVER (PARTITION BY symbol ORDER BY ts_ms, type, direction, price ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS back FROM kp WHERE k=1),
 kb AS (SELECT *, len(list_filter(coalesce(back, []), lambda x: x.t>=ts_ms-{MEM} AND x.d=direction)) AS allies, CASE WHEN conf<60 THEN 0 ELSE conf END AS c0 FROM ka),
 adm AS (SELECT symbol, ts_ms, type, direction, price, floor(CASE WHEN allies>=2 THEN least(greatest(c0*1.3::DOUBLE,0),98) ELSE c0 END+0.5)::DOUBLE AS conf,
   row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, type, direction, price)-1 AS sn FROM kb)"""


def admitted(spark, d):
    return signals.admit(raw(spark, d), COOL, 60.0, MEM)


@query("d24_registered_signals", f"WITH RECURSIVE {ALL} SELECT {OUT} FROM raw")
def _(spark, d):
    return sig(raw(spark, d))


@query("g00_admitted_signals", f"WITH RECURSIVE {ADMIT} SELECT {OUT} FROM adm")
def _(spark, d):
    return sig(admitted(spark, d))


RECENT = f"""{ADMIT}, rc AS (SELECT *, list({{'t': ts_ms, 'd': direction, 'k': type, 'c': conf}}) OVER (PARTITION BY symbol ORDER BY sn ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS l0 FROM adm),
 rl AS (SELECT *, list_filter(l0, lambda x: x.t>=ts_ms-{MEM}) AS l FROM rc),
 vt AS (SELECT *, coalesce(list_sum(list_transform(list_filter(l, lambda x: x.d='bullish'), lambda x: x.c)),0) AS bull, coalesce(list_sum(list_transform(list_filter(l, lambda x: x.d='bearish'), lambda x: x.c)),0) AS bear,
  len(list_distinct(list_transform(list_filter(l, lambda x: x.d='bullish'), lambda x: x.k))) AS tb, len(list_distinct(list_transform(list_filter(l, lambda x: x.d='bearish'), lambda x: x.k))) AS ts FROM rl)"""


def recent(spark, d):
    return signals.recent_signals(admitted(spark, d))


@query("a01_confluence", f"""WITH RECURSIVE {RECENT} SELECT symbol, ts_ms, type, direction, CASE WHEN direction='bullish' THEN tb ELSE ts END::INTEGER AS confluence,
 array_to_string(list_sort(list_distinct(list_transform(list_filter(l, lambda x: x.d=direction), lambda x: x.k))), ',') AS types FROM vt""")
def _(spark, d):
    types = signals.confluence_types(F.col("recent"), F.col("ts_ms"), F.col("direction"), MEM)
    return recent(spark, d).select("symbol", "ts_ms", "type", "direction", F.size(types).alias("confluence"),
                                   F.array_join(types, ",").alias("types"))


@query("a02_direction_vote", f"""WITH RECURSIVE {RECENT}, q AS (SELECT *, CASE WHEN bull>bear+50 THEN 'LONG' WHEN bear>bull+50 THEN 'SHORT' ELSE 'NEUTRAL' END AS dir FROM vt),
 r AS (SELECT *, CASE dir WHEN 'LONG' THEN tb WHEN 'SHORT' THEN ts ELSE 0 END AS n, CASE WHEN dir='NEUTRAL' THEN 0 ELSE {clamp('50+abs(bull-bear)/5', 50, 95)} END AS c0 FROM q),
 u AS (SELECT *, CASE WHEN n>=4 THEN least(c0+15,98) ELSE c0 END AS c1 FROM r)
SELECT symbol, sn AS signal_no, bull, bear, dir AS vote, n::INTEGER AS confluence, round(CASE WHEN n>=5 THEN least(c1+25,98) ELSE c1 END,6) AS conf FROM u""")
def _(spark, d):
    v = recent(spark, d).withColumn("v", signals.direction_vote(F.col("recent"), F.col("ts_ms"), 50.0, MEM))
    return rounded(v.selectExpr("symbol", "signal_no", "v.bull", "v.bear", "v.direction as vote", "v.confluence", "v.conf"),
                   "symbol signal_no bull bear vote confluence", "conf")


@query("n01_live_confluence", f"""WITH RECURSIVE {RECENT}, lv AS (SELECT *, list_filter(l, lambda x: x.c*exp(-(CASE x.k WHEN 'CASCADE_CHAIN' THEN 0.003 ELSE 0.0005 END)::DOUBLE*(ts_ms-x.t))>20) AS m FROM vt),
 c AS (SELECT *, list_filter(m, lambda x: x.d='bullish') AS mb, list_filter(m, lambda x: x.d='bearish') AS ms FROM lv),
 e AS (SELECT *, CASE WHEN len(mb)>len(ms) THEN 'LONG' WHEN len(ms)>len(mb) THEN 'SHORT' ELSE 'NONE' END AS dir FROM c),
 f AS (SELECT *, CASE dir WHEN 'LONG' THEN len(list_distinct(list_transform(mb, lambda x: x.k))) WHEN 'SHORT' THEN len(list_distinct(list_transform(ms, lambda x: x.k))) ELSE 0 END AS n FROM e)
SELECT symbol, sn AS signal_no, dir AS direction, n::INTEGER AS count, CASE WHEN n>=5 THEN 25 WHEN n>=4 THEN 15 ELSE 0 END::INTEGER AS bonus FROM f""")
def _(spark, d):
    v = recent(spark, d).withColumn("v", signals.live_confluence(F.col("recent"), F.col("ts_ms"), 20.0, MEM))
    return v.selectExpr("symbol", "signal_no", "v.direction", "v.count", "v.bonus")


VERIFY = f"""{ADMIT}, pq AS (SELECT a.symbol, a.sn, a.direction, t.ts_ms, t.trade_id, t.price>a.price*1.2::DOUBLE AS up FROM adm a JOIN trades t ON t.symbol=a.symbol
   AND t.ts_ms>=a.ts_ms+{HOUR} AND t.ts_ms<=a.ts_ms+{10 * HOUR} AND (t.price>a.price*1.2::DOUBLE OR t.price<a.price*0.8::DOUBLE)),
 pf AS (SELECT symbol, sn, arg_min(up, trade_id) AS up, min(ts_ms) AS touch_ts FROM pq GROUP BY ALL),
 ver AS (SELECT a.*, touch_ts, CASE WHEN up IS NULL THEN 'EXPIRED' WHEN up=(direction='bullish') THEN 'VERIFIED' ELSE 'MISSED' END AS verification FROM adm a LEFT JOIN pf USING (symbol, sn))"""


def verified(spark, d):
    return signals.verify(recent(spark, d), src.trades(spark, d), "signal_no", HOUR, 10 * HOUR, 0.2)


@query("a03_verified_signals", f"WITH RECURSIVE {VERIFY} SELECT symbol, sn AS signal_no, touch_ts, verification FROM ver")
def _(spark, d):
    return verified(spark, d).select("symbol", "signal_no", "touch_ts", "verification")


@query("a04_signal_counts", f"""WITH RECURSIVE {VERIFY} SELECT symbol, count(*) AS "all", count(*) FILTER (direction='bullish') AS bull, count(*) FILTER (direction='bearish') AS bear,
 count(*) FILTER (conf<50) AS warn, count(*) FILTER (conf>=80) AS high, count(*) FILTER (verification='VERIFIED') AS verified FROM ver GROUP BY symbol""")
def _(spark, d):
    return signals.signal_counts(verified(spark, d))


@query("n10_confidence_bins", f"""WITH RECURSIVE {VERIFY}, b AS (SELECT *, CASE WHEN conf>=90 THEN '90+' WHEN conf>=80 THEN '80-90' WHEN conf>=70 THEN '70-80' WHEN conf>=60 THEN '60-70' ELSE '<60' END AS bin FROM ver)
SELECT bin, count(*) AS total, count(*) FILTER (verification='VERIFIED') AS wins, count(*) FILTER (verification='MISSED') AS missed,
 round(count(*) FILTER (verification='VERIFIED')/count(*),6) AS win_rate, round(count(*) FILTER (verification='VERIFIED')/nullif(count(*) FILTER (verification<>'EXPIRED'),0),6) AS verified_rate FROM b GROUP BY bin""")
def _(spark, d):
    from depthlens.plans.performance import confidence_bins
    return rounded(confidence_bins(verified(spark, d)), "bin total wins missed", "win_rate verified_rate")


@query("a05_recent_list", f"""WITH RECURSIVE {ADMIT}, nw AS (SELECT symbol, max(ts_ms)+1000 AS now FROM adm GROUP BY symbol),
 r AS (SELECT adm.*, now, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC, type DESC, direction DESC, price DESC) AS rank FROM adm JOIN nw USING (symbol) WHERE now-ts_ms<={5 * DAY})
SELECT symbol, rank::INTEGER AS rank, ts_ms, type, round(conf*exp(-(CASE type WHEN 'CASCADE_CHAIN' THEN 0.003 ELSE 0.0005 END)::DOUBLE*(now-ts_ms)),6) AS decayed_conf FROM r WHERE rank<=30""")
def _(spark, d):
    s = admitted(spark, d)
    now = s.groupBy("symbol").agg((F.max("ts_ms") + 1000).alias("now_ms"))
    return rounded(signals.recent_list(s, now, 30, 5 * DAY), "symbol rank ts_ms type", "decayed_conf")


@query("a06_summary_text", f"""WITH RECURSIVE {RECENT}, q AS (SELECT *, CASE WHEN bull>bear+50 THEN 'LONG' WHEN bear>bull+50 THEN 'SHORT' ELSE 'NEUTRAL' END AS dir, list_filter(l0[-10:], lambda x: x.t>=ts_ms-{MEM}) AS l10 FROM vt),
 r AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(l10, lambda x: CASE WHEN x.k LIKE '%CASCADE%' THEN 'CASCADE' END), lambda t: t IS NOT NULL))) AS tags, CASE dir WHEN 'LONG' THEN tb WHEN 'SHORT' THEN ts ELSE 0 END AS n FROM q)
SELECT symbol, sn AS signal_no, CASE WHEN dir='NEUTRAL' THEN 'DEAD | no clear direction' ELSE 'DEAD | '||lower(dir)||' pressure: '||CASE WHEN len(tags)>0 THEN array_to_string(tags,'; ') ELSE len(l0)||' signals agree' END||'. RR: 2.5. Confluence: '||n||'/6' END AS text FROM r""")
def _(spark, d):
    r = recent(spark, d)
    now = F.col("ts_ms")
    r = r.withColumn("v", signals.direction_vote(F.col("recent"), now, 50.0, MEM))
    text = signals.summary_text(F.lit("DEAD"), F.col("v.direction"), F.col("recent"), now, F.lit(2.5),
                                F.col("v.confluence"), MEM)
    return r.select("symbol", "signal_no", text.alias("text"))


@query("n06_compression_breakout", f"""WITH {FLOW}, c AS (SELECT symbol, ts_ms, CASE WHEN pressure>5 THEN 'buy' WHEN pressure< -5 THEN 'sell' ELSE 'neutral' END AS cvd_dir,
 CASE WHEN lo5=hi5 AND bn>=4 AND lo5>0 THEN 'buy' WHEN lo5=hi5 AND bn>=4 AND lo5<0 THEN 'sell' ELSE 'neutral' END AS flow_dir, CASE WHEN pd>0 THEN 'buy' WHEN pd<0 THEN 'sell' ELSE 'neutral' END AS tape_dir FROM lb),
 v AS (SELECT *, (cvd_dir='buy')::INT+(flow_dir='buy')::INT+(tape_dir='buy')::INT AS b, (cvd_dir='sell')::INT+(flow_dir='sell')::INT+(tape_dir='sell')::INT AS s FROM c)
SELECT symbol, ts_ms, CASE WHEN greatest(b,s)<2 OR b=s THEN 'neutral' WHEN b>s THEN 'bullish' ELSE 'bearish' END AS breakout,
 CASE greatest(b,s) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'none' END AS agreement FROM v""")
def _(spark, d):
    from depthlens.operators.ordered import order_rows
    o = order_rows(bars(spark, d), ["symbol"], ["bar_ts"]).frame(4, 0, lambda w: {
        "pd": F.lag("delta").over(w), "lo": F.min(F.signum("delta")).over(w.rowsBetween(-4, 0)),
        "hi": F.max(F.signum("delta")).over(w.rowsBetween(-4, 0))})

    def side(up, down):
        return F.when(up, "buy").when(down, "sell").otherwise("neutral")
    run = (F.col("lo") == F.col("hi")) & (F.col(RN) >= 4)
    hints = o.df.withColumns({
        "cvd_dir": side(F.col("pressure") > 5, F.col("pressure") < -5),
        "flow_dir": side(run & (F.col("lo") > 0), run & (F.col("lo") < 0)),
        "tape_dir": side(F.col("pd") > 0, F.col("pd") < 0)})
    return signals.compression_breakout(hints).select("symbol", F.col("end_ts").alias("ts_ms"), "breakout", "agreement")
