from __future__ import annotations

from pyspark.sql import functions as F

from depthlens.functions import books as bx
from depthlens.operators import book, detectors, flow
from depthlens.operators import quality
from depthlens.operators.ordered import RN
from depthlens.sources import driver_tables as src
from driver_queries.common import BOOKS, DAY, HOUR, LIQS, TRADES, recursive, rounded

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def levels(df, *cols):
    return src.book_levels(df).select("symbol", "seq", "side", F.col("rank").cast("bigint").alias("rank"), "price", "qty", *cols)


@query("b01_sorted_book_levels", f"WITH {BOOKS} SELECT symbol, seq, side, rank, price, qty FROM levels")
def _(spark, d):
    b = src.books(spark, d).withColumns({"bids": F.reverse("bids"), "asks": F.shuffle("asks", F.lit(1))})
    return levels(book.sort_sides(b))


CHANGES = f"""{BOOKS}, st AS (SELECT l.*, b.rn AS step FROM levels l JOIN bk b USING (symbol, seq)),
 prev AS (SELECT symbol, side, price, qty AS was, step+1 AS step FROM st),
 ch AS (SELECT symbol, side, price, step, coalesce(qty,0) AS qty FROM st FULL JOIN prev USING (symbol, side, price, step)
  WHERE coalesce(qty,0)<>coalesce(was,0))"""


@query("b02_level_changes", f"""WITH {CHANGES} SELECT c.symbol, c.side, c.price, c.step, c.qty, b.seq FROM ch c
 JOIN bk b ON b.symbol=c.symbol AND b.rn=c.step""")
def _(spark, d):
    return book.level_changes(src.books(spark, d)).select("symbol", "side", "price", "step", "qty", "seq")


@query("b02_rebuilt_books", f"WITH {BOOKS} SELECT symbol, seq, side, rank, price, qty FROM levels WHERE rank<50")
def _(spark, d):
    b = src.books(spark, d)
    at = book.ordered_books(b).df.select(
        "symbol", F.lit(1).cast("bigint").alias("epoch"), F.col(RN).alias("step"), "ts_ms", "seq")
    return levels(book.rebuild_books(book.level_changes(b), at, bin_steps=8))


SUMS = f"""{BOOKS}, sz AS (SELECT l.*, b.nb, b.na, b.mid, b.spread, b.best_bid, b.best_ask, b.rn, price*qty AS n FROM levels l JOIN bk b USING (symbol, seq)),
 s AS (SELECT symbol, seq, any_value(rn) AS rn, any_value(mid) AS mid, any_value(spread) AS spread,
 any_value(best_bid) AS best_bid, any_value(best_ask) AS best_ask, any_value(nb) AS nb, any_value(na) AS na, """ + ", ".join(
    f"coalesce(sum(n) FILTER (side='{s}' AND rank<least({k},nb,na)),0) AS {s[0]}{k}" for s in ("bid", "ask") for k in (5, 10, 20)) + """,
 sum(n) FILTER (rank<least(5,nb,na))/sum(qty) FILTER (rank<least(5,nb,na)) AS mp,
 coalesce(sum(n) FILTER (side='bid' AND rank<10),0) AS bid_depth, coalesce(sum(n) FILTER (side='ask' AND rank<10),0) AS ask_depth FROM sz GROUP BY symbol, seq)"""
OBI = "CASE WHEN b{k}+a{k}>0 THEN (b{k}-a{k})/(b{k}+a{k}) ELSE 0 END"
IMB = ", ".join(f"round({OBI.format(k=k)},6) AS obi{k}" for k in (5, 10, 20))


@query("b03_book_measures", f"""WITH {SUMS} SELECT symbol, seq, best_bid, best_ask, mid, spread, round(spread/mid*10000,6) AS spread_bps,
 {IMB}, round(coalesce(mp,mid),6) AS microprice, bid_depth, ask_depth, abs({OBI.format(k=5)}-({OBI.format(k=20)}))>0.3 AS obi_divergence FROM s""")
def _(spark, d):
    return rounded(book.book_measures(src.books(spark, d)),
                   "symbol seq best_bid best_ask mid spread bid_depth ask_depth obi_divergence",
                   "spread_bps obi5 obi10 obi20 microprice")


@query("b05_smoothed_imbalance", recursive(
    f"""{BOOKS}, wq AS (SELECT l.symbol, l.seq, side, CASE WHEN side='bid' THEN (mid-price)/spread ELSE (price-mid)/spread END AS dist, qty
   FROM levels l JOIN bk USING (symbol, seq) WHERE rank<10 AND spread>0),
  g AS (SELECT symbol, seq, coalesce(sum(qty*exp(-2*dist)) FILTER (side='bid' AND dist>=0),0) AS b,
    coalesce(sum(qty*exp(-2*dist)) FILTER (side='ask' AND dist>=0),0) AS a FROM wq GROUP BY ALL),
  n AS (SELECT symbol, seq, CASE WHEN a+b>0 THEN (b-a)/(b+a) ELSE 0 END AS raw, row_number() OVER w -1 AS rn,
    exp(-coalesce((seq-lag(seq) OVER w)*{DAY},{2 * DAY})/{2.0 * DAY}::DOUBLE) AS k FROM g WINDOW w AS (PARTITION BY symbol ORDER BY seq))""",
    "n", {"e": ("x.raw*(1-x.k)", "p.e*x.k+x.raw*(1-x.k)")},
    "SELECT symbol, seq, round(raw,6) AS raw_obi, round(e,6) AS obi, rn>=4 AS valid FROM n JOIN rec USING (symbol, rn)"))
def _(spark, d):
    return rounded(book.smoothed_imbalance(src.books(spark, d), 2 * DAY), "symbol seq valid", "raw_obi obi")


@query("b07_book_velocity", f"""WITH {BOOKS}, st AS (SELECT l.*, b.rn FROM levels l JOIN bk b USING (symbol, seq)),
 m AS (SELECT x.symbol, x.seq, sum(abs(x.qty-y.qty)*x.price) AS moved FROM st x JOIN st y ON x.symbol=y.symbol AND x.side=y.side
  AND x.rank=y.rank AND y.rn=x.rn-1 AND x.price=y.price GROUP BY ALL),
 g AS (SELECT b.symbol, b.seq, coalesce(moved,0) AS moved, b.ts_ms-lag(b.ts_ms) OVER (PARTITION BY b.symbol ORDER BY b.seq) AS dt
  FROM bk b LEFT JOIN m USING (symbol, seq))
SELECT symbol, seq, round(moved/dt*1000,6) AS velocity FROM g""")
def _(spark, d):
    return rounded(book.book_velocity(src.books(spark, d)), "symbol seq", "velocity")


@query("b09_microprice_deviation", recursive(
    SUMS + ", n AS (SELECT symbol, seq, rn, (coalesce(mp,mid)-mid)/mid*10000 AS dv FROM s)",
    "n", {"e": ("x.dv*0.3::DOUBLE", "p.e*0.7::DOUBLE+x.dv*0.3::DOUBLE")},
    "SELECT symbol, seq, round(dv,6) AS deviation, round(e/100,6) AS micro_dev, rn>=4 AS valid FROM n JOIN rec USING (symbol, rn)"))
def _(spark, d):
    return rounded(book.microprice_deviation(src.books(spark, d)), "symbol seq valid", "deviation micro_dev")


@query("b11_dom_ladder", f"""WITH {BOOKS}, t AS (SELECT *, price*qty AS notional, least(15, count(*) FILTER (side='ask') OVER (PARTITION BY symbol, seq)) AS na
 FROM levels), r AS (SELECT * FROM t WHERE rank<15)
SELECT symbol, seq, side, CASE WHEN side='bid' THEN na+rank ELSE na-1-rank END AS position, price, qty, notional,
 round(notional/max(notional) OVER (PARTITION BY symbol, seq),6) AS bar FROM r""")
def _(spark, d):
    return rounded(book.dom_ladder(src.books(spark, d)).withColumn("position", F.col("position").cast("bigint")),
                   "symbol seq side position price qty notional", "bar")


@query("b11_level_heat", f"""WITH {BOOKS}, r AS (SELECT * FROM levels WHERE rank<25)
SELECT symbol, seq, side, rank, price, qty, round(qty/max(qty) OVER (PARTITION BY symbol, seq),6) AS heat FROM r""")
def _(spark, d):
    return rounded(book.level_heat(src.books(spark, d)).withColumn("rank", F.col("rank").cast("bigint")),
                   "symbol seq side rank price qty", "heat")


@query("b12_fill_estimates", f"""WITH {BOOKS}, od AS (SELECT symbol, ts_ms, trade_id AS order_id, side, qty*4 AS want FROM trades),
 j AS (SELECT od.*, b.seq, b.mid FROM od ASOF LEFT JOIN bk b ON od.symbol=b.symbol AND od.ts_ms>=b.ts_ms),
 w AS (SELECT j.*, l.price AS lp, greatest(least(l.qty, want-(sum(l.qty) OVER (PARTITION BY order_id ORDER BY rank)-l.qty)),0) AS take
  FROM j LEFT JOIN levels l ON l.symbol=j.symbol AND l.seq=j.seq AND l.side=CASE WHEN j.side='buy' THEN 'ask' ELSE 'bid' END),
 g AS (SELECT symbol, order_id, any_value(side) AS side, any_value(mid) AS mid, any_value(want) AS want,
  sum(lp*take) AS cost, sum(take) AS filled FROM w GROUP BY ALL)
SELECT symbol, order_id, round(cost/filled,6) AS fill_price, coalesce(least(filled,want),0) AS fill_qty,
 round(CASE WHEN mid IS NULL THEN 0 ELSE floor(least(abs((cost/filled-mid)/mid)*10000,50)*100+0.5)/100 END,6) AS slippage_bps FROM g""")
def _(spark, d):
    orders = src.trades(spark, d).selectExpr("symbol", "ts_ms", "trade_id as order_id", "side", "qty * 4 as want")
    return rounded(book.estimate_fills(orders, src.books(spark, d)), "symbol order_id fill_qty", "fill_price slippage_bps")


@query("b13_near_depth", f"""WITH {BOOKS} SELECT l.symbol, l.seq,
 coalesce(sum(price*qty) FILTER (side='bid' AND price>=mid*0.99::DOUBLE),0) AS near_bid,
 coalesce(sum(price*qty) FILTER (side='ask' AND price<=mid*1.01::DOUBLE),0) AS near_ask FROM levels l JOIN bk USING (symbol, seq) GROUP BY ALL""")
def _(spark, d):
    return src.books(spark, d).select(
        "symbol", "seq", bx.near_depth(F.col("bids"), bx.mid() * 0.99, True).alias("near_bid"),
        bx.near_depth(F.col("asks"), bx.mid() * 1.01, False).alias("near_ask"))


# thresholds are lowered: daily books of the event table have many small levels
WALLS = f"""{BOOKS}, ok AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq)-1 AS bi FROM bk WHERE nb>=5 AND na>=5),
 md AS (SELECT l.symbol, l.seq, side, median(qty) AS med FROM levels l JOIN ok USING (symbol, seq) WHERE rank<least(10,nb,na) GROUP BY ALL),
 wl AS (SELECT l.symbol, l.ts_ms, l.seq, l.side, l.rank, l.price, l.qty, med, bi, mid FROM levels l JOIN ok USING (symbol, seq) JOIN md USING (symbol, seq, side)
  WHERE rank<15 AND qty>med*(least(greatest(spread/mid*10000/5,0.5::DOUBLE),3.0::DOUBLE)*0.6::DOUBLE)),
 w1 AS (SELECT *, coalesce(lag(bi) OVER w<>bi-1, true) AS is_new, lag(qty) OVER w AS pq FROM wl WINDOW w AS (PARTITION BY symbol, side, price ORDER BY bi)),
 w2 AS (SELECT *, last_value(CASE WHEN is_new THEN qty END IGNORE NULLS) OVER w AS initial_qty,
   last_value(CASE WHEN is_new THEN ts_ms END IGNORE NULLS) OVER w AS first_ts,
   CASE WHEN NOT is_new THEN pq END AS prev_qty FROM w1 WINDOW w AS (PARTITION BY symbol, side, price ORDER BY bi ROWS UNBOUNDED PRECEDING)),
 walls AS (SELECT *, coalesce(prev_qty-qty>initial_qty*0.5, false) AS pulled FROM w2)"""
WALL_MULT = 0.6


def wset(spark, d):
    return book.wall_levels(src.books(spark, d), WALL_MULT)


@query("b14_wall_levels", f"""WITH {WALLS} SELECT symbol, seq, side, rank, price, qty, is_new, initial_qty, first_ts, pulled FROM walls""")
def _(spark, d):
    return wset(spark, d).withColumn("rank", F.col("rank").cast("bigint")).select(
        "symbol", "seq", "side", "rank", "price", "qty", "is_new", "initial_qty", "first_ts", "pulled")


# every other book quotes its prices 0.005 % higher: the same walls as on the plain grid, none of them new for the move
@query("b14_drifting_walls", f"""WITH {WALLS} SELECT symbol, seq, side, rank, CASE WHEN seq%2=1 THEN price*1.00005::DOUBLE ELSE price END AS price, qty, is_new, initial_qty, first_ts, pulled FROM walls""")
def _(spark, d):
    up = F.when(F.col("seq") % 2 == 1, 1.00005).otherwise(1.0)
    moved = src.books(spark, d).withColumns({
        c: F.transform(c, lambda x: F.struct((x["price"] * up).alias("price"), x["qty"].alias("qty"))) for c in ("bids", "asks")})
    return book.wall_levels(moved, WALL_MULT).withColumn("rank", F.col("rank").cast("bigint")).select(
        "symbol", "seq", "side", "rank", "price", "qty", "is_new", "initial_qty", "first_ts", "pulled")


@query("n02_wall_executions", f"""WITH {WALLS}, tt AS (SELECT symbol, floor(price/5)*5 AS price, ts_ms, qty AS tq FROM trades)
SELECT w.symbol, w.seq, w.side, w.price, coalesce(sum(tq),0) AS executed_qty FROM walls w LEFT JOIN tt
 ON tt.symbol=w.symbol AND tt.price=w.price AND tt.ts_ms>w.first_ts AND tt.ts_ms<=w.ts_ms GROUP BY w.symbol, w.seq, w.side, w.price""")
def _(spark, d):
    trades = src.trades(spark, d).withColumn("price", (F.floor(F.col("price") / 5) * 5).cast("double"))
    return book.wall_executions(wset(spark, d), trades).select("symbol", "seq", "side", "price", "executed_qty")


# ---- detectors ---------------------------------------------------------------------------------
def det(df, *evidence):
    return rounded(df.select("symbol", "seq", "detector", "side", "confidence", *[
        F.col("evidence")[e].alias(e) for e in evidence]), "symbol seq detector side", " ".join(("confidence",) + evidence))


@query("d04_skew", f"""WITH {SUMS}, k AS (SELECT symbol, seq, CASE WHEN bid_depth+ask_depth>0 THEN (bid_depth-ask_depth)/(bid_depth+ask_depth) ELSE 0 END AS skew FROM s)
SELECT symbol, seq, 'skew' AS detector, CASE WHEN abs(skew)<0.4 THEN 'neutral' WHEN skew>0 THEN 'bullish' ELSE 'bearish' END AS side,
 round(CASE WHEN abs(skew)>=0.4 THEN least(abs(skew)/0.8::DOUBLE,1) ELSE 0 END,6) AS confidence, round(skew,6) AS skew FROM k""")
def _(spark, d):
    return det(detectors.skew(src.books(spark, d)), "skew")


@query("d03_compression", f"""WITH {BOOKS}, m AS (SELECT symbol, seq, side, median(qty) AS med FROM levels GROUP BY ALL),
 g AS (SELECT l.symbol, l.seq, max(qty) FILTER (side='bid' AND qty>med*3) AS b, max(qty) FILTER (side='ask' AND qty>med*3) AS a
  FROM levels l JOIN m USING (symbol, seq, side) GROUP BY ALL)
SELECT symbol, seq, 'compression' AS detector, 'neutral' AS side, CASE WHEN b IS NOT NULL AND a IS NOT NULL AND spread/mid<0.01 THEN 0.85 ELSE 0 END::DOUBLE AS confidence,
 b AS bid_wall_qty, a AS ask_wall_qty FROM g JOIN bk USING (symbol, seq)""")
def _(spark, d):
    return det(detectors.compression(src.books(spark, d), 0.01), "bid_wall_qty", "ask_wall_qty")


@query("d05_liquidity_void", f"""WITH {BOOKS}, g AS (SELECT *, abs(price-lag(price) OVER w) AS gap, lag(price) OVER w AS pp FROM levels WHERE rank<10
  WINDOW w AS (PARTITION BY symbol, seq, side ORDER BY rank)),
 a AS (SELECT symbol, seq, side, max(gap) AS mx, median(gap) AS md, count(*) AS n, arg_max((price+pp)/2, (gap,-rank)) AS vm FROM g GROUP BY ALL),
 c AS (SELECT *, CASE WHEN n>=3 AND mx>=md*3 THEN least(mx/(md*5),0.8) ELSE 0 END AS conf FROM a),
 p AS (SELECT symbol, seq, max(conf) FILTER (side='bid') AS cb, max(conf) FILTER (side='ask') AS ca, max(mx) FILTER (side='bid') AS mb,
  max(mx) FILTER (side='ask') AS ma, max(vm) FILTER (side='bid') AS vb, max(vm) FILTER (side='ask') AS va FROM c GROUP BY ALL)
SELECT symbol, seq, 'liquidity_void' AS detector, CASE WHEN greatest(cb,ca)=0 THEN 'neutral' WHEN cb>=ca THEN 'bearish' ELSE 'bullish' END AS side,
 round(greatest(cb,ca),6) AS confidence, CASE WHEN cb>=ca THEN mb ELSE ma END AS max_gap,
 CASE WHEN cb>=ca THEN vb ELSE va END AS void_mid FROM p""")
def _(spark, d):
    return det(detectors.liquidity_void(src.books(spark, d)), "max_gap", "void_mid")


@query("d06_ladder", f"""WITH {BOOKS}, m AS (SELECT symbol, seq, side, median(qty) AS med FROM levels WHERE rank<15 GROUP BY ALL),
 w AS (SELECT l.*, abs(price-lag(price) OVER (PARTITION BY l.symbol, l.seq, l.side ORDER BY rank)) AS gap FROM levels l JOIN m USING (symbol, seq, side) WHERE qty>=med*2),
 a AS (SELECT symbol, seq, side, count(*) AS n, stddev_pop(gap)/avg(gap) AS cv FROM w GROUP BY ALL),
 c AS (SELECT *, CASE WHEN n>=3 AND cv<=0.6 THEN least(n/5,0.8) ELSE 0 END AS conf FROM a),
 p AS (SELECT symbol, seq, coalesce(max(conf) FILTER (side='bid'),0) AS cb, coalesce(max(conf) FILTER (side='ask'),0) AS ca,
  coalesce(max(n) FILTER (side='bid'),0) AS nb2, coalesce(max(n) FILTER (side='ask'),0) AS na2 FROM c GROUP BY ALL)
SELECT b.symbol, b.seq, 'ladder' AS detector, CASE WHEN greatest(coalesce(cb,0),coalesce(ca,0))=0 THEN 'neutral' WHEN cb>=ca THEN 'bullish' ELSE 'bearish' END AS side,
 round(greatest(coalesce(cb,0),coalesce(ca,0)),6)::DOUBLE AS confidence, coalesce(CASE WHEN cb>=ca THEN nb2 ELSE na2 END,0)::DOUBLE AS wall_count
FROM bk b LEFT JOIN p USING (symbol, seq)""")
def _(spark, d):
    return det(detectors.ladder(src.books(spark, d), 0.6), "wall_count")


BIG = f"""{BOOKS}, m AS (SELECT symbol, seq, side, median(qty) AS med, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY symbol, seq, side) AS full_n FROM levels)
   WHERE rank<15 AND full_n>=5 GROUP BY ALL),
 q AS (SELECT l.*, med, row_number() OVER (PARTITION BY l.symbol, l.side, l.price ORDER BY l.seq)-1 AS rn FROM levels l JOIN m USING (symbol, seq, side)
  WHERE rank<15 AND qty>=med*2 AND price*qty>=50000),
 st AS (SELECT symbol, side, price, min(ts_ms) AS t FROM q GROUP BY ALL
  UNION ALL SELECT symbol, side, price, t FROM (SELECT st.symbol, st.side, st.price, min(q.ts_ms) AS t FROM st JOIN q
   ON q.symbol=st.symbol AND q.side=st.side AND q.price=st.price AND q.ts_ms>st.t+{5 * DAY} GROUP BY ALL) z)"""


@query("d01_wall", f"""WITH RECURSIVE {BIG}, f AS (SELECT q.*, row_number() OVER (PARTITION BY symbol, seq, side ORDER BY rank) AS k
  FROM q JOIN st USING (symbol, side, price) WHERE q.ts_ms=st.t),
 p AS (SELECT symbol, seq, max(price) FILTER (side='bid' AND k=1) AS b, max(price) FILTER (side='ask' AND k=1) AS a FROM f GROUP BY ALL)
SELECT symbol, seq, CASE WHEN b IS NOT NULL AND a IS NOT NULL THEN 'compression' ELSE 'wall' END AS detector,
 CASE WHEN b IS NOT NULL AND a IS NOT NULL THEN 'neutral' WHEN b IS NOT NULL THEN 'bullish' ELSE 'bearish' END AS side,
 CASE WHEN b IS NOT NULL AND a IS NOT NULL THEN 0.49 ELSE 0.7 END::DOUBLE AS confidence, coalesce(b,a) AS wall_price FROM p""")
def _(spark, d):
    return det(detectors.wall(src.books(spark, d), 2.0, 50_000.0, 5 * DAY), "wall_price")


@query("d02_wall_states", f"""WITH RECURSIVE {BIG}, j AS (SELECT q.*, s.t AS t0 FROM q ASOF JOIN st s
   ON q.symbol=s.symbol AND q.side=s.side AND q.price=s.price AND q.ts_ms>=s.t),
 i AS (SELECT j.*, q0.qty AS q0 FROM j JOIN q q0 ON q0.symbol=j.symbol AND q0.side=j.side AND q0.price=j.price AND q0.ts_ms=j.t0)
SELECT symbol, seq, side, price, qty, q0 AS initial_qty, CASE WHEN ts_ms=t0 THEN 'appeared' WHEN qty>q0*1.2::DOUBLE THEN 'strengthened'
 WHEN qty<q0*0.6::DOUBLE THEN 'pulled' ELSE 'held' END AS state FROM i""")
def _(spark, d):
    return detectors.wall_states(src.books(spark, d), 2.0, 50_000.0, 5 * DAY).select(
        "symbol", "seq", "side", "price", "qty", "initial_qty", "state")


@query("d07_iceberg", f"""WITH {SUMS}, x AS (SELECT b.symbol, b.seq, coalesce(sum(t.price*t.qty) FILTER (t.side='sell'),0) AS sells,
  coalesce(sum(t.price*t.qty) FILTER (t.side='buy'),0) AS buys FROM bk b LEFT JOIN trades t ON t.symbol=b.symbol AND t.ts_ms<=b.ts_ms AND t.ts_ms>=b.ts_ms-{5 * DAY} GROUP BY ALL),
 k AS (SELECT symbol, seq, CASE WHEN ask_depth>0 THEN sells/ask_depth ELSE 0 END AS sx, CASE WHEN bid_depth>0 THEN buys/bid_depth ELSE 0 END AS bx FROM x JOIN s USING (symbol, seq))
SELECT symbol, seq, 'iceberg' AS detector, CASE WHEN greatest(sx,bx)<=2 THEN 'neutral' WHEN sx>bx THEN 'bullish' ELSE 'bearish' END AS side,
 round(CASE WHEN greatest(sx,bx)>=2 THEN least((greatest(sx,bx)-2)/2,1) ELSE 0 END,6) AS confidence,
 round(sx,6) AS sell_absorption, round(bx,6) AS buy_absorption FROM k""")
def _(spark, d):
    return det(detectors.iceberg(src.books(spark, d), src.trades(spark, d), 5 * DAY), "sell_absorption", "buy_absorption")


@query("d08_flow_expansion", f"""WITH {TRADES}, g AS (SELECT symbol, ts_ms//{HOUR}*{HOUR} AS bar_ts, sum(qty) AS v,
  sum(CASE WHEN side='buy' THEN qty ELSE -qty END) AS d FROM trades GROUP BY ALL),
 l AS (SELECT *, lag(d) OVER w AS p, row_number() OVER w -1 AS seq FROM g WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)),
 k AS (SELECT *, coalesce(v>=15 AND p<>0 AND abs(d)>=abs(p)*2, false) AS hit FROM l)
SELECT symbol, seq, 'flow_expansion' AS detector, CASE WHEN NOT hit OR d=0 THEN 'neutral' WHEN d>0 THEN 'bullish' ELSE 'bearish' END AS side,
 round(CASE WHEN hit THEN least(abs(d)/15,1)*0.8::DOUBLE ELSE 0 END,6) AS confidence, d AS delta, v AS volume FROM k""")
def _(spark, d):
    return det(detectors.flow_expansion(flow.time_bars(src.trades(spark, d), HOUR), 15.0), "delta", "volume")


@query("d10_liquidation_cluster", f"""WITH {TRADES}, {LIQS}, k AS (SELECT symbol, trade_id, count(*) OVER w AS n, coalesce(sum(notional) FILTER (side='long') OVER w,0) AS lo,
  coalesce(sum(notional) FILTER (side='short') OVER w,0) AS sh, max(price) OVER w-min(price) OVER w AS price_range, avg(price) OVER w AS cluster_price FROM liqs
  WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)),
 h AS (SELECT *, n>=5 AND lo+sh>=50000 AND (lo>sh*2 OR sh>lo*2) AS hit FROM k)
SELECT symbol, trade_id AS seq, 'liquidation_cluster' AS detector, CASE WHEN NOT hit THEN 'neutral' WHEN lo>sh THEN 'bearish' ELSE 'bullish' END AS side,
 round(CASE WHEN hit THEN least((lo+sh)/150000,1) ELSE 0 END,6) AS confidence, round(price_range,6) AS price_range, round(cluster_price,6) AS cluster_price FROM h""")
def _(spark, d):
    return det(detectors.liquidation_cluster(src.liquidations(spark, d), DAY, 5, 50_000.0), "price_range", "cluster_price")


@query("d09_quote_manipulation")
def _(spark, d):
    return det(detectors.quote_manipulation(src.books(spark, d), 20_000.0, 10 * DAY, 1, 1.0 / DAY), "price", "rate")


@query("q07_valid_books", f"WITH {BOOKS} SELECT symbol, seq, (nb>0 AND na>0 AND best_bid<best_ask) AS valid, nb AS bid_levels FROM bk")
def _(spark, d):
    b = src.books(spark, d)
    return b.select("symbol", "seq", quality.valid_book(F.col("bids"), F.col("asks")).alias("valid"),
                    F.size(quality.valid_levels(F.col("bids"))).cast("bigint").alias("bid_levels"))
