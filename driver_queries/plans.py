from __future__ import annotations

from pyspark.sql import functions as F

from depthlens.operators import candle_detectors, candles as cn, signals, strategy
from depthlens.plans import backtest, outcomes, performance, sizing, trade_plans
from depthlens.sources import driver_tables as src
from driver_queries.books import WALLS
from driver_queries.candles import CD, INPUTS, RSI, pick
from driver_queries.common import DAY, HOUR, ORDERED, TRADES, recursive, rounded, rsql
from driver_queries.signals import admitted, walls

QUERIES, SQL = {}, {}
HOLD = 6 * DAY


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


PLANS = f"""{TRADES}, sg AS (SELECT symbol, trade_id AS plan_id, ts_ms, CASE WHEN side='buy' THEN 'BUY' ELSE 'SELL' END AS side, price, (5+trade_id%7)::DOUBLE AS spread, qty,
  CASE WHEN trade_id%3=0 THEN NULL WHEN side='buy' THEN price-100 ELSE price+100 END AS wall, CASE WHEN side='buy' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM trades),
 p1 AS (SELECT *, price+s*(price*0.0001::DOUBLE) AS entry, CASE WHEN wall>0 THEN abs(price-wall)+spread ELSE spread*3 END AS dist FROM sg),
 p2 AS (SELECT *, entry-s*dist AS stop FROM p1),
 plans AS (SELECT *, entry+s*abs(entry-stop)*1.5::DOUBLE AS tp1, entry+s*abs(entry-stop)*2.5::DOUBLE AS tp2, 2.5::DOUBLE AS rr FROM p2)"""


def plan_signals(spark, d):
    return src.trades(spark, d).selectExpr(
        "symbol", "trade_id as plan_id", "ts_ms", "case when side = 'buy' then 'BUY' else 'SELL' end as side", "price",
        "cast(5 + trade_id % 7 as double) as spread", "qty",
        "case when trade_id % 3 = 0 then null when side = 'buy' then price - 100 else price + 100 end as wall")


def plans(spark, d):
    p = trade_plans.trade_plan(F.col("side"), F.col("price"), F.col("spread"), F.col("wall"))
    return plan_signals(spark, d).withColumn("p", p).filter("p is not null").select(
        "symbol", "plan_id", "ts_ms", "side", "price", "qty", "p.*")


@query("r01_trade_plans", f"WITH {PLANS} SELECT symbol, plan_id, side, {rsql('entry stop tp1 tp2 rr')} FROM plans")
def _(spark, d):
    return rounded(plans(spark, d), "symbol plan_id side", "entry stop tp1 tp2 rr")


@query("r02_relevant_wall", f"""WITH {WALLS}, w AS (SELECT symbol, ts_ms, max(price) FILTER (side='bid') AS b, min(price) FILTER (side='ask') AS a FROM walls GROUP BY ALL),
 s AS (SELECT symbol, trade_id AS plan_id, ts_ms, side FROM trades), j AS (SELECT s.*, w.ts_ms AS wts, w.b, w.a FROM s ASOF LEFT JOIN w ON s.symbol=w.symbol AND s.ts_ms>=w.ts_ms)
SELECT symbol, plan_id, CASE WHEN ts_ms-wts<={2 * DAY} THEN CASE WHEN side='buy' THEN a ELSE b END END AS wall_price FROM j""")
def _(spark, d):
    return trade_plans.relevant_wall(plan_signals(spark, d), walls(spark, d), "plan_id", 2 * DAY).select(
        "symbol", "plan_id", "wall_price")


@query("r04_net_rr", f"""WITH {PLANS} SELECT symbol, plan_id, round(rr-(0.0008::DOUBLE+0.0005::DOUBLE)/(abs(entry-stop)/entry)-0.0001::DOUBLE*(300.0::DOUBLE/3600),6) AS net_rr FROM plans""")
def _(spark, d):
    p = plans(spark, d)
    return rounded(p.withColumn("net_rr", trade_plans.net_rr(F.col("rr"), F.col("entry"), F.col("stop"), funding=0.0001)),
                   "symbol plan_id", "net_rr")


@query("r06_fixed_fraction", f"""WITH {PLANS}, z AS (SELECT *, least(10000*0.02::DOUBLE/abs(entry-stop), 10000*0.1::DOUBLE/entry) AS q FROM plans)
SELECT symbol, plan_id, round(q,6) AS qty, round(q*entry,6) AS notional, 200.0::DOUBLE AS risk_amount, round((0.45::DOUBLE*1.5::DOUBLE-(1-0.45::DOUBLE))/1.5::DOUBLE,6) AS kelly FROM z""")
def _(spark, d):
    z = sizing.fixed_fraction(10_000.0, 0.02, F.col("entry"), F.col("stop"), 0.45, 1.5, 0.1)
    return rounded(plans(spark, d).withColumn("z", z).select("symbol", "plan_id", "z.*"), "symbol plan_id", "qty notional risk_amount kelly")


@query("r07_leveraged_positions", f"""WITH {PLANS}, k AS (SELECT *, (0.55::DOUBLE-(1.0::DOUBLE-0.55::DOUBLE)/rr)*((60+plan_id%40)/100.0::DOUBLE) AS kelly FROM plans),
 r AS (SELECT *, least(kelly*100/2,2.0) AS risk_pct FROM k), q AS (SELECT *, risk_pct/100*1000/abs(entry-stop) AS lq FROM r),
 n AS (SELECT *, lq*entry AS notional FROM q), l AS (SELECT *, greatest(least(notional/1000,20),1) AS leverage, CASE WHEN notional>1000000 THEN 0.025 WHEN notional>250000 THEN 0.01 WHEN notional>50000 THEN 0.005 ELSE 0.004 END::DOUBLE AS mmr FROM n)
SELECT symbol, plan_id, round(kelly,6) AS kelly, round(risk_pct,6) AS risk_pct, round(notional,6) AS notional, round(leverage,6) AS leverage, round(notional/leverage,6) AS margin,
 round(notional*0.0004::DOUBLE*2/lq,6) AS breakeven, round(CASE WHEN side='BUY' THEN entry*(1-1/leverage+mmr) ELSE entry*(1+1/leverage-mmr) END,6) AS liquidation,
 CASE WHEN qty>12 THEN 'LIMIT ONLY' ELSE 'MARKET' END AS order_type FROM l""")
def _(spark, d):
    p = plans(spark, d).withColumns({
        "direction": F.when(F.col("side") == "BUY", "LONG").otherwise("SHORT"),
        "conf": (60 + F.col("plan_id") % 40).cast("double"), "vpin": F.when(F.col("qty") > 12, 0.9).otherwise(0.1)})
    return rounded(sizing.leveraged_positions(p), "symbol plan_id order_type",
                   "kelly risk_pct notional leverage margin breakeven liquidation")


@query("n12_kelly_chain", f"""WITH {PLANS}, k AS (SELECT *, greatest(0.55::DOUBLE-(1.0::DOUBLE-0.55::DOUBLE)/rr,0) AS kelly, (60+plan_id%40)::DOUBLE AS conf FROM plans)
SELECT symbol, plan_id, round(kelly,6) AS kelly, round(kelly/2,6) AS half, round(kelly/2*(conf/100),6) AS scaled, round(least(kelly/2*(conf/100),0.12::DOUBLE),6) AS fraction, round(least(kelly/2*(conf/100),0.12::DOUBLE)*1000,6) AS amount FROM k""")
def _(spark, d):
    z = sizing.kelly_chain(0.55, F.col("rr"), (60 + F.col("plan_id") % 40).cast("double"), 1000.0, 0.12)
    return rounded(plans(spark, d).withColumn("z", z).select("symbol", "plan_id", "z.*"), "symbol plan_id", "kelly half scaled fraction amount")


@query("r08_portfolio_check", f"""WITH {TRADES}, a AS (SELECT symbol AS account, count(*)%5 AS op, (sum(qty)%1100)::DOUBLE AS tr, (sum(price)%1300)-900 AS pnl, (count(*)%7)/10.0::DOUBLE AS corr FROM trades GROUP BY symbol),
 p AS (SELECT symbol AS account, trade_id AS plan_id, qty*20 AS risk FROM trades),
 r AS (SELECT p.*, tr, CASE WHEN op>=3 THEN 'max_positions' WHEN pnl<= -500 THEN 'daily_loss_limit' WHEN tr+risk>1000 AND 1000-tr<=0 THEN 'portfolio_risk_full' WHEN tr+risk>1000 THEN 'portfolio_risk_reduced'
   WHEN risk>200 THEN 'risk_capped' WHEN corr>0.5 THEN 'correlation_exceeded' END AS reason FROM p JOIN a USING (account)),
 f AS (SELECT *, reason IS NULL OR reason IN ('portfolio_risk_reduced','risk_capped') AS allowed, CASE reason WHEN 'portfolio_risk_reduced' THEN (1000-tr)/risk WHEN 'risk_capped' THEN 200/risk END AS adj FROM r)
SELECT account, plan_id, reason, allowed, round(adj,6) AS adjustment, round(CASE WHEN allowed THEN risk*coalesce(adj,1) ELSE 0 END,6) AS sized_risk FROM f""")
def _(spark, d):
    t = src.trades(spark, d).withColumnRenamed("symbol", "account")
    accounts = t.groupBy("account").agg(
        (F.count("*") % 5).alias("open_positions"), (F.sum("qty") % 1100).alias("total_risk"),
        ((F.sum("price") % 1300) - 900).alias("daily_pnl"), ((F.count("*") % 7) / 10.0).alias("correlation_exposure"),
    ).withColumns({"max_daily_loss": F.lit(500.0), "max_positions": F.lit(3), "equity": F.lit(10_000.0),
                   "max_risk_per_trade": F.lit(0.02), "max_correlation": F.lit(0.5)})
    p = t.select("account", F.col("trade_id").alias("plan_id"), (F.col("qty") * 20).alias("risk_amount"))
    return rounded(sizing.portfolio_check(p, accounts), "account plan_id reason allowed", "adjustment sized_risk")


# ---- outcomes ---------------------------------------------------------------------------------
OUTCOMES = f"""{PLANS}, c1 AS (SELECT p.symbol, p.plan_id, t.ts_ms, t.trade_id, t.price, CASE WHEN s*(t.price-stop)<=0 THEN 0 ELSE 1 END AS tgt FROM plans p JOIN trades t ON t.symbol=p.symbol
   AND t.ts_ms>p.ts_ms AND t.ts_ms<=p.ts_ms+{HOLD} AND (s*(t.price-stop)<=0 OR s*(t.price-tp1)>=0)),
 f1 AS (SELECT symbol, plan_id, min(ts_ms) AS t1, arg_min(price, trade_id) AS x1, arg_min(tgt, trade_id) AS g1 FROM c1 GROUP BY ALL),
 c2 AS (SELECT p.symbol, p.plan_id, t.ts_ms, t.trade_id, t.price, CASE WHEN s*(t.price-entry)<=0 THEN 0 ELSE 1 END AS tgt FROM plans p JOIN f1 USING (symbol, plan_id) JOIN trades t ON t.symbol=p.symbol
   AND t.ts_ms>f1.t1 AND t.ts_ms<=p.ts_ms+{HOLD} AND (s*(t.price-entry)<=0 OR s*(t.price-tp2)>=0) WHERE g1=1),
 f2 AS (SELECT symbol, plan_id, min(ts_ms) AS t2, arg_min(price, trade_id) AS x2, arg_min(tgt, trade_id) AS g2 FROM c2 GROUP BY ALL),
 lp AS (SELECT p.symbol, p.plan_id, arg_max(t.price, t.trade_id) AS lastp FROM plans p JOIN trades t ON t.symbol=p.symbol AND t.ts_ms>p.ts_ms AND t.ts_ms<=p.ts_ms+{HOLD} GROUP BY ALL),
 o1 AS (SELECT p.*, t1, x1, g1, t2, x2, g2, lastp, CASE WHEN lastp IS NULL THEN 'pending' WHEN g1=0 THEN 'stopped_out' WHEN g2=1 THEN 'tp2_hit' WHEN g2=0 THEN 'stopped_out' WHEN g1=1 THEN 'tp1_hit' ELSE 'filled' END AS status,
   CASE WHEN g1=0 THEN stop WHEN g2=1 THEN x2 WHEN g2=0 THEN entry END AS exit_price, CASE WHEN g1=0 THEN t1 ELSE t2 END AS exit_ms, CASE WHEN g1=1 THEN qty*0.5::DOUBLE ELSE 0 END AS q1
  FROM plans p LEFT JOIN f1 USING (symbol, plan_id) LEFT JOIN f2 USING (symbol, plan_id) LEFT JOIN lp USING (symbol, plan_id)),
 o2 AS (SELECT *, CASE WHEN status='pending' THEN 0 ELSE 0.0005::DOUBLE*(qty*entry+q1*coalesce(x1,0)+coalesce((qty-q1)*exit_price,0)) END AS fees FROM o1),
 oc AS (SELECT *, CASE WHEN status='pending' THEN 0 ELSE s*(coalesce(x1,0)-entry)*q1+s*(coalesce(exit_price,lastp,entry)-entry)*(qty-q1)-fees END AS pnl, exit_price IS NOT NULL AS closed FROM o2),
 outc AS (SELECT *, CASE WHEN stop=entry THEN 0 ELSE pnl/(abs(entry-stop)*qty) END AS r FROM oc)"""


def bracket(spark, d):
    return outcomes.bracket_outcomes(plans(spark, d), src.trades(spark, d), HOLD)


@query("o01_bracket_outcomes", f"WITH {OUTCOMES} SELECT symbol, plan_id, status, exit_ms, closed, round(exit_price,6) AS exit_price, round(fees,6) AS fees, round(pnl,6) AS pnl, round(r,6) AS r_multiple FROM outc")
def _(spark, d):
    return rounded(bracket(spark, d), "symbol plan_id status exit_ms closed", "exit_price fees pnl r_multiple")


@query("o03_account_equity", f"""WITH {OUTCOMES} SELECT symbol, count(*) FILTER (closed) AS closed_orders, count(*) FILTER (NOT closed) AS open_orders, round(coalesce((sum(pnl::DECIMAL(28,10)) FILTER (closed))::DOUBLE,0),6) AS closed_pnl,
 round(coalesce((sum(pnl::DECIMAL(28,10)) FILTER (NOT closed))::DOUBLE,0),6) AS open_pnl, round(10000+coalesce((sum(pnl::DECIMAL(28,10)) FILTER (closed))::DOUBLE,0)+coalesce((sum(pnl::DECIMAL(28,10)) FILTER (NOT closed))::DOUBLE,0),6) AS equity FROM outc GROUP BY symbol""")
def _(spark, d):
    return rounded(outcomes.account_equity(bracket(spark, d), 10_000.0), "symbol closed_orders open_orders", "closed_pnl open_pnl equity")


METRICS = "n wins losses gross_profit gross_loss win_rate avg_r net_r expectancy profit_factor sharpe avg_hold_ms wilson_low wilson_high"


@query("o06_trade_metrics", f"""WITH {OUTCOMES}, cl AS (SELECT * FROM outc WHERE closed), g AS (SELECT symbol, count(*) AS n, count(*) FILTER (pnl>0) AS wins, count(*) FILTER (pnl<0) AS losses, coalesce((sum(pnl::DECIMAL(28,10)) FILTER (pnl>0))::DOUBLE,0) AS gp,
  coalesce((sum((-pnl)::DECIMAL(28,10)) FILTER (pnl<=0))::DOUBLE,0) AS gl, avg(r) AS ar, sum(r) AS nr, avg(pnl) AS mp, stddev_samp(pnl) AS sd, max(exit_ms)-min(ts_ms) AS span, avg(exit_ms-ts_ms) AS hold FROM cl GROUP BY symbol),
 h AS (SELECT *, wins/n AS p, n/span*31557600000.0::DOUBLE AS py, 1+3.8416::DOUBLE/n AS sc FROM g)
SELECT symbol, n, wins, losses, round(gp,6) AS gross_profit, round(gl,6) AS gross_loss, round(p,6) AS win_rate, round(ar,6) AS avg_r, round(nr,6) AS net_r,
 round(p*(gp/wins)-losses/n*(gl/losses),6) AS expectancy, round(gp/gl,6) AS profit_factor, round(mp/sd*sqrt(py),6) AS sharpe, round(hold,6) AS avg_hold_ms,
 round((p+3.8416::DOUBLE/(2*n))/sc-1.96::DOUBLE*sqrt((p*(1-p)+3.8416::DOUBLE/(4*n))/n)/sc,6) AS wilson_low, round((p+3.8416::DOUBLE/(2*n))/sc+1.96::DOUBLE*sqrt((p*(1-p)+3.8416::DOUBLE/(4*n))/n)/sc,6) AS wilson_high FROM h""")
def _(spark, d):
    t = bracket(spark, d).filter("closed").withColumn("entry_ms", F.col("submit_ms"))
    return rounded(performance.trade_metrics(t, ["symbol"]), "symbol n wins losses",
                   " ".join(c for c in METRICS.split() if c not in ("n", "wins", "losses")))


@query("o09_max_drawdown", f"""WITH {OUTCOMES}, e AS (SELECT symbol, exit_ms, plan_id, 100000+sum(pnl) OVER (PARTITION BY symbol ORDER BY exit_ms, plan_id) AS eq FROM outc WHERE closed),
 k AS (SELECT *, greatest(100000, max(eq) OVER (PARTITION BY symbol ORDER BY exit_ms, plan_id)) AS pk FROM e)
SELECT symbol, round(max((pk-eq)/pk),6) AS max_drawdown, round(max(pk-eq),6) AS max_fall FROM k GROUP BY symbol""")
def _(spark, d):
    return rounded(performance.max_drawdown(bracket(spark, d).filter("closed"), ["symbol"], ["exit_ms", "plan_id"], 100_000.0),
                   "symbol", "max_drawdown max_fall")


HORIZONS = (6 * HOUR, DAY, 3 * DAY)
FWD = f"""{PLANS}, hz AS (SELECT unnest([{', '.join(f'{h}::BIGINT' for h in HORIZONS)}]) AS h), mx AS (SELECT symbol, max(ts_ms) AS e FROM trades GROUP BY symbol),
 fw AS (SELECT sg.symbol, sg.plan_id, h, any_value(sg.ts_ms) AS ts_ms, any_value(s) AS s, any_value(sg.price) AS p, arg_max(t.price, t.trade_id) AS lp, max(t.price) AS hi, min(t.price) AS lo
  FROM sg CROSS JOIN hz LEFT JOIN trades t ON t.symbol=sg.symbol AND t.ts_ms>=sg.ts_ms AND t.ts_ms<sg.ts_ms+h GROUP BY sg.symbol, sg.plan_id, h),
 fr AS (SELECT fw.*, s*(lp-p)/p AS ret, greatest(s*(CASE WHEN s>0 THEN hi ELSE lo END-p)/p,0) AS mfe, least(s*(CASE WHEN s>0 THEN lo ELSE hi END-p)/p,0) AS mae, e>=ts_ms+h AS realized,
  row_number() OVER (PARTITION BY h ORDER BY ts_ms DESC, symbol DESC, plan_id DESC) AS k FROM fw JOIN mx USING (symbol))"""


def forward(spark, d, keep=None):
    return outcomes.forward_returns(plan_signals(spark, d), src.trades(spark, d), "plan_id", HORIZONS, keep)


@query("o04_forward_returns", f"WITH {FWD} SELECT symbol, plan_id, h AS horizon_ms, realized, {rsql('ret mfe mae')} FROM fr")
def _(spark, d):
    return rounded(forward(spark, d), "symbol plan_id horizon_ms realized", "ret mfe mae")


@query("o04_newest_forward_returns", f"WITH {FWD} SELECT symbol, plan_id, h AS horizon_ms, realized, {rsql('ret mfe mae')} FROM fr WHERE k<=500")
def _(spark, d):
    return rounded(forward(spark, d, 500), "symbol plan_id horizon_ms realized", "ret mfe mae")


@query("o05_horizon_metrics", f"""WITH {FWD}, q AS (SELECT h, coalesce(ret,0) AS ret FROM fr WHERE realized), o AS (SELECT h, ret, row_number() OVER (PARTITION BY h ORDER BY ret)-1 AS i, count(*) OVER (PARTITION BY h) AS n FROM q)
SELECT h AS horizon_ms, any_value(n) AS count, round(avg(CASE WHEN ret>0 THEN 1.0::DOUBLE ELSE 0 END),6) AS win_rate, round(avg(ret),6) AS avg_return, round(avg(ret),6) AS expectancy,
 round(max(ret) FILTER (i=n//2),6) AS median_return FROM o GROUP BY h""")
def _(spark, d):
    return rounded(performance.horizon_metrics(forward(spark, d)), "horizon_ms count", "win_rate avg_return expectancy median_return")


@query("n09_trade_quality", f"""WITH {OUTCOMES.replace(PLANS, FWD)}, a AS (SELECT symbol, avg(mae) AS am, avg(mfe) AS af FROM fr GROUP BY symbol), b AS (SELECT symbol, avg(exit_ms-ts_ms) AS hold, avg(r) AS ar FROM outc GROUP BY symbol)
SELECT symbol, round(am,6) AS avg_mae, round(af,6) AS avg_mfe, round(abs(am)/af,6) AS mae_mfe_ratio, round(hold,6) AS avg_hold_ms, round(ar,6) AS avg_r FROM a JOIN b USING (symbol)""")
def _(spark, d):
    return rounded(performance.trade_quality(bracket(spark, d), forward(spark, d), ["symbol"]), "symbol",
                   "avg_mae avg_mfe mae_mfe_ratio avg_hold_ms avg_r")


@query("o11_session_rollup", f"""WITH {OUTCOMES}, g AS (SELECT symbol, count(*) FILTER (closed) AS n, count(*) FILTER (closed AND pnl>0) AS w, (sum(pnl::DECIMAL(28,10)) FILTER (closed AND pnl>0))::DOUBLE AS gain, abs((sum(pnl::DECIMAL(28,10)) FILTER (closed AND pnl<=0))::DOUBLE) AS loss,
  avg(pnl) FILTER (closed) AS m, stddev_samp(pnl) FILTER (closed) AS sd, sum(pnl::DECIMAL(28,10))::DOUBLE AS al, sum(fees::DECIMAL(28,10))::DOUBLE AS tf FROM outc GROUP BY symbol)
SELECT symbol AS session_id, n AS trades, w AS wins, round(w/n,6) AS win_rate, round(gain/loss,6) AS profit_factor, round(m/sd*sqrt(252.0::DOUBLE),6) AS sharpe, round(50000+al,6) AS current_equity, round(greatest(50000,50000+al),6) AS peak_equity,
 round((greatest(50000,50000+al)-(50000+al))/greatest(50000,50000+al),6) AS max_drawdown, round(tf,6) AS total_fees FROM g""")
def _(spark, d):
    o = bracket(spark, d)
    pos = o.select(F.col("symbol").alias("session_id"), F.when(F.col("closed"), F.col("status")).otherwise("open").alias("status"),
                   "pnl", F.col("fees").alias("fee"))
    ses = src.trades(spark, d).select(F.col("symbol").alias("session_id")).distinct().withColumn("start_equity", F.lit(50_000.0))
    return rounded(performance.session_rollup(pos, ses), "session_id trades wins",
                   "win_rate profit_factor sharpe current_equity peak_equity max_drawdown total_fees")


@query("o11_keep_last_sessions", "SELECT o_custkey AS session_id, max(epoch_us(o_orderdate)//1000) AS started_ms FROM orders GROUP BY o_custkey ORDER BY 2 DESC, 1 DESC LIMIT 20")
def _(spark, d):
    s = src.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("session_id")).agg(
        F.max(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate) div 1000")).alias("started_ms"))
    return performance.keep_last_sessions(s, 20)


# ---- candle detectors and positions ---------------------------------------------------------------
DET = "symbol, ts, detector, side, round(confidence,6) AS confidence, price"


def det(df):
    return rounded(df, "symbol ts detector side price", "confidence")


@query("d20_mean_reversion", f"""WITH {INPUTS}, z AS (SELECT symbol, ts, c AS price, 0.7::DOUBLE AS confidence, 'mean_reversion' AS detector, CASE WHEN rn>=19 AND c<=m20-1.5::DOUBLE*sd20 THEN 'long' WHEN rn>=19 AND c>=m20+1.5::DOUBLE*sd20 THEN 'short' END AS side FROM src)
SELECT {DET} FROM z WHERE side IS NOT NULL""")
def _(spark, d):
    return det(candle_detectors.mean_reversion(src.candles(spark, d, HOUR), 20, 1.5))


@query("d21_momentum", recursive(INPUTS, "src", pick("ag", "al"), f""", z0 AS (SELECT symbol, ts, rn, c AS price, {RSI} AS rsi FROM rec JOIN src USING (symbol, rn)),
 z AS (SELECT *, 'momentum' AS detector, CASE WHEN rn>=14 AND rsi<40 THEN 'long' WHEN rn>=14 AND rsi>60 THEN 'short' END AS side, CASE WHEN rsi<40 THEN (40-rsi)/30 ELSE (rsi-60)/30 END AS confidence FROM z0)
SELECT {DET} FROM z WHERE side IS NOT NULL"""))
def _(spark, d):
    return det(candle_detectors.momentum(src.candles(spark, d, HOUR), 40.0, 60.0))


@query("d22_breakout", f"""WITH {CD}, z0 AS (SELECT *, max(h) OVER w AS hi, min(l) OVER w AS lo FROM cd WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
 z AS (SELECT symbol, ts, c AS price, 'breakout' AS detector, 0.8::DOUBLE AS confidence, CASE WHEN rn>=20 AND c>hi THEN 'long' WHEN rn>=20 AND c<lo THEN 'short' END AS side FROM z0) SELECT {DET} FROM z WHERE side IS NOT NULL""")
def _(spark, d):
    return det(candle_detectors.breakout(src.candles(spark, d, HOUR)))


@query("d23_volume_spike", f"""WITH {CD}, z0 AS (SELECT *, sum(v) OVER (PARTITION BY symbol ORDER BY rn)/(rn+1) AS av FROM cd),
 z AS (SELECT symbol, ts, c AS price, 'volume_spike' AS detector, least(v/(av*2),1) AS confidence, CASE WHEN c>o THEN 'long' ELSE 'short' END AS side FROM z0 WHERE rn>=9 AND v>av*2) SELECT {DET} FROM z""")
def _(spark, d):
    return det(candle_detectors.volume_spike(src.candles(spark, d, HOUR)))


POSITIONS = f"""tt AS (SELECT symbol, ts_ms, trade_id, price FROM trades),
 ps AS (SELECT symbol, ts AS plan_id, ts+{HOUR} AS ts_ms, CASE WHEN c>=o THEN 'long' ELSE 'short' END AS side, CASE WHEN c>=o THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s, c AS price, atr FROM rec JOIN src USING (symbol, rn) WHERE atr>0),
 p1 AS (SELECT *, price-s*atr*0.3::DOUBLE AS stop FROM ps), p2 AS (SELECT *, price+s*abs(price-stop) AS tp1, price+s*abs(price-stop)*2 AS tp2, 100.0::DOUBLE/abs(price-stop) AS size, price+s*price*0.0001::DOUBLE AS entry FROM p1),
 p3 AS (SELECT *, size*entry*0.0002::DOUBLE AS ef, entry+s*(size*entry*0.0002::DOUBLE*2/size) AS be FROM p2),
 k1 AS (SELECT p.symbol, p.plan_id, min(t.ts_ms) AS t1, arg_min(t.price, t.trade_id) AS x1, arg_min(CASE WHEN s*(t.price-stop)<=0 THEN 0 ELSE 1 END, t.trade_id) AS g1 FROM p3 p JOIN tt t ON t.symbol=p.symbol AND t.ts_ms>p.ts_ms AND t.ts_ms<=p.ts_ms+{HOLD}
   AND (s*(t.price-stop)<=0 OR s*(t.price-tp1)>=0) GROUP BY ALL),
 k2 AS (SELECT p.symbol, p.plan_id, min(t.ts_ms) AS t2, arg_min(t.price, t.trade_id) AS x2, arg_min(CASE WHEN s*(t.price-be)<=0 THEN 0 ELSE 1 END, t.trade_id) AS g2 FROM p3 p JOIN k1 USING (symbol, plan_id) JOIN tt t ON t.symbol=p.symbol AND t.ts_ms>k1.t1 AND t.ts_ms<=p.ts_ms+{HOLD}
   AND (s*(t.price-be)<=0 OR s*(t.price-tp2)>=0) WHERE g1=1 GROUP BY ALL),
 kl AS (SELECT p.symbol, p.plan_id, arg_max(t.price, t.trade_id) AS lastp FROM p3 p JOIN tt t ON t.symbol=p.symbol AND t.ts_ms>p.ts_ms AND t.ts_ms<=p.ts_ms+{HOLD} GROUP BY ALL),
 q1 AS (SELECT p.*, t1, x1, g1, t2, x2, g2, lastp, coalesce(g1=1 AND s*(x1-be)<=0,false) AS flat FROM p3 p LEFT JOIN k1 USING (symbol, plan_id) LEFT JOIN k2 USING (symbol, plan_id) LEFT JOIN kl USING (symbol, plan_id)),
 q2 AS (SELECT *, CASE WHEN g1=0 THEN 'stopped_out' WHEN flat THEN 'breakeven' WHEN g2=1 THEN 'tp2_hit' WHEN g2=0 THEN 'breakeven' WHEN g1=1 THEN 'tp1_hit' ELSE 'open' END AS status,
  CASE WHEN g1=0 OR flat THEN x1 ELSE x2 END AS xp, CASE WHEN g1=0 OR flat THEN t1 ELSE t2 END AS exit_ms FROM q1),
 q3 AS (SELECT *, ef+coalesce(size*xp*0.0005::DOUBLE,0) AS fee FROM q2), pos AS (SELECT *, s*(coalesce(xp,lastp,entry)-entry)*size-fee AS pnl, xp IS NOT NULL AS closed FROM q3)"""


def positions(spark, d):
    c = cn.ordered_candles(src.candles(spark, d, HOUR))
    a = cn.atr(c, 14, "atr").df.filter("atr > 0").selectExpr(
        "symbol", "ts as plan_id", f"ts + {HOUR} as ts_ms", "case when c >= o then 'long' else 'short' end as side", "c as price", "atr")
    return outcomes.position_outcomes(outcomes.candle_positions(a, stop_atr=0.3), src.trades(spark, d), HOLD)


@query("o02_position_outcomes", recursive(INPUTS, "src", pick("atr"), f", {POSITIONS} SELECT symbol, plan_id, side, status, exit_ms, xp AS exit_price, closed, round(fee,6) AS fee, round(pnl,6) AS pnl, round(pnl/(abs(entry-stop)*size),6) AS r_multiple FROM pos"))
def _(spark, d):
    return rounded(positions(spark, d), "symbol plan_id side status exit_ms exit_price closed", "fee pnl r_multiple")


OPEN = f"""{OUTCOMES}, pr AS (SELECT symbol, trade_id, ts_ms, CASE WHEN side='buy' THEN 'long' ELSE 'short' END AS side FROM trades),
 oa AS (SELECT pr.symbol, pr.trade_id, any_value(pr.side) AS side, count(*) FILTER (o.ts_ms<=pr.ts_ms AND (o.exit_ms IS NULL OR o.exit_ms>pr.ts_ms)) AS open_count,
  count(*) FILTER (o.ts_ms<=pr.ts_ms AND (o.exit_ms IS NULL OR o.exit_ms>pr.ts_ms) AND o.side='BUY') AS open_longs, coalesce((sum(o.pnl::DECIMAL(28,10)) FILTER (o.exit_ms<=pr.ts_ms))::DOUBLE,0) AS realized_pnl, coalesce((sum(o.pnl::DECIMAL(28,10)) FILTER (o.exit_ms<=pr.ts_ms AND o.exit_ms//86400000=pr.ts_ms//86400000))::DOUBLE,0) AS day_pnl
 FROM pr LEFT JOIN outc o ON o.symbol=pr.symbol GROUP BY pr.symbol, pr.trade_id)"""


def open_at(spark, d):
    pos = bracket(spark, d).select(
        "symbol", F.col("submit_ms").alias("entry_ms"), "exit_ms", F.when(F.col("side") == "BUY", "long").otherwise("short").alias("side"),
        "pnl", F.col("plan_id").alias("position_id"))
    probes = src.trades(spark, d).select(
        "symbol", "ts_ms", "trade_id", F.when(F.col("side") == "buy", "long").otherwise("short").alias("side"))
    return sizing.open_positions_at(pos, probes, "trade_id")


@query("j04_open_positions", f"WITH {OPEN} SELECT symbol, trade_id, open_count, open_longs, open_count-open_longs AS open_shorts, round(realized_pnl,6) AS realized_pnl, round(day_pnl,6) AS day_pnl FROM oa")
def _(spark, d):
    return rounded(open_at(spark, d), "symbol trade_id open_count open_longs open_shorts", "realized_pnl day_pnl")


@query("r10_risk_check", f"""WITH {OPEN}, r AS (SELECT *, CASE WHEN open_count>=5 THEN 'max_open' WHEN day_pnl<= -300 THEN 'daily_loss' WHEN CASE WHEN side='long' THEN open_longs ELSE open_count-open_longs END>=3 THEN 'same_direction' END AS reason FROM oa)
SELECT symbol, trade_id, reason, reason IS NULL AS allowed FROM r""")
def _(spark, d):
    return sizing.risk_check(open_at(spark, d)).select("symbol", "trade_id", "reason", "allowed")


@query("r09_candle_sizing", recursive(INPUTS, "src", pick("atr"), """SELECT symbol, ts, round(c-1.5::DOUBLE*atr,6) AS stop, round(CASE WHEN atr=0 THEN 0 ELSE 100/(1.5::DOUBLE*atr) END,6) AS size, round(c+1.5::DOUBLE*atr,6) AS tp1, round(c+2*(1.5::DOUBLE*atr),6) AS tp2 FROM rec JOIN src USING (symbol, rn)"""))
def _(spark, d):
    o = cn.atr(cn.ordered_candles(src.candles(spark, d, HOUR)), 14, "atr").df
    side, c = F.lit("long"), F.col("c")
    o = o.withColumn("stop", sizing.atr_stop(side, c, F.col("atr"), 1.5))
    o = o.withColumns({"size": sizing.risk_size(10_000.0, 0.01, c, F.col("stop")), "t": sizing.r_targets(side, c, F.col("stop"), 1.0, 2.0)})
    return rounded(o.select("symbol", "ts", "stop", "size", "t.*"), "symbol ts", "stop size tp1 tp2")


@query("r11_portfolio_heat", f"WITH {OUTCOMES} SELECT symbol AS account, round(sum((abs(entry-stop)*qty)::DECIMAL(28,10))::DOUBLE/100000,6) AS heat FROM outc WHERE NOT closed GROUP BY symbol")
def _(spark, d):
    o = bracket(spark, d).filter("not closed").select(F.col("symbol").alias("account"), "entry", "stop", F.col("qty").alias("size"))
    return rounded(sizing.portfolio_heat(o, 100_000.0), "account", "heat")


# ---- back-tests ------------------------------------------------------------------------------------
RANGES = {"mult": (1.0, 2.0)}
GRID = f"""{CD}, ri AS (SELECT *, avg(c) OVER w AS m, stddev_pop(c) OVER w AS sd, lead(c,5) OVER (PARTITION BY symbol ORDER BY rn)/c-1 AS fwd, count(*) OVER (PARTITION BY symbol) AS n FROM cd
   WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 gr AS (SELECT ri.*, mult FROM ri, unnest([@MULTS@]) AS u(mult)),
 tr2 AS (SELECT *, CASE WHEN rn>=19 AND c<=m-sd*mult THEN 1 WHEN rn>=19 AND c>=m+sd*mult THEN -1 ELSE 0 END AS side FROM gr),
 td AS (SELECT *, side*fwd AS ret FROM tr2 WHERE side<>0 AND fwd IS NOT NULL)"""


def grid_metrics(by, source, every):
    """Metrics of each group; those of ``every`` without a trade have zeros."""
    return f"""ev AS ({every}), eq AS (SELECT {by}, ts, ret, 10000+sum(ret*10000) OVER (PARTITION BY {by} ORDER BY ts) AS eq FROM {source}),
 pk AS (SELECT *, greatest(10000, max(eq) OVER (PARTITION BY {by} ORDER BY ts)) AS pk FROM eq),
 g0 AS (SELECT {by}, count(*) AS total_trades, avg(CASE WHEN ret>0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, coalesce(sum(ret) FILTER (ret>0),0)/nullif(coalesce(sum(-ret) FILTER (ret<=0),0),0) AS profit_factor,
  coalesce(avg(ret)/nullif(stddev_pop(ret),0)*sqrt(252.0::DOUBLE),0) AS sharpe, greatest(max((pk-eq)/pk),0) AS max_drawdown FROM pk GROUP BY {by}),
 gm AS (SELECT {by}, coalesce(total_trades,0) AS total_trades, coalesce(win_rate,0) AS win_rate, CASE WHEN total_trades IS NULL THEN 0 ELSE profit_factor END AS profit_factor,
  coalesce(sharpe,0) AS sharpe, coalesce(max_drawdown,0) AS max_drawdown FROM ev LEFT JOIN g0 USING ({by}))"""


CAL = GRID.replace("@MULTS@", "1.0::DOUBLE,1.25,1.5,1.75,2.0") + ", " + grid_metrics("symbol, mult", "td", "SELECT DISTINCT symbol, mult FROM gr")


def cal(spark, d):
    return backtest.calibrate(src.candles(spark, d, HOUR), RANGES)


@query("t02_calibration", f"WITH {CAL} SELECT symbol, mult, total_trades, {rsql('win_rate profit_factor sharpe max_drawdown')} FROM gm")
def _(spark, d):
    return rounded(cal(spark, d), "symbol mult total_trades", "win_rate profit_factor sharpe max_drawdown")


@query("t03_best_result", f"WITH {CAL}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, mult) AS k FROM gm) SELECT symbol, mult, total_trades, round(sharpe,6) AS sharpe FROM b WHERE k=1")
def _(spark, d):
    return rounded(backtest.best_result(cal(spark, d), ["symbol"], ["mult"]), "symbol mult total_trades", "sharpe")


WINDOWS = """SELECT symbol, unnest(range(0,(n-100)//50+1)) AS "window", part, mult FROM (SELECT symbol, mult, max(n) AS n FROM gr GROUP BY ALL) x, unnest(['train','test']) AS y(part) WHERE n>=100"""
WF = GRID.replace("@MULTS@", "1.0::DOUBLE,1.5,2.0") + """, wn AS (SELECT td.*, w.i AS "window" FROM td JOIN (SELECT unnest(range(0,5000)) AS i) w ON td.rn>=w.i*50 AND td.rn<w.i*50+100 AND w.i*50+100<=td.n),
 pt AS (SELECT *, CASE WHEN rn-"window"*50<70 THEN 'train' ELSE 'test' END AS part FROM wn WHERE CASE WHEN rn-"window"*50<70 THEN rn-"window"*50+5<70 ELSE rn-"window"*50+5<100 END), """ + grid_metrics('symbol, "window", part, mult', "pt", WINDOWS) + """,
 bt AS (SELECT *, row_number() OVER (PARTITION BY symbol, "window" ORDER BY sharpe DESC, mult) AS k FROM gm WHERE part='train'),
 wf AS (SELECT b.symbol, b."window", b.mult, b.sharpe AS train_sharpe, coalesce(t.sharpe,0) AS test_sharpe, coalesce(t.win_rate,0) AS test_win_rate, coalesce(t.max_drawdown,0) AS test_drawdown, coalesce(t.total_trades,0) AS test_trades
  FROM bt b LEFT JOIN gm t ON t.symbol=b.symbol AND t."window"=b."window" AND t.mult=b.mult AND t.part='test' WHERE k=1)"""


def wf(spark, d):
    return backtest.walk_forward(src.candles(spark, d, HOUR), RANGES, 100, 50)


@query("t04_walk_forward", f"""WITH {WF} SELECT symbol, "window", mult, test_trades, {rsql('train_sharpe test_sharpe test_win_rate test_drawdown')} FROM wf""")
def _(spark, d):
    return rounded(wf(spark, d), "symbol window mult test_trades", "train_sharpe test_sharpe test_win_rate test_drawdown")


@query("t04_walk_forward_summary", f"""WITH {WF} SELECT symbol, count(*) AS windows, round(avg(test_sharpe),6) AS sharpe, round(max(test_drawdown),6) AS max_drawdown, round(avg(test_win_rate),6) AS win_rate,
 avg(test_sharpe)>0 AND stddev_pop(test_sharpe)<abs(avg(test_sharpe))*0.5 AND count(*)>=3 AS robust FROM wf GROUP BY symbol""")
def _(spark, d):
    return rounded(backtest.walk_forward_summary(wf(spark, d)), "symbol windows robust", "sharpe max_drawdown win_rate")


REPLAY = f"""{POSITIONS}, cx AS (SELECT symbol, ts, rn, c, lag(c) OVER (PARTITION BY symbol ORDER BY rn) AS pc FROM src),
 ev AS (SELECT c.symbol, c.ts, any_value(c.rn) AS rn, any_value(c.c) AS c, any_value(pc) AS pc, 10000+coalesce(sum(p.pnl) FILTER (p.closed AND p.exit_ms<=c.ts),0) AS equity,
  count(*) FILTER (p.ts_ms<=c.ts AND NOT (p.closed AND p.exit_ms<=c.ts)) AS open_positions FROM cx c LEFT JOIN pos p ON p.symbol=c.symbol GROUP BY c.symbol, c.ts)"""


@query("t01_replay_snapshots", recursive(INPUTS, "src", pick("atr"), f", {REPLAY} SELECT symbol, ts, open_positions, round(equity,6) AS equity FROM ev"))
def _(spark, d):
    snaps = backtest.replay_snapshots(src.candles(spark, d, HOUR), positions(spark, d))
    return rounded(snaps, "symbol ts open_positions", "equity")


@query("t01_replay_summary", recursive(INPUTS, "src", pick("atr"), f""", {REPLAY}, pk AS (SELECT *, greatest(10000, max(equity) OVER (PARTITION BY symbol ORDER BY ts)) AS pk, CASE WHEN pc>0 AND c<>pc THEN c/pc-1 END AS ret FROM ev),
 a AS (SELECT symbol, arg_max(equity, ts) AS fe, max((pk-equity)/pk) AS dd, avg(ret)/stddev_samp(ret)*sqrt(252.0::DOUBLE) AS sharpe, count(*) AS snapshots FROM pk GROUP BY symbol),
 b AS (SELECT symbol, count(*) AS n, avg(CASE WHEN pnl>0 THEN 1.0::DOUBLE ELSE 0 END) AS wr FROM pos WHERE closed GROUP BY symbol)
SELECT symbol, snapshots, n AS total_trades, round(fe,6) AS final_equity, round(fe/10000-1,6) AS total_return, round(dd,6) AS max_drawdown, round(sharpe,6) AS sharpe, round(wr,6) AS win_rate FROM a JOIN b USING (symbol)"""))
def _(spark, d):
    pos = positions(spark, d)
    snaps = backtest.replay_snapshots(src.candles(spark, d, HOUR), pos)
    return rounded(backtest.replay_summary(snaps, pos), "symbol snapshots total_trades",
                   "final_equity total_return max_drawdown sharpe win_rate")


# ---- frames, score, decisions, filters ----------------------------------------------------------------
def frames(spark, d):
    b, t = src.books(spark, d), src.trades(spark, d)
    from depthlens.operators import detectors
    reg = detectors.DetectorRegistry()
    for name, fn in (("skew", detectors.skew), ("void", detectors.liquidity_void), ("ladder", detectors.ladder)):
        reg.register(name, fn)
    return strategy.feature_frames(b, t, detectors.aggregate(reg.run(b)), bar_ms=HOUR, tau_ms=2 * DAY, max_gap_ms=2 * HOUR, bucket=100)


@query("f16_feature_frames")
def _(spark, d):
    return rounded(frames(spark, d), "symbol ts_ms seq data_quality flow_delta flow_volume",
                   "cvd_z obi velocity_z micro_dev vpin detector_score volatility")


# a synthetic frame per trade keeps score, vetoes and the filters checkable in SQL
FR = f"""{ORDERED}, fr AS (SELECT symbol, ts_ms, trade_id AS seq, CASE WHEN trade_id%5<>0 THEN (trade_id%61-30)/10.0::DOUBLE END AS cvd_z, CASE WHEN trade_id%7<>0 THEN (trade_id%41-20)/20.0::DOUBLE END AS obi,
  CASE WHEN trade_id%3<>0 THEN (trade_id%37-18)/9.0::DOUBLE END AS velocity_z, (trade_id%13-6)/20.0::DOUBLE AS micro_dev, CASE WHEN trade_id%4<>0 THEN (trade_id%11)/11.0::DOUBLE END AS vpin,
  CASE WHEN trade_id%2=0 THEN (trade_id%19-9)/10.0::DOUBLE END AS detector_score, CASE WHEN trade_id%29<>0 THEN (trade_id%17)/10000.0::DOUBLE END AS volatility FROM tr),
 fq AS (SELECT *, (cvd_z IS NOT NULL)::INT+(obi IS NOT NULL)::INT+(velocity_z IS NOT NULL)::INT+(micro_dev IS NOT NULL)::INT+(vpin IS NOT NULL)::INT+(detector_score IS NOT NULL)::INT+(volatility IS NOT NULL)::INT AS nv FROM fr),
 fs AS (SELECT *, CASE WHEN nv>=4 THEN 'good' WHEN nv>=2 THEN 'degraded' ELSE 'invalid' END AS data_quality,
  CASE WHEN cvd_z IS NULL THEN 0 ELSE least(greatest(cvd_z,-2),2)*0.25::DOUBLE END+CASE WHEN obi IS NULL THEN 0 ELSE least(greatest(obi,-2),2)*0.15::DOUBLE END+CASE WHEN velocity_z IS NULL THEN 0 ELSE least(greatest(velocity_z,-2),2)*0.15::DOUBLE END+CASE WHEN micro_dev IS NULL THEN 0 ELSE least(greatest(micro_dev,-2),2)*0.1::DOUBLE END+CASE WHEN vpin IS NULL THEN 0 ELSE least(greatest(vpin,-2),2)*0.05::DOUBLE END+CASE WHEN detector_score IS NULL THEN 0 ELSE least(greatest(detector_score,-2),2)*0.3::DOUBLE END AS num,
  CASE WHEN cvd_z IS NOT NULL THEN 0.25 ELSE 0 END::DOUBLE+CASE WHEN obi IS NOT NULL THEN 0.15 ELSE 0 END::DOUBLE+CASE WHEN velocity_z IS NOT NULL THEN 0.15 ELSE 0 END::DOUBLE+CASE WHEN micro_dev IS NOT NULL THEN 0.1 ELSE 0 END::DOUBLE+CASE WHEN vpin IS NOT NULL THEN 0.05 ELSE 0 END::DOUBLE+CASE WHEN detector_score IS NOT NULL THEN 0.3 ELSE 0 END::DOUBLE AS den FROM fq),
 sc AS (SELECT *, CASE WHEN den=0 THEN 0 ELSE least(greatest(num/den,-1),1) END AS score, array_to_string(list_filter([CASE WHEN volatility<0.0005 THEN 'flat_market' END, CASE WHEN abs(obi)<0.06 THEN 'obi_confluence' END, CASE WHEN vpin>0.8 THEN 'vpin_veto' END,
   CASE WHEN data_quality='invalid' THEN 'data_quality' END], lambda v: v IS NOT NULL), ',') AS vetoes FROM fs)"""


def trade_frames(spark, d):
    from depthlens.operators.quality import data_quality
    f = src.trades(spark, d).selectExpr(
        "symbol", "ts_ms", "trade_id as seq", "case when trade_id % 5 <> 0 then (trade_id % 61 - 30) / 10.0D end as cvd_z",
        "case when trade_id % 7 <> 0 then (trade_id % 41 - 20) / 20.0D end as obi",
        "case when trade_id % 3 <> 0 then (trade_id % 37 - 18) / 9.0D end as velocity_z", "(trade_id % 13 - 6) / 20.0D as micro_dev",
        "case when trade_id % 4 <> 0 then (trade_id % 11) / 11.0D end as vpin",
        "case when trade_id % 2 = 0 then (trade_id % 19 - 9) / 10.0D end as detector_score",
        "case when trade_id % 29 <> 0 then (trade_id % 17) / 10000.0D end as volatility")
    names = ("cvd_z", "obi", "velocity_z", "micro_dev", "vpin", "detector_score", "volatility")
    return strategy.scored_frames(f.withColumn("data_quality", data_quality([F.col(n) for n in names])))


@query("k01_k02_scored_frames", f"WITH {FR} SELECT symbol, seq, data_quality, vetoes, vetoes='' AS passed, round(score,6) AS score FROM sc")
def _(spark, d):
    f = trade_frames(spark, d).withColumn("vetoes", F.array_join(F.transform("vetoes", lambda v: v["id"]), ","))
    return rounded(f, "symbol seq data_quality vetoes passed", "score")


@query("k03_decisions", f"""WITH RECURSIVE {FR}, ok AS (SELECT symbol, seq, ts_ms, score, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms)-1 AS rn FROM sc WHERE vetoes=''),
 m AS (SELECT symbol, seq, rn, ts_ms, CASE WHEN abs(score)>=0.2 THEN 'A' ELSE 'I' END AS st, score>0 AS sd, ts_ms AS since, false AS fired FROM ok WHERE rn=0
 UNION ALL SELECT o.symbol, o.seq, o.rn, o.ts_ms,
  CASE m.st WHEN 'I' THEN CASE WHEN abs(o.score)>=0.2 THEN 'A' ELSE 'I' END WHEN 'A' THEN CASE WHEN (o.score>0)<>m.sd OR abs(o.score)<0.2 THEN 'I' WHEN o.ts_ms-m.since>={HOUR} THEN 'F' ELSE 'A' END WHEN 'F' THEN 'C' ELSE CASE WHEN o.ts_ms-m.since>={12 * HOUR} THEN 'I' ELSE 'C' END END,
  CASE WHEN m.st='A' THEN m.sd ELSE o.score>0 END, CASE WHEN m.st='I' OR m.st='F' THEN o.ts_ms ELSE m.since END,
  m.st='A' AND (o.score>0)=m.sd AND abs(o.score)>=0.2 AND o.ts_ms-m.since>={HOUR} FROM m JOIN ok o ON o.symbol=m.symbol AND o.rn=m.rn+1)
SELECT symbol, seq, CASE WHEN sd THEN 'BUY' ELSE 'SELL' END AS fired_side FROM m WHERE fired""")
def _(spark, d):
    return strategy.decide(trade_frames(spark, d), 0.2, HOUR, 12 * HOUR).select("symbol", "seq", "fired_side")


FILT = f"""{TRADES}, st AS (SELECT symbol, trade_id, CASE trade_id%4 WHEN 0 THEN 'trending_up' WHEN 1 THEN 'trending_down' WHEN 2 THEN 'ranging' ELSE 'volatile' END AS regime, trade_id%8 AS op, ts_ms-(trade_id%5)*20000 AS lst, ts_ms, (trade_id%10)/10.0::DOUBLE AS conf FROM trades),
 fl AS (SELECT *, CASE WHEN regime NOT IN ('trending_up','trending_down') THEN 'regime_filter' WHEN op>=5 THEN 'max_positions_filter' WHEN ts_ms-lst<60000 THEN 'cooldown_filter' WHEN conf<0.5 THEN 'confidence_filter' WHEN symbol='U3' THEN 'no_u3' END AS reason FROM st)"""


def filtered(spark, d):
    s = src.trades(spark, d).selectExpr(
        "symbol", "trade_id", "ts_ms", "element_at(array('trending_up','trending_down','ranging','volatile'), cast(trade_id % 4 as int) + 1) as regime",
        "trade_id % 8 as open_positions", "ts_ms - (trade_id % 5) * 20000 as last_signal_ts", "(trade_id % 10) / 10.0D as confidence")
    f = strategy.SignalFilters.default().add("no_u3", F.col("symbol") != "U3")
    return f, f.apply(s)


@query("k04_filtered_signals", f"WITH {FILT} SELECT symbol, trade_id, reason AS filter_reason, reason IS NULL AS passed FROM fl")
def _(spark, d):
    return filtered(spark, d)[1].select("symbol", "trade_id", "filter_reason", "passed")


@query("k05_filter_stats", f"""WITH {FILT}, n AS (SELECT * FROM (VALUES (0,'regime_filter'),(1,'max_positions_filter'),(2,'cooldown_filter'),(3,'confidence_filter'),(4,'no_u3')) v(position, name)),
 a AS (SELECT coalesce(n.position,5) AS ord FROM fl LEFT JOIN n ON n.name=fl.reason)
SELECT n.position, n.name, (SELECT count(*) FROM a WHERE ord>n.position) AS passed, (SELECT count(*) FROM a WHERE ord=n.position) AS rejected FROM n""")
def _(spark, d):
    f, df = filtered(spark, d)
    return f.stats(df)


@query("k06_risk_gate", f"""WITH {TRADES} SELECT symbol, trade_id, CASE WHEN trade_id%9>5 THEN 'stale_data' WHEN trade_id%13>10 THEN 'spread' WHEN trade_id%7=6 THEN 'vpin_toxic' WHEN trade_id%11=3 THEN 'compression_active' WHEN trade_id%3=1 AND trade_id%5<4 THEN 'cascade_active' END AS blocked FROM trades""")
def _(spark, d):
    s = src.trades(spark, d).selectExpr(
        "symbol", "trade_id", "ts_ms as now_ms", "ts_ms - (trade_id % 9) * 1000 + 0 as book_ts", "cast(trade_id % 13 as double) as spread_bps",
        "case when trade_id % 7 = 6 then 0.9D else 0.1D end as vpin", "trade_id % 11 = 3 as compression",
        "case when trade_id % 3 = 1 then 1 else 0 end as chain_len", "ts_ms - case when trade_id % 5 < 4 then 0 else 9000 end as chain_ts")
    return s.select("symbol", "trade_id", strategy.risk_gate().alias("blocked"))


# ---- plans from signals ----------------------------------------------------------------------------------
def signal_plans(spark, d):
    recent = signals.recent_signals(admitted(spark, d))
    p = trade_plans.signal_plans(src.books(spark, d), walls(spark, d), recent, tick=0.5, memory_ms=3 * DAY)
    return p.withColumn("net_rr", trade_plans.net_rr(F.col("rr"), F.col("entry"), F.col("stop")))


@query("r03_signal_plans")
def _(spark, d):
    return rounded(signal_plans(spark, d), "symbol ts_ms seq direction conf entry stop target confluence", "rr net_rr")


@query("r05_plan_states")
def _(spark, d):
    p = signal_plans(spark, d).withColumn("blocked", F.lit(None).cast("string"))
    c = trade_plans.admit_plans(p, 3 * DAY, 2, 1.0, DAY)
    cmd = c.filter("seq % 2 = 0").selectExpr("plan_id", "ts_ms + 1000 as ts_ms", "'arm' as command").unionByName(
        c.filter("seq % 3 = 0").selectExpr("plan_id", "ts_ms + 5000 as ts_ms", "'cancel' as command"))
    return trade_plans.plan_states(c, cmd).select("symbol", "ts_ms", "seq", "direction", "state", "armed_ms", "expires_ms")


PLAN_TICKS = f"""{ORDERED}, ok AS (SELECT symbol, ts_ms, trade_id AS seq, CASE WHEN side='buy' THEN 'LONG' ELSE 'SHORT' END AS dir, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms)-1 AS rn FROM tr WHERE trade_id%5<>0 AND trade_id%4>=1 AND qty>3)"""


@query("r05_admitted_plans", f"""WITH RECURSIVE {PLAN_TICKS}, w AS (SELECT symbol, seq, rn, true AS fired, dir AS ld, ts_ms AS lt FROM ok WHERE rn=0
 UNION ALL SELECT o.symbol, o.seq, o.rn, NOT (o.dir=w.ld AND o.ts_ms-w.lt<{6 * HOUR}), o.dir, CASE WHEN o.dir=w.ld AND o.ts_ms-w.lt<{6 * HOUR} THEN w.lt ELSE o.ts_ms END FROM w JOIN ok o ON o.symbol=w.symbol AND o.rn=w.rn+1)
SELECT symbol, seq, ld AS direction FROM w WHERE fired""")
def _(spark, d):
    p = src.trades(spark, d).selectExpr(
        "symbol", "ts_ms", "trade_id as seq", "case when side = 'buy' then 'LONG' else 'SHORT' end as direction",
        "case when trade_id % 5 = 0 then 'spread' end as blocked", "cast(trade_id % 4 + 2 as int) as confluence", "qty as net_rr")
    return trade_plans.admit_plans(p, 6 * HOUR, 3, 3.5).select("symbol", "seq", "direction")
