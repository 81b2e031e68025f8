"""Signal rules and the algebra on their output.

Signals: symbol, ts_ms, type, direction (bullish/bearish/warning), conf (0-100), price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthlens.functions import books as bk
from depthlens.functions.scalar import clamp, decayed, round_half_up
from depthlens.operators.book import ordered_books
from depthlens.operators.fold import greedy_starts
from depthlens.operators.intervals import asof, first_touch, range_frame, range_table
from depthlens.operators.ordered import RN, Ordered, order_rows, top_k
from depthlens.session import write_table


def _signal(df: DataFrame, kind, direction: Column, conf, price) -> DataFrame:
    lit = (lambda x: F.lit(x) if isinstance(x, (str, int, float)) else x)
    return df.select("symbol", "ts_ms", lit(kind).alias("type"), direction.alias("direction"),
                     lit(conf).cast("double").alias("conf"), price.alias("price"))


def _bull(condition: Column) -> Column:
    return F.when(condition, "bullish").otherwise("bearish")


# ---- walls (rows of book.wall_levels / wall_executions) ---------------------------------------
def wall_signals(walls: DataFrame, min_notional: float = 100_000.0) -> DataFrame:
    bid = F.col("side") == "bid"
    new = walls.filter(F.col("is_new") & (F.col("qty") * F.col("price") > min_notional))
    conf = clamp(F.col("qty") / F.col("median_qty") * 4.0 + 55.0, 55, 92)
    return _signal(new, F.when(bid, "BID_WALL").otherwise("ASK_WALL"), _bull(bid), conf, F.col("price"))


def wall_consumed(executions: DataFrame, share: float = 0.7) -> DataFrame:
    done = executions.filter((F.col("qty") > 0) & (F.col("executed_qty") / F.col("qty") > share))
    return _signal(done, "WALL_CONSUMED", _bull(F.col("side") == "bid"), 75, F.col("price"))


def spoofing(executions: DataFrame, near: float = 0.001, executed_below: float = 0.1, within_ms: int = 3000) -> DataFrame:
    """A wall pulled close to the mid price, within ``within_ms`` of its first sight, of which next to nothing was executed."""
    hit = executions.filter(
        F.col("pulled") & (F.col("ts_ms") - F.col("first_ts") < within_ms) & (F.abs(F.col("price") - F.col("mid")) / F.col("mid") < near)
        & (F.col("executed_qty") < F.col("qty") * executed_below))
    return _signal(hit, "SPOOFING", _bull(F.col("side") == "ask"), 85, F.col("mid"))


def compression_onsets(walls: DataFrame, books: DataFrame, within: float = 0.01,
                       max_spread_pct: float = 0.05) -> DataFrame:
    """Walls on both sides and a tight spread, once per stretch with walls on both sides."""
    near = walls.groupBy("symbol", "ts_ms", "seq").agg(
        F.max(((F.col("side") == "bid") & ((F.col("mid") - F.col("price")) / F.col("mid") < within))).alias("hb"),
        F.max(((F.col("side") == "ask") & ((F.col("price") - F.col("mid")) / F.col("mid") < within))).alias("ha"))
    df = books.withColumns({"mid": bk.mid(), "__pct": bk.spread_bps() / 100.0}).select(
        "symbol", "ts_ms", "seq", "mid", "__pct").join(near, ["symbol", "ts_ms", "seq"], "left")
    o = order_rows(df, ["symbol"], ["ts_ms", "seq"])
    walled = F.coalesce(F.col("hb") & F.col("ha"), F.lit(False))
    o = o.cols({"__walled": walled, "__tight": walled & (F.col("__pct") < max_spread_pct)})
    o = o.running({
        "__reset": ("max", F.when(~F.col("__walled"), F.col(RN))),
        "__on": ("max", F.when(F.col("__tight"), F.col(RN))),
    }, inclusive=False)
    fresh = F.col("__on").isNull() | F.coalesce(F.col("__on") < F.col("__reset"), F.lit(False))
    return _signal(o.df.filter(F.col("__tight") & fresh), "COMPRESSION", F.lit("warning"), 74, F.col("mid"))


def wall_ladders(walls: DataFrame, side: str = "bid", tolerance: float = 0.3) -> DataFrame:
    """Evenly spaced walls of a side, when there are more of them than ever before."""
    mine = walls.filter(F.col("side") == side).groupBy("symbol", "ts_ms", "seq").agg(
        F.sort_array(F.collect_list("price"), asc=side == "ask").alias("p"))
    mine = mine.filter(F.size("p") >= 3)

    def even(i):
        g1 = F.abs(F.get("p", i) - F.get("p", i + 1))
        g2 = F.abs(F.get("p", i + 1) - F.get("p", i + 2))
        ok = (g1 > 0) & (g2 > 0) & (F.abs(g1 - g2) / F.nullif(g1, F.lit(0.0)) < tolerance)
        return F.when(ok, 1).otherwise(0)

    count = F.aggregate(F.transform(F.sequence(F.lit(0), F.size("p") - 3), even), F.lit(0), lambda a, x: a + x)
    o = order_rows(mine.withColumn("__c", count), ["symbol"], ["ts_ms", "seq"])
    o = o.running({"__best": ("max", F.col("__c"))}, inclusive=False)
    hit = o.df.filter((F.col("__c") >= 1) & (F.col("__c") > F.coalesce("__best", F.lit(0))))
    return _signal(hit, "LADDER", F.lit("bullish" if side == "bid" else "bearish"),
                   clamp(F.col("__c") * 8.0 + 60.0, 60, 88), F.get("p", F.lit(0)))


# ---- single books ---------------------------------------------------------------------------------
def book_skews(books: DataFrame, depth: int = 10, threshold: float = 0.4) -> DataFrame:
    df = books.filter((F.size("bids") >= depth) & (F.size("asks") >= depth))
    b, a = (bk.notional(bk.top(F.col(c), depth)) for c in ("bids", "asks"))
    df = df.withColumns({"s": bk.balance(b, a), "mid": bk.mid()})
    hit = df.filter(F.abs("s") > threshold)
    return _signal(hit, "BOOK_SKEW", _bull(F.col("s") > 0), clamp(F.abs("s") * 50.0 + 50.0, 50, 85), F.col("mid"))


def skew_divergence(books: DataFrame, depth: int = 10, threshold: float = 0.3) -> DataFrame:
    df = books.filter((F.size("bids") >= depth) & (F.size("asks") >= depth))
    df = df.withColumns({"o5": bk.depth_imbalance(5), "o20": bk.depth_imbalance(20), "mid": bk.mid()})
    hit = df.filter(F.abs(F.col("o5") - F.col("o20")) > threshold)
    return _signal(hit, "SKEW_DIVERGENCE", _bull(F.col("o5") > F.col("o20")), 70, F.col("mid"))


def skew_traps(books: DataFrame, surface: float = 0.5, deep: float = 0.2) -> DataFrame:
    """Surface and deep imbalance of opposite sign: trade against the surface."""
    df = books.withColumns({"obi5": bk.depth_imbalance(5), "obi20": bk.depth_imbalance(20)})
    o5, o20 = F.col("obi5"), F.col("obi20")
    kind = F.when((o5 > surface) & (o20 < -deep), "surface_bullish_deep_bearish").when(
        (o5 < -surface) & (o20 > deep), "surface_bearish_deep_bullish")
    df = df.withColumn("trap", kind).filter("trap is not null")
    return df.select("symbol", "ts_ms", "seq", "obi5", "obi20", F.abs(o5 - o20).alias("divergence"),
                     "trap", _bull(F.col("trap") == "surface_bearish_deep_bullish").alias("direction"))


def book_voids(books: DataFrame, multiple: float = 3.0) -> DataFrame:
    """The first gap among the top ten levels that exceeds ``multiple`` mean gaps, per side.

    Adds the gap's limits (``near``, ``far``) for tracking.
    """
    df = books.filter((F.size("bids") >= 10) & (F.size("asks") >= 10))
    out = []
    for side, c, kind, way in (("ask", "asks", "VOID_ASK", "bullish"), ("bid", "bids", "VOID_BID", "bearish")):
        g = bk.gaps(bk.top(F.col(c), 10))
        mean = F.abs(bk.level(F.col(c), 9)["price"] - bk.level(F.col(c), 0)["price"]) / 9.0
        d = df.withColumns({"__g": g, "__m": mean})
        at = F.array_position(F.transform("__g", lambda x: (F.col("__m") > 0) & (x > F.col("__m") * multiple)), True)
        d = d.withColumn("__i", at.cast("int")).filter("__i > 0")
        gap = F.get("__g", F.col("__i") - 1)
        steps = F.least(F.lit(3), F.floor(gap / F.col("__m")))
        far = F.get(c, F.col("__i"))["price"]
        s = d.select("symbol", "ts_ms", "seq", F.lit(kind).alias("type"), F.lit(way).alias("direction"),
                     clamp(steps * 8.0 + 60.0, 60, 85).alias("conf"), far.alias("price"),
                     F.get(c, F.col("__i") - 1)["price"].alias("near"), far.alias("far"),
                     F.lit(side).alias("side"))
        out.append(s)
    return out[0].unionByName(out[1])


def void_states(voids: DataFrame, books: DataFrame, life_ms: int = 5000) -> DataFrame:
    """How far the books of the next ``life_ms`` fill each void.

    A later book's fill is 1 - its largest remaining hole / the void's width; the best book
    counts.  FILLED from 80 %, FILLING above 0, else DETECTED; every state ends at expires_ms.
    """
    key = ["symbol", "ts_ms", "seq", "type"]
    v = voids.withColumns({"__lo": F.least("near", "far"), "__hi": F.greatest("near", "far"),
                           "__end": F.col("ts_ms") + life_ms})
    v = v.withColumn("__bin", F.explode(F.expr(f"sequence(ts_ms div {life_ms}, __end div {life_ms})")))
    lv = [books.select("symbol", F.lit(side).alias("side"), F.col("ts_ms").alias("__t"), F.inline(c))
          for side, c in (("bid", "bids"), ("ask", "asks"))]
    lv = lv[0].unionByName(lv[1]).select("symbol", "side", "__t", F.col("price").alias("__p"),
                                         F.expr(f"__t div {life_ms}").alias("__bin"))
    inside = v.join(lv, ["symbol", "side", "__bin"]).filter(
        "__t > ts_ms and __t <= __end and __p > __lo and __p < __hi")
    marks = inside.groupBy(*key, "__lo", "__hi", "__t").agg(F.collect_set("__p").alias("__ps"))
    edge = F.array_sort(F.concat(F.array("__lo", "__hi"), "__ps"))
    holes = F.transform(F.sequence(F.lit(1), F.size("__e") - 1),
                        lambda i: F.get("__e", i) - F.get("__e", i - 1))
    fill = 1.0 - F.array_max(holes) / (F.col("__hi") - F.col("__lo"))
    fills = marks.withColumn("__e", edge).withColumn("__f", fill).groupBy(*key).agg(
        F.max("__f").alias("fill"), F.min("__t").alias("first_fill_ts"))
    state = F.when(F.col("fill") >= 0.8, "FILLED").when(F.col("fill") > 0, "FILLING").otherwise("DETECTED")
    return voids.join(fills, key, "left").withColumn("fill", F.coalesce("fill", F.lit(0.0))).withColumns(
        {"state": state, "expires_ms": F.col("ts_ms") + life_ms})


# ---- flow bars (rows of flow.signal_bars) ----------------------------------------------------------
def ordered_bars(bars: DataFrame | Ordered) -> Ordered:
    """Bars in their order, written once; the detectors of flow bars take it wherever they take bars.

    Bars are few rows made of many trades, and an ordering reads its rows more than once.
    """
    if isinstance(bars, Ordered):
        return bars
    return order_rows(write_table(bars.withColumn("ts_ms", F.col("end_ts")), "bars"), ["symbol"], ["bar_ts"])


def absorption(bars: DataFrame, min_delta: float = 100_000.0, max_move: float = 0.0005) -> DataFrame:
    b = bars.withColumn("ts_ms", F.col("end_ts"))
    hit = b.filter((F.abs("delta") > min_delta) & ((F.col("high") - F.col("low")) / F.col("close") < max_move))
    return _signal(hit, "ABSORPTION", _bull(F.col("delta") > 0), 75, F.col("close"))


def flow_sustained(bars: DataFrame | Ordered, n: int = 5) -> DataFrame:
    o = ordered_bars(bars).frame(n - 1, 0, lambda w: {
        "__lo": F.min(F.signum("delta")).over(w.rowsBetween(1 - n, 0)),
        "__hi": F.max(F.signum("delta")).over(w.rowsBetween(1 - n, 0))})
    same = (F.col("__lo") == F.col("__hi")) & (F.col("__lo") != 0) & (F.col(RN) >= n - 1)
    return _signal(o.df.filter(same), "FLOW_SUSTAINED", _bull(F.col("delta") > 0), 60, F.col("close"))


def flow_exhaustion(bars: DataFrame | Ordered, extreme: float = 80.0, share: float = 0.8) -> DataFrame:
    o = ordered_bars(bars).frame(1, 0, lambda w: {"__p": F.lag("pressure").over(w)})
    p = F.abs("pressure")
    hit = o.df.filter((F.col(RN) >= 2) & (p > extreme) & (p > F.abs("__p") * share))
    return _signal(hit, "FLOW_EXHAUSTION", _bull(~(F.col("delta") > 0)), 70, F.col("close"))


def flow_exhaustion_by_strength(bars: DataFrame | Ordered, n: int = 20, level: float = 0.8, similar: float = 0.2) -> DataFrame:
    """|delta| above 80 % of the maximum of 20 bars, and close to the previous bar's strength."""
    o = ordered_bars(bars).frame(n - 1, 0, lambda w: {"__m": F.max(F.abs("delta")).over(w.rowsBetween(1 - n, 0))})
    o = o.col("__s", F.coalesce(F.abs("delta") / F.nullif(F.col("__m"), F.lit(0.0)), F.lit(0.0)))
    o = o.frame(1, 0, lambda w: {"__ps": F.lag("__s").over(w), "__pd": F.lag("delta").over(w)})
    hit = o.df.filter((F.col("__s") > level) & (F.signum("delta") == F.signum("__pd"))
                      & (F.abs(F.col("__s") - F.col("__ps")) < similar))
    return _signal(hit, "FLOW_EXHAUSTION", _bull(~(F.col("delta") > 0)), 70, F.col("close"))


def delta_expansion(bars: DataFrame | Ordered, min_volume: float = 100_000.0) -> DataFrame:
    o = ordered_bars(bars).frame(1, 0, lambda w: {"__p": F.lag("delta").over(w)})
    hit = o.df.filter((F.abs("delta") > F.abs("__p") * 2.0) & (F.col("volume") > min_volume))
    return _signal(hit, "DELTA_EXPANSION", _bull(F.col("delta") > 0),
                   clamp(F.abs("pressure") * 0.3 + 60.0, 60, 90), F.col("close"))


def cvd_divergence(bars: DataFrame, cvd: DataFrame, back: int = 9, min_pressure: float = 5.0) -> DataFrame:
    """Bar pressure against the direction of the cumulative delta over ``back`` trades.

    ``cvd`` are the rows of flow.cumulative_delta.
    """
    c = order_rows(cvd.select("symbol", "ts_ms", "trade_id", "cvd"), ["symbol"], ["ts_ms", "trade_id"])
    c = c.frame(back, 0, lambda w: {"__back": F.lag("cvd", back).over(w)})
    b = order_rows(bars, ["symbol"], ["bar_ts"]).df.filter(F.col(RN) >= 4).withColumn("ts_ms", F.col("end_ts"))
    j = asof(b, c.df, ["symbol"], "ts_ms", ["cvd", "__back"], "bar_ts", "trade_id")
    p, now, then = F.col("pressure"), F.col("cvd"), F.col("__back")
    bear = (p > min_pressure) & (now < then)
    hit = j.filter(bear | ((p < -min_pressure) & (now > then)))
    return _signal(hit, F.when(bear, "CVD_BEAR_DIV").otherwise("CVD_BULL_DIV"), _bull(~bear), 70, F.col("close"))


def tape_spikes(trades: DataFrame, short_ms: int = 1000, long_ms: int = 5000, factor: float = 3.0,
                at_least: int = 5) -> DataFrame:
    """More trades in the short window than ``factor`` times its share of the long one."""
    t = range_frame(trades, ["symbol"], "ts_ms", short_ms - 1, 0, {
        "__n": ("count", F.lit(1)), "__b": ("sum", (F.col("side") == "buy").cast("bigint"))})
    long = range_table(trades, ["symbol"], "ts_ms", long_ms - 1, 0, {"__l": ("count", F.lit(1))})
    t = t.join(long, ["symbol", "ts_ms"])
    usual = F.col("__l") * (short_ms / long_ms)
    hit = t.filter((F.col("__n") > usual * factor) & (F.col("__n") >= at_least))
    return _signal(hit, "TAPE_SPIKE", _bull(F.col("__b") * 2 >= F.col("__n")), 65, F.col("price"))


# ---- liquidations -------------------------------------------------------------------------------------
def cascade_chains(liqs: DataFrame, gap_ms: int = 2000, anchored: bool = True) -> DataFrame:
    """Chains of liquidations of one side; adds ``chain`` and the running ``chain_len``.

    anchored: all within ``gap_ms`` of the chain's first event; otherwise each within
    ``gap_ms`` of the one before.
    """
    o = order_rows(liqs, ["symbol"], ["ts_ms", "trade_id"])
    o = o.frame(1, 0, lambda w: {"__ps": F.lag("side").over(w), "__pt": F.lag("ts_ms").over(w)})
    turn = F.coalesce(F.col("__ps") != F.col("side"), F.lit(True))
    if anchored:
        o = o.running({"__run": ("sum", turn.cast("bigint"))}).kept()
        spans = o.blocked
        runs = order_rows(o.df.drop(RN), ["symbol", "__run"], ["ts_ms", "trade_id"], within=o)
        starts = greedy_starts(runs, "ts_ms", gap_ms, "__start").df.drop(RN, "__run")
        o = order_rows(write_table(starts, "starts") if spans else starts, ["symbol"], ["ts_ms", "trade_id"], within=o)
    else:
        o = o.col("__start", turn | (F.col("ts_ms") - F.col("__pt") >= gap_ms))
    o = o.running({
        "chain": ("sum", F.col("__start").cast("bigint")),
        "__at": ("last", F.when(F.col("__start"), F.col(RN))),
        "chain_ts": ("last", F.when(F.col("__start"), F.col("ts_ms"))),
    })
    return o.col("chain_len", F.col(RN) - F.col("__at") + 1).drop("__ps", "__pt", "__start", "__at").result()


def cascade_signals(chains: DataFrame, at_least: int = 3) -> DataFrame:
    hit = chains.filter(F.col("chain_len") >= at_least)
    return _signal(hit, "CASCADE_CHAIN", _bull(F.col("side") != "long"),
                   clamp(F.col("chain_len") * 8.0 + 60.0, 60, 92), F.col("price"))


def _with_near_depth(liqs: DataFrame, books: DataFrame, around_mid: bool) -> DataFrame:
    """Depth within 0.1 % on the side a liquidation trades into (bids for longs)."""
    j = asof(liqs, books, ["symbol"], "ts_ms", ["bids", "asks"], "trade_id", "seq")
    ref = bk.mid() if around_mid else F.col("price")
    j = j.withColumn("__ref", ref)
    near = F.when(F.col("side") == "long", bk.near_depth(F.col("bids"), F.col("__ref") * 0.999, True)).otherwise(
        bk.near_depth(F.col("asks"), F.col("__ref") * 1.001, False))
    levels = F.when(F.col("side") == "long", F.size("bids")).otherwise(F.size("asks"))
    return j.withColumns({"near": F.coalesce(near, F.lit(0.0)), "book_levels": levels, "mid": bk.mid()})


def cascade_exhaustion(chains: DataFrame, books: DataFrame, factor: float = 1.2) -> DataFrame:
    """First event of a chain (length 3 on) whose near depth outweighs it."""
    j = _with_near_depth(chains.filter("chain_len >= 3"), books, True)
    hit = j.filter((F.col("book_levels") >= 3) & (F.col("near") > F.col("price") * F.col("qty") * factor))
    first = hit.groupBy("symbol", "chain").agg(
        F.min(F.struct("ts_ms", "trade_id", "side", "mid")).alias("f")).select("symbol", "f.*")
    return _signal(first, "CASCADE_EXHAUSTED", _bull(F.col("side") == "long"), 85, F.col("mid"))


def cascade_squeeze(liqs: DataFrame, books: DataFrame, min_notional: float = 100_000.0,
                    factor: float = 1.5) -> DataFrame:
    n = F.col("price") * F.col("qty")
    j = _with_near_depth(liqs.filter(n >= min_notional), books, False)
    hit = j.filter(n > F.col("near") * factor)
    return _signal(hit, "CASCADE_SQUEEZE", _bull(F.col("side") != "long"), 88, F.col("price"))


def liquidation_clusters(liqs: DataFrame, window_ms: int = 10_000, at_least: int = 5,
                         min_notional: float = 500_000.0) -> DataFrame:
    n = F.col("price") * F.col("qty")
    df = range_frame(liqs, ["symbol"], "ts_ms", window_ms, 0, {
        "__n": ("count", F.lit(1)), "__s": ("sum", n),
        "__l": ("sum", (F.col("side") == "long").cast("bigint"))})
    hit = df.filter((F.col("__n") >= at_least) & (F.col("__s") > min_notional))
    return _signal(hit, "LIQ_CLUSTER", _bull(~(F.col("__l") * 2 > F.col("__n"))),
                   clamp(F.col("__n") * 5.0 + 50.0, 50, 95), F.col("price"))


# ---- icebergs -------------------------------------------------------------------------------------------
def iceberg_hits(trades: DataFrame, books: DataFrame, min_notional: float = 50_000.0, band: float = 0.0002,
                 timeout_ms: int = 5000, ratio: float = 2.5) -> DataFrame:
    """Large trades at a visible level, counted per level until ``timeout_ms`` without a hit.

    state: FORMING, then CONFIRMED from the first hit on that is at least the third and whose mean
    size exceeds ``ratio`` times the displayed quantity.  ``iceberg_states`` tells how a level ends.
    """
    big = trades.filter(F.col("price") * F.col("qty") >= min_notional)
    j = asof(big, books, ["symbol"], "ts_ms", ["bids", "asks"], "trade_id", "seq")
    buy = F.col("side") == "buy"
    side = bk.top(F.when(buy, F.col("asks")).otherwise(F.col("bids")), 20)
    hit = F.get(F.filter(side, lambda l: F.abs(l["price"] - F.col("price")) / F.col("price") < band), F.lit(0))
    j = j.withColumns({"__l": hit, "mid": bk.mid()}).filter("__l is not null")
    j = j.withColumns({"level": F.col("__l.price"), "displayed": F.col("__l.qty"),
                       "book_side": F.when(buy, "ask").otherwise("bid"),
                       "notional": F.col("price") * F.col("qty")}).drop("bids", "asks", "__l")
    key = ["symbol", "book_side", "level"]
    o = order_rows(j, key, ["ts_ms", "trade_id"]).frame(1, 0, lambda w: {"__pt": F.lag("ts_ms").over(w)})
    o = o.running({"life": ("sum", F.coalesce(F.col("ts_ms") - F.col("__pt") > timeout_ms, F.lit(True)).cast("bigint"))})
    s = order_rows(o.df.drop("__pt", RN), [*key, "life"], ["ts_ms", "trade_id"], within=o)
    s = s.running({"absorbed": ("sum", F.col("notional"))}).col("hits", F.col(RN) + 1)
    size = F.col("absorbed") / F.col("hits") / F.col("mid") / F.greatest("displayed", F.lit(0.001))
    s = s.col("ratio", size)
    confirmed = (F.col("hits") >= 3) & (F.col("ratio") > ratio)
    s = s.running({"__c": ("max", confirmed)})
    return s.col("state", F.when(F.col("__c"), "CONFIRMED").otherwise("FORMING")).drop("__c").result()


def iceberg_signals(hits: DataFrame, ratio: float = 2.5) -> DataFrame:
    h = hits.filter((F.col("hits") >= 3) & (F.col("ratio") > ratio))
    return _signal(h, "ICEBERG_CONFIRMED", _bull(F.col("book_side") == "ask"),
                   clamp(F.col("ratio") * 5.0 + 60.0, 60, 88), F.col("price"))


def iceberg_states(hits: DataFrame, books: DataFrame, window_ms: int = 5000, eaten: float = 0.5) -> DataFrame:
    """End of each confirmed level within ``window_ms``: PULLED when the level leaves the book, CONSUMED when its quantity
    falls below ``eaten`` of what was displayed, otherwise it stays CONFIRMED; others expire.
    """
    key = ["symbol", "book_side", "level", "life"]
    last = hits.groupBy(*key).agg(
        F.max(F.struct("ts_ms", "trade_id", "hits", "ratio", "state", "displayed", "absorbed")).alias("h")
    ).select(*key, "h.*")
    probe = last.withColumnRenamed("ts_ms", "hit_ts").withColumn("ts_ms", F.col("hit_ts") + window_ms)
    j = asof(probe, books, ["symbol"], "ts_ms", ["bids", "asks"], "trade_id", "seq")
    side = F.when(F.col("book_side") == "ask", F.col("asks")).otherwise(F.col("bids"))
    left = F.get(F.filter(side, lambda l: l["price"] == F.col("level")), F.lit(0))["qty"]
    j = j.withColumn("left_qty", left)
    end = F.when(F.col("state") != "CONFIRMED", "NONE").when(F.col("left_qty").isNull(), "PULLED").when(
        F.col("left_qty") < F.col("displayed") * eaten, "CONSUMED").otherwise("CONFIRMED")
    return j.withColumn("final_state", end).drop("bids", "asks", "ts_ms")


# ---- market regime ----------------------------------------------------------------------------------------
def flow_regimes(books: DataFrame, n: int = 60) -> DataFrame:
    """Five-state regime per book.

    Books need: spread_bps, rate_1s, cvd_move (|cvd - cvd nine trades ago|), chain_len and
    compression (boolean); see strategy.regime_inputs.
    """
    o = ordered_books(books).cols({
        "__v": F.col("spread_bps") * F.greatest(F.coalesce("rate_1s", F.lit(0)), F.lit(1)),
        "__d": F.coalesce("cvd_move", F.lit(0.0))})
    o = o.frame(n - 1, 0, lambda w: {
        "avg_vol": F.avg("__v").over(w.rowsBetween(1 - n, 0)),
        "avg_dir": F.avg("__d").over(w.rowsBetween(1 - n, 0))})
    v, d = F.col("avg_vol"), F.col("avg_dir")
    regime = F.when(F.coalesce("chain_len", F.lit(0)) >= 2, "CHAOS").when(
        F.coalesce("compression", F.lit(False)) & (v < 2), "COILING").when(
        (v > 5) & (d > 100_000), "TRENDING").when((v > 5) & (d < 50_000), "CHOPPY").otherwise("DEAD")
    score = F.create_map(*[F.lit(x) for kv in (
        ("CHAOS", 90), ("COILING", 70), ("TRENDING", 80), ("CHOPPY", 60), ("DEAD", 30)) for x in kv])
    return o.cols({"regime": regime}).col("regime_score", score[F.col("regime")]).drop("__v", "__d").result()


# ---- admission and algebra -----------------------------------------------------------------------------------
ORDER = ["ts_ms", "type", "direction", "price"]


def admit(signals: DataFrame, cooldown_ms: int = 8000, min_conf: float = 60.0, memory_ms: int = 30_000,
          memory_rows: int = 30) -> DataFrame:
    """Admission: one signal per type and cool-down; then the confidence rules.

    Below ``min_conf`` the confidence becomes 0; it shrinks by 0.7 in toxic flow (column
    ``vpin`` above 0.7, if present) and grows by 1.3 (at most 98) when at least two admitted
    signals of the direction lie in the last 30 s and 30 rows.  Of signals that differ in confidence only, the most
    confident counts.
    """
    rest = [c for c in signals.columns if c not in ("symbol", "conf", *ORDER)]
    one = signals.groupBy("symbol", *ORDER).agg(F.max(F.struct("conf", *rest)).alias("__top"))
    # read by each of the orderings below: written, so that the detectors run once
    one = write_table(one.select("symbol", *ORDER, "__top.*").select(signals.columns), "signals")
    all_rows = order_rows(one, ["symbol"], ORDER)
    o = order_rows(one, ["symbol", "type"], ["ts_ms", "direction", "price"], within=all_rows)
    kept = write_table(greedy_starts(o, "ts_ms", cooldown_ms, "__in").df.filter("__in").drop("__in", RN), "kept")
    a = order_rows(kept, ["symbol"], ORDER, within=all_rows)
    a = a.frame(memory_rows, 0, lambda w: {"__back": F.collect_list(F.struct(
        "ts_ms", "direction")).over(w.rowsBetween(-memory_rows, -1))})
    allies = F.size(F.filter("__back", lambda s: (s["ts_ms"] >= F.col("ts_ms") - memory_ms)
                             & (s["direction"] == F.col("direction"))))
    conf = F.when(F.col("conf") < min_conf, 0.0).otherwise(F.col("conf"))
    if "vpin" in signals.columns:
        conf = conf * F.when(F.col("vpin") > 0.7, 0.7).otherwise(1.0)
    conf = F.when(allies >= 2, clamp(conf * 1.3, 0, 98)).otherwise(conf)
    return write_table(a.col("conf", round_half_up(conf).cast("double")).drop("__back").result(), "admitted")


def recent_signals(signals: DataFrame, rows: int = 30) -> DataFrame:
    """Adds ``recent``: the last ``rows`` signals of the symbol, oldest first, this one included."""
    o = order_rows(signals, ["symbol"], ORDER)
    return o.frame(rows - 1, 0, lambda w: {"recent": F.collect_list(F.struct(
        "ts_ms", "type", "direction", "conf", "price")).over(w.rowsBetween(1 - rows, 0))}
    ).col("signal_no", F.col(RN)).result()


def in_memory(recent: Column, now: Column, memory_ms: int = 30_000) -> Column:
    return F.filter(recent, lambda s: now - s["ts_ms"] <= memory_ms)


def confluence_types(recent: Column, now: Column, direction, memory_ms: int = 30_000) -> Column:
    """Distinct types of one direction among the remembered signals, sorted."""
    same = F.filter(in_memory(recent, now, memory_ms), lambda s: s["direction"] == direction)
    return F.array_sort(F.array_distinct(F.transform(same, lambda s: s["type"])))


def direction_vote(recent: Column, now: Column, margin: float = 50.0, memory_ms: int = 30_000) -> Column:
    """Struct(direction, conf, confluence, bull, bear) from the remembered signals.

    A side wins by more than ``margin`` summed confidence; four or more types add 15, five or
    more another 25, at most 98 in all.
    """
    live = in_memory(recent, now, memory_ms)

    def total(d):
        return F.aggregate(F.filter(live, lambda s: s["direction"] == d), F.lit(0.0), lambda a, s: a + s["conf"])

    bull, bear = total("bullish"), total("bearish")
    side = F.when(bull > bear + margin, "LONG").when(bear > bull + margin, "SHORT").otherwise("NEUTRAL")
    types = F.when(side == "LONG", F.size(confluence_types(recent, now, "bullish", memory_ms))).when(
        side == "SHORT", F.size(confluence_types(recent, now, "bearish", memory_ms))).otherwise(0)
    base = F.when(side == "NEUTRAL", 0.0).otherwise(clamp(F.abs(bull - bear) / 5.0 + 50.0, 50, 95))
    with4 = F.when(types >= 4, F.least(base + 15.0, F.lit(98.0))).otherwise(base)
    conf = F.when(types >= 5, F.least(with4 + 25.0, F.lit(98.0))).otherwise(with4)
    return F.struct(side.alias("direction"), conf.alias("conf"), types.alias("confluence"),
                    bull.alias("bull"), bear.alias("bear"))


def live_confluence(recent: Column, now: Column, floor: float = 20.0, memory_ms: int = 30_000) -> Column:
    """Confluence over signals whose decayed confidence is above ``floor``.

    Struct(direction, count, bonus); a tie of the two directions gives NONE.
    """
    live = F.filter(in_memory(recent, now, memory_ms),
                    lambda s: decayed(s["conf"], s["type"], now - s["ts_ms"]) > floor)

    def of(d):
        return F.filter(live, lambda s: s["direction"] == d)

    nb, ns = F.size(of("bullish")), F.size(of("bearish"))
    side = F.when(nb > ns, "LONG").when(ns > nb, "SHORT").otherwise("NONE")
    mine = F.when(nb > ns, of("bullish")).when(ns > nb, of("bearish"))
    count = F.coalesce(F.size(F.array_distinct(F.transform(mine, lambda s: s["type"]))), F.lit(0))
    count = F.when(side == "NONE", 0).otherwise(count)
    bonus = F.when(count >= 5, 25).when(count >= 4, 15).otherwise(0)
    return F.struct(side.alias("direction"), count.alias("count"), bonus.alias("bonus"))


def compression_breakout(df: DataFrame) -> DataFrame:
    """Three hints (cvd_dir, flow_dir, tape_dir in buy/sell/neutral) voted to a direction."""
    def votes(side):
        return sum(((F.col(c) == side).cast("int") for c in ("cvd_dir", "flow_dir", "tape_dir")), F.lit(0))
    b, s = votes("buy"), votes("sell")
    top = F.greatest(b, s)
    return df.withColumns({
        "breakout": F.when((top < 2) | (b == s), "neutral").when(b > s, "bullish").otherwise("bearish"),
        "agreement": F.when(top == 3, "high").when(top == 2, "medium").otherwise("none")})


def verify(signals: DataFrame, prices: DataFrame, signal_id: str, from_ms: int = 5000, to_ms: int = 30_000,
           move: float = 0.0003) -> DataFrame:
    """VERIFIED / MISSED by the first move beyond ``move`` between 5 and 30 s, else EXPIRED."""
    p = F.col("price")
    plans = signals.filter("direction in ('bullish', 'bearish')").withColumns({
        "start_ms": F.col("ts_ms") + from_ms - 1, "end_ms": F.col("ts_ms") + to_ms,
        "lo": p * (1.0 - move), "hi": p * (1.0 + move)})
    slim = plans.select("symbol", signal_id, "direction", "start_ms", "end_ms", "lo", "hi")
    t = first_touch(slim, prices, "symbol", signal_id, strict=True)
    up = F.col("touched") == "hi"
    status = F.when(F.col("touched").isNull(), "EXPIRED").when(
        up == (F.col("direction") == "bullish"), "VERIFIED").otherwise("MISSED")
    out = t.select("symbol", signal_id, "touch_ts", status.alias("verification"))
    return signals.join(out, ["symbol", signal_id], "left")


def signal_counts(signals: DataFrame) -> DataFrame:
    """Counts behind the list filters: all, bull, bear, warn (<50), high (>=80), verified."""
    c, d = F.col("conf"), F.col("direction")
    ver = F.col("verification") if "verification" in signals.columns else F.lit(None).cast("string")
    return signals.groupBy("symbol").agg(
        F.count("*").alias("all"), F.count_if(d == "bullish").alias("bull"), F.count_if(d == "bearish").alias("bear"),
        F.count_if(c < 50).alias("warn"), F.count_if(c >= 80).alias("high"),
        F.count_if(ver == "VERIFIED").alias("verified"))


def recent_list(signals: DataFrame, now: DataFrame, k: int = 30, max_age_ms: int = 120_000) -> DataFrame:
    """The newest ``k`` signals of each symbol within ``max_age_ms`` of ``now_ms``, decayed.

    ``now``: symbol, now_ms.
    """
    live = signals.join(now, "symbol").filter(
        (F.col("now_ms") - F.col("ts_ms") <= max_age_ms) & (F.col("ts_ms") <= F.col("now_ms")))
    newest = [F.desc("ts_ms"), F.desc("type"), F.desc("direction"), F.desc("price")]
    top = top_k(live, ["symbol"], newest, k)
    conf = decayed(F.col("conf"), F.col("type"), F.col("now_ms") - F.col("ts_ms"))
    return top.withColumn("decayed_conf", conf)


# Evidence tags by the text a signal type contains.
EVIDENCE_TAGS = (("WALL", "WALL"), ("CVD", "CVD"), ("SPOOF", "SPOOF"), ("ABSORPTION", "ABSORB"),
                 ("COMPRESSION", "ABSORB"), ("CASCADE", "CASCADE"), ("ICEBERG", "ICEBERG"))


def summary_text(regime: Column, direction: Column, recent: Column, now: Column, rr: Column,
                 confluence: Column, memory_ms: int = 30_000, rows: int = 10) -> Column:
    """One line of text: regime, direction, evidence tags of the last signals, RR, confluence."""
    last = F.slice(recent, -F.least(F.size(recent), F.lit(rows)), rows)
    live = in_memory(F.when(F.size(recent) > 0, last).otherwise(recent), now, memory_ms)
    tags = F.transform(live, lambda s: _tag(s["type"]))
    tags = F.array_distinct(F.filter(tags, lambda t: t.isNotNull()))
    listed = F.when(F.size(tags) > 0, F.array_join(F.array_sort(tags), "; ")).otherwise(
        F.concat(F.size(recent).cast("string"), F.lit(" signals agree")))
    text = F.concat_ws(" | ", regime, F.concat(
        F.lower(direction), F.lit(" pressure: "), listed, F.format_string(". RR: %.1f", rr),
        F.format_string(". Confluence: %d/6", confluence)))
    return F.when(direction == "NEUTRAL", F.concat_ws(" | ", regime, F.lit("no clear direction"))).otherwise(text)


def _tag(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for text, tag in reversed(EVIDENCE_TAGS):
        out = F.when(kind.contains(text), tag).otherwise(out)
    return out
