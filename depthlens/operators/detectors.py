"""Book and flow detectors.

Each returns rows (symbol, ts_ms, seq, detector, side, confidence, evidence): ``side`` is
bullish, bearish or neutral, ``evidence`` a map of named numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthlens.functions import books as bk
from depthlens.functions.scalar import array_mean, array_median, array_std
from depthlens.operators.book import SIDES, ordered_books
from depthlens.operators.fold import greedy_starts
from depthlens.operators.intervals import range_frame
from depthlens.operators.ordered import RN, order_rows

COLUMNS = ("symbol", "ts_ms", "seq", "detector", "side", "confidence", "evidence")


def _evidence(**named: Column) -> Column:
    pairs = [x for k, v in named.items() for x in (F.lit(k), v.cast("double"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _rows(df: DataFrame, name: str, side: Column, confidence: Column, **evidence) -> DataFrame:
    conf = F.coalesce(confidence.cast("double"), F.lit(0.0))
    return df.select("symbol", "ts_ms", "seq", F.lit(name).alias("detector"),
                     F.when(conf > 0, side).otherwise("neutral").alias("side"),
                     conf.alias("confidence"), _evidence(**evidence).alias("evidence"))


# ---- single-book rules -----------------------------------------------------------------------
def skew(books: DataFrame, threshold: float = 0.4) -> DataFrame:
    b, a = bk.notional(bk.top(F.col("bids"), 10)), bk.notional(bk.top(F.col("asks"), 10))
    df = books.withColumns({"__s": bk.balance(b, a), "__b": b, "__a": a})
    s = F.col("__s")
    conf = F.when(F.abs(s) >= threshold, F.least(F.abs(s) / 0.8, F.lit(1.0)))
    return _rows(df, "skew", F.when(s > 0, "bullish").otherwise("bearish"), conf,
                 skew=s, bid_notional=F.col("__b"), ask_notional=F.col("__a"))


def _strongest(side: Column) -> Column:
    """Largest quantity above three times the median, NULL if none."""
    return F.array_max(F.filter(bk.quantities(side), lambda q: q > array_median(bk.quantities(side)) * 3.0))


def compression(books: DataFrame, max_spread: float = 0.0005) -> DataFrame:
    df = books.withColumns({
        "__b": _strongest(F.col("bids")), "__a": _strongest(F.col("asks")),
        "__s": F.coalesce(bk.spread() / F.nullif(bk.mid(), F.lit(0.0)), F.lit(1.0))})
    both = F.col("__b").isNotNull() & F.col("__a").isNotNull()
    conf = F.when(both & (F.col("__s") < max_spread), 0.85)
    return _rows(df, "compression", F.lit("neutral"), conf, bid_wall_qty=F.col("__b"),
                 ask_wall_qty=F.col("__a"), spread_pct=F.col("__s"))


def liquidity_void(books: DataFrame, multiple: float = 3.0) -> DataFrame:
    """A gap of the top ten levels of at least ``multiple`` median gaps."""
    df = books
    for s, c in SIDES:
        side = bk.top(F.col(c), 10)
        gaps = bk.gaps(side)
        df = df.withColumn(f"__g_{s}", gaps).withColumns({
            f"__max_{s}": F.array_max(f"__g_{s}"), f"__med_{s}": array_median(F.col(f"__g_{s}"))})
        big, med = F.col(f"__max_{s}"), F.col(f"__med_{s}")
        df = df.withColumn(f"__c_{s}", F.when(
            (F.size(side) >= 3) & (big >= med * multiple),
            F.coalesce(F.least(big / F.nullif(med * 5.0, F.lit(0.0)), F.lit(0.8)), F.lit(0.8)),
        ).otherwise(0.0))
    bid = F.col("__c_bid") >= F.col("__c_ask")
    at = F.array_position(F.when(bid, F.col("__g_bid")).otherwise(F.col("__g_ask")),
                          F.when(bid, F.col("__max_bid")).otherwise(F.col("__max_ask")))
    side = F.when(bid, F.col("bids")).otherwise(F.col("asks"))
    near, far = (F.get(side, (at + k).cast("int"))["price"] for k in (-1, 0))
    return _rows(df, "liquidity_void", F.when(bid, "bearish").otherwise("bullish"),
                 F.greatest("__c_bid", "__c_ask"),
                 max_gap=F.when(bid, F.col("__max_bid")).otherwise(F.col("__max_ask")),
                 median_gap=F.when(bid, F.col("__med_bid")).otherwise(F.col("__med_ask")),
                 void_mid=(near + far) / 2.0)


def ladder(books: DataFrame, tolerance: float = 0.3) -> DataFrame:
    """Three or more large levels of a side at even distances."""
    df = books
    for s, c in SIDES:
        med = array_median(bk.quantities(bk.top(F.col(c), 15)))
        df = df.withColumn(f"__m_{s}", med)
        df = df.withColumn(f"__w_{s}", F.filter(
            F.col(c), lambda l: (F.col(f"__m_{s}") > 0) & (l["qty"] >= F.col(f"__m_{s}") * 2.0)))
        df = df.withColumn(f"__g_{s}", bk.gaps(F.col(f"__w_{s}")))
        mean = array_mean(F.col(f"__g_{s}"))
        cv = array_std(F.col(f"__g_{s}"), sample=False) / F.when(mean == 0, 1.0).otherwise(mean)
        # array_std is 0 below two values, which is also the deviation of one spacing
        df = df.withColumn(f"__cv_{s}", cv)
        n = F.size(f"__w_{s}")
        df = df.withColumn(f"__c_{s}", F.when(
            (n >= 3) & (F.col(f"__cv_{s}") <= tolerance), F.least(n / 5.0, F.lit(0.8))
        ).otherwise(0.0))
    bid = F.col("__c_bid") >= F.col("__c_ask")
    return _rows(df, "ladder", F.when(bid, "bullish").otherwise("bearish"),
                 F.greatest("__c_bid", "__c_ask"),
                 wall_count=F.when(bid, F.size("__w_bid")).otherwise(F.size("__w_ask")),
                 cv=F.when(bid, F.col("__cv_bid")).otherwise(F.col("__cv_ask")))


# ---- rules that remember levels ----------------------------------------------------------------
def wall(books: DataFrame, multiple: float = 3.0, min_notional: float = 50_000.0,
         rearm_ms: int = 30_000) -> DataFrame:
    """A large level seen for the first time (again after ``rearm_ms``).

    New walls on both sides at once are reported as neutral ``compression``.
    """
    cand = _level_rows(books, 15, lambda c: (F.size(c) >= 5))
    big = (F.col("qty") >= F.col("median_qty") * multiple) & (
        F.col("price") * F.col("qty") >= min_notional)
    o = order_rows(cand.filter(big), ["symbol", "side", "price"], ["ts_ms", "seq"])
    fresh = greedy_starts(o, "ts_ms", rearm_ms + 1, "__new").df.filter("__new")
    best = F.struct("rank", "price", "qty", "median_qty")
    per_book = fresh.groupBy("symbol", "ts_ms", "seq").agg(
        F.min(F.when(F.col("side") == "bid", best)).alias("__b"),
        F.min(F.when(F.col("side") == "ask", best)).alias("__a"))
    both = F.col("__b").isNotNull() & F.col("__a").isNotNull()
    one = F.coalesce("__b", "__a")
    return per_book.select(
        "symbol", "ts_ms", "seq", F.when(both, "compression").otherwise("wall").alias("detector"),
        F.when(both, "neutral").when(F.col("__b").isNotNull(), "bullish").otherwise("bearish")
        .alias("side"),
        F.when(both, 0.7 * 0.7).otherwise(0.7).alias("confidence"),
        _evidence(wall_price=one["price"], wall_qty=one["qty"], median_qty=one["median_qty"],
                  wall_side=F.when(F.col("__b").isNotNull(), 1).otherwise(-1)).alias("evidence"))


def wall_states(books: DataFrame, multiple: float = 3.0, min_notional: float = 50_000.0,
                rearm_ms: int = 30_000) -> DataFrame:
    """Each large level against its quantity when first seen: appeared / strengthened / pulled."""
    cand = _level_rows(books, 15, lambda c: (F.size(c) >= 5))
    big = (F.col("qty") >= F.col("median_qty") * multiple) & (
        F.col("price") * F.col("qty") >= min_notional)
    o = order_rows(cand.filter(big), ["symbol", "side", "price"], ["ts_ms", "seq"])
    o = greedy_starts(o, "ts_ms", rearm_ms + 1, "is_new")
    o = o.running({"initial_qty": ("last", F.when(F.col("is_new"), F.col("qty")))})
    q, q0 = F.col("qty"), F.col("initial_qty")
    state = F.when(F.col("is_new"), "appeared").when(q > q0 * 1.2, "strengthened").when(
        q < q0 * 0.6, "pulled").otherwise("held")
    return o.col("state", state).result()


def _level_rows(books: DataFrame, depth: int, enough: Callable[[str], Column]) -> DataFrame:
    rows = []
    for s, c in SIDES:
        med = array_median(bk.quantities(bk.top(F.col(c), depth)))
        rows.append(books.filter(enough(c)).select(
            "symbol", "ts_ms", "seq", F.lit(s).alias("side"), med.alias("median_qty"),
            F.posexplode(bk.top(F.col(c), depth)).alias("rank", "l")))
    return rows[0].unionByName(rows[1]).select("*", "l.price", "l.qty").drop("l")


def quote_manipulation(books: DataFrame, min_notional: float = 30_000.0, max_age_ms: int = 20_000,
                       min_age_ms: int = 500, fast: float = 5.0) -> DataFrame:
    """Large quotes that are pulled or refreshed too often.

    A level is watched from the first time its notional reaches ``min_notional``.  It counts as
    pulled when it falls below 60 % of its maximum or leaves the top 15.
    """
    o = ordered_books(books).col("__step", F.col(RN))
    o = o.frame(0, 1, lambda w: {"__next_ts": F.lead("ts_ms").over(w), "__next": F.lead("__step").over(w)})
    seen = []
    for s, c in SIDES:
        seen.append(o.df.select("symbol", "ts_ms", F.col("__step").alias("step"), "__next_ts", "__next",
                                F.lit(s).alias("side"), F.inline(bk.top(F.col(c), 15))))
    seen = seen[0].unionByName(seen[1])
    # every sighting announces the next book; where no sighting follows, the level has gone
    gone = seen.filter("__next is not null").select(
        "symbol", "side", "price", F.col("__next").alias("step"), F.col("__next_ts").alias("ts_ms"))
    rows = seen.select("symbol", "side", "price", "step", "ts_ms", "qty").unionByName(
        gone, allowMissingColumns=True)
    rows = rows.groupBy("symbol", "side", "price", "step").agg(
        F.max("ts_ms").alias("ts_ms"), F.max("qty").alias("qty"))
    key = ["symbol", "side", "price"]
    k = order_rows(rows, key, ["step"], within=o).frame(1, 0, lambda w: {"__pt": F.lag("ts_ms").over(w)})
    fresh = F.coalesce(F.col("ts_ms") - F.col("__pt") > max_age_ms, F.lit(True))
    k = k.running({"__life": ("sum", fresh.cast("bigint"))})
    k = order_rows(k.df.drop("__pt", RN), [*key, "__life"], ["step"], within=k)
    k = k.running({"__born": ("max", F.coalesce(F.col("price") * F.col("qty") >= min_notional, F.lit(False)))})
    k = k.where(F.col("__born"))
    k = k.running({
        "first_ts": ("min", F.col("ts_ms")), "max_qty": ("max", F.col("qty")),
        "seen": ("count", F.col("qty")),
    })
    drop = F.col("qty").isNull() | (F.col("qty") < F.col("max_qty") * 0.6)
    k = k.col("__drop", drop).running({"pulled": ("max", F.col("__drop"))})
    k = k.frame(1, 1, lambda w: {
        "__until": F.lead("ts_ms").over(w), "__was": F.coalesce(F.lag("pulled").over(w), F.lit(False))})
    # a level that was pulled before it left the book keeps the time it was last seen
    counts = F.col("qty").isNotNull() | ~F.col("__was")
    k = k.running({"__last": ("max", F.when(counts, F.col("ts_ms")))})
    elapsed = (F.col("__last") - F.col("first_ts")) / 1000.0
    rate = F.coalesce((F.col("seen") - 1) / F.nullif(elapsed, F.lit(0.0)), F.lit(0.0))
    obs = k.df.withColumn("rate", rate)
    bid, pulled = F.col("side") == "bid", F.col("pulled")
    conf = F.when(pulled, F.least(F.col("rate") / fast, F.lit(1.0)) * 0.8).when(
        F.col("rate") > fast, F.least((F.col("rate") - fast) / fast, F.lit(0.6)))
    obs = obs.withColumns({
        "conf": conf, "sig": F.when(bid == pulled, "bullish").otherwise("bearish"),
        # what holds from this event on, while the age stays inside its limits
        "__lo": F.greatest(F.col("ts_ms"), F.col("first_ts") + min_age_ms),
        "__hi": F.least(F.coalesce(F.col("__until") - 1, F.col("ts_ms") + max_age_ms),
                        F.col("first_ts") + max_age_ms),
    }).filter("conf > 0 and __lo <= __hi")
    obs = obs.select("symbol", F.col("side").alias("book_side"), "price", "qty", "max_qty", "rate",
                     "conf", "sig", "__lo", "__hi", F.explode(F.expr(
                         f"sequence(__lo div {max_age_ms}, __hi div {max_age_ms})")).alias("__bin"))
    at = books.select("symbol", "ts_ms", "seq", F.expr(f"ts_ms div {max_age_ms}").alias("__bin"))
    hits = at.join(obs, ["symbol", "__bin"]).filter("ts_ms between __lo and __hi")
    best = F.max(F.struct("conf", "book_side", (-F.col("price")).alias("p"), "sig", "rate", "max_qty", "qty"))
    b = F.col("__best")
    return hits.groupBy("symbol", "ts_ms", "seq").agg(best.alias("__best")).select(
        "symbol", "ts_ms", "seq", F.lit("quote_manipulation").alias("detector"),
        b["sig"].alias("side"), b["conf"].alias("confidence"),
        _evidence(price=-b["p"], rate=b["rate"], max_qty=b["max_qty"], qty=b["qty"]).alias("evidence"))


# ---- rules on trades, bars and liquidations -------------------------------------------------------
def iceberg(books: DataFrame, trades: DataFrame, lookback_ms: int = 60_000,
            multiple: float = 2.0) -> DataFrame:
    """Recent traded notional against the visible top ten levels it was absorbed by."""
    n = F.col("price") * F.col("qty")
    df = range_frame(trades, ["symbol"], "ts_ms", lookback_ms, 0, {
        "__buys": ("sum", F.when(F.col("side") == "buy", n)),
        "__sells": ("sum", F.when(F.col("side") == "sell", n)),
    }, probes=books)
    bid, ask = bk.notional(bk.top(F.col("bids"), 10)), bk.notional(bk.top(F.col("asks"), 10))
    df = df.withColumns({
        "__sell_x": F.coalesce(F.col("__sells") / F.nullif(ask, F.lit(0.0)), F.lit(0.0)),
        "__buy_x": F.coalesce(F.col("__buys") / F.nullif(bid, F.lit(0.0)), F.lit(0.0))})
    sx, bx = F.col("__sell_x"), F.col("__buy_x")
    x = F.greatest(sx, bx)
    conf = F.when(x >= multiple, F.least((x - multiple) / multiple, F.lit(1.0)))
    # at exactly the multiple the rule names a side with confidence 0, i.e. neutral here
    return _rows(df, "iceberg", F.when(sx > bx, "bullish").otherwise("bearish"), conf,
                 sell_absorption=sx, buy_absorption=bx)


def flow_expansion(bars: DataFrame, min_volume: float = 100_000.0, order: str = "bar_ts") -> DataFrame:
    """A busy bar whose delta is at least twice the previous one.  Bars: symbol, bar_ts, delta, volume."""
    o = order_rows(bars, ["symbol"], [order]).frame(
        1, 0, lambda w: {"__prev": F.lag("delta").over(w)})
    d, p = F.col("delta"), F.col("__prev")
    hit = (F.col("volume") >= min_volume) & (p != 0) & (F.abs(d) >= F.abs(p) * 2.0)
    conf = F.when(hit, F.least(F.abs(d) / min_volume, F.lit(1.0)) * 0.8)
    df = o.df.withColumns({"ts_ms": F.col(order), "seq": F.col(RN)})
    return _rows(df, "flow_expansion", F.when(d > 0, "bullish").otherwise("bearish"), conf,
                 delta=d, volume=F.col("volume"))


def liquidation_cluster(liqs: DataFrame, window_ms: int = 10_000, min_count: int = 5,
                        min_notional: float = 500_000.0, probes: DataFrame | None = None) -> DataFrame:
    """Many liquidations of mostly one side in a short window."""
    n = F.col("price") * F.col("qty")
    at = liqs.withColumn("seq", F.col("trade_id")) if probes is None else probes
    df = range_frame(liqs, ["symbol"], "ts_ms", window_ms, 0, {
        "__n": ("count", F.lit(1)), "__long": ("sum", F.when(F.col("side") == "long", n).otherwise(0.0)),
        "__short": ("sum", F.when(F.col("side") == "long", 0.0).otherwise(n)),
        "__sum": ("sum", F.col("price")), "__lo": ("min", F.col("price")), "__hi": ("max", F.col("price")),
    }, probes=at.select("symbol", "ts_ms", "seq"))
    lo, sh = F.col("__long"), F.col("__short")
    both = lo + sh
    sided = (lo > sh * 2.0) | (sh > lo * 2.0)
    hit = (F.col("__n") >= min_count) & (both >= min_notional) & sided
    conf = F.when(hit, F.least(both / (min_notional * 3.0), F.lit(1.0)))
    return _rows(df, "liquidation_cluster", F.when(lo > sh, "bearish").otherwise("bullish"), conf,
                 count=F.col("__n"), total_notional=both, price_range=F.col("__hi") - F.col("__lo"),
                 cluster_price=F.col("__sum") / F.nullif(F.col("__n"), F.lit(0)))


# ---- combination -----------------------------------------------------------------------------------
def aggregate(detections: DataFrame) -> DataFrame:
    """Bullish against bearish confidence per (symbol, ts_ms)."""
    c = F.col("confidence")
    df = detections.groupBy("symbol", "ts_ms").agg(
        F.sum(F.when(F.col("side") == "bullish", c).otherwise(0.0)).alias("bull"),
        F.sum(F.when(F.col("side") == "bearish", c).otherwise(0.0)).alias("bear"))
    score = bk.balance(F.col("bull"), F.col("bear"))
    return df.withColumn("score", score).withColumns({
        "side": F.when(F.col("score") > 0.1, "bullish").when(F.col("score") < -0.1, "bearish")
        .otherwise("neutral"),
        "confidence": F.abs("score")})


class DetectorRegistry:
    """Named detector functions that are run together; disabled ones are left out of the plan."""

    def __init__(self):
        self._detectors: dict[str, Callable[..., DataFrame]] = {}
        self._enabled: dict[str, bool] = {}

    def register(self, name: str, fn: Callable[..., DataFrame], enabled: bool = True) -> None:
        self._detectors[name], self._enabled[name] = fn, enabled

    def unregister(self, name: str) -> None:
        self._detectors.pop(name, None)
        self._enabled.pop(name, None)

    def enable(self, name: str, on: bool = True) -> None:
        if name in self._enabled:
            self._enabled[name] = on

    def names(self) -> Mapping[str, bool]:
        return dict(self._enabled)

    def run(self, *inputs: DataFrame, skip_failing: bool = False) -> DataFrame:
        """Union of all enabled detectors.

        A detector whose plan cannot be built raises; with ``skip_failing`` it yields no rows and its message is kept in
        ``errors``.
        """
        out = None
        for _, part in self._parts(inputs, skip_failing):
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            raise ValueError("no enabled detector")
        return out

    def row_counts(self, *inputs: DataFrame, skip_failing: bool = False) -> DataFrame:
        """(detector, rows) of every enabled detector, those without a row included, in one job."""
        parts = self._parts(inputs, skip_failing)
        if not parts:
            raise ValueError("no enabled detector")
        out = None
        for name, part in parts:
            one = part.agg(F.count("*").alias("rows")).select(F.lit(name).alias("detector"), "rows")
            out = one if out is None else out.unionByName(one)
        return out

    def _parts(self, inputs, skip_failing: bool) -> list[tuple[str, DataFrame]]:
        parts, self.errors = [], {}
        for name, fn in self._detectors.items():
            if not self._enabled[name]:
                continue
            try:
                parts.append((name, fn(*inputs)))
            except Exception as e:
                if not skip_failing:
                    raise
                self.errors[name] = str(e)
        return parts
