"""Checks and repairs of candles, trades and book feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthlens.operators.fold import sequence_walk
from depthlens.operators.ordered import RN, order_rows


# ---- candles: symbol, ts, o, h, l, c, v [, seq = arrival order] ---------------------------
def candle_quality(candles: DataFrame, seq: str = "seq", interval_ms: int = 60_000) -> DataFrame:
    """One report row per symbol; rows are taken in arrival order ``seq``.

    Broken rows (non-positive price, negative volume, high below low) count as invalid and
    take part in no other check.  A gap is a step above two intervals - any step, when the
    previous time stamp occurs more than once.  Penalties: 3 invalid, 2 gap, 1 duplicate,
    2 outlier (a close moving more than 20 %).
    """
    repeats = candles.groupBy("symbol", "ts").agg(F.count("*").alias("__same"))
    o = order_rows(candles.join(repeats, ["symbol", "ts"]), ["symbol"], [seq])
    o = o.frame(1, 0, lambda w: {
        "__pt": F.lag("ts").over(w), "__pc": F.lag("c").over(w), "__ps": F.lag("__same").over(w)})
    broken = (
        (F.least("o", "h", "l", "c") <= 0) | (F.col("v") < 0) | (F.col("h") < F.col("l")))
    shape = (F.col("h") < F.greatest("o", "c")) | (F.col("l") > F.least("o", "c"))
    step = F.col("ts") - F.col("__pt")
    allowed = F.when((F.col("__pt") > 0) & (F.col("__ps") > 1), 0).otherwise(interval_ms) * 2
    checks = {
        "invalid_rows": broken | shape,
        "gaps": ~broken & (F.col("ts") > 0) & (step > allowed),
        "duplicates": ~broken & (step == 0),
        "outliers": ~broken & (F.col("__pc") > 0)
        & (F.abs(F.col("c") - F.col("__pc")) / F.nullif(F.col("__pc"), F.lit(0.0)) > 0.2),
    }
    report = o.df.groupBy("symbol").agg(
        F.count("*").alias("total_rows"), *[F.count_if(c).alias(n) for n, c in checks.items()])
    penalty = F.expr("invalid_rows * 3 + gaps * 2 + duplicates + outliers * 2")
    return report.withColumns({
        "valid_rows": F.col("total_rows") - F.col("invalid_rows"),
        "score": F.greatest(F.lit(0), 100 - penalty),
    })


def sort_and_deduplicate(candles: DataFrame, seq: str = "seq") -> DataFrame:
    """First row in arrival order per (symbol, ts); merged map-side, so no hot window."""
    rest = [c for c in candles.columns if c not in ("symbol", "ts", seq)]
    return candles.groupBy("symbol", "ts").agg(
        F.min(F.struct(seq, *rest)).alias("r")).select("symbol", "ts", "r.*")


def fill_gaps(candles: DataFrame, interval_ms: int) -> DataFrame:
    """Repeat a candle (zero volume) on the interval grid until the next real candle."""
    o = order_rows(candles, ["symbol"], ["ts"]).frame(
        0, 1, lambda w: {"__next": F.lead("ts").over(w)})
    stop = F.coalesce(F.col("__next") - 1, F.col("ts"))
    return o.df.withColumns({"__real": F.col("ts")}).withColumn(
        "ts", F.explode(F.sequence(F.col("ts"), stop, F.lit(interval_ms)))
    ).withColumns({
        "filled": F.col("ts") != F.col("__real"),
        "v": F.when(F.col("ts") == F.col("__real"), F.col("v")).otherwise(0.0),
    }).drop("__next", "__real", RN)


# ---- trades --------------------------------------------------------------------------------
def first_per_trade_id(trades: DataFrame, order: str = "ts_ms") -> DataFrame:
    rest = [c for c in trades.columns if c not in ("symbol", "trade_id", order)]
    return trades.groupBy("symbol", "trade_id").agg(
        F.min(F.struct(order, *rest)).alias("r")).select("symbol", "trade_id", "r.*")


# ---- book feeds: symbol, arrival, kind ('snapshot'/'delta'), first_seq, last_seq -------------
def _epochs(feed: DataFrame):
    """Number the stretches that start at a snapshot; 0 = before the first one."""
    o = order_rows(feed, ["symbol"], ["arrival"])
    return o.running({"epoch": ("sum", (F.col("kind") == "snapshot").cast("bigint"))})


def strict_delta_chain(feed: DataFrame) -> DataFrame:
    """Accept a delta only if it continues the last accepted sequence number exactly.

    A break leaves the book ``resyncing``: later deltas are rejected until a snapshot, or
    the missing delta itself, arrives.  Rows before the first break of an epoch are decided by a window column;
    only the rows from it on are walked.
    """
    o = _epochs(feed).frame(1, 0, lambda w: {"__prev": F.lag("last_seq").over(w)})
    # a delta at the very start of a feed has nothing to continue and is taken as it is
    broken = (F.col("kind") == "delta") & (F.col("first_seq") != F.col("__prev") + 1)
    o = o.col("__first", F.when(broken, F.struct("epoch", (-F.col(RN)).alias("neg"), "__prev")))
    o = o.running({"__stuck": ("max", F.col("__first"))})
    o = o.cols({
        "__lost": F.coalesce(F.col("__stuck.epoch") == F.col("epoch"), F.lit(False)),
        "__m": F.col("__stuck.__prev"),
    })
    base = o.df.drop("__prev", "__first", "__stuck").withColumn("status", F.lit("ok"))
    tail = base.filter("__lost").withColumnRenamed(RN, "__at")
    walked = sequence_walk(order_rows(tail, ["symbol", "epoch"], ["__at"], within=o),
                           "first_seq", "last_seq", "__m", strict=True)
    rows = base.filter("not __lost").drop("__lost", "__m", RN).unionByName(
        walked.drop("__lost", "__m", "__at", RN))
    accepted = F.col("status") == "ok"
    return rows.withColumns({
        "accepted": accepted,
        "state": F.when(F.col("epoch") == 0, "disconnected").when(accepted, "connected")
        .otherwise("resyncing"),
    }).drop("status")


def sequence_status(feed: DataFrame) -> DataFrame:
    """Overlap-tolerant check of each delta: ok, gap, duplicate or stale (no snapshot yet).

    Until the first gap of an epoch the known sequence number is the running maximum of
    ``last_seq``, so those rows are decided by window columns.  From the first gap on the known number
    depends on which rows happen to overlap it; those rows are walked in blocks.
    """
    o = _epochs(feed).running({"__top": ("max", F.struct("epoch", "last_seq"))}, inclusive=False)
    known = F.when(F.col("__top.epoch") == F.col("epoch"), F.col("__top.last_seq"))
    o = o.col("__known", known)
    delta = F.col("kind") == "delta"
    first_gap = delta & (F.col("epoch") > 0) & (F.col("first_seq") > F.col("__known") + 1)
    # the maximum of these structs is the earliest gap of the latest epoch that has one
    o = o.col("__first", F.when(
        first_gap, F.struct("epoch", (-F.col(RN)).alias("neg"), "__known")))
    o = o.running({"__stuck": ("max", F.col("__first"))})
    in_gap = F.coalesce(F.col("__stuck.epoch") == F.col("epoch"), F.lit(False))
    clean = F.when(F.col("kind") == "snapshot", "snapshot").when(
        F.col("epoch") == 0, "stale").when(
        F.col("last_seq") <= F.col("__known"), "duplicate").otherwise("ok")
    o = o.cols({"__in_gap": in_gap, "status": F.when(~in_gap, clean),
                "__m": F.col("__stuck.__known")})
    base = o.df.drop("__top", "__known", "__first", "__stuck")
    settled = base.filter("not __in_gap").drop("__in_gap", "__m", RN)
    tail = base.filter("__in_gap").withColumnRenamed(RN, "__at")
    walked = sequence_walk(
        order_rows(tail, ["symbol", "epoch"], ["__at"], within=o), "first_seq", "last_seq", "__m")
    return settled.unionByName(walked.drop("__in_gap", "__m", "__at", RN))


def is_stale(book_ts: Column, now: Column, threshold_ms: int) -> Column:
    return now - book_ts > threshold_ms


# ---- levels and frames -------------------------------------------------------------------------
def valid_level(level: Column) -> Column:
    ok = (level["price"] > 0) & (level["qty"] >= 0)
    return F.coalesce(ok & ~F.isnan(level["price"]) & ~F.isnan(level["qty"]), F.lit(False))


def valid_levels(levels: Column) -> Column:
    return F.filter(levels, valid_level)


def valid_book(bids: Column, asks: Column) -> Column:
    both = (F.size(bids) > 0) & (F.size(asks) > 0)
    return F.coalesce(both & (F.get(bids, F.lit(0))["price"] < F.get(asks, F.lit(0))["price"]),
                      F.lit(False))


def data_quality(features: list[Column], good: int = 4, degraded: int = 2) -> Column:
    """Grade of a frame from how many features are valid (not NULL)."""
    n = sum((f.isNotNull().cast("int") for f in features), F.lit(0))
    return F.when(n >= good, "good").when(n >= degraded, "degraded").otherwise("invalid")
