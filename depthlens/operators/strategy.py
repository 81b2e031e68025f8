"""Feature frames, composite score, filters and decisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthlens.functions import books as bk
from depthlens.functions.scalar import clamp
from depthlens.operators import book, flow
from depthlens.operators.fold import decision_fires
from depthlens.operators.ordered import RN, order_rows
from depthlens.operators.quality import data_quality


# ---- feature frames -----------------------------------------------------------------------
def latest_of(left: DataFrame, rights: Sequence[tuple[DataFrame, str, Mapping[str, str]]],
              left_id: str = "seq") -> DataFrame:
    """Latest values of several tables at each ``left`` row (symbol, ts_ms).

    ``rights``: (table, id column, {new name: column}).  All tables are merged into one
    ordered union, so they share a single sort.
    """
    parts = [left.select("symbol", "ts_ms", F.lit(len(rights)).alias("__src"), F.col(left_id).cast("bigint").alias("__tie"),
                         F.struct(*[c for c in left.columns if c not in ("symbol", "ts_ms")]).alias("__left"))]
    for i, (df, ident, cols) in enumerate(rights):
        parts.append(df.select("symbol", "ts_ms", F.lit(i).alias("__src"), F.col(ident).cast("bigint").alias("__tie"),
                               F.struct(*[F.col(c).alias(n) for n, c in cols.items()]).alias(f"__r{i}")))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    o = order_rows(merged, ["symbol"], ["ts_ms", "__src", "__tie"])
    o = o.running({f"__s{i}": ("last", F.col(f"__r{i}")) for i in range(len(rights))})
    values = [F.col(f"__s{i}.{n}").alias(n) for i, (_, _, cols) in enumerate(rights) for n in cols]
    return o.df.filter(F.col("__src") == len(rights)).select("symbol", "ts_ms", "__left.*", *values)


def feature_frames(
    books: DataFrame, trades: DataFrame, detector_scores: DataFrame | None = None, *,
    bar_ms: int = 5000, tau_ms: int = 5000, max_gap_ms: int = 10_000, bucket: int = 100_000,
) -> DataFrame:
    """One frame per book: seven features (NULL while not valid) and the quality grade.

    ``detector_scores``: symbol, ts_ms, score of the detections at book times.
    """
    def valid(df, value, ident="trade_id"):
        return df.filter("valid").select("symbol", "ts_ms", ident, value)

    # one ordering of the trades and one of the books serve all their features
    t, b = flow.ordered_trades(trades), book.ordered_books(books)
    obi = book.smoothed_imbalance(b, tau_ms).select("symbol", "ts_ms", "seq", F.when(
        F.col("valid"), F.col("obi")).alias("obi"))
    micro = book.microprice_deviation(b).select("symbol", "ts_ms", "seq", F.when(
        F.col("valid"), F.col("micro_dev")).alias("micro_dev"))
    base = books.select("symbol", "ts_ms", "seq", bk.mid().alias("mid"), bk.spread().alias("spread"))
    base = base.join(obi, ["symbol", "ts_ms", "seq"], "left").join(micro, ["symbol", "ts_ms", "seq"], "left")
    if detector_scores is not None:
        base = base.join(detector_scores.select("symbol", "ts_ms", F.col("score").alias("detector_score")),
                         ["symbol", "ts_ms"], "left")
    else:
        base = base.withColumn("detector_score", F.lit(None).cast("double"))
    bars = flow.time_bars(trades, bar_ms).withColumn("ts_ms", F.col("bar_ts") + bar_ms)
    out = latest_of(base, [
        (valid(flow.cvd_zscore(t), "cvd_z"), "trade_id", {"cvd_z": "cvd_z"}),
        (valid(flow.price_velocity(t, max_gap_ms=max_gap_ms), "velocity_z"), "trade_id", {"velocity_z": "velocity_z"}),
        (valid(flow.vpin(t, bucket), "vpin"), "trade_id", {"vpin": "vpin"}),
        (valid(flow.return_volatility(t), "volatility"), "trade_id", {"volatility": "volatility"}),
        (bars, "bar_ts", {"flow_delta": "delta", "flow_volume": "volume", "flow_pressure": "pressure"}),
    ])
    names = ("cvd_z", "obi", "velocity_z", "micro_dev", "vpin", "detector_score", "volatility")
    return out.withColumn("data_quality", data_quality([F.col(n) for n in names]))


# ---- score and vetoes ------------------------------------------------------------------------
# Default weights of the composite score.
WEIGHTS = {"cvd_z": 0.25, "obi": 0.15, "velocity_z": 0.15, "micro_dev": 0.1, "vpin": 0.05, "detector_score": 0.3}


def normalized(weights: Mapping[str, float]) -> dict[str, float]:
    """Weights scaled to sum 1; the defaults when their sum is not positive."""
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total > 0 else dict(WEIGHTS)


def composite_score(weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Weighted mean of the valid features, each clamped to +-2, in -1..1; 0 without any."""
    w = normalized(weights)
    parts = [F.when(F.col(n).isNotNull(), clamp(F.col(n), -2, 2) * x).otherwise(0.0) for n, x in w.items()]
    used = [F.when(F.col(n).isNotNull(), x).otherwise(0.0) for n, x in w.items()]
    total = sum(used[1:], used[0])
    score = clamp(sum(parts[1:], parts[0]) / F.nullif(total, F.lit(0.0)), -1, 1)
    return F.coalesce(score, F.lit(0.0))


def veto_decisions(flat: float = 0.0005, min_obi: float = 0.06, max_vpin: float = 0.8) -> Column:
    """Array of failed vetoes; volatility is in bps while ``flat`` keeps its original number."""
    def failed(cond, name, reason, adjustment=0.0):
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(
            F.lit(name).alias("id"), F.lit("hard-veto").alias("mode"), F.lit(False).alias("pass"),
            F.lit(reason).alias("reason"), F.lit(adjustment).alias("adjustment")))
    return F.array_compact(F.array(
        failed(F.col("volatility") < flat, "flat_market", "market too flat"),
        failed(F.abs("obi") < min_obi, "obi_confluence", "order-book imbalance too low"),
        failed(F.col("vpin") > max_vpin, "vpin_veto", "order flow too toxic", -0.3),
        failed(F.col("data_quality") == "invalid", "data_quality", "invalid data quality")))


def scored_frames(frames: DataFrame, weights: Mapping[str, float] = WEIGHTS, **limits) -> DataFrame:
    df = frames.withColumns({"score": composite_score(weights), "vetoes": veto_decisions(**limits)})
    return df.withColumn("passed", F.size("vetoes") == 0)


def decide(scored: DataFrame, threshold: float = 0.35, dwell_ms: float = 500, cooldown_ms: float = 15_000,
           order: Sequence[str] = ("ts_ms", "seq")) -> DataFrame:
    """Fired decisions; vetoed frames do not reach the state machine."""
    o = order_rows(scored.filter("passed"), ["symbol"], list(order))
    fires = decision_fires(o, "score", "ts_ms", threshold, dwell_ms, cooldown_ms)
    return o.df.join(fires, ["symbol", RN]).drop(RN)


# ---- signal filters -----------------------------------------------------------------------------
@dataclass
class SignalFilters:
    """Ordered named filters; the first one that fails names the reason.

    A filter is a boolean Column over the signal and its state columns (regime, open_positions,
    last_signal_ts, confidence, ...).
    """

    filters: dict[str, Column] = field(default_factory=dict)

    @classmethod
    def default(cls, regimes=("trending_up", "trending_down"), max_positions: int = 5,
                cooldown_ms: int = 60_000, min_confidence: float = 0.5) -> SignalFilters:
        since = F.col("ts_ms") - F.coalesce(F.col("last_signal_ts"), F.lit(0))
        return cls({
            "regime_filter": F.col("regime").isin(*regimes),
            "max_positions_filter": F.col("open_positions") < max_positions,
            "cooldown_filter": since >= cooldown_ms,
            "confidence_filter": F.col("confidence") >= min_confidence,
        })

    def add(self, name: str, condition: Column) -> SignalFilters:
        self.filters[name] = condition
        return self

    def remove(self, name: str) -> SignalFilters:
        self.filters.pop(name, None)
        return self

    def apply(self, signals: DataFrame) -> DataFrame:
        """Adds ``passed`` and ``filter_reason`` (NULL when passed)."""
        reason = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in self.filters.items()],
                            F.lit(None).cast("string"))
        return signals.withColumn("filter_reason", reason).withColumn("passed", F.col("filter_reason").isNull())

    def stats(self, filtered: DataFrame) -> DataFrame:
        """Passed and rejected per filter, counting only signals that reached it."""
        names = list(self.filters)
        at = F.coalesce(*[F.when(F.col("filter_reason") == n, i) for i, n in enumerate(names)], F.lit(len(names)))
        counts = filtered.groupBy(at.alias("__at")).agg(F.count("*").alias("__n"))
        rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("name")) for i, n in enumerate(names)])
        return counts.select("*", F.inline(rows)).groupBy("position", "name").agg(
            F.coalesce(F.sum(F.when(F.col("__at") > F.col("position"), F.col("__n"))), F.lit(0)).alias("passed"),
            F.coalesce(F.sum(F.when(F.col("__at") == F.col("position"), F.col("__n"))), F.lit(0)).alias("rejected"))


def risk_gate(max_age_ms: int = 5000, max_spread_bps: float = 10.0, max_vpin: float = 0.8,
              cascade_ms: int = 5000) -> Column:
    """Reason that blocks a plan, or NULL.

    Columns: now_ms, book_ts, spread_bps, vpin, compression, chain_len, chain_ts.
    """
    now = F.col("now_ms")
    return (F.when(now - F.col("book_ts") > max_age_ms, "stale_data")
            .when(F.col("spread_bps") > max_spread_bps, "spread")
            .when(F.col("vpin") > max_vpin, "vpin_toxic")
            .when(F.col("compression"), "compression_active")
            .when((F.col("chain_len") >= 1) & (now - F.col("chain_ts") < cascade_ms), "cascade_active"))


def regime_inputs(books: DataFrame, trades: DataFrame, chains: DataFrame, compressions: DataFrame, *,
                  rate_ms: int = 1000, chain_ms: int = 2000) -> DataFrame:
    """Books with the columns signals.flow_regimes needs.

    ``chains``: rows of signals.cascade_chains; a chain counts for ``chain_ms`` after its last
    event.  ``compressions``: symbol, ts_ms, seq, compression per book.
    """
    from depthlens.operators.intervals import range_frame
    cvd = order_rows(flow.cumulative_delta(trades), ["symbol"], ["ts_ms", "trade_id"]).frame(
        9, 0, lambda w: {"cvd_move": F.abs(F.col("cvd") - F.lag("cvd", 9).over(w))}).df
    rated = range_frame(trades, ["symbol"], "ts_ms", rate_ms - 1, 0, {"rate_1s": ("count", F.lit(1))}, probes=books)
    base = rated.withColumn("spread_bps", bk.spread_bps())
    out = latest_of(base, [(cvd, "trade_id", {"cvd_move": "cvd_move"}),
                           (chains.withColumn("__cts", F.col("ts_ms")), "trade_id",
                            {"__len": "chain_len", "__last": "__cts"})])
    live = F.coalesce(F.col("ts_ms") - F.col("__last") < chain_ms, F.lit(False))
    out = out.withColumn("chain_len", F.when(live, F.col("__len")).otherwise(0)).drop("__len", "__last")
    return out.join(compressions.select("symbol", "ts_ms", "seq", "compression"), ["symbol", "ts_ms", "seq"], "left")
