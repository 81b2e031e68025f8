"""Structured Streaming forms of the operators.

Trades here carry ``ts`` (timestamp) besides ``ts_ms``.  Rows later than the watermark are
dropped, and append mode emits a window once the watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from depthlens.operators.flow import _bar_columns, _bar_measures


def with_event_time(df: DataFrame, delay: str = "10 seconds") -> DataFrame:
    return df.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)


def drop_repeated_trades(trades: DataFrame) -> DataFrame:
    """First row per (symbol, trade_id) within the watermark."""
    return trades.dropDuplicatesWithinWatermark(["symbol", "trade_id"])


def time_bars(trades: DataFrame, bucket: str = "5 seconds") -> DataFrame:
    """Aligned flow bars, emitted when the watermark closes them (this also ends idle bars)."""
    bars = trades.groupBy("symbol", F.window("ts", bucket).alias("w")).agg(*_bar_columns())
    return _bar_measures(bars).withColumn("bar_ts", F.unix_millis(F.col("w.start"))).drop("w")


def sliding_counts(trades: DataFrame, length: str = "5 seconds", slide: str = "1 second") -> DataFrame:
    """Trades and signed volume of the last ``length``, every ``slide``."""
    signed = F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    return trades.groupBy("symbol", F.window("ts", length, slide).alias("w")).agg(
        F.count("*").alias("n"), F.sum(signed).alias("delta")).select(
        "symbol", F.unix_millis(F.col("w.end")).alias("until_ms"), "n", "delta")


def liquidation_sessions(liqs: DataFrame, gap: str = "2 seconds") -> DataFrame:
    """Chains of same-side liquidations separated by silence of ``gap``."""
    return liqs.groupBy("symbol", "side", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("chain_len"), F.sum(F.col("price") * F.col("qty")).alias("notional")).select(
        "symbol", "side", F.unix_millis(F.col("w.start")).alias("start_ms"), "chain_len", "notional")


def forward_prices(signals: DataFrame, prices: DataFrame, horizon: str = "30 seconds") -> DataFrame:
    """Signals joined with the prices of the next ``horizon``; both sides have watermarks.

    ``signals``: symbol, ts, signal_id, ...; ``prices``: symbol, ts, price.
    """
    s, p = signals.alias("s"), prices.select("symbol", F.col("ts").alias("price_ts"), F.col("price").alias("later_price")).alias("p")
    return s.join(p, F.expr(
        f"s.symbol = p.symbol and p.price_ts > s.ts and p.price_ts <= s.ts + interval {horizon}")).select(
        "s.*", "p.price_ts", "p.later_price")


# ---- keyed state -------------------------------------------------------------------------------
# Both machines keep a few numbers per key.  A micro-batch hands over one key's new rows, which
# are put in event-time order before they are applied.
def cooldown(signals: DataFrame, cooldown_ms: int = 8000) -> DataFrame:
    """Signals (symbol, type, ts_ms, conf) that start a new cool-down of their type."""
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts_ms", kind="stable")
        keep = []
        for i, t in enumerate(rows["ts_ms"].to_numpy()):
            if last is None or t - last >= cooldown_ms:
                keep.append(i)
                last = int(t)
        state.update((last,))
        yield rows.iloc[keep][["symbol", "type", "ts_ms", "conf"]]

    return signals.select("symbol", "type", "ts_ms", "conf").groupBy("symbol", "type").applyInPandasWithState(
        step, "symbol string, type string, ts_ms long, conf double", "last long", "append", GroupStateTimeout.NoTimeout)


def decisions(scores: DataFrame, threshold: float = 0.35, dwell_ms: int = 500, cooldown_ms: int = 15_000) -> DataFrame:
    """Fires of the decision machine on a stream of (symbol, ts_ms, score)."""
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        mode, side, since = state.get if state.exists else ("IDLE", "", 0)
        rows = pd.concat(list(batches)).sort_values("ts_ms", kind="stable")
        fired = []
        for t, s in zip(rows["ts_ms"].to_numpy(), rows["score"].to_numpy()):
            now, hot = ("BUY" if s > 0 else "SELL"), abs(s) >= threshold
            if mode == "IDLE":
                if hot:
                    mode, side, since = "ARMED", now, int(t)
            elif mode == "ARMED":
                if now != side or not hot:
                    mode = "IDLE"
                elif t - since >= dwell_ms:
                    mode = "FIRED"
                    fired.append((key[0], int(t), side))
            elif mode == "FIRED":
                mode, since = "COOLDOWN", int(t)
            elif t - since >= cooldown_ms:
                mode = "IDLE"
        state.update((mode, side, since))
        yield pd.DataFrame(fired, columns=["symbol", "ts_ms", "fired_side"]).astype({"ts_ms": "int64"})

    return scores.select("symbol", "ts_ms", "score").groupBy("symbol").applyInPandasWithState(
        step, "symbol string, ts_ms long, fired_side string", "mode string, side string, since long",
        "append", GroupStateTimeout.NoTimeout)


def volume_bars(trades: DataFrame, size: float) -> DataFrame:
    """Closed volume bars per symbol; the open bar is the state."""
    out = "symbol string, bar long, bar_ts long, open double, high double, low double, close double, volume double, delta double"

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        bar, ts, o, h, l, c, v, d = state.get if state.exists else (1, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts_ms", "trade_id"])
        closed = []
        for t, p, q, s in zip(rows["ts_ms"], rows["price"], rows["qty"], rows["side"]):
            if v == 0:
                ts, o, h, l = int(t), p, p, p
            h, l, c, v, d = max(h, p), min(l, p), p, v + q, d + (q if s == "buy" else -q)
            if v >= size:
                closed.append((key[0], bar, ts, o, h, l, c, v, d))
                bar, v, d = bar + 1, 0.0, 0.0
        state.update((bar, ts, o, h, l, c, v, d))
        yield pd.DataFrame(closed, columns=["symbol", "bar", "bar_ts", "open", "high", "low", "close", "volume", "delta"]).astype(
            {"bar": "int64", "bar_ts": "int64"})

    return trades.select("symbol", "ts_ms", "trade_id", "price", "qty", "side").groupBy("symbol").applyInPandasWithState(
        step, out, "bar long, ts long, o double, h double, l double, c double, v double, d double",
        "append", GroupStateTimeout.NoTimeout)


# ---- running ---------------------------------------------------------------------------------------
def run_to_table(df: DataFrame, path: str, checkpoint: str, every: str | None = None,
                 transform: Callable[[DataFrame], DataFrame] | None = None):
    """Start writing a stream to parquet.  ``every`` throttles it; without, it takes what there is and ends.

    Each micro-batch goes to its own folder, which a repeated batch overwrites: a restart after
    a lost driver leaves no double rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
