"""Keyed machines on streams that take late rows in event order and let go of quiet keys.

Rows of a key wait in list state until the watermark has passed them, and are then applied in event order, so
a row that comes a batch late, but within the watermark, gives what a batch job gives.  An event-time timer at the
oldest waiting row releases them also if the key gets no more rows.  A machine says when a key has nothing left to
remember; its state is then removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class EventOrdered(StatefulProcessor):
    """Applies ``machine`` to a key's rows in the order of ``order`` (its first column is the event time in ms)."""

    def __init__(self, rows: str, machine: Machine):
        self.rows, self.machine = rows, machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.memory = handle.getValueState("memory", self.machine.memory)

    def _release(self, key, buffered: list[tuple], watermark: int) -> pd.DataFrame:
        """Apply the rows up to the watermark, keep the others and set the timer for them."""
        m = self.machine
        at = [m.columns.index(c) for c in m.order]
        buffered.sort(key=lambda r: tuple(r[i] for i in at))
        cut = next((i for i, r in enumerate(buffered) if r[at[0]] > watermark), len(buffered))
        memory = tuple(self.memory.get()) if self.memory.exists() else None
        memory, out = m.apply(key, memory, buffered[:cut], watermark)
        rest = buffered[cut:]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if memory is None:
            self.memory.clear()
        else:
            self.memory.update(memory)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        wake = [rest[0][at[0]]] if rest else []
        if memory is not None and (until := m.until(memory)) is not None:
            wake.append(until)
        if wake:
            self.handle.registerTimer(max(min(wake), watermark) + 1)
        return pd.DataFrame(out, columns=m.out_columns)

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for pdf in rows for r in pdf[list(self.machine.columns)].astype(object).itertuples(index=False)]
        watermark = timerValues.getCurrentWatermarkInMs()
        out = self._release(key, self._held() + new, watermark)
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._release(key, self._held(), timerValues.getCurrentWatermarkInMs())
        if len(out):
            yield out

    def close(self) -> None:
        pass


class Machine:
    """A fold over the rows of one key.

    ``columns`` of its rows, their ``order`` (event time first), ``memory`` and ``out`` as schema strings.
    """

    columns: tuple[str, ...]
    order: tuple[str, ...]
    memory: str
    out: str

    @property
    def out_columns(self) -> list[str]:
        return [f.split()[0] for f in self.out.split(", ")]

    def apply(self, key, memory, rows, watermark):
        """(memory or None, output rows) after ``rows``, which are complete up to ``watermark``."""
        raise NotImplementedError

    def until(self, memory) -> int | None:
        """Event time after which ``apply`` must look at the memory again even without rows."""
        return None


class Cooldown(Machine):
    """Signals that start a new cool-down of their type; a key is forgotten once its cool-down is over."""

    columns, order = ("ts_ms", "conf"), ("ts_ms", "conf")
    memory, out = "last long", "symbol string, type string, ts_ms long, conf double"

    def __init__(self, cooldown_ms: int):
        self.cooldown_ms = cooldown_ms

    def apply(self, key, memory, rows, watermark):
        last, out = memory[0] if memory else None, []
        for t, conf in rows:
            if last is None or t - last >= self.cooldown_ms:
                out.append((*key, int(t), conf))
                last = int(t)
        if last is not None and watermark - last >= self.cooldown_ms:
            last = None  # whatever comes lies beyond the cool-down
        return (last,) if last is not None else None, out

    def until(self, memory):
        return memory[0] + self.cooldown_ms


class AnchoredChains(Machine):
    """Chains of liquidations of one side that end ``span_ms`` after their first one.

    A chain is emitted when the watermark has passed its end: the timer is the chain's own, so a last chain
    that nothing follows comes out too.
    """

    columns, order = ("ts_ms", "trade_id", "price", "qty"), ("ts_ms", "trade_id")
    memory = "start long, n long, notional double"
    out = "symbol string, side string, start_ms long, chain_len long, notional double"

    def __init__(self, span_ms: int):
        self.span_ms = span_ms

    def apply(self, key, memory, rows, watermark):
        chain, out = memory, []
        for t, _, price, qty in rows:
            if chain is not None and t - chain[0] >= self.span_ms:
                out.append((*key, *chain))
                chain = None
            start, n, notional = chain or (int(t), 0, 0.0)
            chain = (start, n + 1, notional + price * qty)
        if chain is not None and watermark - chain[0] >= self.span_ms:
            out.append((*key, *chain))
            chain = None
        return chain, out

    def until(self, memory):
        return memory[0] + self.span_ms - 1


class PlanLife(Machine):
    """States of one plan: WAITING until its entry trades, OPEN until stop or target, EXPIRED at its end.

    Rows are the plan itself (kind 0: side, entry, stop, target, end) and prices (kind 1).  One row per change of state.
    """

    columns, order = ("ts_ms", "kind", "trade_id", "price", "side", "stop", "target", "end_ms"), ("ts_ms", "kind", "trade_id")
    memory = "state string, side string, entry double, stop double, target double, end_ms long"
    out = "symbol string, plan_id long, ts_ms long, state string, price double"

    def apply(self, key, memory, rows, watermark):
        plan, out = memory, []
        for t, kind, _, price, side, stop, target, end in rows:
            if kind == 0:
                plan = ("WAITING", side, float(price), float(stop), float(target), int(end))
                out.append((*key, int(t), "WAITING", float(price)))
                continue
            if plan is None:
                continue
            if t > plan[5]:
                out.append((*key, plan[5], "EXPIRED", None))
                plan = None
                continue
            sign = 1 if plan[1] == "BUY" else -1
            if plan[0] == "WAITING" and sign * (price - plan[2]) <= 0:
                plan = ("OPEN", *plan[1:])
                out.append((*key, int(t), "OPEN", float(price)))
            elif plan[0] == "OPEN" and (sign * (price - plan[3]) <= 0 or sign * (price - plan[4]) >= 0):
                out.append((*key, int(t), "STOPPED" if sign * (price - plan[3]) <= 0 else "TARGET", float(price)))
                plan = None
        if plan is not None and watermark > plan[5]:
            out.append((*key, plan[5], "EXPIRED", None))
            plan = None
        return plan, out

    def until(self, memory):
        return memory[5]


def run_machine(df: DataFrame, keys: list[str], machine: Machine) -> DataFrame:
    """``machine`` over a stream with a watermark on its time column (``with_event_time``), per ``keys``.

    Keeps state in RocksDB: the provider is set where the session still has its default.
    """
    spark = df.sparkSession
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = ", ".join(f"{c} {types[c]}" for c in machine.columns)
    return df.select("ts", *keys, *machine.columns).groupBy(*keys).transformWithStateInPandas(
        EventOrdered(rows, machine), outputStructType=machine.out, outputMode="Append", timeMode="EventTime")
