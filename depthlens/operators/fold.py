"""Ordered state that no window frame can express, still split into bounded blocks.

All of it works block by block (at most ``block`` rows of one key per task).  Greedy spacing leaps from block to
block by pointer doubling (``_starts_by_jumps``).  The other two folds go in three steps:

1. every block publishes how it maps an incoming state to an outgoing one - a short
   step function, because all that matters of the past is one time threshold;
2. these step functions are chained per key (a few rows per block);
3. every block is walked once with its known incoming state.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depthlens.operators.ordered import RN, Ordered, order_rows
from depthlens.session import write_table

_BLK = "__blk"


def _key_fields(o: Ordered):
    return [o.df.schema[k] for k in o.keys]


def _schema(fields, **extra):
    return T.StructType([*fields, *[T.StructField(n, t) for n, t in extra.items()]])


def _walk(df: DataFrame, groups, values, out_schema, start, step) -> DataFrame:
    """Walk the sorted rows of each group, batch by batch, with a state carried along.

    ``start(row values)`` gives a group's first state; ``step(value arrays, state)`` returns
    (picked positions, extra output arrays, state).  Memory is one Arrow batch.
    """
    keys = [f.name for f in out_schema][: len(out_schema) - 1 - len(values["out"])]
    columns = values["in"]

    def run(batches):
        current, state = None, None
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            ids = [pdf[g].to_numpy(dtype=object) for g in groups]
            arrays = {c: pdf[c].to_numpy() for c in columns}
            change = np.ones(n, bool)
            change[1:] = np.logical_or.reduce([i[1:] != i[:-1] for i in ids])
            cuts = [*np.flatnonzero(change), n]
            picked, extras = [], []
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(i[lo] for i in ids)
                part = {c: a[lo:hi] for c, a in arrays.items()}
                if key != current:
                    current, state = key, start({c: a[0] for c, a in part.items()})
                at, extra, state = step(part, state)
                picked.append(np.asarray(at, dtype=np.int64) + lo)
                extras.append(extra)
            at = np.concatenate(picked)
            out = {k: pdf[k].to_numpy(dtype=object)[at] for k in keys}
            out[RN] = pdf[RN].to_numpy()[at]
            for j, name in enumerate(values["out"]):
                out[name] = np.concatenate([np.asarray(e[j]) for e in extras])
            yield pd.DataFrame(out)

    laid = df.repartition(*groups).sortWithinPartitions(*groups, RN)
    return laid.mapInPandas(run, out_schema)


def _rle(upto, *values):
    """Drop steps whose outcome equals that of the next step."""
    frame = pd.DataFrame({"upto": upto, **{f"v{i}": v for i, v in enumerate(values)}})
    vals = frame.iloc[:, 1:]
    keep = (vals != vals.shift(-1)).any(axis=1)
    return frame[keep]


# ---- greedy spacing ----------------------------------------------------------------------
def greedy_starts(o: Ordered, coord: str, gap: float, name: str = "is_start") -> Ordered:
    """Mark rows chosen greedily so that chosen rows lie at least ``gap`` apart in ``coord``.

    The first row of a key is chosen, then always the first row whose ``coord`` (which must
    not decrease) reaches the last chosen value plus ``gap``.  With a time coordinate this is
    a cool-down or a bar anchored at its first event; with cumulative volume before the row
    it is a bar that closes when its volume reaches ``gap``.
    """
    if gap <= 0:
        raise ValueError("gap must be positive")
    o = o.kept()
    keys = list(o.keys)
    fields = _key_fields(o)
    rn_field = T.StructField(RN, T.LongType())
    slim = o.df.select(*keys, RN, F.col(coord).cast("double").alias("c"))
    starts_schema = T.StructType([*fields, rn_field])

    def step(part, last):
        c = part["c"]
        p = 0 if np.isnan(last) else int(np.searchsorted(c, last + gap))
        picks = []
        while p < len(c):
            picks.append(p)
            last = c[p]
            p = int(np.searchsorted(c, last + gap))
        return picks, (), last

    if not o.blocked:
        starts = _walk(slim, keys, {"in": ["c"], "out": []}, starts_schema,
                       lambda row: float("nan"), step)
    else:
        starts = _starts_by_jumps(o, slim, gap, starts_schema)
    marked = o.df.join(starts.withColumn(name, F.lit(True)), [*keys, RN], "left")
    return o.with_df(marked.withColumn(name, F.coalesce(name, F.lit(False))))


def _next_rows(o: Ordered, slim: DataFrame, gap: float) -> DataFrame:
    """``slim`` (keys, rn, c) with ``next``: the first row whose ``c`` reaches this row's plus ``gap``.

    Rows and targets in one ordering; as many rows lie before a target as its row's number says.
    """
    keys = list(o.keys)
    targets = slim.select(*keys, RN, (F.col("c") + gap).alias("v"), F.lit(0).alias("row"))
    both = targets.unionByName(slim.select(*keys, RN, F.col("c").alias("v"), F.lit(1).alias("row")))
    both = order_rows(both.withColumnRenamed(RN, "own"), keys, ["v", "row", "own"], block=o.block)
    found = both.running({"next": ("sum", F.col("row").cast("bigint"))}).df.filter("row = 0")
    later = F.greatest(F.coalesce("next", F.lit(0)), F.col("own") + 1)
    return slim.join(found.select(*keys, F.col("own").alias(RN), later.alias("next")), [*keys, RN])


def _starts_by_jumps(o: Ordered, slim: DataFrame, gap: float, starts_schema) -> DataFrame:
    """The chosen rows of keys that span many blocks.

    Every row knows the next one chosen after it (``_next_rows``).  Inside a block these steps are followed to its end,
    so a row gets the first row chosen beyond its block.  These leaps are joined with themselves: tables of 1, 2, 4, ...
    leaps; starting with the key's first row, round k adds to the rows reached those 2**k leaps further on.  A block is entered at
    most once, and is then walked from there.  No task sees more than one block of a key.
    """
    keys = list(o.keys)
    fields = _key_fields(o)
    block = o.block
    blk = lambda c: F.floor(F.col(c) / block).cast("bigint")
    steps = write_table(_next_rows(o, slim, gap), "steps")

    def leaps(pdf):
        pdf = pdf.sort_values(RN)
        at, to = pdf[RN].to_numpy(), pdf["next"].to_numpy()
        end = (at[0] // block + 1) * block
        out = to.copy()
        for i in range(len(at) - 1, -1, -1):  # rows of a block are neighbours: the next row's place is its distance
            if to[i] < end and to[i] - at[0] < len(at):
                out[i] = out[to[i] - at[0]]
        return pdf[keys].assign(at=at, to=out)

    b = T.LongType()
    leap = steps.withColumn(_BLK, blk(RN)).groupBy(*keys, _BLK).applyInPandas(leaps, _schema(fields, at=b, to=b))
    leap = write_table(leap, "leaps")
    # only rows that some leap ends at can be entered, besides the first
    ends = leap.select(*keys, F.col("to").alias("at")).distinct()
    nodes = write_table(leap.join(ends, [*keys, "at"], "left_semi").unionByName(leap.filter("at = 0")).distinct(), "jumps")
    # the last leap of a key ends behind its last row
    jump = nodes.join(nodes.select(*keys, F.col("at").alias("to")), [*keys, "to"], "left_semi")
    reached = leap.filter("at = 0").select(*keys, "at")
    hops, most = 1, -(-o.max_rows // block)
    while hops < most:
        on = jump.select(*keys, F.col("at").alias("mid"), F.col("to").alias("far"))
        ahead = reached.join(jump, [*keys, "at"]).select(*keys, F.col("to").alias("at"))
        reached = write_table(reached.unionByName(ahead), "reached")
        jump = write_table(jump.withColumnRenamed("to", "mid").join(on, [*keys, "mid"]).select(*keys, "at", F.col("far").alias("to")), "jumps")
        hops *= 2
    entries = reached.select(*keys, blk("at").alias(_BLK), F.col("at").alias("entry"))
    inside = steps.withColumn(_BLK, blk(RN)).join(entries, [*keys, _BLK])

    def step(part, at):
        base, to, n = part[RN][0], part["next"], len(part[RN])
        picks, p = [], at - base
        while p < n:
            picks.append(p)
            p = to[p] - base
        return picks, (), p + base

    return _walk(inside, [*keys, _BLK], {"in": [RN, "next", "entry"], "out": []}, starts_schema, lambda row: int(row["entry"]), step)


# ---- overlapping sequence numbers -----------------------------------------------------------
def _merge_steps(firsts, lasts):
    """Outgoing number as a step function of the incoming one: pieces (low, high, value) cover all numbers.

    A piece without a value passes the number on.

    A row maps every current number in [first - 1, last - 1] to ``last``.  The function never
    decreases, so pieces lie in the order of their values, and what a row maps is one stretch of
    neighbouring pieces (found by bisection) and of the numbers between them: it becomes one
    piece.  A row makes one piece at most, so all rows together remove no more than they make.
    """
    lows, highs, values = [], [], []
    for first, last in zip(firsts, lasts):
        a, b = first - 1, last - 1
        if b < a:
            continue
        i, j = bisect_left(values, a), bisect_right(values, b)
        # the first piece beyond the row's reach also bounds the numbers that pass on up to here
        high = lows[j] - 1 if j < len(lows) and lows[j] <= b else max(b, highs[j - 1] if i < j else b)
        low = min(a, lows[i]) if i < j else a
        if low <= high:
            lows[i:j], highs[i:j], values[i:j] = [low], [high], [last]
    pieces, at = [], -np.inf
    for low, high, value in zip(lows, highs, values):
        if at < low:
            pieces.append((at, low - 1, None))
        pieces.append((low, high, value))
        at = high + 1
    return [*pieces, (at, np.inf, None)]


def _chain_steps(firsts, lasts, top):
    """Incoming numbers up to ``top`` that some row continues exactly, with the outcome.

    From the last row to the first: a number that a row continues ends where the row's own number does.
    """
    outcome = {}
    for first, last in zip(reversed(list(firsts)), reversed(list(lasts))):
        outcome[first - 1] = outcome.get(last, last)
    points = [(start, start, out) for start, out in sorted(outcome.items()) if start <= top]
    return points or [(-np.inf, -np.inf, None)]


def sequence_walk(
    o: Ordered, first: str, last: str, known: str, strict: bool = False
) -> DataFrame:
    """Add ``status`` of sequence ranges against a known number that starts at ``known``.

    duplicate: ends at or before the known number; gap: starts beyond the next one;
    otherwise ok, and the known number becomes the end of the range.  With ``strict`` a range
    is ok only if it starts at the next number; anything else is a gap.
    """
    o = o.kept()
    keys = list(o.keys)
    fields = _key_fields(o)
    d, b = T.DoubleType(), T.LongType()
    slim = o.df.select(*keys, RN, F.col(first).cast("double").alias("f"),
                       F.col(last).cast("double").alias("l"),
                       F.col(known).cast("double").alias("m"))
    out_schema = _schema(fields, **{RN: b, "__code": T.IntegerType()})

    def step(part, number):
        code = np.zeros(len(part["f"]), dtype=np.int32)
        for i, (f, l) in enumerate(zip(part["f"], part["l"])):
            if l <= number and not strict:
                code[i] = 1
            elif f > number + 1 or (strict and f != number + 1):
                code[i] = 2
            else:
                number = l
        return np.arange(len(code)), (code,), number

    if not o.blocked:
        coded = _walk(slim, keys, {"in": ["f", "l", "m"], "out": ["__code"]}, out_schema,
                      lambda row: row["m"], step)
    else:
        # no number beyond ``top``, the largest one seen before, can enter a block
        slim = replace(o, df=slim).running(
            {"top": ("max", F.greatest("m", "l"))}, inclusive=False
        ).col("top", F.coalesce("top", "m")).df
        slim = slim.withColumn(_BLK, F.floor(F.col(RN) / o.block).cast("bigint"))

        def summary(pdf):
            pdf = pdf.sort_values(RN)
            top = float(pdf["top"].iloc[0])
            rows = pdf["f"].tolist(), pdf["l"].tolist()
            steps = _chain_steps(*rows, top) if strict else _merge_steps(*rows)
            # of those that no number can enter one is kept, so that the block has a row
            steps = [p for p in steps if p[0] <= top] or steps[:1]
            steps = pd.DataFrame(steps, columns=["low", "high", "out"])
            steps["out"] = steps["out"].astype(float)
            for k in [*keys, _BLK, "m"]:
                steps[k] = pdf[k].iloc[0]
            return steps[[*keys, _BLK, "m", "low", "high", "out"]]

        def chain(pdf):
            number, rows = float(pdf["m"].iloc[0]), []
            for blk, part in pdf.sort_values([_BLK, "low"]).groupby(_BLK, sort=True):
                rows.append((blk, number))
                at = int(np.searchsorted(part["low"].to_numpy(), number, side="right")) - 1
                if at >= 0 and number <= part["high"].to_numpy()[at]:
                    out = part["out"].to_numpy()[at]
                    number = number if np.isnan(out) else float(out)
            res = pd.DataFrame(rows, columns=[_BLK, "carry"])
            for k in keys:
                res[k] = pdf[k].iloc[0]
            return res[[*keys, _BLK, "carry"]]

        steps = slim.groupBy(*keys, _BLK).applyInPandas(summary, _schema(
            fields, **{_BLK: b, "m": d, "low": d, "high": d, "out": d}))
        carry = steps.groupBy(*keys).applyInPandas(
            chain, _schema(fields, **{_BLK: b, "carry": d}))
        coded = _walk(slim.join(carry, [*keys, _BLK]), [*keys, _BLK],
                      {"in": ["f", "l", "carry"], "out": ["__code"]}, out_schema,
                      lambda row: row["carry"], step)
    status = F.when(F.col("__code") == 1, "duplicate").when(F.col("__code") == 2, "gap").otherwise("ok")
    return o.df.drop("status").join(
        coded.select(*keys, RN, status.alias("status")), [*keys, RN])


# ---- decision state machine ------------------------------------------------------------------
IDLE, ARMED, FIRED, COOLDOWN = 0, 1, 2, 3


class _Ticks:
    """One block of (ts, score) rows with jump tables between state changes."""

    def __init__(self, ts, score, threshold, dwell, cooldown):
        self.ts, self.n = ts, len(ts)
        self.dwell, self.cooldown = dwell, cooldown
        self.hot = np.abs(score) >= threshold
        self.buy = score > 0
        idx = np.arange(self.n)
        self.next_hot = np.minimum.accumulate(np.where(self.hot, idx, self.n)[::-1])[::-1]
        breaks = np.ones(self.n, bool)
        breaks[1:] = ~self.hot[1:] | ~self.hot[:-1] | (self.buy[1:] != self.buy[:-1])
        nxt = np.where(breaks, idx, self.n)
        nxt = np.append(np.minimum.accumulate(nxt[::-1])[::-1], self.n)
        self.run_end = nxt[1:]

    def _at(self, t):
        return int(np.searchsorted(self.ts, t))

    # every step returns (fired row or None, next idle row or None, final state or None)
    def cool(self, since, first):
        j = max(self._at(since + self.cooldown), first)
        return (None, j + 1, None) if j < self.n else (None, None, (COOLDOWN, 0, since))

    def fire(self, f):
        if f == self.n - 1:
            return f, None, (FIRED, 0, 0.0)
        _, nxt, final = self.cool(self.ts[f + 1], f + 2)
        return f, nxt, final

    def armed(self, side, since, first, run_end):
        f = max(self._at(since + self.dwell), first)
        if f < run_end:
            return self.fire(f)
        if run_end >= self.n:
            return None, None, (ARMED, side, since)
        return None, run_end + 1, None

    def idle(self, p):
        q = int(self.next_hot[p]) if p < self.n else self.n
        if q >= self.n:
            return None, None, (IDLE, 0, 0.0)
        return self.armed(int(self.buy[q]), self.ts[q], q + 1, int(self.run_end[q]))

    def enter(self, state):
        kind, side, since = state
        if kind == IDLE:
            return self.idle(0)
        if kind == FIRED:
            return self.cool(self.ts[0], 1)
        if kind == COOLDOWN:
            return self.cool(since, 0)
        if not self.hot[0] or int(self.buy[0]) != side:
            return None, 1, None
        return self.armed(side, since, 0, int(self.run_end[0]))

    def walk(self, state):
        fired = []
        step = self.enter(state)
        while True:
            if step[0] is not None:
                fired.append(step[0])
            if step[1] is None:
                return fired, step[2]
            step = self.idle(step[1])

    def idle_outcomes(self):
        """Final state when IDLE before row p, for p = 0..n."""
        out = [(IDLE, 0, 0.0)] * (self.n + 1)
        for p in range(self.n - 1, -1, -1):
            _, nxt, final = self.idle(p)
            out[p] = final if nxt is None else out[min(nxt, self.n)]
        return out


def decision_fires(
    o: Ordered,
    score: str = "score",
    ts: str = "ts_ms",
    threshold: float = 0.35,
    dwell_ms: float = 500,
    cooldown_ms: float = 15_000,
):
    """Rows at which the IDLE/ARMED/FIRED/COOLDOWN machine fires, with the side.

    Returns (keys, rn, fired_side).  A score whose size reaches ``threshold`` arms the
    machine; it fires when the same side has stayed above the threshold for ``dwell_ms``.  The tick
    after a fire starts the cool-down; the tick that ends it only returns to IDLE.
    """
    o = o.kept()
    keys = list(o.keys)
    fields = _key_fields(o)
    d, b, i4 = T.DoubleType(), T.LongType(), T.IntegerType()

    def named(df):
        side = F.when(F.col("buy"), "BUY").otherwise("SELL")
        return df.select(*keys, RN, side.alias("fired_side"))

    slim = o.df.select(
        *keys, RN, F.col(ts).cast("double").alias("t"), F.col(score).cast("double").alias("s")
    )
    out_schema = _schema(fields, **{RN: b, "buy": T.BooleanType()})

    def step(part, state):
        block = _Ticks(part["t"], part["s"], threshold, dwell_ms, cooldown_ms)
        rows, state = block.walk(state)
        rows = np.array(rows, dtype=np.int64)
        return rows, (block.buy[rows],), state

    if not o.blocked:
        return named(_walk(slim, keys, {"in": ["t", "s"], "out": ["buy"]}, out_schema,
                           lambda row: (IDLE, 0, 0.0), step))

    slim = slim.withColumn(_BLK, F.floor(F.col(RN) / o.block).cast("bigint"))

    def summary(pdf):
        pdf = pdf.sort_values(RN)
        block = _Ticks(
            pdf["t"].to_numpy(), pdf["s"].to_numpy(), threshold, dwell_ms, cooldown_ms)
        after = block.idle_outcomes()
        t, n = block.ts, block.n

        def final(step):
            return step[2] if step[1] is None else after[min(step[1], n)]

        rows = [(IDLE, 0, np.inf, *after[0]), (FIRED, 0, np.inf, *final(block.cool(t[0], 1)))]
        reach = min(n, int(np.searchsorted(t, t[0] + cooldown_ms)) + 1)
        rows += [(COOLDOWN, 0, t[j], *after[j + 1]) for j in range(reach)]
        for side in (0, 1):
            if block.hot[0] and int(block.buy[0]) == side:
                end = int(block.run_end[0])
                reach = min(end, int(np.searchsorted(t, t[0] + dwell_ms)) + 1)
                rows += [(ARMED, side, t[f], *final(block.fire(f))) for f in range(reach)]
                # the run ends (or the block does) before the dwell is over
                rest = after[min(end + 1, n)] if end < n else (-1, 0, 0.0)
            else:
                rest = after[1]
            rows.append((ARMED, side, np.inf, *rest))
        steps = pd.DataFrame(
            rows, columns=["kind", "side", "upto", "out_kind", "out_side", "out_ts"])
        outcome = steps[["kind", "side", "out_kind", "out_side", "out_ts"]]
        steps = steps[(outcome != outcome.shift(-1)).any(axis=1)].copy()
        for k in [*keys, _BLK]:
            steps[k] = pdf[k].iloc[0]
        return steps[[*keys, _BLK, "kind", "side", "upto", "out_kind", "out_side", "out_ts"]]

    def chain(pdf):
        state, rows = (IDLE, 0, 0.0), []
        for blk, part in pdf.groupby(_BLK, sort=True):
            rows.append((blk, *state))
            kind, side, since = state
            part = part[(part["kind"] == kind) & (part["side"] == (side if kind == ARMED else 0))]
            part = part.sort_values("upto")
            wait = {ARMED: dwell_ms, COOLDOWN: cooldown_ms}.get(kind, 0.0)
            at = int(np.searchsorted(part["upto"].to_numpy(), since + wait))
            if at < len(part):
                row = part.iloc[at]
                if row["out_kind"] >= 0:
                    state = (int(row["out_kind"]), int(row["out_side"]), float(row["out_ts"]))
        res = pd.DataFrame(rows, columns=[_BLK, "kind", "side", "since"])
        for k in keys:
            res[k] = pdf[k].iloc[0]
        return res[[*keys, _BLK, "kind", "side", "since"]]

    steps = slim.groupBy(*keys, _BLK).applyInPandas(summary, _schema(fields, **{
        _BLK: b, "kind": i4, "side": i4, "upto": d, "out_kind": i4, "out_side": i4, "out_ts": d}))
    carry = steps.groupBy(*keys).applyInPandas(
        chain, _schema(fields, **{_BLK: b, "kind": i4, "side": i4, "since": d}))
    return named(_walk(
        slim.join(carry, [*keys, _BLK]), [*keys, _BLK],
        {"in": ["t", "s", "kind", "side", "since"], "out": ["buy"]}, out_schema,
        lambda row: (int(row["kind"]), int(row["side"]), float(row["since"])), step))
