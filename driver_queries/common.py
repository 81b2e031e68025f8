"""Shared pieces of the check SQL and small helpers for the query functions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

HOUR = 3_600_000
DAY = 24 * HOUR

TRADES = """trades AS (
  SELECT 'U' || CAST(user_id % 10 AS VARCHAR) AS symbol, epoch_us(ts) // 1000 AS ts_ms, event_id AS trade_id,
    CAST(1000 + floor(value * 10) AS DOUBLE) AS price, CAST(1 + event_id % 17 AS DOUBLE) AS qty,
    CASE WHEN event_type IN ('purchase','signup','view') THEN 'buy' ELSE 'sell' END AS side, event_type
  FROM events)"""

ORDERED = TRADES + """, tr AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id) - 1 AS rn,
    price * qty AS notional, CASE WHEN side = 'buy' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sgn
  FROM trades)"""

LIQS = """liqs AS (
  SELECT symbol, ts_ms, trade_id, price, qty, price * qty AS notional,
    CASE WHEN trade_id % 2 = 0 THEN 'long' ELSE 'short' END AS side
  FROM trades WHERE event_type = 'error')"""


def candles(interval_ms: int = 6 * HOUR) -> str:
    return TRADES + f""", candles AS (
  SELECT symbol, ts_ms // {interval_ms} * {interval_ms} AS ts,
    arg_min(price, trade_id) AS o, max(price) AS h, min(price) AS l, arg_max(price, trade_id) AS c,
    sum(qty) AS v
  FROM trades GROUP BY ALL), cd AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM candles)"""


BOOKS = TRADES + f""", mids AS (
  SELECT symbol, ts_ms // {DAY} AS day, floor(median(price)) AS m FROM trades GROUP BY ALL),
lv AS (
  SELECT t.symbol, (t.ts_ms // {DAY} + 1) * {DAY} AS ts_ms, t.ts_ms // {DAY} AS seq,
    CASE WHEN price <= m THEN 'bid' ELSE 'ask' END AS side,
    floor(price / 5) * 5 + CASE WHEN price <= m THEN 0 ELSE 5 END AS price, sum(qty) AS qty
  FROM trades t JOIN mids ON t.symbol = mids.symbol AND t.ts_ms // {DAY} = mids.day
  GROUP BY ALL),
levels AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, seq, side
    ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) - 1 AS rank FROM lv),
tops AS (
  SELECT symbol, ts_ms, seq, max(price) FILTER (side = 'bid') AS best_bid,
    min(price) FILTER (side = 'ask') AS best_ask, count(*) FILTER (side = 'bid') AS nb,
    count(*) FILTER (side = 'ask') AS na
  FROM levels GROUP BY ALL),
bk AS (
  SELECT *, (best_bid + best_ask) / 2 AS mid, best_ask - best_bid AS spread,
    row_number() OVER (PARTITION BY symbol ORDER BY seq) - 1 AS rn FROM tops)"""


def recursive(base: str, source: str, steps: dict[str, tuple[str, str]], final: str,
              part: str = "symbol") -> str:
    """Recurrence over ``source`` (needs ``rn``): name -> (first value, next value).

    In the next value ``p`` is the previous row's result and ``x`` the current source row.
    """
    first = ", ".join(f"CAST({i} AS DOUBLE) AS {n}" for n, (i, _) in steps.items())
    nxt = ", ".join(f"CAST({s} AS DOUBLE) AS {n}" for n, (_, s) in steps.items())
    return f"""WITH RECURSIVE {base}, rec AS (
  SELECT x.{part}, x.rn, {first} FROM {source} x WHERE x.rn = 0
  UNION ALL
  SELECT x.{part}, x.rn, {nxt} FROM rec p JOIN {source} x ON x.{part} = p.{part} AND x.rn = p.rn + 1)
{final}"""


def exact_rounding(sql: str) -> str:
    """Spell out ``round(x, 6)`` as floor arithmetic, which both engines do alike."""
    low = re.compile(r"\bround\(")
    at = 0
    while m := low.search(sql, at):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner = sql[m.end():i - 1].rstrip()
        if not re.search(r",\s*6$", inner):
            at = m.end()
            continue
        body = inner[:inner.rindex(",")]
        sql = f"{sql[:m.start()]}(floor(({body})*1e6::DOUBLE+0.5::DOUBLE)/1e6::DOUBLE){sql[i:]}"
        at = m.start()
    return sql


def rounded(df: DataFrame, plain: str, doubles: str = "") -> DataFrame:
    """Select columns; the doubles are rounded to six digits."""
    return df.selectExpr(*plain.split(), *[f"floor({c} * 1e6D + 0.5D) / 1e6D as {c}" for c in doubles.split()])


def rsql(doubles: str, prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{c}, 6) AS {c}" for c in doubles.split())
