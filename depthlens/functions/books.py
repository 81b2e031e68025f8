"""Expressions over book sides: arrays of (price, qty) sorted best first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def level(side: Column, i: int) -> Column:
    return F.get(side, F.lit(i))


def best_bid(bids: str | Column = "bids") -> Column:
    return level(_c(bids), 0)["price"]


def best_ask(asks: str | Column = "asks") -> Column:
    return level(_c(asks), 0)["price"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mid() -> Column:
    """NULL when a side is empty."""
    return (best_bid() + best_ask()) / 2.0


def spread() -> Column:
    return best_ask() - best_bid()


def spread_bps() -> Column:
    return spread() / F.nullif(mid(), F.lit(0.0)) * 10_000.0


def top(side: Column, n) -> Column:
    return F.slice(side, 1, n)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def notional(side: Column) -> Column:
    return F.aggregate(side, F.lit(0.0), lambda a, l: a + l["price"] * l["qty"])


def quantities(side: Column) -> Column:
    return F.transform(side, lambda l: l["qty"])


def balance(bid: Column, ask: Column) -> Column:
    """(bid - ask) / (bid + ask), 0 when both are 0."""
    return F.coalesce((bid - ask) / F.nullif(bid + ask, F.lit(0.0)), F.lit(0.0))


def depth_imbalance(n: int) -> Column:
    """Notional imbalance of the first ``n`` levels (fewer if a side is shorter)."""
    k = F.least(F.lit(n), F.size("bids"), F.size("asks"))
    return balance(notional(top(F.col("bids"), k)), notional(top(F.col("asks"), k)))


def weighted_imbalance(levels: int = 10) -> Column:
    """Imbalance with weight exp(-2 * distance / spread); levels beyond mid are skipped."""
    m, s = mid(), spread()

    def weighted(side, sign):
        def term(a, l):
            dist = (m - l["price"]) * sign / s
            return a + F.when(dist >= 0, l["qty"] * F.exp(dist * -2.0)).otherwise(0.0)
        return F.aggregate(top(F.col(side), levels), F.lit(0.0), term)

    return balance(weighted("bids", 1.0), weighted("asks", -1.0))


def microprice(n: int = 5) -> Column:
    """Size-weighted mean price of the first ``n`` levels of both sides, else mid."""
    k = F.least(F.lit(n), F.size("bids"), F.size("asks"))
    b, a = top(F.col("bids"), k), top(F.col("asks"), k)
    qty = total(quantities(b)) + total(quantities(a))
    return F.coalesce((notional(b) + notional(a)) / F.nullif(qty, F.lit(0.0)), mid())


def near_depth(side: Column, limit: Column, is_bid: bool) -> Column:
    """Notional of levels at ``limit`` or better."""
    near = F.filter(side, (lambda l: l["price"] >= limit) if is_bid
                    else (lambda l: l["price"] <= limit))
    return notional(near)


def gaps(side: Column) -> Column:
    """Price distances of neighbouring levels."""
    n = F.size(side)
    return F.when(n >= 2, F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.abs(F.get(side, i)["price"] - F.get(side, i - 1)["price"]),
    )).otherwise(F.array().cast("array<double>"))


def churn(side: str, previous: str) -> Column:
    """Sum of |quantity change| * price over levels that kept rank and price."""
    same = F.zip_with(F.col(side), F.col(previous), lambda a, b: F.when(
        F.abs(a["price"] - b["price"]) < 0.001, F.abs(a["qty"] - b["qty"]) * a["price"]
    ).otherwise(0.0))
    return total(same)
