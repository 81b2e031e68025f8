"""Column expressions: statistics, price grids, costs, signal age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# ---- statistics -----------------------------------------------------------------------
def clamp(x: Column, low: float, high: float) -> Column:
    # least and greatest pass over NULL, which must stay NULL here
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def z_score(value: Column, mean: Column, sigma: Column) -> Column:
    return F.when(sigma == 0, 0.0).otherwise((value - mean) / F.nullif(sigma, F.lit(0.0)))


def ema_step(prev: Column, value: Column, alpha: float) -> Column:
    return value * alpha + prev * (1.0 - alpha)


def array_mean(xs: Column) -> Column:
    """0 for an empty array."""
    total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(xs) > 0, total / F.nullif(F.size(xs), F.lit(0))).otherwise(0.0)


def array_median(xs: Column) -> Column:
    """Median of a short array (mean of the middle two); 0 when empty."""
    s, n = F.array_sort(xs), F.size(xs)
    lower = F.get(s, F.floor((n - 1) / 2).cast("int"))
    upper = F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lower + upper) / 2.0).otherwise(0.0)


def array_mad(xs: Column) -> Column:
    """Median absolute deviation of a short array."""
    return array_median(F.transform(xs, lambda x: F.abs(x - array_median(xs))))


def array_std(xs: Column, sample: bool = True) -> Column:
    n = F.size(xs)
    mean = array_mean(xs)
    ss = F.aggregate(F.transform(xs, lambda x: (x - mean) * (x - mean)), F.lit(0.0),
                     lambda a, x: a + x)
    return F.when(n >= 2, F.sqrt(ss / F.nullif(n - (1 if sample else 0), F.lit(0)))).otherwise(0.0)


def robust_std(xs: Column) -> Column:
    """MAD scaled to a normal distribution; 0 below two values."""
    return F.when(F.size(xs) >= 2, array_mad(xs) * 1.4826).otherwise(0.0)


def money_sum(x: Column) -> Column:
    """Sum of amounts to ten decimals that does not depend on the order of the rows."""
    return F.sum(x.cast("decimal(28,10)")).cast("double")


# ---- price and quantity grids -----------------------------------------------------------
def round_half_up(x: Column) -> Column:
    """Nearest integer, halves toward plus infinity."""
    return F.floor(x + 0.5)


def price_to_ticks(price: Column, tick: Column) -> Column:
    return round_half_up(price / tick)


def ticks_to_price(ticks: Column, tick: Column) -> Column:
    return ticks * tick


def round_price(price: Column, tick: Column) -> Column:
    return ticks_to_price(price_to_ticks(price, tick), tick)


def floor_qty(qty: Column, lot: Column) -> Column:
    # the tiny offset keeps a whole number of lots from being floored one lot down
    return F.floor(qty / lot + 1e-9) * lot


def notional(price: Column, qty: Column, multiplier: Column | float = 1.0) -> Column:
    return price * qty * multiplier


def enforce_min_notional(price: Column, qty: Column, step: Column, minimum: Column) -> Column:
    """Quantity on the step grid, raised so that price * qty reaches ``minimum``."""
    stepped = floor_qty(qty, step)
    raised = F.ceil(minimum / price / step - 1e-9) * step
    return F.when(price * stepped < minimum, raised).otherwise(stepped)


def format_fixed(x: Column, decimals: int = 2) -> Column:
    return F.format_string(f"%.{decimals}f", x)


def format_pct(x: Column) -> Column:
    return F.format_string("%.2f%%", x * 100.0)


# ---- costs ------------------------------------------------------------------------------
MAKER_FEE = 0.0002
TAKER_FEE = 0.0005


def fee(size: Column, price: Column, maker: bool) -> Column:
    return size * price * (MAKER_FEE if maker else TAKER_FEE)


def slippage(price: Column, side: Column, bps: float) -> Column:
    """Signed price concession: positive for a long, negative for a short."""
    amount = price * (bps / 10_000.0)
    return F.when(side == "long", amount).otherwise(-amount)


def total_cost(entry_fee: Column, exit_fee: Column, slip: Column) -> Column:
    return entry_fee + exit_fee + F.abs(slip)


def r_multiple(pnl: Column, risk: Column) -> Column:
    return F.when(risk == 0, 0.0).otherwise(pnl / F.nullif(risk, F.lit(0.0)))


def breakeven_price(entry: Column, total_fee: Column, size: Column, side: Column) -> Column:
    per_unit = F.coalesce(total_fee / F.nullif(size, F.lit(0.0)), F.lit(0.0))
    return F.when(side == "long", entry + per_unit).otherwise(entry - per_unit)


# ---- signals ----------------------------------------------------------------------------
# Confidence decay per millisecond and signal type.
DECAY_PER_MS = {
    "WALL": 0.0002, "BID_WALL": 0.0002, "ASK_WALL": 0.0002,
    "SPOOFING": 0.002,
    "CASCADE_SQUEEZE": 0.003, "CASCADE_CHAIN": 0.003, "CASCADE_EXHAUSTED": 0.003,
    "CVD_BULL_DIV": 0.003, "CVD_BEAR_DIV": 0.003,
    "VOID_ASK": 0.0008, "VOID_BID": 0.0008,
    "ICEBERG": 0.0003, "ICEBERG_FORMING": 0.0003, "ICEBERG_CONFIRMED": 0.0003,
}
DEFAULT_DECAY_PER_MS = 0.0005


def decay_rate(signal_type: Column) -> Column:
    rate = F.lit(DEFAULT_DECAY_PER_MS)
    by_rate: dict[float, list[str]] = {}
    for name, r in DECAY_PER_MS.items():
        by_rate.setdefault(r, []).append(name)
    for r, names in by_rate.items():
        rate = F.when(signal_type.isin(names), r).otherwise(rate)
    return rate


def decayed(confidence: Column, signal_type: Column, age_ms: Column) -> Column:
    return confidence * F.exp(-decay_rate(signal_type) * age_ms)


def has_hard_veto(filters: Column) -> Column:
    return F.exists(filters, lambda f: (f["mode"] == "hard-veto") & ~f["pass"])


def soft_penalty_sum(filters: Column) -> Column:
    failed = F.filter(filters, lambda f: (f["mode"] == "soft-penalty") & ~f["pass"])
    return F.aggregate(failed, F.lit(0.0), lambda a, f: a + f["adjustment"])


def is_expired(signal_ts: Column, now: Column, ttl_ms: int = 60_000) -> Column:
    return now - signal_ts > ttl_ms
