"""Raw exchange messages -> typed rows.  Works on batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TRADES = "array<struct<px:string,sz:string,side:string,ts:string,tradeId:string,instId:string>>"
_BOOKS = "array<struct<bids:array<array<string>>,asks:array<array<string>>,ts:string>>"


def _num(c: Column) -> Column:
    return c.try_cast("double")


def parse_candle_rows(raw: DataFrame, value: str = "value") -> DataFrame:
    """``[ts, o, h, l, c, v]`` arrays (numbers or strings) to typed candle columns."""
    a = F.from_json(value, "array<string>")
    names = ("o", "h", "l", "c", "v")
    return raw.withColumn("__a", a).withColumns({
        "ts": F.get("__a", F.lit(0)).try_cast("bigint"),
        **{n: _num(F.get("__a", F.lit(i + 1))) for i, n in enumerate(names)},
    }).drop("__a", value)


def parse_trades(raw: DataFrame, value: str = "value") -> DataFrame:
    """``{px, sz, side, ts}`` objects to trades; any side but buy is a sell."""
    t = F.from_json(value, "struct<px:string,sz:string,side:string,ts:string>")
    return raw.withColumn("__t", t).withColumns({
        "ts_ms": F.col("__t.ts").try_cast("bigint"), "price": _num(F.col("__t.px")), "qty": _num(F.col("__t.sz")),
        "side": F.when(F.col("__t.side") == "buy", "buy").otherwise("sell"),
    }).drop("__t", value)


def _channel(raw: DataFrame, value: str, name: str, payload: str) -> DataFrame:
    """Messages of one channel.  Acknowledgements and text that is no JSON are dropped."""
    ack = F.col(value).contains('"event":"subscribe"') | F.col(value).contains('"event":"error"')
    head = F.from_json(value, f"struct<arg:struct<channel:string,instId:string>,data:{payload}>")
    return raw.filter(~ack).withColumn("__m", head).filter(F.col("__m.arg.channel") == name)


def feed_trades(raw: DataFrame, value: str = "value") -> DataFrame:
    """All trades of the ``trades`` channel messages."""
    rows = _channel(raw, value, "trades", _TRADES).select("*", F.explode("__m.data").alias("__t"))
    return rows.select(
        *[c for c in raw.columns if c != value], F.col("__m.arg.instId").alias("symbol"),
        F.col("__t.ts").try_cast("bigint").alias("ts_ms"), F.col("__t.tradeId").try_cast("bigint").alias("trade_id"),
        _num(F.col("__t.px")).alias("price"), _num(F.col("__t.sz")).alias("qty"),
        F.when(F.col("__t.side") == "buy", "buy").otherwise("sell").alias("side"))


def feed_books(raw: DataFrame, arrival: str, value: str = "value") -> DataFrame:
    """The first book of each ``books5`` message; ``arrival`` becomes its sequence number."""
    rows = _channel(raw, value, "books5", _BOOKS).withColumn("__b", F.get("__m.data", F.lit(0))).filter("__b is not null")

    def side(c):
        return F.transform(F.col(f"__b.{c}"), lambda l: F.struct(
            _num(F.get(l, F.lit(0))).alias("price"), _num(F.get(l, F.lit(1))).alias("qty")))
    return rows.select(F.col("__m.arg.instId").alias("symbol"), F.col("__b.ts").try_cast("bigint").alias("ts_ms"),
                       F.col(arrival).alias("seq"), side("bids").alias("bids"), side("asks").alias("asks"))


def checksum(payload: Column) -> Column:
    """CRC-32 as eight lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.crc32(payload.cast("binary"))), 8, "0"))


def verify_checksums(raw: DataFrame, payload: str, expected: str) -> DataFrame:
    return raw.withColumn("checksum_ok", F.coalesce(checksum(F.col(payload)) == F.lower(expected), F.lit(False)))


# ---- market events by kind --------------------------------------------------------------------
KINDS = ("trade", "bookSnapshot", "bookDelta", "markPrice", "liquidation")


def events_of(events: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind of a wide event table (see schemas.MARKET_EVENT)."""
    if kind not in KINDS:
        raise ValueError(f"unknown event kind {kind!r}")
    return events.filter(F.col("kind") == kind)
