import random

import pytest

from depthlens.operators.fold import _merge_steps
from depthlens.operators.quality import (
    candle_quality, fill_gaps, sequence_status, sort_and_deduplicate, strict_delta_chain)
from depthlens.session import BLOCK_ROWS_CONF

CANDLES = "symbol string, seq long, ts long, o double, h double, l double, c double, v double"


def _candle(seq, ts, o=100.0, h=105.0, l=98.0, c=103.0, v=500.0):
    return ("X", seq, ts, o, h, l, c, v)


def test_fill_gaps_and_deduplicate(spark):
    df = spark.createDataFrame([_candle(i, t) for i, t in enumerate([0, 60_000, 180_000])], CANDLES)
    rows = {r["ts"]: r for r in fill_gaps(df, 60_000).collect()}
    assert sorted(rows) == [0, 60_000, 120_000, 180_000]
    assert rows[120_000]["v"] == 0 and rows[120_000]["filled"] and rows[180_000]["v"] == 500
    df = spark.createDataFrame(
        [_candle(i, t, c=100.0 + i) for i, t in enumerate([3000, 1000, 1000, 2000])], CANDLES)
    assert sorted((r["ts"], r["c"]) for r in sort_and_deduplicate(df).collect()) == [
        (1000, 101.0), (2000, 103.0), (3000, 100.0)]


def test_quality_report(spark):
    clean = [_candle(i, 1000 + 60_000 * i) for i in range(100)]
    r = candle_quality(spark.createDataFrame(clean, CANDLES)).first()
    assert (r["total_rows"], r["score"]) == (100, 100)
    bad = [_candle(0, 1000), _candle(1, 61_000, o=-1.0), _candle(2, 500_000), _candle(3, 500_000),
           _candle(4, 560_000, h=101.0), _candle(5, 620_000, c=150.0, h=160.0)]
    r = candle_quality(spark.createDataFrame(bad, CANDLES)).first()
    # after the duplicated stamp any step is a gap
    assert (r["invalid_rows"], r["gaps"], r["duplicates"], r["outliers"]) == (2, 2, 1, 1)


@pytest.mark.parametrize("block", ["6", "40", "65536"])
def test_sequence_checks(spark, block):
    spark.conf.set(BLOCK_ROWS_CONF, block)
    try:
        rnd = random.Random(3)
        rows, seq = [], 100
        for i in range(260):
            if rnd.random() < 0.04 and i > 5:
                seq += 50
                rows.append(("X", i, "snapshot", seq, seq))
            else:
                first = seq + 1 + rnd.choice([0, 0, 0, 0, -3, -8, 4])
                last = first + rnd.choice([0, 1, 5])
                seq = max(seq, last)
                rows.append(("X", i, "delta", first, last))
        df = spark.createDataFrame(
            rows, "symbol string, arrival long, kind string, first_seq long, last_seq long")
        got = {r["arrival"]: r["status"] for r in sequence_status(df).collect()}
        known = None
        for _, i, kind, first, last in rows:
            if kind == "snapshot":
                known, want = last, "snapshot"
            elif known is None:
                want = "stale"
            elif last <= known:
                want = "duplicate"
            elif first > known + 1:
                want = "gap"
            else:
                known, want = last, "ok"
            assert got[i] == want, i
        chain = {r["arrival"]: r["accepted"] for r in strict_delta_chain(df).collect()}
        prev, seen = None, False
        for _, i, kind, first, last in rows:
            if kind == "snapshot":
                prev, ok, seen = last, True, True
            else:
                ok = prev is None or first == prev + 1
                prev = last if ok else prev
            assert chain[i] == ok, i
    finally:
        spark.conf.unset(BLOCK_ROWS_CONF)


def test_merge_steps_matches_loop():
    rnd = random.Random(8)
    for _ in range(200):
        ranges = [(f, f + rnd.randrange(4)) for f in (rnd.randrange(30) for _ in range(8))]
        pieces = _merge_steps([f for f, _ in ranges], [l for _, l in ranges])
        for start in range(-2, 36):
            m = start
            for f, l in ranges:
                if l > m and f <= m + 1:
                    m = l
            out = [v for lo, hi, v in pieces if lo <= start <= hi]
            assert len(out) == 1
            assert (start if out[0] is None else out[0]) == m
