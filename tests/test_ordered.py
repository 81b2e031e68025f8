import random

import pytest
from pyspark.sql import functions as F

from depthlens.operators.ordered import moving_deviation, order_rows


def _rows(seed, n=400):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.6 else rnd.choice("abc"), i * 7 % 1000 + i, i,
             rnd.choice([None, rnd.uniform(-5, 5)])) for i in range(n)]


@pytest.fixture(scope="module", params=[4, 16, 37, 100_000])
def ordered(spark, request):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "symbol string, ts long, id long, x double").repartition(5)
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return order_rows(df, ["symbol"], ["ts", "id"], block=request.param), groups


def _by_id(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_numbering_and_running(ordered):
    o, groups = ordered
    got = _by_id(o.running({
        "s": ("sum", F.col("x")), "n": ("count", F.col("x")), "lo": ("min", F.col("x")),
        "hi": ("max", F.col("x")), "f": ("first", F.col("x")), "l": ("last", F.col("x")),
    }).df, "rn", "s", "n", "lo", "hi", "f", "l")
    for rows in groups.values():
        seen = []
        for i, r in enumerate(rows):
            if r[3] is not None:
                seen.append(r[3])
            rn, s, n, lo, hi, f, l = got[r[2]]
            assert (rn, n) == (i, len(seen))
            if seen:
                assert s == pytest.approx(sum(seen))
                assert (lo, hi, f, l) == (min(seen), max(seen), seen[0], seen[-1])
            else:
                assert s is None and lo is None and f is None


def test_exclusive_running(ordered):
    o, groups = ordered
    got = _by_id(o.running({"m": ("max", F.col("x")), "n": ("count", F.lit(1))},
                           inclusive=False).df, "m", "n")
    for rows in groups.values():
        for i, r in enumerate(rows):
            prev = [p[3] for p in rows[:i] if p[3] is not None]
            assert got[r[2]] == (max(prev) if prev else None, i)


def test_frames(ordered):
    o, groups = ordered
    got = _by_id(o.frame(3, 2, lambda w: {
        "lag": F.lag("id", 1).over(w), "lead": F.lead("id", 2).over(w),
        "s": F.sum("id").over(w.rowsBetween(-3, 0)),
    }).df, "lag", "lead", "s")
    for rows in groups.values():
        ids = [r[2] for r in rows]
        for i, r in enumerate(rows):
            assert got[r[2]] == (
                ids[i - 1] if i else None,
                ids[i + 2] if i + 2 < len(ids) else None,
                sum(ids[max(0, i - 3): i + 1]),
            )


def test_scan_and_where(ordered):
    o, groups = ordered
    o2 = o.where(F.col("x").isNotNull())
    got = _by_id(o2.scan({"y": (F.exp(-F.abs("x")), F.col("x"))})
                 .ema({"e": (F.col("x"), 0.2)}, seed_first=True).df, "rn", "y", "e")
    import math
    n = 0
    for rows in groups.values():
        y, e = 0.0, None
        for i, r in enumerate([r for r in rows if r[3] is not None]):
            y = math.exp(-abs(r[3])) * y + r[3]
            e = r[3] if e is None else 0.2 * r[3] + 0.8 * e
            assert got[r[2]] == (i, pytest.approx(y, abs=1e-9), pytest.approx(e, abs=1e-9))
            n += 1
    assert n == len(got)


def test_chained_steps_run_what_lies_before_them_once(spark):
    """Each step over blocks that reads its rows twice ran all steps before it twice: four times for two of them."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        calls.add(1)
        return x

    n = 300
    df = spark.range(n).selectExpr("'a' as symbol", "id as ts", "cast(id as double) as x")
    o = order_rows(df, ["symbol"], ["ts"], block=40).frame(1, 0, lambda w: {"p": F.lag("x").over(w)})
    o = o.col("y", counted(F.coalesce("p", F.lit(0.0)))).where(F.col("y") >= 0)
    o = o.frame(3, 0, lambda w: {"m": F.max("y").over(w.rowsBetween(-3, 0))})
    got = o.ema({"e": (F.col("m"), 1.0)}).running({"s": ("sum", F.col("y"))}).df.orderBy("rn").collect()
    assert [r.e for r in got] == [float(max(i - 1, 0)) for i in range(n)]
    assert got[-1].s == sum(range(n - 1)) and calls.value == n


def test_moving_deviation_of_blocks_against_a_loop(ordered):
    import statistics

    o, groups = ordered
    big = o.col("x", F.col("x") + 1e9)
    got = _by_id(big.moving("d", F.col("x"), 5, lambda x: moving_deviation(x, 6)).df, "rn", "d")
    assert len(got) == sum(map(len, groups.values()))
    for rows in groups.values():
        for i, r in enumerate(rows):
            seen = [p[3] + 1e9 for p in rows[max(0, i - 5): i + 1] if p[3] is not None]
            want = pytest.approx(statistics.stdev(seen), rel=1e-9, abs=1e-9) if len(seen) > 1 else None
            assert got[r[2]] == (i, want)


def test_volatility_takes_no_sliding_frame_row_by_row(spark):
    """Numbers with a mean far from 0 keep their digits, over several blocks, and time does not grow with the frame."""
    import random
    import statistics

    from depthlens.operators import flow

    rnd = random.Random(5)
    prices = [100.0 + rnd.randrange(50) for _ in range(500)]
    rows = [("A", i, i, p) for i, p in enumerate(prices)]
    trades = spark.createDataFrame(rows, "symbol string, ts_ms long, trade_id long, price double")
    got = flow.return_volatility(order_rows(trades, ["symbol"], ["ts_ms", "trade_id"], block=120))
    assert "stddev" not in got._jdf.queryExecution().toString()
    found = {r.trade_id: (r.ret, r.volatility, r.valid) for r in got.collect()}
    rets, e = [], 0.0
    for i in range(1, 500):
        rets.append((prices[i] - prices[i - 1]) / prices[i - 1])
        e = e * 19 / 21 + (statistics.stdev(rets[-300:]) if i > 1 else 0.0) * 2 / 21
        assert found[i] == (rets[-1], pytest.approx(e * 1e4, rel=1e-12), i > 28)
