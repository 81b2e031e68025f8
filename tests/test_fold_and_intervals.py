import random

import pytest
from pyspark.sql import functions as F

from depthlens.operators import fold
from depthlens.operators.fold import decision_fires, greedy_starts
from depthlens.operators.intervals import asof, first_touch, last_price, price_tree, range_frame
from depthlens.operators.ordered import order_rows


def _groups(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("block", [7, 50, 10_000])
@pytest.mark.parametrize("gap", [5, 40, 1000])
def test_greedy_spacing(spark, block, gap):
    rnd = random.Random(gap)
    rows, t = [], 0
    for i in range(300):
        t += rnd.choice([0, 1, 2, 15])
        rows.append((rnd.choice("aaab"), t, i))
    df = spark.createDataFrame(rows, "k string, t long, id long")
    o = greedy_starts(order_rows(df, ["k"], ["t", "id"], block=block), "t", gap)
    got = {r["id"] for r in o.df.filter("is_start").collect()}
    want = set()
    for part in _groups(rows).values():
        last = None
        for _, t, i in part:
            if last is None or t - last >= gap:
                want.add(i)
                last = t
    assert got == want


def test_greedy_spacing_of_one_long_key(spark):
    """One key of 10^5 rows, the gap far above what a block spans, and so short that a block holds many starts."""
    df = spark.range(100_000).select(F.lit("a").alias("k"), (F.col("id") * 3 + F.col("id") % 2).alias("t"), "id")
    t = [i * 3 + i % 2 for i in range(100_000)]
    for gap in (25_000, 40):
        o = greedy_starts(order_rows(df, ["k"], ["t", "id"], block=1000), "t", gap)
        want, last = set(), None
        for i, x in enumerate(t):
            if last is None or x - last >= gap:
                want.add(i)
                last = x
        assert {r["id"] for r in o.df.filter("is_start").collect()} == want


def _loop_fsm(part, thr, dwell, cool):
    state, side, since, out = "IDLE", None, 0, {}
    for _, t, i, s in part:
        now = "BUY" if s > 0 else "SELL"
        if state == "IDLE":
            if abs(s) >= thr:
                state, side, since = "ARMED", now, t
        elif state == "ARMED":
            if now != side or abs(s) < thr:
                state = "IDLE"
            elif t - since >= dwell:
                state = "FIRED"
                out[i] = now
        elif state == "FIRED":
            state, since = "COOLDOWN", t
        elif t - since >= cool:
            state = "IDLE"
    return out


@pytest.mark.parametrize("block", [3, 11, 64, 10_000])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decision_machine(spark, block, seed):
    rnd = random.Random(seed)
    rows, t, s = [], 0, 0.0
    for i in range(500):
        t += rnd.choice([1, 5, 20])
        s = max(-1.0, min(1.0, s * 0.9 + rnd.uniform(-0.35, 0.35)))
        rows.append((rnd.choice("aaab"), t, i, s))
    df = spark.createDataFrame(rows, "k string, ts_ms long, id long, score double")
    o = order_rows(df, ["k"], ["ts_ms", "id"], block=block)
    fires = decision_fires(o, threshold=0.35, dwell_ms=30, cooldown_ms=60)
    got = {r["id"]: r["fired_side"] for r in o.df.join(fires, ["k", "rn"]).collect()}
    want = {}
    for part in _groups(rows).values():
        want.update(_loop_fsm(part, 0.35, 30, 60))
    assert want and got == want


def test_range_frame_and_asof(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("aab"), rnd.randrange(2000), i, rnd.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ts long, id long, x long")
    probes = [(rnd.choice("aabc"), rnd.randrange(2000), i) for i in range(100)]
    pf = spark.createDataFrame(probes, "k string, ts long, pid long")
    aggs = {"n": ("count", F.lit(1)), "s": ("sum", F.col("x")), "hi": ("max", F.col("x")),
            "l": ("last", F.col("x"))}
    own = {r["id"]: r for r in
           range_frame(df, ["k"], "ts", 70, 15, aggs, order=["ts", "id"]).collect()}
    for k, t, i, x in rows:
        frame = sorted((r[1], r[2], r[3]) for r in rows if r[0] == k and t - 70 <= r[1] <= t + 15)
        assert (own[i]["n"], own[i]["s"], own[i]["hi"], own[i]["l"]) == (
            len(frame), sum(f[2] for f in frame), max(f[2] for f in frame), frame[-1][2])
    got = {r["pid"]: r for r in
           range_frame(df, ["k"], "ts", 70, 15, aggs, probes=pf, order=["ts", "id"]).collect()}
    for k, t, i in probes:
        frame = sorted((r[1], r[2], r[3]) for r in rows if r[0] == k and t - 70 <= r[1] <= t + 15)
        assert got[i]["n"] == len(frame)
        assert got[i]["l"] == (frame[-1][2] if frame else None)
    joined = {r["pid"]: r["x"] for r in asof(pf, df, ["k"], "ts", ["x"], "pid", "id").collect()}
    for k, t, i in probes:
        past = sorted((r[1], r[2], r[3]) for r in rows if r[0] == k and r[1] <= t)
        assert joined[i] == (past[-1][2] if past else None)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("fan_out", [3, 7, 90, 5000])
def test_first_touch(spark, fan_out, strict):
    rnd = random.Random(9)
    rows, p = [], 100
    for i in range(400):
        p += rnd.choice([-1, 0, 1])
        rows.append(("a", i * 3 + rnd.randrange(3), i, float(p)))
    plans = [("a", i, s, s + rnd.choice([30, 300]), 100.0 - rnd.randrange(8),
              100.0 + rnd.randrange(8)) for i, s in enumerate(rnd.sample(range(1000), 60))]
    got = {r["pid"]: (r["touch_id"], r["touched"]) for r in first_touch(
        spark.createDataFrame(plans, "k string, pid long, start_ms long, end_ms long, lo double, hi double"),
        spark.createDataFrame(rows, "k string, ts_ms long, trade_id long, price double"),
        "k", "pid", fan_out, strict).collect()}
    for _, pid, s, e, lo, hi in plans:
        want = (None, None)
        for _, t, i, x in sorted(rows, key=lambda r: (r[1], r[2])):
            if s < t <= e:
                if (x < lo) if strict else (x <= lo):
                    want = (i, "lo")
                    break
                if (x > hi) if strict else (x >= hi):
                    want = (i, "hi")
                    break
        assert got[pid] == want


def test_first_touch_reads_one_small_node_a_level(spark):
    """Starts inside a millisecond, missing barriers and keys; every node that a plan may read has at most ``fan_out`` children."""
    rnd = random.Random(4)
    rows, p = [], 100.0
    for i in range(3000):
        p += rnd.choice([-0.5, 0, 0.5])
        rows.append((rnd.choice("aab"), i // 4, i, p))
    tree = price_tree(spark.createDataFrame(rows, "k string, ts_ms long, trade_id long, price double"), "k", 8)
    assert len(tree.levels) == 4
    for n, level in enumerate(tree.levels):
        assert level.agg(F.max(F.size("children"))).first()[0] <= 8
        assert level.groupBy("k", "node").count().agg(F.max("count")).first()[0] == 1
    plans = []
    for pid in range(200):
        start = rnd.randrange(-5, 760)
        lo, hi = 100 - rnd.randrange(0, 40) / 2, 100 + rnd.randrange(0, 40) / 2
        plans.append((rnd.choice("abc"), pid, start, start + rnd.choice([0, 3, 80, 5000]), rnd.choice([lo, None]), rnd.choice([hi, hi, None]),
                      rnd.choice([None, start * 4 + 1])))
    df = spark.createDataFrame(plans, "k string, pid long, start_ms long, end_ms long, lo double, hi double, start_id long")
    got = {r["pid"]: (r["touch_ts"], r["touch_id"], r["touch_price"], r["touched"]) for r in first_touch(df, tree, "k", "pid").collect()}
    for k, pid, s, e, lo, hi, sid in plans:
        want = (None,) * 4
        for kk, t, i, x in rows:
            if kk == k and (t > s or (t == s and sid is not None and i > sid)) and t <= e:
                side = "lo" if lo is not None and x <= lo else "hi" if hi is not None and x >= hi else None
                if side:
                    want = (t, i, x, side)
                    break
        assert got[pid] == want


@pytest.mark.parametrize("strict", [False, True])
def test_sequence_steps_equal_a_walk(strict):
    rnd = random.Random(12)
    for _ in range(400):
        rows = [(f, f + rnd.randrange(0, 6)) for f in (rnd.randrange(1, 40) for _ in range(rnd.randrange(0, 25)))]
        firsts, lasts = [f for f, _ in rows], [x for _, x in rows]
        steps = fold._chain_steps(firsts, lasts, 60) if strict else fold._merge_steps(firsts, lasts)
        for number in range(-2, 60):
            now = number
            for f, x in rows:
                if f == now + 1 if strict else f - 1 <= now <= x - 1:
                    now = x
            got = next((out for low, high, out in steps if low <= number <= high and out is not None), number)
            assert got == now


def test_sequence_steps_of_a_full_block_take_little_time():
    import time

    n = 65_536
    forward = [[(10 * i, 10 * i + 5) for i in range(n)], [(i + 1, i + 1) for i in range(n)], [(1, i + 2) for i in range(n)]]
    # every row of a feed that runs backwards is inserted before all others
    backward = [[(10 * (n - i), 10 * (n - i) + 5) for i in range(n)], [(n - i, 2 * n - i) for i in range(n)]]
    for rows, most in [(r, 2) for r in forward] + [(r, 10) for r in backward]:
        began = time.process_time()
        fold._merge_steps([f for f, _ in rows], [x for _, x in rows])
        fold._chain_steps([f for f, _ in rows], [x for _, x in rows], 10**9)
        assert time.process_time() - began < most


def test_a_crowded_node_is_dealt_to_tasks_and_plans_stay_single(spark, monkeypatch):
    """Many plans of one node, more than a task should get; every plan keeps one row, touched or not."""
    monkeypatch.setattr("depthlens.operators.intervals.TASK_ROWS", 50)
    rnd = random.Random(6)
    prices = [("a", i // 2, i, 100.0 + rnd.randrange(-20, 20)) for i in range(600)]
    plans = [("a", i, rnd.randrange(40), 300, 100.0 - rnd.randrange(30), 100.0 + rnd.randrange(30)) for i in range(400)]
    tree = price_tree(spark.createDataFrame(prices, "k string, ts_ms long, trade_id long, price double"), "k", 64)
    df = spark.createDataFrame(plans, "k string, pid long, start_ms long, end_ms long, lo double, hi double")
    rows = first_touch(df, tree, "k", "pid").collect()
    assert len(rows) == 400
    got = {r["pid"]: r["touch_id"] for r in rows}
    priced = {r["pid"]: (r["p"], r["t"]) for r in last_price(df, tree, "start_ms", "p", "t").collect()}
    for _, pid, start, end, lo, hi in plans:
        assert got[pid] == next((i for _, t, i, x in prices if start < t <= end and (x <= lo or x >= hi)), None)
        assert priced[pid] == max((i, (x, t)) for _, t, i, x in prices if t <= start)[1]


def test_first_touch_meets_no_arrays_and_takes_one_task_share(spark):
    """Plans meet prices as sorted rows: a row with a node's 64 children cost 220 microseconds a plan and descent."""
    from pyspark.sql import types as T

    tree = price_tree(spark.range(5000).selectExpr("'a' as k", "id as ts_ms", "id as trade_id", "cast(id % 100 as double) as price"), "k", 512)
    assert not any(isinstance(f.dataType, T.ArrayType) for f in tree.prices.schema)
    assert tree.prices.groupBy("k", "node").count().agg(F.max("count")).first()[0] == 512
    assert len(tree.leaves["a"]["ts"]) == 10


def test_forward_returns_take_more_tasks_for_more_signals(spark, monkeypatch):
    """Few alike columns shuffle to few bytes; the tasks must still follow the rows, and the returns stay right."""
    from depthlens.plans.outcomes import forward_returns

    monkeypatch.setattr("depthlens.operators.intervals.TASK_ROWS", 10)
    prices = [("a", i, i, 100.0 + i) for i in range(200)]
    p = spark.createDataFrame(prices, "symbol string, ts_ms long, trade_id long, price double")
    s = p.selectExpr("symbol", "trade_id as sid", "ts_ms", "'BUY' as side", "price")
    out = forward_returns(s, p, "sid", (5, 20))
    assert out.rdd.getNumPartitions() >= 20
    for r in out.collect():
        last = min(r["ts_ms"] + r["horizon_ms"] - 1, 199)
        assert abs(r["ret"] - (last - r["ts_ms"]) / r["price"]) < 1e-12
        assert r["realized"] == (199 >= r["ts_ms"] + r["horizon_ms"])


def test_fills_count_levels_instead_of_folding_them(spark):
    """Each order against a loop; the plan of an order holds no fold over the levels of its book."""
    from depthlens.operators.book import estimate_fills

    rnd = random.Random(8)
    level = lambda best, step: [(best + step * i, rnd.choice([0.0, 1.5, 4.0, None if i == 9 else 2.0])) for i in range(rnd.randrange(12))]
    books = [("a", t * 10, t, level(99.0, -1), level(101.0, 1)) for t in range(20)]
    kind = "array<struct<price:double,qty:double>>"
    b = spark.createDataFrame(books, f"symbol string, ts_ms long, seq long, bids {kind}, asks {kind}")
    orders = [("a", rnd.randrange(-20, 220), i, rnd.choice(["buy", "sell"]), rnd.choice([0.0, 0.5, 3.0, 20.0, 500.0])) for i in range(150)]
    out = estimate_fills(spark.createDataFrame(orders, "symbol string, ts_ms long, order_id long, side string, want double"), b)
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["order_id"]: r for r in out.collect()}
    assert len(got) == 150
    for _, ts, i, side, want in orders:
        past = [x for x in books if x[1] <= ts]
        if not past or not past[-1][3] or not past[-1][4] or want <= 0:
            continue
        left, cost, filled = want, 0.0, 0.0
        for price, qty in past[-1][4 if side == "buy" else 3]:
            q = left if qty is None else max(min(qty, left), 0.0)
            left, cost, filled = left - q, cost + price * q, filled + q
        assert got[i]["fill_qty"] == (min(filled, want) if filled else 0.0)
        if filled:
            assert abs(got[i]["fill_price"] - cost / filled) < 1e-9
