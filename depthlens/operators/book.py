"""Order-book operators.  Books: symbol, ts_ms, seq, bids, asks (levels best first)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthlens.functions import books as bk
from depthlens.functions.scalar import array_median, clamp, round_half_up
from depthlens.operators.intervals import asof
from depthlens.operators.ordered import RN, Ordered, order_rows
from depthlens.session import write_table

SIDES = (("bid", "bids"), ("ask", "asks"))


def sort_sides(books: DataFrame) -> DataFrame:
    """Put both sides of raw snapshots into best-first order."""
    return books.withColumns({
        "bids": F.sort_array("bids", asc=False), "asks": F.sort_array("asks", asc=True)})


def ordered_books(books: DataFrame | Ordered) -> Ordered:
    if isinstance(books, Ordered):
        return books
    return order_rows(books, ["symbol"], ["ts_ms", "seq"])


# ---- reconstruction ------------------------------------------------------------------------
def level_changes(books: DataFrame) -> DataFrame:
    """Per-level changes that turn each book of a symbol into the next one.

    The first book of a symbol is its snapshot (epoch 1); a vanished level has qty 0.
    """
    o = ordered_books(books)
    parts = [
        o.df.select("symbol", F.col(RN).alias("step"), F.lit(s).alias("side"), F.inline(c))
        for s, c in SIDES
    ]
    levels = parts[0].unionByName(parts[1])
    after = levels.select("symbol", (F.col("step") + 1).alias("step"), "side", "price",
                          F.col("qty").alias("was"))
    both = levels.unionByName(after, allowMissingColumns=True).groupBy(
        "symbol", "step", "side", "price").agg(F.max("qty").alias("qty"), F.max("was").alias("was"))
    known = o.df.select("symbol", F.col(RN).alias("step"), "ts_ms", "seq")
    changed = both.filter(F.coalesce("qty", F.lit(0.0)) != F.coalesce("was", F.lit(0.0)))
    # steps after the last book have no row in ``known``
    return changed.join(known, ["symbol", "step"]).select(
        "symbol", F.lit(1).cast("bigint").alias("epoch"), "step", "ts_ms", "seq", "side", "price",
        F.coalesce("qty", F.lit(0.0)).alias("qty"))


def rebuild_books(
    changes: DataFrame, at: DataFrame, keep: int = 50, bin_steps: int = 64
) -> DataFrame:
    """Books at the requested steps from level changes.

    ``changes``: symbol, epoch, step, side, price, qty (0 deletes); a snapshot starts a new
    epoch.  ``at``: symbol, epoch, step [, more columns].  A level is valid from its change to
    its next change; these stretches meet the requested steps by (symbol, epoch, bin).
    """
    keys = ["symbol", "epoch", "side", "price"]
    o = order_rows(changes.select(*keys, "step", "qty"), keys, ["step"])
    o = o.frame(0, 1, lambda w: {"__to": F.lead("step").over(w) - 1})
    ends = at.groupBy("symbol", "epoch").agg(F.max("step").alias("__end"))
    alive = o.df.filter("qty > 0").join(ends, ["symbol", "epoch"])
    alive = alive.withColumn("__to", F.coalesce("__to", "__end")).filter("step <= __to")
    alive = alive.withColumnRenamed("step", "__from").withColumn("__bin", F.explode(F.expr(
        f"sequence(__from div {bin_steps}, __to div {bin_steps})")))
    asked = at.withColumn("__bin", F.expr(f"step div {bin_steps}"))
    rows = alive.join(asked, ["symbol", "epoch", "__bin"]).filter("step between __from and __to")
    group = [c for c in at.columns]
    lvl = F.struct("price", "qty")
    return rows.groupBy(*group).agg(
        F.slice(F.sort_array(F.collect_list(F.when(F.col("side") == "bid", lvl)), asc=False),
                1, keep).alias("bids"),
        F.slice(F.sort_array(F.collect_list(F.when(F.col("side") == "ask", lvl))),
                1, keep).alias("asks"),
    )


# ---- per-book measures ---------------------------------------------------------------------
def book_measures(books: DataFrame) -> DataFrame:
    """Touch, spread, imbalances at three depths, microprice and depth of every book."""
    return books.withColumns({
        "best_bid": bk.best_bid(), "best_ask": bk.best_ask(), "mid": bk.mid(),
        "spread": bk.spread(), "spread_bps": bk.spread_bps(),
        "obi5": bk.depth_imbalance(5), "obi10": bk.depth_imbalance(10),
        "obi20": bk.depth_imbalance(20), "microprice": bk.microprice(),
        "bid_depth": bk.notional(bk.top(F.col("bids"), 10)),
        "ask_depth": bk.notional(bk.top(F.col("asks"), 10)),
    }).withColumn("obi_divergence", F.abs(F.col("obi5") - F.col("obi20")) > 0.3)


def smoothed_imbalance(books: DataFrame, tau_ms: int = 5000) -> DataFrame:
    """Distance-weighted imbalance with an EMA that forgets by elapsed time."""
    o = ordered_books(books).where((bk.spread() > 0) & (bk.mid() > 0))
    o = o.col("raw_obi", bk.weighted_imbalance())
    o = o.frame(1, 0, lambda w: {"__dt": F.col("ts_ms") - F.lag("ts_ms").over(w)})
    keep = F.exp(-F.coalesce(F.col("__dt"), F.lit(tau_ms)).cast("double") / float(tau_ms))
    o = o.col("__keep", keep)
    o = o.scan({"obi": (F.col("__keep"), F.col("raw_obi") * (1.0 - F.col("__keep")))})
    return o.col("valid", F.col(RN) >= 4).drop("__dt", "__keep").result()


def book_velocity(books: DataFrame) -> DataFrame:
    """Traded-or-moved notional per second at unchanged levels since the previous book."""
    o = ordered_books(books).frame(1, 0, lambda w: {
        "__b": F.lag("bids").over(w), "__a": F.lag("asks").over(w),
        "__dt": F.col("ts_ms") - F.lag("ts_ms").over(w)})
    moved = bk.churn("bids", "__b") + bk.churn("asks", "__a")
    return o.col("velocity", F.when(F.col("__dt") > 0, moved / F.col("__dt") * 1000.0)).drop(
        "__b", "__a", "__dt").result()


def microprice_deviation(books: DataFrame) -> DataFrame:
    """EMA(0.3) of the microprice's distance from the touch middle, in hundreds of bps."""
    o = ordered_books(books).where(bk.mid() > 0)
    o = o.col("deviation", (bk.microprice() - bk.mid()) / bk.mid() * 10_000.0)
    o = o.ema({"__ema": (F.col("deviation"), 0.3)})
    return o.cols({"micro_dev": F.col("__ema") / 100.0, "valid": F.col(RN) >= 4}).drop(
        "__ema").result()


def dom_ladder(books: DataFrame, depth: int = 15) -> DataFrame:
    """Depth rows of both sides with notional, display position and bar scale.

    Asks are listed from the far side down to the touch, then the bids.
    """
    scale = F.greatest(*[F.array_max(F.transform(
        bk.top(F.col(c), depth), lambda l: l["price"] * l["qty"])) for _, c in SIDES])
    base = books.withColumn("max_notional", scale)
    rows = []
    for side, c in SIDES:
        shown = F.size(bk.top(F.col("asks"), depth))
        r = base.select("symbol", "ts_ms", "seq", "max_notional", shown.alias("__asks"),
                        F.lit(side).alias("side"), F.posexplode(bk.top(F.col(c), depth)))
        place = F.col("__asks") + F.col("pos") if side == "bid" else F.col("__asks") - 1 - F.col("pos")
        rows.append(r.withColumn("position", place))
    out = rows[0].unionByName(rows[1]).select(
        "symbol", "ts_ms", "seq", "side", "position", "col.price", "col.qty", "max_notional")
    n = F.col("price") * F.col("qty")
    return out.withColumns({"notional": n, "bar": n / F.nullif(F.col("max_notional"), F.lit(0.0))})


def level_heat(books: DataFrame, depth: int = 25) -> DataFrame:
    """Quantity of each top level relative to the largest one of the book."""
    top_qty = F.greatest(*[F.array_max(bk.quantities(bk.top(F.col(c), depth))) for _, c in SIDES])
    base = books.withColumn("max_qty", top_qty)
    rows = [base.select("symbol", "seq", "max_qty", F.lit(s).alias("side"),
                        F.posexplode(bk.top(F.col(c), depth)).alias("rank", "l")) for s, c in SIDES]
    return rows[0].unionByName(rows[1]).select(
        "symbol", "seq", "side", "rank", "l.price", "l.qty",
        (F.col("l.qty") / F.nullif(F.col("max_qty"), F.lit(0.0))).alias("heat"))


# ---- fills ---------------------------------------------------------------------------------
def estimate_fills(
    orders: DataFrame, books: DataFrame, max_bps: float = 50.0, impact: float = 1.0
) -> DataFrame:
    """Walk the latest book for market orders (symbol, ts_ms, order_id, side, want).

    Adds fill_price, fill_qty and slippage_bps (against mid, capped).  Each
    book's levels are summed up once; an order only counts the levels that begin before its quantity is filled.
    """
    def sums(levels):
        """Per level what the levels before it hold and cost: taken once per book, not once per order."""
        none = F.struct(F.lit(0.0).alias("before"), F.lit(0.0).alias("paid"), F.lit(None).cast("double").alias("price"),
                        F.lit(None).cast("double").alias("qty"))

        def add(done, l):
            last = F.coalesce(F.try_element_at(done, F.lit(-1)), none)
            held = F.coalesce(last["qty"], F.lit(0.0))
            # a level without a quantity fills whatever is left
            q = F.when(l["qty"].isNull(), float("inf")).otherwise(F.greatest(l["qty"], F.lit(0.0)))
            paid = F.when(held > 0, last["paid"] + last["price"] * held).otherwise(last["paid"])
            return F.concat(done, F.array(F.struct(
                (last["before"] + held).alias("before"), paid.alias("paid"), l["price"].cast("double").alias("price"), q.alias("qty"))))

        empty = F.array().cast("array<struct<before:double,paid:double,price:double,qty:double>>")
        return F.aggregate(levels, empty, add)

    walked = books.withColumns({"__mid": bk.mid(), "bids": sums(F.col("bids")), "asks": sums(F.col("asks"))})
    walked = write_table(walked.select("symbol", "ts_ms", "seq", "__mid", "bids", "asks"), "walked")
    o = asof(orders, walked, ["symbol"], "ts_ms", ["__mid", "bids", "asks"], "order_id", "seq")
    o = o.withColumnRenamed("__mid", "mid")
    side = F.when(F.col("side") == "buy", F.col("asks")).otherwise(F.col("bids"))
    left = F.coalesce(F.col("want") * impact, F.lit(float("inf")))
    o = o.withColumns({"__levels": side, "__left": left})
    reached = F.size(F.filter("__levels", lambda l: l["before"] < F.col("__left")))
    o = o.withColumn("__w", F.try_element_at("__levels", F.nullif(reached, F.lit(0))))
    last = F.least(F.col("__w.qty"), F.col("__left") - F.col("__w.before"))
    filled = F.coalesce(F.col("__w.before") + last, F.when(F.col("__levels").isNotNull(), 0.0))
    o = o.withColumns({"__filled": filled, "__cost": F.col("__w.paid") + F.col("__w.price") * last})
    filled = F.col("__filled")
    avg = F.col("__cost") / F.nullif(filled, F.lit(0.0))
    idle = (F.col("want") <= 0) | F.coalesce(F.col("mid") <= 0, F.lit(True))
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    bps = F.least(F.abs((avg - F.col("mid")) / F.col("mid")) * 10_000.0, F.lit(max_bps))
    none = filled <= 0
    return o.withColumns({
        "fill_price": F.when(idle, F.col("mid")).when(
            none, F.col("mid") * (1.0 + sign * max_bps / 10_000.0)).otherwise(avg),
        "fill_qty": F.when(idle | none, 0.0).otherwise(F.least(filled / impact, F.col("want"))),
        "slippage_bps": F.when(idle, 0.0).when(none, max_bps).otherwise(
            round_half_up(bps * 100.0) / 100.0),
    }).drop("__levels", "__left", "__w", "__filled", "__cost", "bids", "asks")


# ---- walls -----------------------------------------------------------------------------------
def wall_levels(books: DataFrame, mult: float = 3.0, depth: int = 15, band: float = 1e-4) -> DataFrame:
    """Wall sightings: top levels above median(top 10) * mult * clamp(spread bps / 5, .5, 3).

    Adds per sighting: ``is_new`` (no wall within ``band`` of this price in the previous book),
    ``initial_qty`` and ``first_ts`` of its first sighting, and ``pulled`` (more than half of the
    initial quantity vanished since the last book).  Walls of two books are matched nearest
    first and one to one, so a wall keeps its identity while its price drifts by less than
    ``band`` a book.  Books with fewer than five levels on a side are passed over.
    """
    o = ordered_books(books).where((F.size("bids") >= 5) & (F.size("asks") >= 5))
    n10 = F.least(F.lit(10), F.size("bids"), F.size("asks"))
    factor = clamp(bk.spread_bps() / 5.0, 0.5, 3.0) * mult
    base = o.df.withColumns({"mid": bk.mid(), "__f": factor, "spread": bk.spread()})
    rows = []
    for side, c in SIDES:
        med = array_median(bk.quantities(bk.top(F.col(c), n10)))
        rows.append(base.select(
            "symbol", "ts_ms", "seq", F.col(RN).alias("book"), "mid", "spread",
            F.lit(side).alias("side"), med.alias("median_qty"), "__f",
            F.posexplode(bk.top(F.col(c), depth)).alias("rank", "l")))
    walls = rows[0].unionByName(rows[1]).select("*", "l.price", "l.qty").drop("l")
    walls = walls.filter(F.col("qty") > F.col("median_qty") * F.col("__f")).drop("__f")
    # a price occurs once per side of a book
    w = order_rows(walls, ["symbol", "side", "price"], ["book"], within=o)
    w = w.frame(1, 1, lambda win: {
        "__pb": F.lag("book").over(win), "prev_qty": F.lag("qty").over(win), "__nb": F.lead("book").over(win)})
    new = F.coalesce(F.col("__pb") != F.col("book") - 1, F.lit(True))
    w = w.col("is_new", new).cols({"prev_qty": F.when(~F.col("is_new"), F.col("prev_qty"))})
    w = w.running({
        "initial_qty": ("last", F.when(F.col("is_new"), F.col("qty"))),
        "first_ts": ("last", F.when(F.col("is_new"), F.col("ts_ms"))),
        "__run": ("last", F.when(F.col("is_new"), F.col("book"))),
    })
    last = F.coalesce(F.col("__nb") != F.col("book") + 1, F.lit(True))
    seen = _join_drifting(w.col("__last", last).drop("__pb", "__nb").result(), band)
    pulled = F.col("prev_qty") - F.col("qty") > F.col("initial_qty") * 0.5
    return seen.withColumn("pulled", F.coalesce(pulled, F.lit(False)))


def _nearest_first(pairs):
    """Of an array of (distance, new price, old price, ...) those kept if the nearest match first and each price once."""
    start = F.struct(F.expr("cast(array() as array<double>)").alias("new"), F.expr("cast(array() as array<double>)").alias("old"))

    def step(taken, p):
        free = ~F.array_contains(taken["new"], p["price"]) & ~F.array_contains(taken["old"], p["old"])
        add = lambda side, x: F.when(free, F.concat(taken[side], F.array(x))).otherwise(taken[side])
        return F.struct(add("new", p["price"]).alias("new"), add("old", p["old"]).alias("old"))

    taken = F.aggregate(F.array_sort(pairs), start, step)
    return F.arrays_zip(taken["new"].alias("price"), taken["old"].alias("old"))


def _join_drifting(walls: DataFrame, band: float) -> DataFrame:
    """Runs of sightings at one price (``__run``: their first book) joined where the price moved within ``band``.

    A run that begins is matched with runs that ended in the book before.  Prices go to cells of
    log price as wide as the band, so what is near lies in the same or a neighbouring cell: an equi-join,
    and of a book side only the walls that moved.  Chains of runs are followed to the first one
    by pointer doubling.
    """
    run = ["symbol", "side", "price", "__run"]
    walls = write_table(walls, "walls")
    width = -math.log1p(-band)
    cell = F.floor(F.log(F.col("price")) / width).cast("bigint")
    begun = walls.filter("is_new").select("symbol", "side", "book", "price", cell.alias("cell"))
    ended = walls.filter("__last").select(
        "symbol", "side", (F.col("book") + 1).alias("book"), F.col("price").alias("old"), F.col("__run").alias("old_run"),
        F.col("qty").alias("old_qty"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = begun.join(ended, ["symbol", "side", "book", "cell"]).withColumn("away", F.abs(F.col("old") - F.col("price")))
    near = near.filter(F.col("away") / F.col("price") < band)
    # a book side has at most ``depth`` walls
    pairs = near.groupBy("symbol", "side", "book").agg(F.collect_list(F.struct("away", "price", "old")).alias("pairs"))
    kept = pairs.select("symbol", "side", "book", F.inline(_nearest_first(F.col("pairs"))))
    links = near.join(kept, ["symbol", "side", "book", "price", "old"]).select(
        "symbol", "side", "price", F.col("book").alias("__run"), F.col("old").alias("to_price"), F.col("old_run").alias("to_run"), "old_qty")
    links = write_table(links, "wall_links")
    if links.isEmpty():
        return walls.drop("__run", "__last")
    roots = links.select(*run, "to_price", "to_run")
    while True:
        up = roots.select("symbol", "side", F.col("price").alias("to_price"), F.col("__run").alias("to_run"),
                          F.col("to_price").alias("up_price"), F.col("to_run").alias("up_run"))
        further = roots.join(up, ["symbol", "side", "to_price", "to_run"], "left")
        moved = write_table(further, "wall_roots")
        roots = moved.select(*run, F.coalesce("up_price", "to_price").alias("to_price"), F.coalesce("up_run", "to_run").alias("to_run"))
        if moved.filter("up_run IS NOT NULL").isEmpty():
            break
    first = walls.filter("is_new").select(
        "symbol", "side", F.col("price").alias("to_price"), F.col("__run").alias("to_run"),
        F.col("initial_qty").alias("root_qty"), F.col("first_ts").alias("root_ts"))
    roots = roots.join(first, ["symbol", "side", "to_price", "to_run"]).select(*run, "root_qty", "root_ts")
    out = walls.join(roots, run, "left").join(links.select(*run, "old_qty"), run, "left")
    linked = F.col("is_new") & F.col("old_qty").isNotNull()
    return out.withColumns({
        "prev_qty": F.when(linked, F.col("old_qty")).otherwise(F.col("prev_qty")),
        "initial_qty": F.coalesce("root_qty", "initial_qty"), "first_ts": F.coalesce("root_ts", "first_ts"),
        "is_new": F.col("is_new") & ~linked,
    }).drop("__run", "__last", "root_qty", "root_ts", "old_qty")


def wall_executions(walls: DataFrame, trades: DataFrame) -> DataFrame:
    """Executed quantity at each wall's price since the wall appeared.

    Walls are matched with trades by an as-of value of the running traded quantity per price:
    two as-of lookups instead of a join of every wall with every trade of its life.
    """
    t = order_rows(trades, ["symbol", "price"], ["ts_ms", "trade_id"])
    t = t.running({"done": ("sum", F.col("qty"))}).df.select(
        "symbol", "price", "ts_ms", "trade_id", "done")
    w = walls.withColumn("__id", F.struct("seq", "side", "rank"))
    now = asof(w, t.withColumn("__tid", F.struct(
        F.col("trade_id").alias("seq"), F.lit("").alias("side"), F.lit(0).alias("rank"))),
        ["symbol", "price"], "ts_ms", ["done"], "__id", "__tid")
    born = now.withColumnRenamed("done", "__now").withColumnsRenamed(
        {"ts_ms": "__ts", "first_ts": "ts_ms"})
    then = asof(born, t.withColumn("__tid", F.struct(
        F.col("trade_id").alias("seq"), F.lit("").alias("side"), F.lit(0).alias("rank"))),
        ["symbol", "price"], "ts_ms", ["done"], "__id", "__tid")
    executed = F.coalesce("__now", F.lit(0.0)) - F.coalesce("done", F.lit(0.0))
    return then.withColumn("executed_qty", executed).drop("__now", "done", "__id").withColumnsRenamed(
        {"ts_ms": "first_ts"}).withColumnsRenamed({"__ts": "ts_ms"})
