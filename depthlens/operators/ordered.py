"""Ordered computation per key that does not put a whole key in one task.

A plain ``Window.partitionBy(symbol).orderBy(ts)`` sends every row of a symbol to one
task; a symbol holding a third of the data then decides the run time.  ``Ordered``
numbers the rows of each key (``rn``) and cuts them into blocks of a fixed number of
rows.  Window functions run inside a block; what crosses a block border is added from
small tables with one row per block:

* running aggregates  - block totals, prefix-summed over blocks
* row frames, lag/lead - the border rows are copied into the neighbouring block (``moving``: frames as numpy arrays)
* affine recurrences   - y = a*y' + b composes associatively, so blocks fold to one pair
* first / last values  - carried like a running aggregate

Numbering costs nothing extra while every key fits in one block (a count decides): rows are then
numbered by ``row_number``.  Otherwise the rows are range-sorted on (key, order), which
splits hot keys by sampling, written to the shared checkpoint folder, and numbered
from the partition sizes.  Steps that read their rows twice then write them once (``kept``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from depthlens.session import block_rows as configured_block_rows
from depthlens.session import write_table

RN = "rn"
_BLK = "__blk"
_RADIX = 4
#: Values of neighbouring frames that are held at once.
_FRAME_CELLS = 500_000


@dataclass(frozen=True)
class Ordered:
    """A DataFrame whose rows are numbered 0,1,2,... per key in column ``rn``."""

    df: DataFrame
    keys: tuple[str, ...]
    max_rows: int
    block: int
    #: Whether the rows come straight from a written table, so that reading them again costs a scan.
    stored: bool = False

    # ---- plumbing -------------------------------------------------------------
    def with_df(self, df: DataFrame) -> Ordered:
        return replace(self, df=df, stored=False)

    def kept(self) -> Ordered:
        """Rows for a step that reads them more than once: written, if keys span blocks and they are not yet.

        Else each such step would run all steps before it again, and a chain of them would double the work every time.
        """
        if not self.blocked or self.stored:
            return self
        return replace(self, df=write_table(self.df, "kept"), stored=True)

    def select(self, *cols) -> Ordered:
        """Project; keys and ``rn`` are always kept."""
        return replace(self, df=self.df.select(*self.keys, RN, *cols))

    def col(self, name: str, expr: Column) -> Ordered:
        return replace(self, df=self.df.withColumn(name, expr))

    def cols(self, exprs: Mapping[str, Column]) -> Ordered:
        return replace(self, df=self.df.withColumns(dict(exprs)))

    def drop(self, *names: str) -> Ordered:
        return replace(self, df=self.df.drop(*names))

    def result(self) -> DataFrame:
        return self.df.drop(RN)

    @property
    def blocked(self) -> bool:
        return self.max_rows > self.block

    @property
    def _blk(self) -> Column:
        return F.floor(F.col(RN) / F.lit(self.block)).cast("bigint")

    def _with_blk(self) -> DataFrame:
        return self.df.withColumn(_BLK, self._blk)

    # ---- running aggregates -----------------------------------------------------
    def running(self, aggs: Mapping[str, tuple[str, Column]], inclusive: bool = True) -> Ordered:
        """Add aggregates over all rows of the key up to the current one.

        ``aggs`` maps a new column to (kind, expression); kind is one of sum, count, min,
        max, first, last.  Nulls are ignored.  ``inclusive=False`` leaves the current row
        out.  An empty frame gives NULL (0 for count).
        """
        part = [*self.keys, _BLK] if self.blocked else list(self.keys)
        end = 0 if inclusive else -1
        w = Window.partitionBy(*part).orderBy(RN).rowsBetween(Window.unboundedPreceding, end)
        src = self.kept()._with_blk() if self.blocked else self.df
        src = src.withColumns({f"__x_{n}": e for n, (_, e) in aggs.items()})
        local = src.withColumns(
            {n: _aggregate(kind, F.col(f"__x_{n}")).over(w) for n, (kind, _) in aggs.items()}
        ).drop(*[f"__x_{n}" for n in aggs])
        if not self.blocked:
            return self.with_df(local)
        totals = src.groupBy(*part).agg(
            *[_total(kind, F.col(f"__x_{n}")).alias(f"__t_{n}") for n, (kind, _) in aggs.items()]
        )
        before = (
            Window.partitionBy(*self.keys).orderBy(_BLK)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = totals.select(
            *part,
            *[_merge(kind, F.col(f"__t_{n}")).over(before).alias(f"__c_{n}")
              for n, (kind, _) in aggs.items()],
        )
        joined = local.join(carry, part, "left").withColumns(
            {n: _combine(kind, F.col(f"__c_{n}"), F.col(n)) for n, (kind, _) in aggs.items()}
        )
        return self.with_df(joined.drop(_BLK, *[f"__c_{n}" for n in aggs]))

    # ---- bounded row frames -------------------------------------------------------
    def frame(
        self,
        before: int,
        after: int,
        exprs: Callable[[WindowSpec], Mapping[str, Column]],
    ) -> Ordered:
        """Add window expressions that look at most ``before`` rows back and ``after`` ahead.

        ``exprs`` receives the window (partitioned and ordered) and returns new columns,
        e.g. ``lambda w: {"prev": F.lag("price").over(w)}``.
        """
        if not self.blocked:
            w = Window.partitionBy(*self.keys).orderBy(RN)
            return self.with_df(self.df.withColumns(dict(exprs(w))))
        w = Window.partitionBy(*self.keys, _BLK).orderBy(RN)
        out = self._bordered(before, after).withColumns(dict(exprs(w))).filter(F.col(_BLK) == self._blk).drop(_BLK)
        return self.with_df(out)

    def _bordered(self, before: int, after: int) -> DataFrame:
        """The rows of every block whose frames reach them: their own and, near a border, neighbours."""
        rn = F.col(RN)
        targets = F.sequence(
            F.greatest(F.floor((rn - after) / self.block), F.lit(0)).cast("bigint"),
            F.floor((rn + before) / self.block).cast("bigint"))
        return self.df.withColumn(_BLK, F.explode(targets))

    def moving(self, name: str, value: Column, before: int, fn: Callable[[np.ndarray], np.ma.MaskedArray]) -> Ordered:
        """Add the double ``name``: ``fn`` of the values of a block's rows in their order, NULLs masked.

        The results of ``fn`` may depend on ``before`` rows back; masked ones become NULL.  For frames that numpy evaluates for
        a block at once and that Spark would evaluate row by row.
        """
        block, blocked = self.block, self.blocked
        rows = self._bordered(before, 0) if blocked else self.df.withColumn(_BLK, F.lit(0).cast("bigint"))
        rows = rows.withColumn(name, value.cast("double"))
        schema = StructType([StructField(f.name, f.dataType, True) for f in rows.drop(_BLK).schema.fields])

        def run(table):
            import pyarrow as pa
            import pyarrow.compute as pc

            table = table.sort_by(RN).combine_chunks()
            x = table.column(name)
            missing = x.is_null().to_numpy()
            found = fn(np.ma.masked_array(x.fill_null(0.0).to_numpy(), missing))
            found = pa.array(np.ma.getdata(found), mask=np.ma.getmaskarray(found))
            out = table.set_column(table.schema.get_field_index(name), name, found)
            if blocked:  # copies from the block before end here
                out = out.filter(pc.greater_equal(out.column(RN), out.column(_BLK)[0].as_py() * block))
            return out.drop_columns([_BLK])

        return self.with_df(rows.groupBy(*self.keys, _BLK).applyInArrow(run, schema))

    # ---- affine recurrences ----------------------------------------------------------
    def scan(self, steps: Mapping[str, tuple[Column, Column]]) -> Ordered:
        """Add y_i = a_i * y_(i-1) + b_i with y_(-1) = 0, for each (a, b) in ``steps``.

        Each pass widens the composed stretch fourfold with plain ``lag`` columns, so
        the work stays in the JVM and needs no array of the whole block.
        """
        names = list(steps)
        part = [*self.keys, _BLK] if self.blocked else list(self.keys)
        src = self._with_blk() if self.blocked else self.df
        src = src.withColumns({
            **{f"__a_{n}": steps[n][0].cast("double") for n in names},
            **{f"__b_{n}": steps[n][1].cast("double") for n in names},
        })
        stretch = min(self.block, max(self.max_rows, 1))
        local = _compose(src, part, RN, names, stretch)
        if not self.blocked:
            out = local.withColumns({n: F.col(f"__b_{n}") for n in names})
        else:
            # read twice: for the blocks' ends and for the rows
            local = write_table(local, "scanned")
            pair = [F.col(f"__{x}_{n}") for n in names for x in "ab"]
            ends = local.groupBy(*part).agg(
                F.max_by(F.struct(*pair), F.col(RN)).alias("__end")
            ).select(*part, "__end.*")
            blocks = -(-self.max_rows // self.block)
            over = Window.partitionBy(*self.keys).orderBy(_BLK)
            folded = _compose(ends, self.keys, _BLK, names, blocks)
            # one row per block; written so that the planner knows its true size
            carry = write_table(folded.select(
                *part, *[F.lag(f"__b_{n}").over(over).alias(f"__c_{n}") for n in names]
            ), "carry")
            out = local.join(carry, part, "left").withColumns({
                n: F.col(f"__b_{n}") + F.col(f"__a_{n}") * F.coalesce(f"__c_{n}", F.lit(0.0))
                for n in names
            }).drop(_BLK, *[f"__c_{n}" for n in names])
        return replace(self, df=out.drop(*[f"__{x}_{n}" for n in names for x in "ab"]), stored=self.blocked)

    def ema(self, columns: Mapping[str, tuple[Column, float]], seed_first: bool = False) -> Ordered:
        """Exponential averages ``new -> (value, alpha)``; start at 0 or at the first value."""
        first = F.col(RN) == 0
        steps = {}
        for name, (value, alpha) in columns.items():
            if seed_first:
                steps[name] = (
                    F.when(first, 0.0).otherwise(1.0 - alpha),
                    F.when(first, value).otherwise(value * alpha),
                )
            else:
                steps[name] = (F.lit(1.0 - alpha), value * alpha)
        return self.scan(steps)

    # ---- subsets --------------------------------------------------------------------
    def where(self, condition: Column) -> Ordered:
        """Keep matching rows and number them again without gaps."""
        kept = self.col("__keep", F.coalesce(condition, F.lit(False)))
        kept = kept.running({"__n": ("sum", F.col("__keep").cast("bigint"))})
        df = kept.df.filter("__keep").withColumn(RN, F.col("__n") - 1).drop("__keep", "__n")
        return self.with_df(df)


def order_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: int | None = None,
    within: Ordered | None = None,
) -> Ordered:
    """Number the rows of each key by ``order`` (which must be unique per key).

    ``within``: an ordering whose keys are a subset of ``keys`` and that has at least as many
    rows per key; if its keys fit in a block, these do too and need not be counted.
    """
    keys = tuple(keys)
    block = block or (within.block if within else configured_block_rows(df.sparkSession))
    if within is not None and within.max_rows <= block:
        biggest = within.max_rows
    else:
        biggest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if biggest <= block:
        w = Window.partitionBy(*keys).orderBy(*order)
        return Ordered(
            df.withColumn(RN, F.row_number().over(w).cast("bigint") - 1), keys, biggest, block
        )
    at = F.monotonically_increasing_id()
    laid_out = write_table(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("__at", at),
        "ordered",
    ).withColumn("__part", F.shiftright("__at", 33))
    sizes = laid_out.groupBy(*keys, "__part").agg(
        F.count("*").alias("__n"), F.min("__at").alias("__start")
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    # one row per key and sorted partition; written so that the planner knows its true size
    offsets = write_table(
        sizes.select(
            *keys, "__part",
            (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__start")).alias("__shift"),
        ),
        "offsets",
    )
    numbered = laid_out.join(offsets, [*keys, "__part"]).withColumn(
        RN, F.col("__at") + F.col("__shift")
    )
    return Ordered(numbered.drop("__at", "__part", "__shift"), keys, biggest, block, stored=True)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"):
    """First ``k`` rows per key.  Spark cuts each task's rows of a key to ``k`` before they meet."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def rolling_sum(x: Column, n: int, w: WindowSpec) -> Column:
    """Sum of the last ``n`` rows as a difference of two growing sums.

    Spark evaluates a sliding frame anew for every row, a growing one incrementally; inside
    ``Ordered.frame`` the sums never reach beyond one block.  An empty frame gives 0.
    """
    start = Window.unboundedPreceding
    upto = F.coalesce(F.sum(x).over(w.rowsBetween(start, 0)), F.lit(0))
    return upto - F.coalesce(F.sum(x).over(w.rowsBetween(start, -n)), F.lit(0))


def moving_deviation(x: np.ma.MaskedArray, n: int) -> np.ma.MaskedArray:
    """Sample deviation of the last ``n`` values around their own mean; masked values do not count, fewer than two give a masked one.

    Both passes run over all frames of a few thousand rows at once, so no digits are lost to differences of growing sums.
    """
    known = np.concatenate([np.zeros(n), ~np.ma.getmaskarray(x)])
    values = np.concatenate([np.zeros(n), np.ma.filled(x, 0.0)])
    frames, knowns = (np.lib.stride_tricks.sliding_window_view(a, n)[1:] for a in (values, known))
    counts = np.cumsum(known)
    counts = counts[n:] - counts[:-n]
    squares = np.empty(len(x))
    step = max(1, _FRAME_CELLS // n)
    with np.errstate(invalid="ignore", over="ignore"):
        for at in range(0, len(x), step):
            v, c = frames[at:at + step], counts[at:at + step]
            away = v - (v.sum(axis=1) / np.maximum(c, 1))[:, None]
            if (c < n).any():
                away = np.where(knowns[at:at + step] > 0, away, 0.0)
            squares[at:at + step] = np.square(away, out=away).sum(axis=1)
        return np.ma.masked_array(np.sqrt(squares / np.maximum(counts - 1, 1)), counts < 2)


# ---- aggregate vocabulary ------------------------------------------------------------
def _aggregate(kind: str, x: Column) -> Column:
    if kind == "first":
        return F.first(x, ignorenulls=True)
    if kind == "last":
        return F.last(x, ignorenulls=True)
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](x)


def _total(kind: str, x: Column) -> Column:
    if kind == "first":
        return F.min_by(x, F.when(x.isNotNull(), F.col(RN)))
    if kind == "last":
        return F.max_by(x, F.when(x.isNotNull(), F.col(RN)))
    return _aggregate(kind, x)


def _merge(kind: str, total: Column) -> Column:
    return F.sum(total) if kind == "count" else _aggregate(kind, total)


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind == "count":
        return F.coalesce(carry, F.lit(0)) + local
    if kind == "sum":
        return F.coalesce(carry + local, carry, local)
    if kind == "min":
        return F.least(carry, local)
    if kind == "max":
        return F.greatest(carry, local)
    return F.coalesce(carry, local) if kind == "first" else F.coalesce(local, carry)


def _compose(
    df: DataFrame, part: Sequence[str], order: str, names: Sequence[str], length: int
) -> DataFrame:
    """Prefix-compose the pairs (__a, __b) in ``order`` for stretches of ``length`` rows."""
    over = f"over (partition by {', '.join(f'`{c}`' for c in part)} order by `{order}`)"
    columns = df.columns
    stride = 1
    while stride < length:
        lags = [
            f"lag(`__{x}_{n}`, {k * stride}, {identity}) {over} as `__l{x}_{k}_{n}`"
            for n in names for k in range(1, _RADIX) for x, identity in (("a", "1D"), ("b", "0D"))
        ]
        composed = {}
        for n in names:
            a = [f"`__a_{n}`"] + [f"`__la_{k}_{n}`" for k in range(1, _RADIX)]
            b = [f"`__b_{n}`"] + [f"`__lb_{k}_{n}`" for k in range(1, _RADIX)]
            acc = b[-1]
            for k in range(_RADIX - 2, -1, -1):
                acc = f"({b[k]} + {a[k]} * {acc})"
            composed[f"__a_{n}"] = f"{' * '.join(a)} as `__a_{n}`"
            composed[f"__b_{n}"] = f"{acc} as `__b_{n}`"
        df = df.selectExpr("*", *lags).selectExpr(*[composed.get(c, f"`{c}`") for c in columns])
        stride *= _RADIX
    return df
