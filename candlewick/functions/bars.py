"""Window expressions over one series' bars, in the order of time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weighted sums of up to so many bars are spelled out with lag; longer ones fold a list.
SPELLED = 40


class Bars:
    """A DataFrame that operators add columns to; all its windows share one partitioning and
    order, so however many there are, rows are shuffled and sorted once."""

    def __init__(self, df: DataFrame, series: Sequence[str], order: Sequence[str]):
        self.df, self.series, self.order = df, list(series), list(order)
        self.window = Window.partitionBy(*self.series).orderBy(*self.order)
        self.numbers, self.index = count(), None

    def let(self, e: Column) -> Column:
        """e as a column of its own, so that windows can be taken over it."""
        name = f"__b{next(self.numbers)}"
        self.df = self.df.withColumn(name, e)
        return F.col(name)

    def lag(self, x: Column, k: int = 1) -> Column:
        return F.lag(x, k).over(self.window) if k else x

    def rows(self, p: int):
        return self.window.rowsBetween(-(p - 1), 0)

    def over(self, x: Column, p: int, agg: Callable[[Column], Column]) -> Column:
        """An aggregate of the last p bars; null until p bars, none of them null, are there."""
        return F.when(F.count(x).over(self.rows(p)) == p, agg(x).over(self.rows(p)))

    def mean(self, x: Column, p: int) -> Column:
        return self.over(x, p, F.avg)

    def sum(self, x: Column, p: int) -> Column:
        return self.over(x, p, F.sum)

    def max(self, x: Column, p: int) -> Column:
        return self.over(x, p, F.max)

    def min(self, x: Column, p: int) -> Column:
        return self.over(x, p, F.min)

    def std(self, x: Column, p: int) -> Column:
        return self.over(x, p, F.stddev_pop)

    def running(self, x: Column) -> Column:
        return F.sum(x).over(self.window.rowsBetween(Window.unboundedPreceding, 0))

    def number(self) -> Column:
        """The bar's number in its series."""
        if self.index is None:
            self.index = self.let(F.row_number().over(self.window).cast("double"))
        return self.index

    def valid(self, x: Column) -> Column:
        """How many bars with a value there are up to this one."""
        return F.count(x).over(self.window.rowsBetween(Window.unboundedPreceding, 0))

    def fir(self, x: Column, weights: Sequence[float]) -> Column:
        """sum of weights[k] * x[t-k]; weights start with the newest bar's."""
        p = len(weights)
        if p <= SPELLED:
            return reduce(lambda a, b: a + b, (self.lag(x, k) * float(w) for k, w in enumerate(weights)))
        listed = F.collect_list(x).over(self.rows(p))
        total = F.aggregate(F.zip_with(listed, F.array(*(F.lit(float(w)) for w in reversed(weights))), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.when(F.count(x).over(self.rows(p)) == p, total)

    def listed(self, x: Column, p: int) -> Column:
        """The last p values as an array, oldest first; null until they are there."""
        return self.over(x, p, F.collect_list)

    def line(self, x: Column, p: int) -> tuple[Column, Column]:
        """Least-squares slope over the last p bars, and the line's value at the newest one."""
        n = self.number()
        full = F.count(x).over(self.rows(p)) == p
        slope = F.when(full, F.regr_slope(x, n).over(self.rows(p)))
        at = F.when(full, F.regr_slope(x, n).over(self.rows(p)) * n + F.regr_intercept(x, n).over(self.rows(p)))
        return slope, at

    def true_range(self, h: Column, l: Column, c: Column) -> Column:  # noqa: E741
        before = self.lag(c)
        return F.when(h.isNotNull() & l.isNotNull() & c.isNotNull(), F.greatest(h - l, F.abs(h - before), F.abs(l - before)))

    def fold(self, name: str, inputs: Sequence[Column], **params) -> list[Column]:
        """The outputs of a recursive operator of these columns: one pass in Python."""
        from ..plans.runner import fold_columns

        ins = [self.let(x.cast("double")) for x in inputs]
        names = [c._jc.toString() for c in ins]
        self.df, outs = fold_columns(self.df, self.series, self.order, name, names, params, f"__f{next(self.numbers)}")
        return [F.col(c) for c in outs]

    def ma(self, x: Column, kind: str, p: int) -> Column:
        """A moving average by name: in the JVM where a window can do it, else as a fold."""
        from ..operators.registry import operator

        op = operator(kind)
        if len(op.inputs) != 1:
            raise ValueError(f"{kind} needs more than one column")
        key = next((k for k in op.params if k in ("period", "length")), None)
        if key is None:
            raise ValueError(f"{kind} has no period")
        if op.native:
            out = op.make(self, self.let(x), **(op.params | {key: p}))
            return self.let(next(iter(out.values())) if isinstance(out, dict) else out)
        return self.fold(kind, [x], **{key: p})[0]
