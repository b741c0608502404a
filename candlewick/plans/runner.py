"""Operators applied to DataFrames: once, over a grid of parameters, several at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bars import Bars
from ..operators.registry import Operator, operator
from ..sources.candles import source

#: A fold to run: operator, its input columns, parameters, names of its output columns.
Job = tuple[str, list[str], dict[str, Any], list[str]]


class _Runner:
    """One fold going through the bars of one series."""

    def __init__(self, op: Operator, params: dict[str, Any]):
        self.step, self.width, self.hold, self.last = op.make(**params), len(op.outputs), op.gap == "hold", None
        self.none = (float("nan"),) * self.width

    def __call__(self, row: tuple) -> tuple:
        for v in row:
            if v != v:
                return self.last if self.hold and self.last is not None else self.none
        out = self.step(*row)
        self.last = out if isinstance(out, tuple) else (out,)
        return self.last


class _Loose(_Runner):
    """Volume may be missing where the operator can do without it."""

    def __call__(self, row: tuple) -> tuple:
        return super().__call__(row) if row[-1] == row[-1] else super().__call__((*row[:-1], 0.0))


def runner(op: Operator, params: dict[str, Any]) -> _Runner:
    return (_Loose if op.name in ("uma", "mod_god_mode") else _Runner)(op, params)


def _floats(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def fold_pass(df: DataFrame, series: Sequence[str], order: Sequence[str], jobs: Sequence[Job]) -> DataFrame:
    """df with the outputs of all jobs, in one pass.

    Rows are dealt by series and sorted; each task then streams its partition batch by batch
    and starts anew at each series, so a series of any length needs one step's state and one
    batch in memory. Missing values come out as null."""
    at = {c: i for i, c in enumerate(df.columns)}
    keys, ins = [at[c] for c in series], [[at[c] for c in cols] for _, cols, _, _ in jobs]
    names = [n for *_, outs in jobs for n in outs]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    todo = [(name, params, len(outs)) for name, _, params, outs in jobs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from candlewick.operators import operator as find

        now, steps = object(), []
        for batch in batches:
            n = batch.num_rows
            keyed = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * n
            cuts = [0, *(i for i in range(1, n) if keyed[i] != keyed[i - 1]), n] if n else [0]
            outs = [np.full(n, np.nan) for _ in names]
            rows = [list(zip(*(_floats(batch.column(c)).tolist() for c in cols))) for cols in ins]
            for a, b in zip(cuts, cuts[1:]):
                if keyed[a] != now:
                    now, steps = keyed[a], [runner(find(name), params) for name, params, _ in todo]
                first = 0
                for j, step in enumerate(steps):
                    width = todo[j][2]
                    got = [step(r) for r in rows[j][a:b]]
                    for k in range(width):
                        outs[first + k][a:b] = [g[k] for g in got]
                    first += width
            made = [pa.array(o, pa.float64(), mask=~np.isfinite(o)) for o in outs]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [f"c{i}" for i in range(batch.num_columns + len(made))])

    return df.repartition(*series).sortWithinPartitions(*series, *order).mapInArrow(run, schema)


def fold_columns(df: DataFrame, series: Sequence[str], order: Sequence[str], name: str, inputs: list[str], params: dict[str, Any], prefix: str) -> tuple[DataFrame, list[str]]:
    op = operator(name)
    outs = [f"{prefix}_{o}" for o in op.outputs]
    return fold_pass(df, series, order, [(op.name, inputs, op.checked(params), outs)]), outs


def _bars(df: DataFrame, series: str | Sequence[str], ts: str, tie: Sequence[str]) -> Bars:
    return Bars(df, [series] if isinstance(series, str) else list(series), [ts, *tie])


def _input(bars: Bars, df: DataFrame, op: Operator, letter: str, columns: dict[str, str], ts: str, lenient: bool, known: dict[str, Column]) -> Column:
    """An input as a column of doubles in which missing is null; each source is made once."""
    if letter == "ts":
        return F.col(f"`{ts}`")
    name = columns.get(letter, op.source(letter))
    if name not in known:
        x = source(df, name, lenient).cast("double")
        known[name] = bars.let(F.when(~F.isnan(x), x))
    return known[name]


def apply_all(df: DataFrame, jobs: Sequence[tuple[str, dict[str, Any], dict[str, str]]], series: str | Sequence[str] = "series", ts: str = "ts", tie: Sequence[str] = (), lenient: bool = False, columns: dict[str, str] | None = None) -> DataFrame:
    """Several operators in one plan: jobs are (operator, parameters, {output: column name}).
    Windows share one shuffle and sort; all folds share one pass in Python."""
    columns, bars, known = columns or {}, _bars(df, series, ts, tie), {}
    folds: list[Job] = []
    made: dict[str, Column] = {}
    for name, params, names in jobs:
        op = operator(name)
        params = op.checked(params)
        inputs = [_input(bars, df, op, i, columns, ts, lenient, known) for i in op.inputs]
        if op.native:
            out = op.make(bars, *inputs, **params)
            out = out if isinstance(out, dict) else {"values": out}
            made |= {names[o]: bars.let(out[o]) for o in op.outputs}
        else:
            folds.append((op.name, [c._jc.toString() for c in inputs], params, [f"__o{len(made) + k}" for k in range(len(op.outputs))]))
            made |= {names[o]: F.col(c) for o, c in zip(op.outputs, folds[-1][3])}
    if folds:
        bars.df = fold_pass(bars.df, bars.series, bars.order, folds)
    return bars.df.select(*(F.col(f"`{c}`") for c in df.columns), *(c.alias(n) for n, c in made.items()))


def apply(df: DataFrame, name: str, *, series: str | Sequence[str] = "series", ts: str = "ts", tie: Sequence[str] = (), names: dict[str, str] | None = None, columns: dict[str, str] | None = None, warmup: str = "null", lenient: bool = False, checked: bool = False, **params: Any) -> DataFrame:
    """df with an operator's outputs as further columns.

    columns: input letter -> column or derived source, where it is not the usual one; names:
    output -> column name. Without enough bars the outputs are null (warmup="nan": nan).
    checked: a series without any value of an input is an error, found by counting first."""
    op = operator(name)
    if checked:
        keys = [series] if isinstance(series, str) else list(series)
        ins = [source(df, (columns or {}).get(i, op.source(i)), lenient).cast("double") for i in op.inputs if i != "ts"]
        bad = df.groupBy(*keys).agg(*(F.count(F.when(~F.isnan(x), x)).alias(f"n{k}") for k, x in enumerate(ins))).where(" OR ".join(f"n{k} = 0" for k in range(len(ins)))).limit(1).collect()
        if bad or df.isEmpty():
            raise ValueError(f"{name}: no values in {bad[0] if bad else 'an empty table'}")
    names = {o: (names or {}).get(o, name if op.outputs == ("values",) else f"{name}_{o}") for o in op.outputs}
    out = apply_all(df, [(name, params, names)], series, ts, tie, lenient, columns)
    if warmup == "nan":
        for n in names.values():
            if dict(out.dtypes)[n] == "double":
                out = out.withColumn(n, F.coalesce(F.col(n), F.lit(float("nan"))))
    return out


def expand_grid(given: Any) -> list[Any]:
    """A value, a list of values, or (start, end, step), either way round; step 0 or equal
    ends give one value."""
    if not isinstance(given, tuple):
        return list(given) if isinstance(given, (list, set)) else [given]
    start, end, step = given
    if step == 0 or start == end:
        return [start]
    n = int(abs(end - start) / abs(step) + 1e-9)
    out = [start + (abs(step) if end > start else -abs(step)) * k for k in range(n + 1)]
    if not out:
        raise ValueError(f"{given} is no range")
    return out


def combinations(op: Operator, grid: dict[str, Any]) -> list[dict[str, Any]]:
    keys = list(grid)
    return [op.checked(dict(zip(keys, values))) for values in product(*(expand_grid(grid[k]) for k in keys))]


def sweep(df: DataFrame, name: str, grid: dict[str, Any], *, series: str | Sequence[str] = "series", ts: str = "ts", tie: Sequence[str] = (), columns: dict[str, str] | None = None) -> DataFrame:
    """One row for each bar and combination: series, ts, tie, combo_id, the swept parameters,
    the outputs. Windows of all combinations share one sort; folds one pass."""
    op = operator(name)
    combos = combinations(op, grid)
    names = [{o: f"__s{i}_{k}" for k, o in enumerate(op.outputs)} for i in range(len(combos))]
    wide = apply_all(df, [(name, p, n) for p, n in zip(combos, names)], series, ts, tie, columns=columns)
    rows = F.array(*(F.struct(F.lit(i).alias("combo_id"), *(F.lit(p[k]).alias(k) for k in grid), *(F.col(n[o]).alias(o) for o in op.outputs)) for i, (p, n) in enumerate(zip(combos, names))))
    keys = [*([series] if isinstance(series, str) else series), ts, *tie]
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def for_params(swept: DataFrame, **params: Any) -> DataFrame:
    """The rows of one combination of a sweep."""
    for k, v in params.items():
        swept = swept.where(F.col(k) == F.lit(v))
    return swept



#: Moving averages by the names that `ma` takes.
MOVING_AVERAGES = tuple(
    "sma ema dema tema smma zlema wma alma cwma cora_wave edcf fwma gaussian highpass highpass_2_pole hma jma jsa linreg kama ehlers_kama ehlers_itrend ehlers_ecema ehlers_pma ehma nama nma pwma reflex sinwma sqwma srwma swma supersmoother supersmoother_3_pole tilson trendflex trima wilders vpwma vwma dma epma sama maaq buff_averages frama volatility_adjusted_ma vwap tradjema uma volume_adjusted_ma mama mwdx hwma".split()
)
#: Moving averages whose parameters include no period that stands for them.
WITHOUT_PERIOD = ("tradjema", "uma", "volume_adjusted_ma", "hwma", "mama", "mwdx", "vwap")
ALIASES = {"highpass2": "highpass_2_pole", "vama": "volume_adjusted_ma"}


class NoMovingAverage(ValueError):
    """No moving average has this name."""


class NotPeriodBased(ValueError):
    """A moving average without a period was asked for by one."""


def _period_key(op: Operator) -> str | None:
    if op.name in WITHOUT_PERIOD:
        return None
    return next((k for k in ("period", "length", "window", "warmup_bars", "hull_length", "base_period", "fast_period") if k in op.params), None)


def ma(df: DataFrame, ma_type: str, period: int | None = None, **how: Any) -> DataFrame:
    """A moving average by name, any case, with further parameters of its own."""
    name = ALIASES.get(ma_type.lower(), ma_type.lower())
    if name not in MOVING_AVERAGES:
        raise NoMovingAverage(f"there is no moving average {ma_type!r}")
    op = operator(name)
    if period is not None:
        key = _period_key(op)
        if key is None:
            raise NotPeriodBased(f"{name} has no period")
        how[key] = period
    return apply(df, name, **how)


def ma_batch(df: DataFrame, ma_type: str, period_range: tuple[int, int, int], **how: Any) -> DataFrame:
    """A sweep of a moving average's period."""
    name = ALIASES.get(ma_type.lower(), ma_type.lower())
    if name not in MOVING_AVERAGES:
        raise NoMovingAverage(f"there is no moving average {ma_type!r}")
    if (key := _period_key(operator(name))) is None:
        raise NotPeriodBased(f"{name} has no period to sweep")
    return sweep(df, name, {key: period_range}, **how)


def list_moving_averages(spark: SparkSession) -> DataFrame:
    """Names and what they can do, as a small table."""
    rows = []
    for n in MOVING_AVERAGES:
        op = operator(n)
        rows.append((n, len(op.inputs) > 1, _period_key(op) is not None, len(op.outputs) == 1, op.native))
    return spark.createDataFrame(rows, "name string, requires_candles boolean, period_based boolean, single_output boolean, native boolean")


def ma_param_schema(ma_type: str) -> list[dict[str, Any]]:
    """Further parameters of a moving average: key, kind, default."""
    op = operator(ALIASES.get(ma_type.lower(), ma_type.lower()))
    key = _period_key(op)
    return [{"key": k, "kind": type(v).__name__, "default": v} for k, v in op.params.items() if k != key]
