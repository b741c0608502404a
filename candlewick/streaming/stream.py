"""Operators on streams.

Folds, and the window averages as steps of their own (`averages`), keep one step for each
series in the state store: a micro-batch's bars go through it in the order of time. Bars that
come out of order can wait for the watermark. Other native operators look back on a fixed number of bars: the last ones of
each series are kept as a small table beside the checkpoint, put in front of the next
micro-batch, and the same window plan as in batch runs over both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.registry import Operator, operator
from ..plans import runner
from ..sources.candles import source
from . import averages

#: Native operators that sum from the first bar on run as these folds on a stream.
TWINS = {"ad": "stream_ad", "obv": "stream_obv", "wad": "stream_wad", "vpt": "stream_vpt", "emv": "stream_emv"}


def _cumulative(name: str):
    """Steps of the cumulative operators."""
    nan = float("nan")

    def ad():
        y = 0.0

        def step(h, l, c, v):  # noqa: E741
            nonlocal y
            y += ((c - l) - (h - c)) / (h - l) * v if h != l else 0.0
            return y

        return step

    def obv():
        y, c0 = 0.0, nan

        def step(c, v):
            nonlocal y, c0
            y += v if c > c0 else -v if c < c0 else 0.0
            c0 = c
            return y

        return step

    def wad():
        y, c0 = 0.0, nan

        def step(h, l, c):  # noqa: E741
            nonlocal y, c0
            y += c - min(l, c0) if c > c0 else c - max(h, c0) if c < c0 else 0.0
            c0 = c
            return y

        return step

    def vpt():
        y, c0 = 0.0, nan

        def step(c, v):
            nonlocal y, c0
            b, c0 = c0, c
            if b != b or not b:
                return nan
            y += (c - b) / b * v
            return y

        return step

    def emv():
        m0 = nan

        def step(h, l, v):  # noqa: E741
            nonlocal m0
            m, b = (h + l) / 2, m0
            m0 = m
            return (m - b) / (v / 10000 / (h - l)) if h != l and v else nan

        return step

    return {"ad": ad, "obv": obv, "wad": wad, "vpt": vpt, "emv": emv}[name]


def _as_fold(op: Operator) -> Operator:
    from dataclasses import replace

    return replace(op, make=_cumulative(op.name), native=False) if op.native else op


class _Window:
    """A window average's step, which sees bars with missing values too."""

    def __init__(self, name: str, params: dict[str, Any]):
        self.step = averages.step(name, **params)

    def __call__(self, row: tuple) -> tuple:
        out = self.step(*row)
        return out if isinstance(out, tuple) else (out,)


def stream(bars: DataFrame, name: str, *, series: str = "series", ts: str = "ts", columns: dict[str, str] | None = None, delay: str | None = None, **params: Any) -> DataFrame:
    """A streaming DataFrame of (series, ts, outputs) of a recursive or cumulative operator, or
    of a window average.

    The state is the pickled step, the time of its last bar and the bars that wait. Without
    `delay` the bars of one micro-batch are sorted and go through the step at once; a bar not
    later than the last one seen has come too late and is left out. With `delay` (an interval)
    bars wait until the watermark, that far behind the latest bar of all series, has passed
    them, so bars in any order within it give what they give in order; of bars of one time
    the first to come counts. Bars that the watermark never passes are not shown, nor
    are bars without a time and, as a watermark starts there, with `delay` those of 1970-01-01
    00:00 UTC or before."""
    op = operator(name)
    window = op.native and op.name in averages.STEPS
    if op.native and not window and op.name not in TWINS:
        raise ValueError(f"{name} looks back on a fixed number of bars; use stream_batches")
    op, params = op if window else _as_fold(op), op.checked(params)
    seconds = (F.unix_micros(F.col(ts)) / 1e6).alias("seconds")
    ins = [(seconds if i == "ts" else source(bars, (columns or {}).get(i, op.source(i))).cast("double")).alias(f"i{k}") for k, i in enumerate(op.inputs)]
    slim = bars.select(F.col(series).alias("series"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts)).alias("us"), *ins)
    slim = slim.where(F.col("ts").isNotNull())
    if delay:
        slim = slim.withWatermark("ts", delay)
    series_type = slim.schema["series"].dataType
    out = T.StructType([T.StructField("series", series_type), T.StructField("ts", T.TimestampType()), *(T.StructField(o, T.DoubleType()) for o in op.outputs)])
    state_type = T.StructType([T.StructField("step", T.BinaryType()), T.StructField("last", T.LongType()), T.StructField("waiting", T.BinaryType())])
    names = [f"i{k}" for k in range(len(op.inputs))]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = [] if state.hasTimedOut else list(batches)
        step, last, waiting = (cloudpickle.loads(state.get[0]), state.get[1], cloudpickle.loads(state.get[2])) if state.exists else (_Window(op.name, params) if window else runner.runner(op, params), None, None)
        pdf = pd.concat([*([] if waiting is None else [waiting]), *new]).sort_values("us", kind="stable")
        if last is not None:
            pdf = pdf[pdf["us"] > last]
        rest = None
        if delay:
            pdf = pdf.drop_duplicates("us")
            passed = pdf["us"] <= state.getCurrentWatermarkMs() * 1000
            pdf, rest = pdf[passed], pdf[~passed]
        rows = [step(r) for r in pdf[names].astype(float).itertuples(index=False, name=None)]
        last = int(pdf["us"].iloc[-1]) if len(pdf) else last
        if delay or len(pdf):
            state.update((cloudpickle.dumps(step), last, cloudpickle.dumps(rest)))
        if rest is not None and len(rest):
            state.setTimeoutTimestamp(max(int(rest["us"].iloc[0]) // 1000, state.getCurrentWatermarkMs()) + 1)
        got = pd.DataFrame(rows, columns=list(op.outputs), dtype=float)
        got.insert(0, "ts", pdf["ts"].to_numpy())
        got.insert(0, "series", key[0])
        yield got

    return slim.groupBy("series").applyInPandasWithState(run, out, state_type, "append", GroupStateTimeout.EventTimeTimeout if delay else GroupStateTimeout.NoTimeout)


def lookback(op: Operator, params: dict[str, Any]) -> int:
    """Bars that a native operator's value depends on."""
    n = op.memory(**params) if op.memory else None
    if n is None:
        raise ValueError(f"{op.name} with these parameters has no bounded memory")
    return n


def stream_batches(name: str, tail_path: str, sink: Callable[[DataFrame, int], None], *, series: str = "series", ts: str = "ts", **params: Any) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: native operators over the kept bars and the new ones.

    Each micro-batch writes the bars that the next one needs to tail_path/<batch id>; a
    repeated batch reads the same ones again, so results do not depend on failures."""
    op = operator(name)
    checked = op.checked(params)
    keep = lookback(op, checked)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_new", F.lit(True))
        fs = spark._jvm.org.apache.hadoop.fs.Path(tail_path).getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{tail_path}/{batch_id - 1}")):
            rows = spark.read.schema(batch.schema).parquet(f"{tail_path}/{batch_id - 1}").withColumn("_new", F.lit(False)).unionByName(rows)
        sink(runner.apply(rows, name, series=series, ts=ts, **params).where("_new").drop("_new"), batch_id)
        last = F.row_number().over(Window.partitionBy(series).orderBy(F.desc(ts)))
        rows.withColumn("_r", last).where(F.col("_r") <= keep).select(*batch.columns).write.mode("overwrite").parquet(f"{tail_path}/{batch_id}")

    return each


def ma_stream(bars: DataFrame, ma_type: str, period: int | None = None, **how: Any) -> DataFrame:
    """A moving average of a stream by name, any of those that `ma` takes; an unknown name is
    an error, and so is a period for one that has none."""
    name = runner.ALIASES.get(ma_type.lower(), ma_type.lower())
    if name not in runner.MOVING_AVERAGES:
        raise runner.NoMovingAverage(f"there is no moving average {ma_type!r}")
    if period is not None:
        if (key := runner._period_key(operator(name))) is None:
            raise runner.NotPeriodBased(f"{name} has no period")
        how[key] = period
    return stream(bars, name, **how)
