"""The registered queries of the library's own operators, and their SQL.

Bars are built from the test tables: hourly ones from events (series: event_type), daily
ones from orders (series: o_orderpriority) for operators with long windows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import OPERATORS
from ..sources.candles import candles
from . import runner
from .machines import MACHINES
from .oracles import DAILY, EXPRESSIONS, HOURLY, sql_of, sweep_sql

DIGITS = 6
#: Places for operators some of whose values lie on a rounding boundary at DIGITS.
COARSE = {"fosc": 4, "nadaraya_watson_envelope": 3, "ehlers_pma": 8}
#: Operators that need more bars than the hourly tables have.
LONG = {"nadaraya_watson_envelope", "sama", "prb", "rsmk", "damiani_volatmeter", "halftrend", "otto", "volatility_adjusted_ma", "decycler", "dec_osc", "bandpass", "frama", "emd"}


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL")
    return candles(events, F.col("event_type"), F.date_trunc("hour", "ts"), "value", ["ts", "event_id"], F.sum("value"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return candles(orders, F.col("o_orderpriority"), F.date_trunc("day", "o_orderdate"), "o_totalprice", ["o_orderdate", "o_orderkey"], F.count("o_totalprice").cast("double"))


def _rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles below 1e9 to so many places; minus zero to zero."""
    shown = lambda c: F.when(F.abs(c) < 1e9, F.round(c, digits) + F.lit(0.0)).otherwise(F.col(c))
    return df.select(*(shown(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def one_shot(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = (daily if name in LONG else hourly)(spark, sf_dir)
    op = OPERATORS[name]
    out = runner.apply(bars, name, names={o: o for o in op.outputs})
    return _rounded(out.select("series", "ts", *op.outputs), COARSE.get(name, DIGITS))


def sma_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(runner.sweep(hourly(spark, sf_dir), "sma", {"period": (5, 45, 5)}))


def double_alma_crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each series and pair of ALMA periods: how often the fast one crosses the slow one,
    and the sum of the next bar's changes while it is above."""
    bars = hourly(spark, sf_dir)
    periods = [5, 10, 15, 20, 30, 40, 50]
    wide = runner.apply_all(bars, [("alma", {"period": p}, {"values": f"a{p}"}) for p in periods] + [("mom", {"period": 1}, {"values": "change"})])
    pairs = [(f, s) for f in periods for s in periods if f < s]
    rows = F.array(*(F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow"), (F.col(f"a{f}") > F.col(f"a{s}")).alias("up")) for f, s in pairs))
    from pyspark.sql import Window

    w = Window.partitionBy("series", "fast", "slow").orderBy("ts")
    r = wide.select("series", "ts", "change", F.explode(rows).alias("r")).select("series", "ts", "change", "r.*").withColumn("was", F.lag("up").over(w))
    out = r.groupBy("series", "fast", "slow").agg(F.count(F.when(F.col("up") != F.col("was"), 1)).alias("crossings"), F.sum(F.when(F.col("was"), F.col("change")).otherwise(0.0)).alias("gain"))
    return out.select("series", "fast", "slow", "crossings", (F.round("gain", 4) + F.lit(0.0)).alias("gain"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several operators of the hourly bars in one plan."""
    jobs = [("sma", {}, {"values": "sma"}), ("alma", {}, {"values": "alma"}), ("rsi", {}, {"values": "rsi"}), ("atr", {}, {"values": "atr"})]
    return _rounded(runner.apply_all(hourly(spark, sf_dir), jobs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: partial(one_shot, n) for n in OPERATORS}
    return out | {"candles_hourly": lambda s, d: _rounded(hourly(s, d)), "candles_daily": lambda s, d: _rounded(daily(s, d)), "sma_sweep": sma_sweep, "double_alma_crossover": double_alma_crossover, "list_moving_averages": lambda s, d: runner.list_moving_averages(s)}


def oracle_sql() -> dict[str, str]:
    out = {n: sql_of(layers, DAILY if n in LONG else HOURLY, OPERATORS[n].outputs, COARSE.get(n, DIGITS)) for n, layers in (EXPRESSIONS | MACHINES).items()}
    show = "series, ts, " + ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in ("open", "high", "low", "close", "volume"))
    return out | {"candles_hourly": f"WITH bars AS ({HOURLY}) SELECT {show} FROM bars", "candles_daily": f"WITH bars AS ({DAILY}) SELECT {show} FROM bars"} | sweep_sql(HOURLY, DIGITS)
