"""Candles: from CSV, from ticks, and the prices derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: CSV columns by place: the close comes before high and low.
CSV = T.StructType([T.StructField("timestamp", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "close", "high", "low", "volume"))])
DERIVED = {
    "hl2": lambda c: (c("high") + c("low")) / 2,
    "hlc3": lambda c: (c("high") + c("low") + c("close")) / 3,
    "ohlc4": lambda c: (c("open") + c("high") + c("low") + c("close")) / 4,
    "hlcc4": lambda c: (c("high") + c("low") + 2 * c("close")) / 4,
}
DERIVED["hlcc"] = DERIVED["hlcc4"]


def read_csv(spark: SparkSession, path: str, series: str = "series") -> DataFrame:
    """Candle files with a header, columns by place; a value that is no number ends the read."""
    first = spark.read.text(path).first()
    if first is None or len(first[0].split(",")) < 2:
        raise ValueError("a candle file has at least a timestamp and a close")
    schema = T.StructType([CSV["timestamp"], CSV["close"]]) if len(first[0].split(",")) == 2 else CSV
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, mode="FAILFAST")
    for name in ("open", "high", "low", "volume"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("double"))
    ts = F.timestamp_millis("timestamp")
    return df.select(F.lit(series).alias("series"), ts.alias("ts"), "open", "high", "low", "close", "volume")


def source(df: DataFrame, name: str, lenient: bool = False) -> Column:
    """A column of df, or a price derived from its columns. An unknown name is an error;
    leniently it stands for close."""
    by_lower = {c.lower(): c for c in df.columns}
    if name in df.columns or name.lower() in by_lower:
        return F.col(f"`{name if name in df.columns else by_lower[name.lower()]}`")
    if name.lower() in DERIVED:
        return DERIVED[name.lower()](lambda c: source(df, c))
    if lenient:
        return source(df, "close")
    raise ValueError(f"there is no source {name!r}; columns: {', '.join(df.columns)}; derived: {', '.join(DERIVED)}")


def candles(ticks: DataFrame, series: Column, bucket: Column, value: str, order: Sequence[str], volume: Column | None = None) -> DataFrame:
    """Ticks to bars: one partial aggregation, so only one row a bar and task is shuffled."""
    key = F.struct(*order)
    return ticks.groupBy(series.alias("series"), bucket.alias("ts")).agg(
        F.min_by(value, key).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, key).alias("close"), (volume if volume is not None else F.count(value).cast("double")).alias("volume")
    )


def resample(bars: DataFrame, unit: str) -> DataFrame:
    """Bars of a longer unit (minute, hour, day, week, month)."""
    return bars.groupBy("series", F.date_trunc(unit, "ts").alias("ts")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )
