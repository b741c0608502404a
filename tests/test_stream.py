"""Streams give what batches give."""

import math

import pytest
from pyspark.sql import functions as F
from test_operators import bars, column, near

from candlewick.operators import operator
from candlewick.plans import runner
from candlewick.sources.candles import source
from candlewick.streaming import averages
from candlewick.streaming.stream import ma_stream, stream, stream_batches


def _files(spark, tmp_path):
    b = bars(spark, [50 + 10 * math.sin(i / 3) + i % 5 for i in range(90)], "a").union(bars(spark, [20 + i % 9 for i in range(90)], "b"))
    parts = [b.where(f"unix_timestamp(ts) / 3600 >= {k} AND unix_timestamp(ts) / 3600 < {k + 30}") for k in (0, 30, 60)]
    for k, p in enumerate(parts):
        p.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return b, b.schema


def _source(spark, tmp_path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


@pytest.mark.parametrize("name", ["ema", "rsi", "atr", "macd", "adx", "supertrend", "obv", "ad"])
def test_folds(spark, tmp_path, name):
    b, schema = _files(spark, tmp_path)
    q = stream(_source(spark, tmp_path, schema), name).writeStream.format("memory").queryName(f"out_{name}").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got, want = spark.table(f"out_{name}"), runner.apply(b, name, names={o: o for o in operator(name).outputs})
    for o in operator(name).outputs:
        near([None if v is None or v != v else v for v in column(got, o)], column(want, o))


@pytest.mark.parametrize("name", ["sma", "alma", "aroon", "hma"])
def test_windows(spark, tmp_path, name):
    b, schema = _files(spark, tmp_path)
    each = stream_batches(name, f"{tmp_path}/tail", lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{i}"))
    q = _source(spark, tmp_path, schema).writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got, want = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out"), runner.apply(b, name)
    for c in set(want.columns) - set(b.columns):
        near(column(got, c), column(want, c))


def test_names(spark, tmp_path):
    _, schema = _files(spark, tmp_path)
    assert ma_stream(_source(spark, tmp_path, schema), "EMA", 5).isStreaming
    with pytest.raises(ValueError):
        ma_stream(_source(spark, tmp_path, schema), "nothing", 5)
    with pytest.raises(ValueError):
        stream(_source(spark, tmp_path, schema), "aroon")
    with pytest.raises(runner.NotPeriodBased):
        ma_stream(_source(spark, tmp_path, schema), "vwap", 5)


def test_all_averages_stream(spark, tmp_path):
    _, schema = _files(spark, tmp_path)
    source = _source(spark, tmp_path, schema)
    assert all(ma_stream(source, n).isStreaming for n in runner.MOVING_AVERAGES)


GAPS = [50 + 10 * math.sin(i / 3) + i % 5 if i not in (3, 57) else None for i in range(100)]


def _steps(op, name, rows, params):
    step = averages.step(name, **params)
    outs = []
    for r in rows:
        ins = [r["ts"].timestamp() if i == "ts" else math.nan if r[i] is None else r[i] for i in op.inputs]
        y = step(*ins)
        outs.append([None if v != v else v for v in (y if isinstance(y, tuple) else (y,))])
    return outs


@pytest.mark.parametrize("name", averages.STEPS)
def test_steps_are_the_windows(spark, name):
    op = operator(name)
    b = bars(spark, GAPS, "a")
    for given in [{}] + [{k: 4} for k in ("period", "length") if k in op.params]:
        params = op.checked(given)
        want = runner.apply(b, name, names={o: o for o in op.outputs}, **given)
        rows = b.select("ts", *(source(b, op.source(i)).cast("double").alias(i) for i in op.inputs if i != "ts")).orderBy("ts").collect()
        got = _steps(op, name, rows, params)
        for k, o in enumerate(op.outputs):
            near([g[k] for g in got], column(want, o))


@pytest.mark.parametrize("name", ["sma", "ema", "vwap"])
def test_late_bars_wait_for_the_watermark(spark, tmp_path, name):
    b = bars(spark, [50 + 10 * math.sin(i / 3) for i in range(60)], "a").union(bars(spark, [20 + i % 9 for i in range(60)], "b"))
    b = b.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))  # a watermark starts at the epoch
    hour = "unix_timestamp(ts) / 3600"
    # every third bar comes a file later than the others
    for k in range(4):
        at = f"cast(floor({hour} / 15) + if({hour} % 3 = 0, 1, 0) AS int) = {k + 1}"
        b.where(at).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    bars(spark, [1.0], "c").selectExpr("series", "ts + INTERVAL 114 HOURS AS ts", "open", "high", "low", "close", "volume").union(b.where(f"cast(floor({hour} / 15) + if({hour} % 3 = 0, 1, 0) AS int) >= 5")).coalesce(1).write.parquet(f"{tmp_path}/in/4")
    q = stream(_source(spark, tmp_path, b.schema), name, delay="24 hours").writeStream.format("memory").queryName(f"late_{name}").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got, want = spark.table(f"late_{name}").where("series <> 'c'"), runner.apply(b, name)
    near([None if v is None or v != v else v for v in column(got, "values")], column(want, name))
