"""Hand-worked values, edges, and properties that hold for whole families."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candlewick.functions import steps, weights
from candlewick.operators import OPERATORS, operator
from candlewick.plans import runner
from candlewick.sources.candles import read_csv, source

WEIGHTED = ["wma", "alma", "cwma", "ehma", "fwma", "pwma", "sinwma", "sqwma", "srwma", "swma", "trima", "vpwma"]


def bars(spark, closes, series="s"):
    rows = [(series, i, *(None if c is None else (c - 1.0, c + 2.0, c - 2.0, float(c)))) if c is not None else (series, i, None, None, None, None) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "series string, n long, open double, high double, low double, close double")
    return df.selectExpr("series", "timestamp_seconds(n * 3600) AS ts", "open", "high", "low", "close", "cast(n % 7 + 1 AS double) AS volume")


def column(df, name):
    return [r[name] for r in df.orderBy("series", "ts").collect()]


def near(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (got, want)


def test_there_are_all_operators():
    assert len([n for n in OPERATORS if n != "laguerre"]) == 191


def test_fibonacci_weights(spark):
    near(column(runner.apply(bars(spark, [1, 2, 3, 4, 5]), "fwma"), "fwma"), [None] * 4 + [46 / 12])
    got = column(runner.apply(bars(spark, range(10, 101, 10)), "fwma", period=4), "fwma")
    assert math.isclose(got[3], 30.0) and math.isclose(got[4], 40.0)


def test_nearest_rank(spark):
    b = bars(spark, range(1, 11))
    for p, at4, at5 in ((50.0, 3, 4), (25.0, 1, 2), (75.0, 4, 5), (100.0, 5, 6)):
        got = column(runner.apply(b, "percentile_nearest_rank", length=5, percentage=p), "percentile_nearest_rank")
        assert got[:4] == [None] * 4 and got[4:6] == [at4, at5]


def test_rolling_extremes(spark):
    b = bars(spark, [2, 5, 3, 8, 1])
    near(column(runner.apply(b, "midpoint", period=2), "midpoint"), [None, 3.5, 4, 5.5, 4.5])


def test_atr_needs_its_bars(spark):
    got = column(runner.apply(bars(spark, [1, 2, 3, 4, 5]), "atr", length=3), "atr")
    assert got[:2] == [None, None] and all(v is not None for v in got[2:])


def test_dec_osc_and_its_sweep(spark):
    b = bars(spark, [100 + 3 * math.sin(i) + i for i in range(15)])
    one = column(runner.apply(b, "dec_osc", hp_period=10, k=1.0), "dec_osc")
    assert one[:2] == [None, None] and one[2] is not None
    swept = runner.sweep(b, "dec_osc", {"hp_period": [10, 20], "k": [0.5, 1.0, 1.5]})
    near(column(runner.for_params(swept, hp_period=10, k=1.0), "values"), one)


def test_correl_hl_of_flat_prices(spark):
    """0 where high, low or both stand still; Pearson's r elsewhere, of tiny moves too; null in short or broken windows."""
    high = [5, 5, 5, 5, 6, 8, 7, 9, 9, 9, 9, None, 9, 8, 7]
    low = [1, 2, 1, 3, 2, 4, 4, 4, 4, 4, 4, 4, 3, 2, 1]
    tiny = [k * k % 5 * 1e-90 for k in range(9)]
    pairs = {"a": (high, low), "b": (low, low[::-1]), "c": (tiny, tiny[::-1])}
    rows = [(s, i, *(None if v is None else float(v) for v in both)) for s, (hs, ls) in pairs.items() for i, both in enumerate(zip(hs, ls))]
    df = spark.createDataFrame(rows, "series string, ts long, high double, low double")

    def r(hs, ls):
        if None in hs or len(hs) < 3:
            return None
        if len(set(hs)) == 1 or len(set(ls)) == 1:
            return 0.0
        a, b = ([v - sum(xs) / 3 for v in xs] for xs in (hs, ls))
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(v * v for v in a)) / math.sqrt(sum(v * v for v in b))

    want = [r(hs[max(0, i - 2) : i + 1], ls[max(0, i - 2) : i + 1]) for hs, ls in pairs.values() for i in range(len(hs))]
    near(column(runner.apply(df, "correl_hl", period=3), "correl_hl"), want)
    assert want[2] == want[3] == want[8] == want[9] == 0.0 and want[11:14] == [None] * 3


def test_derived_sources(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(90.0, 130.0, 70.0, 110.0)], "open double, high double, low double, close double")
    got = df.select(*(source(df, s).alias(s) for s in ("hl2", "hlc3", "ohlc4", "hlcc4", "HLCC"))).first()
    near(list(got), [100, 310 / 3, 100, 105, 105])
    with pytest.raises(ValueError):
        source(df, "nothing")
    assert df.select(source(df, "nothing", lenient=True).alias("x")).first()[0] == 110.0
    assert df.select(F.col("close")).first()[0] == 110.0


def test_csv_puts_close_before_high(spark, tmp_path):
    (tmp_path / "c.csv").write_text("timestamp,open,close,high,low,volume\n1000,1,2,3,0.5,9\n2000,2,3,4,1,8\n")
    got = read_csv(spark, str(tmp_path / "c.csv")).orderBy("ts").collect()
    assert (got[0].close, got[0].high, got[0].low, got[0].volume) == (2.0, 3.0, 0.5, 9.0)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edges(spark, name):
    """Empty tables, one bar, gaps, and columns of other names do no harm."""
    b = bars(spark, [])
    assert runner.apply(b, name).count() == 0
    rows = runner.apply(bars(spark, [5.0]).union(bars(spark, [1.0, None, 3.0, None], "t")).selectExpr("*", "1 AS values", "2 AS period", "3 AS __x"), name, names={o: f"out_{o}" for o in operator(name).outputs}).collect()
    assert len(rows) == 5


@pytest.mark.parametrize("name", ["sma", "ema", "rsi", "atr", "macd", "supertrend", "alma", "kama", "adx"])
def test_series_do_not_mix(spark, name):
    a, c = [50 + 10 * math.sin(i / 3) for i in range(60)], [80 + 5 * math.cos(i / 5) for i in range(60)]
    out = operator(name).outputs[0]
    names = {o: o for o in operator(name).outputs}
    both = runner.apply(bars(spark, a, "a").union(bars(spark, c, "c")), name, names=names)
    near(column(both.where("series = 'a'"), out), column(runner.apply(bars(spark, a, "a"), name, names=names), out))


def test_joint_run_is_each_run(spark):
    b = bars(spark, [50 + 10 * math.sin(i / 3) for i in range(60)])
    jobs = [(n, {}, {o: f"{n}_{o}" for o in operator(n).outputs}) for n in ("sma", "rsi", "macd", "bollinger_bands", "atr")]
    joint = runner.apply_all(b, jobs)
    for n, _, names in jobs:
        one = runner.apply(b, n, names=names)
        for c in names.values():
            near(column(joint, c), column(one, c))
    plan = joint._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and plan.count("MapInArrow") == 1


def test_parameters_are_checked_at_once(spark):
    b = bars(spark, [1, 2, 3])
    for bad in ({"period": 0}, {"period": 2.5}, {"what": 1}):
        with pytest.raises((ValueError, TypeError)):
            runner.apply(b, "sma", **bad)
    with pytest.raises(ValueError):
        runner.apply(b, "nothing")
    with pytest.raises(ValueError):
        runner.apply(bars(spark, [None, None]), "sma", checked=True)


def test_grids():
    assert runner.expand_grid((5, 15, 5)) == [5, 10, 15] and runner.expand_grid((15, 5, 5)) == [15, 10, 5]
    assert runner.expand_grid((5, 9, 0)) == [5] and runner.expand_grid((5, 5, 3)) == [5] and runner.expand_grid(7) == [7]


def test_sweep_rows_are_one_shots(spark):
    x = [float("nan")] * 5 + [math.sin(0.001 * i) + 0.0002 * i for i in range(5, 200)]
    b = bars(spark, [None if v != v else v for v in x])
    for name in ("sma", "ema", "wma"):
        swept = runner.ma_batch(b, name, (5, 15, 5))
        for p in (5, 10, 15):
            near(column(runner.for_params(swept, period=p), "values"), column(runner.ma(b, name, p), name))


def test_moving_averages_by_name(spark):
    b = bars(spark, [50 + 10 * math.sin(i / 3) for i in range(120)])
    for n in runner.MOVING_AVERAGES:
        assert runner.ma(b, n.upper()).count() == 120
    for name in runner.WITHOUT_PERIOD:
        with pytest.raises(runner.NotPeriodBased):
            runner.ma(b, name, 5)
        with pytest.raises(runner.NotPeriodBased):
            runner.ma_batch(b, name, (5, 10, 5))
    for call in (lambda: runner.ma(b, "nothing"), lambda: runner.ma_batch(b, "nothing", (5, 10, 5))):
        with pytest.raises(runner.NoMovingAverage):
            call()
    assert runner.list_moving_averages(spark).count() == len(runner.MOVING_AVERAGES) == 55
    assert {"key": "offset", "kind": "float", "default": 0.85} in runner.ma_param_schema("alma")


def test_a_fold_inside_a_native_operator(spark):
    b = bars(spark, [50 + 10 * math.sin(i / 3) for i in range(80)])
    got = runner.apply(b, "bollinger_bands", matype="ema")
    assert all(v is not None for v in column(got, "bollinger_bands_middle"))


@given(st.integers(1, 100))
@settings(max_examples=30, deadline=None)
def test_weights_sum_to_one(period):
    for n in WEIGHTED:
        assert math.isclose(sum(getattr(weights, n)(period)), 1.0, rel_tol=1e-9)


@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=200), st.integers(1, 50))
@settings(max_examples=50, deadline=None)
def test_means_stay_within_their_values(xs, period):
    sma, ema, rma = steps.Sma(period), steps.EmaMean(period), steps.Rma(period)
    for i, x in enumerate(xs):
        low, top = min(xs[: i + 1]), max(xs[: i + 1])
        for y in (sma(x), ema(x), rma(x)):
            assert y != y or low - 1e-6 * (1 + abs(low)) <= y <= top + 1e-6 * (1 + abs(top))
    if len(xs) >= period:
        assert math.isclose(steps_value(steps.Sma(period), xs), sum(xs[-period:]) / period, rel_tol=1e-9, abs_tol=1e-6)


def steps_value(step, xs):
    for x in xs:
        y = step(x)
    return y


@given(st.floats(1, 1e5), st.sampled_from(["ema", "smma", "dema", "tema", "zlema", "kama", "jma", "hwma", "mwdx", "vidya", "mama", "frama", "sama", "maaq"]))
@settings(max_examples=40, deadline=None)
def test_constant_in_constant_out(x, name):
    op = operator(name)
    step = op.make(**op.params)
    for _ in range(150):
        y = step(*([x] * len(op.inputs)))
    y = y[0] if isinstance(y, tuple) else y
    assert math.isclose(y, x, rel_tol=1e-6)
