"""Trend, bands, stops and volatility with a finite memory, in the JVM."""

from __future__ import annotations

from math import cos, exp, log, pi, sin

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import native


@native("up", "down", memory=lambda length: length + 1)
def aroon(b, h, l, length=14):  # noqa: E741
    """Over length + 1 bars; of equal extremes the latest counts."""
    top, low = b.let(b.listed(h, length + 1)), b.let(b.listed(l, length + 1))

    def since(a, extreme):
        return F.array_position(F.reverse(a), extreme) - 1

    return {"up": 100 * (1 - since(top, F.array_max(top)) / length), "down": 100 * (1 - since(low, F.array_min(low)) / length)}


@native(memory=lambda length: length + 1)
def aroonosc(b, h, l, length=14):  # noqa: E741
    """Of equal extremes the first counts."""
    top, low = b.let(b.listed(h, length + 1)), b.let(b.listed(l, length + 1))
    d = 100.0 / length * (F.array_position(top, F.array_max(top)) - F.array_position(low, F.array_min(low)))
    return F.greatest(F.lit(-100.0), F.least(F.lit(100.0), d)) + F.when(top.isNull() | low.isNull(), F.lit(None)).otherwise(0.0)


@native("bulls", "bears", memory=lambda period, mode: 2 * period)
def aso(b, o, h, l, c, period=10, mode=0):  # noqa: E741
    def pair(top, low, first):
        r = F.when(top == low, F.lit(1.0)).otherwise(top - low)
        return 50 * ((c - low) + (top - first)) / r, 50 * ((top - c) + (first - low)) / r

    gh, gl, go = b.let(b.max(h, period)), b.let(b.min(l, period)), b.let(b.lag(o, period - 1))
    bull_in, bear_in = pair(h, l, o)
    bull_group, bear_group = pair(gh, gl, go)
    known = gh.isNotNull() & gl.isNotNull() & go.isNotNull()
    bull = b.let(F.when(known, {0: (bull_in + bull_group) / 2, 1: bull_in, 2: bull_group}[mode]))
    bear = b.let(F.when(known, {0: (bear_in + bear_group) / 2, 1: bear_in, 2: bear_group}[mode]))
    rows = b.rows(period)  # the mean is over as many as there are, at the start
    return {"bulls": F.when(known, F.avg(bull).over(rows)), "bears": F.when(known, F.avg(bear).over(rows))}


def deviation_of(b, x, period, devtype, middle=None):
    """0 standard, 1 mean absolute, 2 median absolute, 3 mode deviation of the last p bars."""
    if devtype == 0:
        return b.std(x, period)
    listed = b.let(b.listed(x, period))
    if devtype == 1:
        mean = b.let(b.mean(x, period))
        return F.aggregate(F.transform(listed, lambda v: F.abs(v - mean)), F.lit(0.0), lambda s, v: s + v) / period
    if devtype == 2:
        mid = b.let(_median(F.array_sort(listed), period))
        return _median(F.array_sort(F.transform(listed, lambda v: F.abs(v - mid))), period)
    # the most frequent value, the least of them if several are
    counted = F.transform(listed, lambda v: F.struct((-F.size(F.filter(listed, lambda w: w == v))).alias("n"), v.alias("v")))
    mode = b.let(F.array_min(counted)["v"])
    return F.sqrt(F.aggregate(F.transform(listed, lambda v: (v - mode) * (v - mode)), F.lit(0.0), lambda s, v: s + v) / period)


def _median(ordered, period):
    half = period // 2
    return F.element_at(ordered, half + 1) if period % 2 else (F.element_at(ordered, half) + F.element_at(ordered, half + 1)) / 2


@native("upper", "middle", "lower", memory=lambda period, devup, devdn, matype, devtype: period if matype == "sma" else None)
def bollinger_bands(b, x, period=20, devup=2.0, devdn=2.0, matype="sma", devtype=0):
    middle = b.ma(x, matype, period)
    dev = b.let(deviation_of(b, x, period, devtype))
    return {"upper": middle + devup * dev, "middle": middle, "lower": middle - devdn * dev}


@native(memory=lambda period, devup, devdn, matype, devtype: period if matype == "sma" else None)
def bollinger_bands_width(b, x, period=20, devup=2.0, devdn=2.0, matype="sma", devtype=0):
    return (devup + devdn) * deviation_of(b, x, period, devtype) / b.ma(x, matype, period)


@native(memory=lambda period, scalar, drift: None if drift > 1 else period + 1)
def chop(b, h, l, c, period=14, scalar=100.0, drift=1):  # noqa: E741
    reach = b.let(b.true_range(h, l, c))
    atr = reach if drift == 1 else b.fold("wilders", [reach], period=drift)[0]
    total, spread = b.sum(b.let(atr), period), b.max(h, period) - b.min(l, period)
    return F.when((total > 0) & (spread > 0), scalar * F.log2(total / spread) / (log(period) / log(2)))


@native("real", "imag", "angle", "state", memory=lambda period, threshold: period + 3)
def correlation_cycle(b, x, period=20, threshold=9.0):
    """Correlation of the bars before this one with a cosine and a negative sine."""
    before = b.let(b.lag(x))
    mean, sd = b.let(b.mean(before, period)), b.let(b.std(before, period))

    def corr(wave):
        m = sum(wave) / period
        dev = (sum((w - m) ** 2 for w in wave) / period) ** 0.5
        s = sum((b.lag(before, k) * w for k, w in enumerate(wave)), F.lit(0.0)) / period
        return b.let(F.when(mean.isNotNull(), F.when((sd > 0) & F.lit(dev > 0), (s - mean * m) / (sd * (dev or 1.0))).otherwise(0.0)))

    re, im = corr([cos(2 * pi * k / period) for k in range(period)]), corr([-sin(2 * pi * k / period) for k in range(period)])
    a = F.when(im == 0, F.lit(0.0)).otherwise(F.degrees(F.atan(re / im) + pi / 2))
    angle = b.let(F.when(re.isNotNull(), F.when(im > 0, a - 180).otherwise(a)))
    last = b.lag(angle)
    state = F.when(F.abs(angle - last) < threshold, F.when(angle >= 0, F.lit(1.0)).otherwise(-1.0)).otherwise(0.0)
    return {"real": re, "imag": im, "angle": angle, "state": F.when(last.isNotNull() & angle.isNotNull(), state)}


@native(memory=lambda period, **_: 3 * period + 3)
def devstop(b, h, l, period=20, mult=0.0, devtype=0, direction="long", ma_type="sma"):  # noqa: E741
    two = b.let(F.when(b.lag(h).isNotNull(), F.greatest(h, b.lag(h)) - F.least(l, b.lag(l))))
    reach = b.ma(two, ma_type, period) + mult * deviation_of(b, two, period, devtype)
    base = b.let(h - reach if direction == "long" else l + reach)
    rows = b.rows(period)  # the extreme is over as many as there are, at the start
    return F.when(base.isNotNull(), (F.max(base) if direction == "long" else F.min(base)).over(rows))


@native("upper", "middle", "lower", memory=lambda period: period)
def donchian(b, h, l, period=20):  # noqa: E741
    top, low = b.max(h, period), b.min(l, period)
    return {"upper": top, "middle": (top + low) / 2, "lower": low}


@native(memory=lambda period, mult, direction, ma_type: period if ma_type == "sma" else None)
def kaufmanstop(b, h, l, period=22, mult=2.0, direction="long", ma_type="sma"):  # noqa: E741
    reach = mult * b.ma(b.let(h - l), ma_type, period)
    return l - reach if direction == "long" else h + reach


@native("upper", "middle", "lower", memory=lambda fast_period, slow_period, devup, devdn, fast_ma_type, slow_ma_type: 2 * max(fast_period, slow_period) + 1 if (fast_ma_type, slow_ma_type) == ("sma", "sma") else None)
def mab(b, x, fast_period=10, slow_period=50, devup=1.0, devdn=1.0, fast_ma_type="sma", slow_ma_type="sma"):
    fast, slow = b.let(b.ma(x, fast_ma_type, fast_period)), b.let(b.ma(x, slow_ma_type, slow_period))
    rms = b.let(F.sqrt(b.mean(b.let((fast - slow) * (fast - slow)), fast_period)))
    return {"upper": slow + devup * rms, "middle": fast, "lower": slow - devdn * rms}


@native("is_min", "is_max", "last_min", "last_max", ahead="order", memory=lambda order: None)
def minmax(b, h, l, order=3):  # noqa: E741
    """Strict extremes against `order` bars on both sides: it looks ahead."""
    left, right = b.window.rowsBetween(-order, -1), b.window.rowsBetween(1, order)

    def full(x):
        return (F.count(x).over(left) == order) & (F.count(x).over(right) == order) & x.isNotNull()

    low = b.let(F.when(full(l) & (l < F.min(l).over(left)) & (l < F.min(l).over(right)), l))
    top = b.let(F.when(full(h) & (h > F.max(h).over(left)) & (h > F.max(h).over(right)), h))
    upto = b.window.rowsBetween(Window.unboundedPreceding, 0)
    return {"is_min": low, "is_max": top, "last_min": F.last(low, ignorenulls=True).over(upto), "last_max": F.last(top, ignorenulls=True).over(upto)}


@native("upper", "lower", memory=lambda bandwidth, multiplier, lookback: lookback + 500)
def nadaraya_watson_envelope(b, x, bandwidth=8.0, multiplier=3.0, lookback=500):
    w = [exp(-(k * k) / (2 * bandwidth * bandwidth)) for k in range(lookback)]
    s = sum(w)
    y = b.let(b.fir(x, [v / s for v in w]))
    err = multiplier * b.mean(b.let(F.abs(x - y)), 499)
    return {"upper": y + err, "lower": y - err}


@native("r4", "r3", "r2", "r1", "pp", "s1", "s2", "s3", "s4", memory=lambda mode: 1)
def pivot(b, o, h, l, c, mode=3):  # noqa: E741
    """0 standard, 1 Fibonacci, 2 DeMark, 3 Camarilla, 4 Woodie; levels a mode lacks are null."""
    none, r = F.lit(None).cast("double"), h - l
    if mode == 2:
        pp = F.when(c < o, h + 2 * l + c).when(c > o, 2 * h + l + c).otherwise(h + l + 2 * c) / 4
        half = F.when(c < o, h + 2 * l + c).when(c > o, 2 * h + l + c).otherwise(h + l + 2 * c) / 2
        up, down = [half - l], [half - h]
    elif mode == 4:
        pp = (h + l + 2 * o) / 4
        up, down = [2 * pp - l, pp + r, h + 2 * (pp - l)], [2 * pp - h, pp - r, l - 2 * (h - pp)]
        up, down = [*up, up[2] + r], [*down, down[2] - r]
    else:
        pp = (h + l + c) / 3
        if mode == 0:
            up, down = [2 * pp - l, pp + r, h + 2 * (pp - l)], [2 * pp - h, pp - r, l - 2 * (h - pp)]
        elif mode == 1:
            up, down = [pp + k * r for k in (0.382, 0.618, 1.0)], [pp - k * r for k in (0.382, 0.618, 1.0)]
        else:
            up, down = [c + k * r for k in (0.0916, 0.183, 0.275, 0.55)], [c - k * r for k in (0.0916, 0.183, 0.275, 0.55)]
    up, down = up + [none] * (4 - len(up)), down + [none] * (4 - len(down))
    return {"pp": pp} | {f"r{k + 1}": v for k, v in enumerate(up)} | {f"s{k + 1}": v for k, v in enumerate(down)}


@native("main", "upper", "lower", memory=lambda **p: None)
def prb(b, x, smooth_data=True, smooth_period=10, regression_period=100, polynomial_order=2, regression_offset=0, ndev=2.0):
    """Polynomial least squares as a fixed weighted sum of the last n bars."""
    import numpy as np

    y = b.let(b.ma(x, "supersmoother", smooth_period) if smooth_data else x)
    n = regression_period
    t = np.arange(1, n + 1, dtype=float) / n  # scaled for a well-conditioned fit
    design = np.vander(t, polynomial_order + 1, increasing=True)
    at = np.vander(np.array([(n - regression_offset) / n]), polynomial_order + 1, increasing=True)[0]
    w = at @ np.linalg.pinv(design)
    main = b.let(b.fir(y, w[::-1].tolist()))
    sd = ndev * b.std(y, n)
    return {"main": main, "upper": main + sd, "lower": main - sd}


@native(memory=lambda period, scalar: 2 * period)
def ui(b, x, period=14, scalar=100.0):
    top = b.max(x, period)
    drop = b.let(scalar * (x - top) / top)
    return F.sqrt(b.mean(b.let(drop * drop), period))


@native("plus", "minus", memory=lambda period: period + 1)
def vi(b, h, l, c, period=14):  # noqa: E741
    total = b.sum(b.let(F.when(b.lag(c).isNotNull(), b.true_range(h, l, c))), period)
    return {"plus": b.sum(b.let(F.abs(h - b.lag(l))), period) / total, "minus": b.sum(b.let(F.abs(l - b.lag(h))), period) / total}
