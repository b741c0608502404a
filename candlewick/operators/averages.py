"""Moving averages with a finite memory, in the JVM."""

from __future__ import annotations

from math import floor, sqrt

from pyspark.sql import functions as F

from ..functions import weights as W
from .registry import native


@native(memory=lambda period: period)
def sma(b, x, period=9):
    return b.mean(x, period)


@native(memory=lambda period: period)
def wma(b, x, period=30):
    return b.fir(x, W.wma(period))


@native(memory=lambda period, **_: period)
def alma(b, x, period=9, offset=0.85, sigma=6.0):
    return b.fir(x, W.alma(period, offset, sigma))


@native(memory=lambda period: period)
def cwma(b, x, period=14):
    return _late(b, x, W.cwma(period), period)


def _late(b, x, w, bars):
    """A weighted sum that starts only once `bars` bars are there."""
    return F.when(b.valid(x) >= bars, b.fir(x, w))


@native(memory=lambda period: period)
def ehma(b, x, period=14):
    return b.fir(x, W.ehma(period))


@native(memory=lambda period, offset: period + offset + 1)
def epma(b, x, period=11, offset=4):
    return _late(b, x, W.epma(period, offset), period + offset + 1)


@native(memory=lambda period: period)
def fwma(b, x, period=5):
    return b.fir(x, W.fwma(period))


@native(memory=lambda period: period)
def pwma(b, x, period=5):
    return b.fir(x, W.pwma(period))


@native(memory=lambda period: period)
def sinwma(b, x, period=14):
    return b.fir(x, W.sinwma(period))


@native(memory=lambda period: period + 2)
def sqwma(b, x, period=14):
    return _late(b, x, W.sqwma(period), period + 2)


@native(memory=lambda period: period + 2)
def srwma(b, x, period=14):
    return _late(b, x, W.srwma(period), period + 2)


@native(memory=lambda period: period)
def swma(b, x, period=5):
    return b.fir(x, W.swma(period))


@native(memory=lambda period: period)
def trima(b, x, period=30):
    return b.fir(x, W.trima(period))


@native(memory=lambda period, power: period + 2)
def vpwma(b, x, period=14, power=0.382):
    return _late(b, x, W.vpwma(period, power), period + 1)


@native(memory=lambda period: 2 * period)
def hma(b, x, period=5):
    half, root = max(1, period // 2), max(1, floor(sqrt(period)))
    d = b.let(2 * b.fir(x, W.wma(half)) - b.fir(x, W.wma(period)))
    return b.fir(d, W.wma(root))


@native(memory=lambda period, **_: 2 * period)
def cora_wave(b, x, period=20, r_multi=2.0, smooth=True):
    y = b.fir(x, W.cora(period, r_multi))
    return b.fir(b.let(y), W.wma(max(1, round(sqrt(period))))) if smooth else y


@native(memory=lambda period: period + 1)
def jsa(b, x, period=30):
    return (x + b.lag(x, period)) / 2


@native(memory=lambda period: period)
def linreg(b, x, period=14):
    return b.line(x, period)[1]


@native(memory=lambda period: 2 * period + 1)
def edcf(b, x, period=15):
    """Weights are squared distances to the bars before; from bar f + 2p on."""
    w = b.let(sum(((x - b.lag(x, k)) * (x - b.lag(x, k)) for k in range(1, period)), F.lit(0.0)))
    num, den = b.sum(b.let(w * x), period), b.sum(w, period)
    return F.when((b.valid(x) > 2 * period) & (den != 0), num / den)


@native(memory=lambda period: period + 2)
def nma(b, x, period=40):
    """Between x[p-1] and x[p] by the root-weighted absolute differences of logarithms."""
    ln = b.let(F.log(x) * 1000)
    d = b.let(F.abs(ln - b.lag(ln)))
    num = sum((b.lag(d, k) * (sqrt(k + 1) - sqrt(k)) for k in range(period)), F.lit(0.0))
    den = sum((b.lag(d, k) for k in range(period)), F.lit(0.0))
    ratio = b.let(F.when(den == 0, F.lit(0.0)).otherwise(num / den))
    return b.lag(x, period - 1) * ratio + b.lag(x, period) * (1 - ratio)


@native("fast", "slow", memory=lambda fast_period, slow_period: max(fast_period, slow_period))
def buff_averages(b, x, v, fast_period=5, slow_period=20):
    xv = b.let(x * v)

    def mean(p):
        total = b.sum(b.let(F.when(xv.isNotNull(), v)), p)
        return F.when(total != 0, b.sum(xv, p) / total)

    return {"fast": mean(fast_period), "slow": mean(slow_period)}


@native(memory=lambda period: period)
def vwma(b, x, v, period=20):
    xv = b.let(x * v)
    total = b.sum(b.let(F.when(xv.isNotNull(), v)), period)
    return F.when(total != 0, b.sum(xv, period) / total)


@native(x="hlc3")
def vwap(b, ts, x, v, anchor="1d"):
    """Volume-weighted mean since the start of the anchor's bucket (minutes, hours, days from
    the epoch, or calendar months)."""
    n, unit = int(anchor[:-1] or 1), anchor[-1]
    t = ts.cast("timestamp")
    if unit == "M":
        bucket = F.floor((F.year(t) * 12 + F.month(t) - 1) / n)
    else:
        bucket = F.floor(F.unix_timestamp(t) / (n * {"m": 60, "h": 3600, "d": 86400}[unit]))
    from pyspark.sql import Window

    key = b.let(bucket)
    since = Window.partitionBy(*b.series, key).orderBy(*b.order).rowsBetween(Window.unboundedPreceding, 0)
    volume = F.sum(F.when(x.isNotNull(), v)).over(since)
    return F.when(volume > 0, F.sum(x * v).over(since) / volume)


@native("predict", "trigger", memory=lambda: 20, x="hl2")
def pma(b, x):
    w1 = b.let(b.fir(x, W.wma(7)))
    p = b.let(2 * w1 - b.fir(w1, W.wma(7)))
    return {"predict": p, "trigger": b.fir(p, W.wma(4))}


@native("predict", "trigger", memory=lambda: 21)
def ehlers_pma(b, x):
    """As pma, on the bars before this one."""
    before = b.let(b.lag(x))
    w1 = b.let(b.fir(before, W.wma(7)))
    p = b.let(2 * w1 - b.fir(w1, W.wma(7)))
    return {"predict": p, "trigger": b.fir(p, W.wma(4))}


@native(memory=lambda length, **_: None)
def volume_adjusted_ma(b, x, v, length=13, vi_factor=0.67, strict=True, sample_period=0):
    """Bars count by volume over vi_factor * mean volume, back until their weights reach
    `length` (10 * length bars at most); if not strict, `length` bars whatever their weights.
    What the weights exceed or lack counts at the price of the bar before those. The mean is
    over all bars so far, or the last sample_period."""
    mean = b.running(v) / b.valid(v) if sample_period == 0 else b.mean(v, sample_period)
    unit = b.let(F.when(mean * vi_factor > 0, mean * vi_factor))
    most = 10 * length if strict else length
    pair = b.let(F.struct(x.alias("x"), v.alias("v")))
    listed = b.let(F.reverse(F.collect_list(pair).over(b.rows(most + 1))))
    start = F.struct(F.lit(0.0).alias("xs"), F.lit(0.0).alias("ws"), F.lit(0).alias("bars"))

    def add(s, e):
        w = F.coalesce(e["v"] / unit, F.lit(0.0))
        more = F.struct((s["xs"] + F.coalesce(e["x"] * w, F.lit(0.0))).alias("xs"), (s["ws"] + w).alias("ws"), (s["bars"] + 1).alias("bars"))
        return F.when(s["ws"] < float(length), more).otherwise(s) if strict else more

    s = b.let(F.aggregate(F.slice(listed, 1, most), start, add))
    before = F.get(listed, s["bars"])["x"]
    out = (s["xs"] - (s["ws"] - length) * before) / length
    return F.when(b.valid(x) >= length, out)
