"""Volume, statistics and regression, in the JVM."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from .registry import native
from .trend import _median, deviation_of


@native(memory=lambda: None)
def ad(b, h, l, c, v):  # noqa: E741
    return b.running(F.when(h == l, F.lit(0.0)).otherwise(((c - l) - (h - c)) / (h - l) * v))


@native(memory=lambda period: period)
def correl_hl(b, h, l, period=5):  # noqa: E741
    """0 where either price stands still: F.corr would divide by zero there, an error in ANSI mode."""
    both = b.let(F.when(h.isNotNull() & l.isNotNull(), F.lit(1.0)))
    r = F.try_divide(F.covar_pop(h, l).over(b.rows(period)), b.std(h, period) * b.std(l, period))
    return F.when(F.count(both).over(b.rows(period)) == period, F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)))


@native(memory=lambda period, devtype: period)
def deviation(b, x, period=9, devtype=0):
    return deviation_of(b, x, period, devtype)


@native(memory=lambda period: period)
def kurtosis(b, x, period=5):
    """Population excess kurtosis, from centred moments."""
    mean, listed = b.let(b.mean(x, period)), b.let(b.listed(x, period))

    def moment(k):
        return F.aggregate(F.transform(listed, lambda v: F.pow(v - mean, F.lit(float(k)))), F.lit(0.0), lambda s, v: s + v) / period

    m2 = b.let(moment(2))
    return F.when(m2 > 1e-14, moment(4) / (m2 * m2) - 3)


@native(memory=lambda period: period)
def linearreg_angle(b, x, period=14):
    return F.atan(b.line(x, period)[0]) * (180 / pi)


@native(memory=lambda period: period)
def linearreg_intercept(b, x, period=14):
    """The line's value at the window's first bar."""
    slope, at = b.line(x, period)
    return at - slope * (period - 1)


@native(memory=lambda period: period)
def linearreg_slope(b, x, period=14):
    """Slopes of 1.1e-8 or less count as none."""
    slope = b.line(x, period)[0]
    return F.when(F.abs(slope) <= 1.1e-8, F.lit(0.0)).otherwise(slope)


@native(memory=lambda period: 2 * period)
def mean_ad(b, x, period=5):
    """Each bar's distance from its own mean, averaged."""
    return b.mean(b.let(F.abs(x - b.mean(x, period))), period)


@native(memory=lambda period: period)
def medium_ad(b, x, period=5):
    listed = b.let(b.listed(x, period))
    mid = b.let(_median(F.array_sort(listed), period))
    return _median(F.array_sort(F.transform(listed, lambda v: F.abs(v - mid))), period)


@native(memory=lambda period: period + 1, x="hlc3")
def mfi(b, x, v, period=14):
    before = b.lag(x)
    flow = F.when(before.isNotNull(), x * v)
    up = b.sum(b.let(F.when(flow.isNull(), F.lit(None)).otherwise(F.when(x > before, flow).otherwise(0.0))), period)
    down = b.sum(b.let(F.when(flow.isNull(), F.lit(None)).otherwise(F.when(x < before, flow).otherwise(0.0))), period)
    return F.when(up + down <= 1e-14, F.lit(0.0)).otherwise(100 * up / (up + down))


@native(memory=lambda: None)
def obv(b, c, v):
    before = b.lag(c)
    step = F.when(before.isNull(), F.lit(0.0)).when(c > before, v).when(c < before, -v).otherwise(0.0)
    return F.when(c.isNotNull() & v.isNotNull(), b.running(step))


@native(memory=lambda length, percentage: length)
def percentile_nearest_rank(b, x, length=15, percentage=50.0):
    """Over the values that the last `length` bars have; missing ones are left out."""
    listed = b.let(F.array_sort(F.collect_list(x).over(b.rows(length))))
    n = F.size(listed)
    at = F.greatest(F.lit(1), F.least(n, F.floor(F.lit(percentage) * n / 100 + 0.5).cast("int")))
    return F.when((b.number() >= length) & (n > 0), F.element_at(listed, at))


@native(memory=lambda period, nbdev: period)
def stddev(b, x, period=5, nbdev=1.0):
    return b.std(x, period) * nbdev


@native(memory=lambda period: period)
def tsf(b, x, period=14):
    slope, at = b.line(x, period)
    return at + slope


@native(memory=lambda period, nbdev: period)
def var(b, x, period=14, nbdev=1.0):
    return b.over(x, period, F.var_pop) * (nbdev * nbdev)


@native(memory=lambda short_period, long_period: long_period)
def vosc(b, v, short_period=2, long_period=5):
    slow = b.mean(v, long_period)
    return F.when(slow != 0, 100 * (b.mean(v, short_period) - slow) / slow)


def _vpc(b, x, v, fast, slow):
    """Price confirmation, price ratio and volume multiplier."""
    xv = b.let(x * v)
    vwma_slow, vwma_fast = b.sum(xv, slow) / b.sum(v, slow), b.sum(xv, fast) / b.sum(v, fast)
    return b.let(vwma_slow - b.mean(x, slow)), b.let(vwma_fast / b.mean(x, fast)), b.let(b.mean(v, fast) / b.mean(v, slow))


@native("vpci", "vpcis", memory=lambda short_range, long_range: short_range + long_range)
def vpci(b, c, v, short_range=5, long_range=25):
    vpc, vpr, vm = _vpc(b, c, v, short_range, long_range)
    out = b.let(vpc * vpr * vm)
    return {"vpci": out, "vpcis": b.sum(b.let(out * v), short_range) / b.sum(v, short_range)}


@native(memory=lambda fast_period, slow_period, multiplier: 200 + 2 * slow_period)
def avsl(b, c, l, v, fast_period=12, slow_period=26, multiplier=2.0):  # noqa: E741
    """The window of the price part depends on the data (1 to 200 bars); its bars from before
    the slow means exist count by their plain low. Without volume a weighted mean is the plain
    one."""
    cv = b.let(c * v)
    slow, fast = b.let(b.mean(c, slow_period)), b.let(b.mean(c, fast_period))
    weighted = lambda p, plain: F.when(b.sum(v, p) != 0, b.sum(cv, p) / b.sum(v, p)).otherwise(plain)
    vpc = b.let(weighted(slow_period, slow) - slow)
    vpr = b.let(F.when(fast != 0, weighted(fast_period, fast) / fast).otherwise(1.0))
    vm = b.let(F.when(b.sum(v, slow_period) != 0, b.mean(v, fast_period) / b.mean(v, slow_period)).otherwise(1.0))
    vpci_ = b.let(vpc * vpr * vm)
    reach = F.round(F.when(vpc < 0, F.abs(vpci_ - 3)).otherwise(vpci_ + 3))
    length = b.let(F.greatest(F.lit(1.0), F.least(F.lit(200.0), reach)).cast("int"))
    unit = F.when((vpc > -1) & (vpc < 0), F.lit(-1.0)).when((vpc >= 0) & (vpc < 1), F.lit(1.0)).otherwise(vpc)
    part = b.let(F.when(slow.isNull(), l).when(unit * vpr != 0, l / (unit * vpr)).otherwise(0.0))
    listed = F.reverse(F.collect_list(part).over(b.rows(200)))
    price = F.aggregate(F.slice(listed, 1, length), F.lit(0.0), lambda s, x: s + x) / length / 100
    return b.mean(b.let(l - price + multiplier * vpci_ * vm), slow_period)


@native(memory=lambda: None)
def vpt(b, c, v):
    """From bar f + 2 of the closes on; a gap is never made up for."""
    move = b.let((c - b.lag(c)) / b.lag(c) * v)
    whole = b.running(F.when(move.isNull() & (b.valid(c) > 1), F.lit(1.0)).otherwise(0.0))
    return F.when((whole == 0) & move.isNotNull(), b.running(move))


@native(memory=lambda: None)
def wad(b, h, l, c):  # noqa: E741
    before = b.lag(c)
    step = F.when(before.isNull() | (c == before), F.lit(0.0)).when(c > before, c - F.least(l, before)).otherwise(c - F.greatest(h, before))
    return F.when(c.isNotNull(), b.running(step))


@native(memory=lambda period, ma_type, nbdev, devtype: period if ma_type == "sma" else None)
def zscore(b, x, period=14, ma_type="sma", nbdev=1.0, devtype=0):
    dev = b.let(deviation_of(b, x, period, devtype))
    return F.when(dev * dev > 1e-30, (x - b.ma(x, ma_type, period)) / (nbdev * dev))
