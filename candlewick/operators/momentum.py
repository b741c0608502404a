"""Price transforms, momentum and oscillators with a finite memory, in the JVM."""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import functions as F

from .registry import native


def _share(num, den, flat):
    return F.when(den == 0, F.lit(float(flat))).otherwise(num / den)


@native("osc", "change", memory=lambda: 40)
def acosc(b, h, l):  # noqa: E741
    mid = b.let((h + l) / 2)
    ao = b.let(b.mean(mid, 5) - b.mean(mid, 34))
    osc = b.let(ao - b.mean(ao, 5))
    return {"osc": osc, "change": osc - F.coalesce(b.lag(osc), F.lit(0.0))}


@native(memory=lambda short_period, long_period: long_period, x="hl2")
def ao(b, x, short_period=5, long_period=34):
    return b.mean(x, long_period) * -1 + b.mean(x, short_period)


@native(memory=lambda: 1)
def bop(b, o, h, l, c):  # noqa: E741
    return F.when(h - l <= 0, F.lit(0.0)).otherwise((c - o) / (h - l))


@native(memory=lambda period: period, x="hlc3")
def cci(b, x, period=14):
    """Mean absolute deviation from the current mean."""
    mean = b.let(b.mean(x, period))
    dev = F.aggregate(F.transform(b.listed(x, period), lambda v: F.abs(v - mean)), F.lit(0.0), lambda s, v: s + v) / period
    dev = b.let(dev)
    return F.when(dev == 0, F.lit(0.0)).otherwise((x - mean) / (0.015 * dev))


@native(memory=lambda period, scalar: period)
def cfo(b, x, period=14, scalar=100.0):
    return F.when(x != 0, scalar * (x - b.line(x, period)[1]) / x)


@native(memory=lambda period: period + 1)
def cg(b, x, period=10):
    """Centre of gravity; from bar f + p on, over p - 1 bars."""
    num = sum(((k + 1.0) * b.lag(x, k) for k in range(period - 1)), F.lit(0.0))
    den = sum((b.lag(x, k) for k in range(period - 1)), F.lit(0.0))
    return F.when(b.valid(x) > period, F.when(F.abs(den) <= 1e-12, F.lit(0.0)).otherwise(-num / den))


@native(memory=lambda short_roc_period, long_roc_period, ma_period, ma_type: None if ma_type != "wma" else long_roc_period + ma_period)
def coppock(b, x, short_roc_period=11, long_roc_period=14, ma_period=10, ma_type="wma"):
    both = b.let(100 * (x / b.lag(x, short_roc_period) - 1) + 100 * (x / b.lag(x, long_roc_period) - 1))
    return b.ma(both, ma_type, ma_period)


@native(memory=lambda period: period + period // 2 + 1)
def dpo(b, x, period=5):
    return b.lag(x, period // 2 + 1) - b.mean(x, period)


@native(memory=lambda: None)
def emv(b, h, l, v):  # noqa: E741
    """Ease of movement; the mid price before is that of the last bar without gaps."""
    ok = h.isNotNull() & l.isNotNull() & v.isNotNull()
    mid = b.let(F.when(ok, (h + l) / 2))
    before = F.last(mid, ignorenulls=True).over(b.window.rowsBetween(-(1 << 30), -1))
    return F.when(ok & (h != l) & (v != 0), (mid - before) / (v / 10000 / (h - l)))


@native(memory=lambda period: period + 1)
def er(b, x, period=5):
    """Efficiency over p - 1 steps; 0 when flat, 1 at most."""
    way = b.sum(b.let(F.abs(x - b.lag(x))), period - 1) if period > 1 else F.lit(0.0)
    move = F.abs(x - b.lag(x, period - 1))
    return F.when(move.isNotNull(), F.when(way > 0, F.least(F.lit(1.0), move / way)).otherwise(0.0))


@native("bull", "bear", memory=lambda period, ma_type: None)
def eri(b, h, l, x, period=13, ma_type="ema"):  # noqa: E741
    m = b.ma(x, ma_type, period)
    return {"bull": h - m, "bear": l - m}


@native(memory=lambda period: period + 2)
def fosc(b, x, period=5):
    """Against the forecast that the bar before made; the first one is against 0."""
    slope, at = b.line(x, period)
    tsf = b.let(slope + at)
    before = F.when(b.valid(x) == period, F.lit(0.0)).otherwise(b.lag(tsf))
    return F.when((x != 0) & tsf.isNotNull(), 100 * (x - before) / x)


@native("k", "d", "j", memory=lambda fast_k_period, slow_k_period, slow_k_ma_type, slow_d_period, slow_d_ma_type: None)
def kdj(b, h, l, c, fast_k_period=9, slow_k_period=3, slow_k_ma_type="sma", slow_d_period=3, slow_d_ma_type="sma"):  # noqa: E741
    top, low = b.max(h, fast_k_period), b.min(l, fast_k_period)
    fast = b.let(F.when(top != low, 100 * (c - low) / (top - low)))
    k = b.let(b.ma(fast, slow_k_ma_type, slow_k_period))
    d = b.let(b.ma(k, slow_d_ma_type, slow_d_period))
    return {"k": k, "d": d, "j": 3 * k - 2 * d}


@native("line", "signal", memory=lambda **p: p["roc_period4"] + p["sma_period4"] + p["signal_period"])
def kst(b, x, sma_period1=10, sma_period2=10, sma_period3=10, sma_period4=15, roc_period1=10, roc_period2=15, roc_period3=20, roc_period4=30, signal_period=9):
    terms = []
    for i, (r, s) in enumerate(((roc_period1, sma_period1), (roc_period2, sma_period2), (roc_period3, sma_period3), (roc_period4, sma_period4)), 1):
        roc = b.let(100 * (x / b.lag(x, r) - 1))
        terms.append(i * b.mean(roc, s))
    line = b.let(terms[0] + terms[1] + terms[2] + terms[3])
    return {"line": line, "signal": b.mean(line, signal_period)}


@native("macz", "histogram", memory=lambda **p: None)
def macz(b, x, v, fast_length=12, slow_length=25, signal_length=9, lengthz=20, length_stdev=25, use_lag=False, gamma=0.02, a=1.0, b_=1.0):
    total = b.sum(v, lengthz)
    vwap = b.let(F.when(total != 0, b.sum(b.let(x * v), lengthz) / total))
    # the deviation from the current mean over the window, spelled out from moments
    mean_x, mean_xx = b.mean(x, lengthz), b.mean(b.let(x * x), lengthz)
    zsd = b.let(F.sqrt(F.greatest(F.lit(0.0), mean_xx - 2 * vwap * mean_x + vwap * vwap)))
    z = F.when(zsd > 0, (x - vwap) / zsd).otherwise(0.0)
    sd = b.let(b.std(x, length_stdev))
    macd = b.mean(x, fast_length) - b.mean(x, slow_length)
    line = b.let(F.when(sd > 0, a * z + b_ * macd / sd))
    if use_lag:
        line = b.fold("laguerre", [line], gamma=gamma)[0]
    return {"macz": line, "histogram": line - b.mean(line, signal_length)}


@native(memory=lambda: 1)
def marketefi(b, h, l, v):  # noqa: E741
    return F.when(v != 0, (h - l) / v)


@native(memory=lambda: 1)
def medprice(b, h, l):  # noqa: E741
    return (h + l) / 2


@native(memory=lambda period: period)
def midpoint(b, x, period=14):
    return (b.max(x, period) + b.min(x, period)) / 2


@native(memory=lambda period: period)
def midprice(b, h, l, period=14):  # noqa: E741
    return (b.max(h, period) + b.min(l, period)) / 2


@native(memory=lambda period: period + 1)
def mom(b, x, period=10):
    return x - b.lag(x, period)


@native("sine", "lead", memory=lambda period: period + 1)
def msw(b, x, period=5):
    """Phase of the period's Fourier component; angles as in the usual sine wave."""
    re = b.let(sum((cos(2 * pi * k / period) * b.lag(x, k) for k in range(period)), F.lit(0.0)))
    im = b.let(sum((sin(2 * pi * k / period) * b.lag(x, k) for k in range(period)), F.lit(0.0)))
    phase = F.when(F.abs(re) > 0.001, F.atan(im / re)).otherwise(F.when(im < 0, -pi).otherwise(pi))
    phase = F.when(re < 0, phase + pi).otherwise(phase) + pi / 2
    phase = F.when(phase < 0, phase + 2 * pi).otherwise(phase)
    phase = b.let(F.when(re.isNotNull(), F.when(phase > 2 * pi, phase - 2 * pi).otherwise(phase)))
    return {"sine": F.sin(phase), "lead": F.sin(phase + pi / 4)}


@native(memory=lambda period: 2 * period + 1)
def net_myrsi(b, x, period=14):
    """Concordance of the order of the last p values of MyRSI with time."""
    d = b.let(x - b.lag(x))
    gain, loss = (b.let(F.when(d.isNotNull(), F.greatest(s * d, F.lit(0.0)))) for s in (1, -1))  # greatest passes over nulls
    up, down = b.sum(gain, period), b.sum(loss, period)
    my = b.let(_share(up - down, up + down, 0))
    listed = b.listed(my, period)
    pairs = F.expr(f"flatten(transform(sequence(1, {period - 1}), i -> transform(sequence(0, i - 1), j -> struct(i AS i, j AS j))))") if period > 1 else F.array()
    got = b.let(listed)
    s = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.signum(F.element_at(got, p["i"] + 1) - F.element_at(got, p["j"] + 1)))
    net = b.let(F.when(got.isNotNull(), s / (period * (period - 1) / 2)))
    return F.when(b.valid(x) == period + 1, F.lit(0.0)).otherwise(net)


@native(memory=lambda fast_period, slow_period, ma_type: None if ma_type != "sma" else slow_period)
def ppo(b, x, fast_period=12, slow_period=26, ma_type="sma"):
    slow = b.ma(x, ma_type, slow_period)
    return F.when(slow != 0, 100 * (b.ma(x, ma_type, fast_period) / slow - 1))


@native(memory=lambda period: period)
def qstick(b, o, c, period=5):
    return b.mean(b.let(c - o), period)


@native(memory=lambda period: period + 1)
def roc(b, x, period=9):
    before = b.lag(x, period)
    return F.when(b.valid(x) > period, F.when(before.isNull() | (before == 0), F.lit(0.0)).otherwise(x / before * 100 - 100))


@native(memory=lambda period: period + 1)
def rocp(b, x, period=10):
    before = b.lag(x, period)
    return F.when(before != 0, (x - before) / before)


@native(memory=lambda period: period + 1)
def rocr(b, x, period=10):
    before = b.lag(x, period)
    return F.when(b.valid(x) > period, F.when(before.isNull() | (before == 0), F.lit(0.0)).otherwise(x / before))


def _off_centre(b, h, l, c, length):  # noqa: E741
    """The close less the mean of the range's middle and the simple average."""
    return b.let(c - ((b.max(h, length) + b.min(l, length)) / 2 + b.mean(c, length)) / 2)


@native("squeeze", "momentum", "momentum_signal", memory=lambda length_bb, length_kc, **_: 2 * max(length_bb, length_kc) + 2)
def squeeze_momentum(b, h, l, c, length_bb=20, mult_bb=2.0, length_kc=20, mult_kc=1.5):  # noqa: E741
    mean, sd = b.mean(c, length_bb), b.std(c, length_bb)
    kc, reach = b.mean(c, length_kc), b.mean(b.let(b.true_range(h, l, c)), length_kc)
    up_bb, low_bb, up_kc, low_kc = mean + mult_bb * sd, mean - mult_bb * sd, kc + mult_kc * reach, kc - mult_kc * reach
    known = mean.isNotNull() & kc.isNotNull() & reach.isNotNull()
    state = F.when((low_bb > low_kc) & (up_bb < up_kc), F.lit(-1.0)).when((low_bb < low_kc) & (up_bb > up_kc), F.lit(1.0)).otherwise(0.0)
    m = b.let(b.line(_off_centre(b, h, l, c, length_kc), length_kc)[1])
    before = b.lag(m)
    signal = F.when(m > 0, F.when(m > before, F.lit(1.0)).otherwise(2.0)).otherwise(F.when(m < before, F.lit(-1.0)).otherwise(-2.0))
    return {"squeeze": F.when(known, state), "momentum": m, "momentum_signal": F.when(before.isNotNull() & m.isNotNull(), signal)}


@native("k", "d", memory=lambda **_: None)
def stoch(b, h, l, c, fastk_period=14, slowk_period=3, slowk_ma_type="sma", slowd_period=3, slowd_ma_type="sma"):  # noqa: E741
    top, low = b.max(h, fastk_period), b.min(l, fastk_period)
    fast = b.let(F.when(top == low, F.lit(50.0)).otherwise(100 * (c - low) / (top - low)))
    k = b.let(b.ma(fast, slowk_ma_type, slowk_period))
    return {"k": k, "d": b.ma(k, slowd_ma_type, slowd_period)}


@native("k", "d", memory=lambda fastk_period, fastd_period, fastd_matype: fastk_period + fastd_period)
def stochf(b, h, l, c, fastk_period=5, fastd_period=3, fastd_matype=0):  # noqa: E741
    top, low = b.max(h, fastk_period), b.min(l, fastk_period)
    k = b.let(F.when(top == low, F.when(c == top, F.lit(100.0)).otherwise(0.0)).otherwise(100 * (c - low) / (top - low)))
    return {"k": k, "d": b.ma(k, "sma" if fastd_matype == 0 else "ema", fastd_period)}


@native("momentum", "squeeze", memory=lambda length, **_: 2 * length + 2)
def ttm_squeeze(b, h, l, c, length=20, bb_mult=2.0, kc_mult_high=1.0, kc_mult_mid=1.5, kc_mult_low=2.0):  # noqa: E741
    momentum = b.line(_off_centre(b, h, l, c, length), length)[1]
    width, reach = b.let(bb_mult * b.std(c, length)), b.let(b.mean(b.let(b.true_range(h, l, c)), length))
    state = F.when(width <= kc_mult_high * reach, F.lit(3.0)).when(width <= kc_mult_mid * reach, F.lit(2.0)).when(width <= kc_mult_low * reach, F.lit(1.0)).otherwise(0.0)
    return {"momentum": momentum, "squeeze": F.when(width.isNotNull() & reach.isNotNull(), state)}


@native(memory=lambda period: period, x="hl2")
def ttm_trend(b, x, c, period=5):
    return F.coalesce(c > b.mean(x, period), F.lit(False))


@native(memory=lambda **p: p["timeperiod3"] + 1)
def ultosc(b, h, l, c, timeperiod1=7, timeperiod2=14, timeperiod3=28):  # noqa: E741
    before = b.lag(c)
    low = F.least(l, before)
    buy = b.let(F.when(before.isNotNull(), c - low))
    reach = b.let(F.when(before.isNotNull(), F.greatest(h - l, F.abs(h - before), F.abs(l - before))))

    def part(p):
        s = b.sum(reach, p)
        return _share(b.sum(buy, p), s, 0)

    return 100 * (4 * part(timeperiod1) + 2 * part(timeperiod2) + part(timeperiod3)) / 7


@native(memory=lambda: 1)
def wclprice(b, h, l, c):  # noqa: E741
    return (h + l + 2 * c) / 4


@native(memory=lambda period: period)
def willr(b, h, l, c, period=14):  # noqa: E741
    top, low = b.max(h, period), b.min(l, period)
    return F.when(top == low, F.lit(0.0)).otherwise(-100 * (top - c) / (top - low))
