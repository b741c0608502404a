"""Recursive momentum operators and oscillators."""

from __future__ import annotations

from collections import deque
from math import atanh, copysign, log, nan, sqrt, tanh

from ..functions import weights as W
from ..functions.steps import NAN, Ema0, EmaMean, Fir, GainLoss, HighPass2, Lag, Max, Min, Rma, Rsi, Seeded, Sma, Sum, average
from .folds_averages import _deviation, clamp
from .registry import fold


@fold("x")
def apo(short_period=10, long_period=20):
    a, b = Ema0(short_period), Ema0(long_period)
    return lambda x: a(x) - b(x)


@fold("x")
def rsi(period=14):
    return Rsi(period)


@fold("x")
def cmo(period=14):
    gl = GainLoss(period)

    def step(x):
        g, l = gl(x)  # noqa: E741
        return NAN if g != g else 100 * (g - l) / (g + l) if g + l else 0.0

    return step


@fold("x")
def cci_cycle(length=10, factor=0.5):
    q, fast, slow, mean = deque(maxlen=length), Seeded((length + 1) // 2), Seeded(length), Rma(max(1, round(sqrt(length))))

    def stochastic():
        ring, f, y = deque(maxlen=length), NAN, NAN

        def one(x):
            nonlocal f, y
            if x != x:
                return NAN
            ring.append(x)
            low, top = min(ring), max(ring)
            f = 100 * (x - low) / (top - low) if top > low else f
            if f == f:
                y = f if y != y else y + factor * (f - y)
            return y

        return one

    first, second = stochastic(), stochastic()

    def step(x):
        q.append(x)
        if len(q) < length:
            return NAN
        m = sum(q) / length
        dev = sum(abs(v - m) for v in q) / length
        c = (x - m) / (0.015 * dev) if dev else 0.0
        return second(first(mean(2 * fast(c) - slow(c))))

    return step


@fold("h l")
def cvi(period=10):
    e, old, n = Ema0(period), Lag(period), 0

    def step(h, l):  # noqa: E741
        nonlocal n
        n += 1
        y = e(h - l)
        o = old(y)
        return 100 * (y - o) / o if n >= 2 * period and o else NAN

    return step


@fold("x")
def dec_osc(hp_period=125, k=1.0):
    """High-pass of half the period of what a high-pass of the whole one leaves, per price."""
    a, b, n = HighPass2(hp_period), HighPass2(hp_period / 2), 0

    def step(x):
        nonlocal n
        n += 1
        h = a(x)
        y = b(x - (h if n > 2 else 0.0))
        return 100 * k * y / x if n > 2 and x else NAN

    return step


@fold("h l")
def dti(r=14, s=10, u=5):
    up = [2 / (p + 1) for p in (r, s, u)]
    num, den, ph, pl = [0.0] * 3, [0.0] * 3, NAN, NAN

    def step(h, l):  # noqa: E741
        nonlocal ph, pl
        if ph != ph:
            ph, pl = h, l
            return NAN
        x = max(h - ph, 0.0) - max(pl - l, 0.0)
        ph, pl = h, l
        a, b = x, abs(x)
        for k in range(3):
            num[k] += up[k] * (a - num[k])
            den[k] += up[k] * (b - den[k])
            a, b = num[k], den[k]
        return 100 * a / b if b else 0.0

    return step


@fold("h l", "fisher", "signal")
def fisher(period=9):
    top, low, v, f = Max(period), Min(period), 0.0, 0.0

    def step(h, l):  # noqa: E741
        nonlocal v, f
        m = (h + l) / 2
        hi, lo = top(m), low(m)
        if hi != hi:
            return NAN, NAN
        v = clamp(0.67 * v + 0.66 * ((m - lo) / max(hi - lo, 0.001) - 0.5), -0.999, 0.999)
        before, f = f, atanh(v) + 0.5 * f
        return f, before

    return step


@fold("x", "upper", "lower", "upper_change", "lower_change")
def gatorosc(jaws_length=13, jaws_shift=8, teeth_length=8, teeth_shift=5, lips_length=5, lips_shift=3):
    e = [Ema0(jaws_length), Ema0(teeth_length), Ema0(lips_length)]
    old = [Lag(jaws_shift), Lag(teeth_shift), Lag(lips_shift)]
    pu = pl = NAN
    n, warm = 0, max(jaws_length + jaws_shift, teeth_length + teeth_shift, lips_length + lips_shift)

    def step(x):
        nonlocal pu, pl, n
        n += 1
        j, t, p = (o(m(x)) for o, m in zip(old, e))
        if n < warm:
            return NAN, NAN, NAN, NAN
        u, w = abs(j - t), -abs(t - p)
        out = u, w, u - pu, w - pl
        pu, pl = u, w
        return out

    return step


@fold("x")
def ift_rsi(rsi_period=5, wma_period=9):
    r, w = Rsi(rsi_period), Fir(W.wma(wma_period))

    def step(x):
        y = w(0.1 * (r(x) - 50))
        return tanh(y)

    return step


def laguerre(alpha):
    """Gains over all moves between four Laguerre filters that start at zero."""
    g, s = 1 - alpha, [0.0] * 4

    def step(x):
        nonlocal s
        n0 = alpha * x + g * s[0]
        n1 = s[0] - g * n0 + g * s[1]
        n2 = s[1] - g * n1 + g * s[2]
        s = [n0, n1, n2, s[2] - g * n2 + g * s[3]]
        moves = [x - y for x, y in zip(s, s[1:])]
        way = sum(map(abs, moves))
        return sum(m for m in moves if m > 0) / way if way else NAN

    return step


@fold("h l")
def lrsi(alpha=0.2):
    g, s = 1 - alpha, None

    def step(h, l):  # noqa: E741
        nonlocal s
        x = (h + l) / 2
        if s is None:
            s = [x] * 4
            return NAN
        a, b, c, d = s
        n0 = alpha * x + g * a
        n1 = -g * n0 + a + g * b
        n2 = -g * n1 + b + g * c
        n3 = -g * n2 + c + g * d
        s = [n0, n1, n2, n3]
        d = [n0 - n1, n1 - n2, n2 - n3]
        up, down = sum(max(v, 0.0) for v in d), sum(max(-v, 0.0) for v in d)
        return up / (up + down) if up + down else 0.0

    return step


@fold("x", "macd", "signal", "hist")
def macd(fast_period=12, slow_period=26, signal_period=9, ma_type="ema"):
    kind = (lambda p: Seeded(p)) if ma_type == "ema" else (lambda p: average(ma_type, p))
    fast, slow, signal, n = kind(fast_period), kind(slow_period), kind(signal_period), 0

    def step(x):
        nonlocal n
        n += 1
        m = fast(x) - slow(x)
        s = signal(m) if n >= slow_period else NAN
        return m, s, m - s

    return step


@fold("h l")
def mass(period=5):
    a, b, total, n = Ema0(9), Ema0(9), Sum(period), 0

    def step(h, l):  # noqa: E741
        nonlocal n
        n += 1
        e = a(h - l)
        if n < 9:
            return NAN
        d = b(e)
        if n < 17:
            return NAN
        return total(e / d if d else nan)

    return step


@fold("h l c v", "wavetrend", "signal", "histogram")
def mod_god_mode(n1=17, n2=6, n3=4, mode="tradition_mg", use_volume=False):
    """The mean of a mode's parts that are there; signal is its plain mean over 6 bars."""
    parts = {"godmode": "tci csi mf willy", "tradition": "tci mf rsi", "godmode_mg": "tci csi_mg mf willy cbci lrsi", "tradition_mg": "tci mf rsi cbci lrsi"}[mode].split()
    e1, e2, e3 = Ema0(n1), Ema0(n1), Ema0(n2)
    r3, lag, re = Rsi(n3, flat=100.0), laguerre(0.7), Ema0(n3)
    rq, top, low = deque(maxlen=n2 + 1), Max(n2), Min(n2)
    tsi_a, tsi_b, tsi_c, tsi_d = Ema0(n1), Ema0(n2), Ema0(n1), Ema0(n2)
    pos, neg, tp0, c0 = Sum(n3), Sum(n3), NAN, NAN
    six, hist, n = Sma(6), Ema0(n3), 0

    def step(h, l, c, v):  # noqa: E741
        nonlocal tp0, c0, n
        n += 1
        got = {}
        e = e1(c)
        d = e2(abs(c - e))
        if d:
            got["tci"] = e3((c - e) / (0.025 * d)) + 50
        r = r3(c)
        got["rsi"] = r
        if r == r:
            rq.append(r)
            smooth = re(r)
            if len(rq) > n2:
                got["cbci"] = r - rq[0] + smooth
        got["lrsi"] = 100 * lag(c)
        hi, lo = top(c), low(c)
        if hi == hi and hi != lo:
            got["willy"] = 60 * (c - hi) / (hi - lo) + 80
        if c0 == c0:
            m = c - c0
            a, b = tsi_b(tsi_a(m)), tsi_d(tsi_c(abs(m)))
            if b:
                got["csi"] = got["csi_mg"] = (r + 50 * a / b + 50) / 2
        tp = (h + l + c) / 3
        if use_volume and v == v:
            if tp0 == tp0:  # the first bar has no flow
                p, q = pos(tp * v if tp > tp0 else 0.0), neg(tp * v if tp < tp0 else 0.0)
                if p == p:
                    got["mf"] = 100 * p / (p + q) if q else 100.0
        else:
            got["mf"] = r
        tp0, c0 = tp, c
        there = [got[k] for k in parts if got.get(k, NAN) == got.get(k, NAN)]
        if n < max(n1, n2, n3) or not there:
            return NAN, NAN, NAN
        w = sum(there) / len(there)
        s = six(w)
        return w, s, hist(2 * (w - s) + 50)

    return step


@fold("x")
def pfe(period=10, smoothing=5):
    q, e = deque(maxlen=period + 1), Ema0(smoothing)

    def step(x):
        q.append(x)
        if len(q) <= period:
            return NAN
        d = x - q[0]
        way = sum(sqrt(1 + (q[i + 1] - q[i]) ** 2) for i in range(period))
        return e(copysign(100 * sqrt(d * d + period * period) / way, d) if d else -100 * period / way)

    return step


@fold("x", "fast", "slow")
def qqe(rsi_period=14, smoothing_factor=5, fast_factor=4.236):
    r, e, a, b, before, slow = Rsi(rsi_period), EmaMean(smoothing_factor), Ema0(alpha=1 / 14), Ema0(alpha=1 / 14), NAN, NAN

    def step(x):
        nonlocal before, slow
        f = e(r(x))
        if f != f:
            return NAN, NAN
        if before != before:
            before = slow = f
            b(a(0.0))
            return f, slow
        d = fast_factor * b(a(abs(f - before)))
        up, down = f + d, f - d
        if up < slow:
            new = up
        elif f > slow and before < slow:
            new = down
        elif down > slow:
            new = down
        elif f < slow and before > slow:
            new = up
        else:
            new = slow
        before, slow = f, new
        return f, slow

    return step


@fold("x")
def reverse_rsi(rsi_length=14, rsi_level=50.0):
    """The price at which the RSI would be at the level."""
    length, x0 = 2 * rsi_length - 1, NAN
    up, down = Seeded(length), Seeded(length)
    ratio = rsi_level / (100 - rsi_level)

    def step(x):
        nonlocal x0
        d = 0.0 if x0 != x0 else x - x0
        x0 = x
        u, w = up(max(d, 0.0)), down(max(-d, 0.0))
        if u != u:
            return NAN
        y = (rsi_length - 1) * (w * ratio - u)
        return x + (y if y >= 0 else y / ratio)

    return step


@fold("main other", "indicator", "signal")
def rsmk(lookback=90, period=3, signal_period=20, matype="ema", signal_matype="ema"):
    old = Lag(lookback)
    kind = lambda t, p: EmaMean(p) if t == "ema" else average(t, p)
    a, b = kind(matype, period), kind(signal_matype, signal_period)

    def step(main, other):
        if main <= 0 or other <= 0:
            return NAN, NAN
        y = log(main / other)
        m = a(y - old(y))
        i = 100 * m
        return i, b(i)

    return step


@fold("x")
def rsx(period=14):
    """Three doubly smoothed stages of the change and of its size, from bar `period` on. Until
    `settle` bars more have gone by, and again after as many bars without any change at the
    start, the value is 50."""
    f, n, x0, settle, seen, moved = 3 / (period + 2), 0, NAN, max(period - 1, 5), 1, False

    def stage():
        a = b = 0.0

        def one(v):
            nonlocal a, b
            a += f * (v - a)
            b += f * (a - b)
            return 1.5 * a - 0.5 * b

        return one

    num, den = [stage() for _ in range(3)], [stage() for _ in range(3)]

    def step(x):
        nonlocal n, x0, seen, moved
        n += 1
        d, x0 = 100 * (x - x0), x
        if n <= period:
            return NAN
        a, b = d, abs(d)
        for p, q in zip(num, den):
            a, b = p(a), q(b)
        seen = min(seen, settle) + 1
        moved = moved or (seen <= settle and d != 0)
        if seen == settle and not moved:
            seen = 0
        return clamp((a / b + 1) * 50, 0.0, 100.0) if seen > settle and b > 1e-10 else 50.0

    return step


@fold("x")
def rvi(period=10, ma_len=14, matype=1, devtype=0):
    dev, x0 = _deviation(period, devtype), NAN
    kind = (lambda: Sma(ma_len)) if matype == 0 else (lambda: Seeded(ma_len))
    up, down = kind(), kind()

    def step(x):
        nonlocal x0
        d, x0 = x - x0, x
        s = dev(x)
        if s != s or d != d:
            return NAN
        u, w = up(s if d > 0 else 0.0), down(s if d < 0 else 0.0)
        return 100 * u / (u + w) if u == u and u + w else NAN

    return step


@fold("x", "k", "d")
def srsi(rsi_period=14, stoch_period=14, k=3, d=3):
    r, top, low, fast, slow = Rsi(rsi_period), Max(stoch_period), Min(stoch_period), Sma(k), Sma(d)

    def step(x):
        y = r(x)
        hi, lo = top(y), low(y)
        if hi != hi:
            return NAN, NAN
        a = fast(100 * (y - lo) / (hi - lo) if hi != lo else 50.0)
        return a, slow(a)

    return step


@fold("x")
def stc(fast_period=23, slow_period=50, k_period=10, d_period=3, fast_ma_type="ema", slow_ma_type="ema"):
    kind = lambda t, p: Seeded(p) if t == "ema" else average(t, p)
    fast, slow = kind(fast_ma_type, fast_period), kind(slow_ma_type, slow_period)

    def stage():
        top, low, e, last = Max(k_period), Min(k_period), EmaMean(d_period), NAN

        def one(x):
            nonlocal last
            hi, lo = top(x), low(x)
            if hi != hi:
                return NAN
            last = 100 * (x - lo) / (hi - lo) if hi > lo else (last if last == last else 50.0)
            return e(last)

        return one

    a, b = stage(), stage()
    return lambda x: b(a(fast(x) - slow(x)))


@fold("x")
def trix(period=18):
    e, before = [Seeded(period) for _ in range(3)], NAN

    def step(x):
        nonlocal before
        y = log(x) if x > 0 else NAN
        for s in e:
            y = s(y)
        d, before = y - before, y
        return 10000 * d

    return step


@fold("x")
def tsi(long_period=25, short_period=13):
    a, b, c, d, x0, n = Ema0(long_period), Ema0(short_period), Ema0(long_period), Ema0(short_period), NAN, 0

    def step(x):
        nonlocal x0, n
        m, x0 = x - x0, x
        if m != m:
            return NAN
        n += 1
        u, w = b(a(m)), d(c(abs(m)))
        if n < long_period + short_period - 1:
            return NAN
        return clamp(100 * u / w, -100.0, 100.0) if w else NAN

    return step


def _wave(n1, n2, n3, factor, early):
    esa, dev, avg, mean = Ema0(n1), Ema0(n1), Ema0(n2), Sma(n3)
    n = 0

    def step(x):
        nonlocal n
        n += 1
        e = esa(x)
        d = dev(abs(x - e))
        w1 = avg((x - e) / (factor * d) if d else 0.0)
        w2 = mean(w1)
        return (w1, w2) if n >= early else (NAN, NAN)

    return step


@fold("x", "wt1", "wt2", "wt_diff", x="hlc3")
def wavetrend(channel_length=9, average_length=12, ma_length=3, factor=0.015):
    wave = _wave(channel_length, average_length, ma_length, factor, channel_length + average_length + ma_length - 2)

    def step(x):
        a, b = wave(x)
        return a, b, b - a

    return step


@fold("x", "wt1", "wt2", "hist")
def wto(channel_length=10, average_length=21):
    wave = _wave(channel_length, average_length, 4, 0.015, 1)

    def step(x):
        a, b = wave(x)
        return a, b, a - b

    return step
