"""Recursive moving averages and filters. A step gets finite values only; nan means none yet."""

from __future__ import annotations

from collections import deque
from math import atan, cos, exp, floor, log, pi, sqrt

from ..functions import weights as W
from ..functions.steps import NAN, Ema0, EmaMean, Fir, HighPass1, HighPass2, Lag, Max, Min, Ring, Rma, Seeded, Sma, Std, SuperSmoother, TrueRange
from .registry import fold


def clamp(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


@fold("x", gap="hold")
def ema(period=9):
    return EmaMean(period)


@fold("x")
def smma(period=7):
    return Rma(period)


@fold("x")
def wilders(period=5):
    return Rma(period)


@fold("x")
def dema(period=30):
    one, two = Ema0(period), Ema0(period)

    def step(x):
        e = one(x)
        return 2 * e - two(e)

    return step


@fold("x")
def tema(period=9):
    e1, e2, e3, n = Ema0(period), Ema0(period), Ema0(period), 0

    def step(x):
        nonlocal n
        n += 1
        a = e1(x)
        b = e2(a) if n >= period else NAN
        c = e3(b) if n >= 2 * period - 1 else NAN
        return 3 * a - 3 * b + c if n >= 3 * period - 2 else NAN

    return step


@fold("x")
def zlema(period=14):
    lag, mean = (period - 1) // 2, Ema0(period)
    old, n = Lag(lag), 0

    def step(x):
        nonlocal n
        o = old(x)
        n += 1
        y = mean(x if n <= lag else 2 * x - o)
        return y if n >= period else NAN

    return step


@fold("x")
def tilson(period=5, volume_factor=0.0):
    e = [Seeded(period) for _ in range(6)]
    v = volume_factor
    c1, c2, c3, c4 = -(v**3), 3 * v * v + 3 * v**3, -6 * v * v - 3 * v - 3 * v**3, 1 + 3 * v + v**3 + 3 * v * v

    def step(x):
        y = [x]
        for s in e:
            y.append(s(y[-1]))
        return c1 * y[6] + c2 * y[5] + c3 * y[4] + c4 * y[3]

    return step


def _adaptive(period, fast, slow, rate):
    """Kaufman's scheme: the constant follows the efficiency of the last p steps."""
    q, y = deque(maxlen=period + 1), NAN

    def step(x):
        nonlocal y
        q.append(x)
        if len(q) <= period:
            return NAN
        if y != y:
            y = x
            return y
        way = sum(abs(q[i + 1] - q[i]) for i in range(period))
        er = abs(x - q[0]) / way if way else 0.0
        y += rate(er) * (x - y)
        return y

    return step


@fold("x")
def kama(period=30):
    return _adaptive(period, 2, 30, lambda er: (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2)


@fold("x")
def ehlers_kama(period=20):
    """Efficiency over p - 1 steps; starts from the bar before."""
    q, y = deque(maxlen=period + 1), NAN

    def step(x):
        nonlocal y
        q.append(x)
        if len(q) < period:
            return NAN
        if y != y:
            y = q[-2] if len(q) > 1 else x
        last = list(q)[-period:]
        way = sum(abs(b - a) for a, b in zip(last, last[1:]))
        ef = min(1.0, abs(x - last[0]) / way) if way else 0.0
        y += (0.6667 * ef + 0.0645) ** 2 * (x - y)
        return y

    return step


@fold("x")
def maaq(period=11, fast_period=2, slow_period=30):
    """Values pass through for p bars."""
    fast, slow, q, y = 2 / (fast_period + 1), 2 / (slow_period + 1), deque(maxlen=period + 1), NAN

    def step(x):
        nonlocal y
        q.append(x)
        if len(q) <= period:
            y = x
            return y
        way = sum(abs(q[i + 1] - q[i]) for i in range(period))
        er = abs(x - q[0]) / way if way else 0.0
        y += (er * fast + slow) ** 2 * (x - y)
        return y

    return step


@fold("x")
def mwdx(factor=0.2):
    return Ema0(alpha=factor)


@fold("x")
def highpass(period=48):
    return HighPass1(period)


@fold("x")
def highpass_2_pole(period=48, k=0.707):
    return HighPass2(period, k)


@fold("x")
def decycler(hp_period=125, k=0.707):
    hp, n = HighPass2(hp_period, k), 0

    def step(x):
        nonlocal n
        n += 1
        y = hp(x)
        return x - y if n > 2 else NAN

    return step


@fold("x")
def supersmoother(period=14):
    """Starts once p values are there, with the values themselves."""
    s, n = SuperSmoother(period), 0

    def step(x):
        nonlocal n
        n += 1
        if n < period:
            s.x1 = x
            return NAN
        return s(x)

    return step


@fold("x")
def supersmoother_3_pole(period=14):
    a = exp(-pi / period)
    b, c = 2 * a * cos(1.738 * pi / period), a * a
    k0, k1, k2, k3 = 1 - c * c - b + b * c, b + c, -c - b * c, c * c
    y = deque(maxlen=3)

    def step(x):
        y.append(x if len(y) < 3 else k0 * x + k1 * y[2] + k2 * y[1] + k3 * y[0])
        return y[-1]

    return step


@fold("x")
def gaussian(period=14, poles=4):
    from math import comb

    beta = (1 - cos(2 * pi / period)) / (2 ** (1 / poles) - 1)
    a = -beta + sqrt(beta * beta + 2 * beta)
    back = [(-1) ** (k + 1) * comb(poles, k) * (1 - a) ** k for k in range(1, poles + 1)]
    y = deque([0.0] * poles, maxlen=poles)
    n = 0

    def step(x):
        nonlocal n
        n += 1
        y.appendleft(a**poles * x + sum(f * v for f, v in zip(back, y)))
        return y[0] if n >= period else NAN

    return step


def _flex(period, smooth, deviation):
    s, q, ms, n = SuperSmoother(smooth), deque(maxlen=period + 1), 0.0, 0

    def step(x):
        nonlocal ms, n
        n += 1
        q.append(s(x))
        if len(q) <= period:
            return 0.0
        d = deviation(q, period)
        ms = 0.04 * d * d + 0.96 * ms
        return d / sqrt(ms) if ms > 0 else 0.0

    return step


@fold("x")
def reflex(period=20):
    def deviation(q, p):
        slope = (q[0] - q[-1]) / p
        return sum(q[-1] + k * slope - q[-1 - k] for k in range(1, p + 1)) / p

    return _flex(period, max(1.0, period / 2), deviation)


@fold("x")
def trendflex(period=20):
    return _flex(period, max(1.0, period / 2), lambda q, p: sum(q[-1] - q[-1 - k] for k in range(1, p + 1)) / p)


@fold("x")
def hwma(na=0.2, nb=0.1, nc=0.1):
    f = v = a = NAN

    def step(x):
        nonlocal f, v, a
        if f != f:
            f, v, a = x, 0.0, 0.0
        f0, v0, a0 = f, v, a
        f = na * x + (1 - na) * (f0 + v0 + a0 / 2)
        v = nb * (f - f0) + (1 - nb) * (v0 + a0)
        a = nc * (v - v0) + (1 - nc) * a0
        return f + v + a / 2

    return step


@fold("x")
def jma(period=7, phase=50.0, power=2):
    beta = 0.45 * (period - 1) / (0.45 * (period - 1) + 2)
    alpha = beta**power
    ratio = 0.5 if phase < -100 else 2.5 if phase > 100 else phase / 100 + 1.5
    e0 = e1 = e2 = 0.0
    j = NAN

    def step(x):
        nonlocal e0, e1, e2, j
        if j != j:
            e0, j = x, x
            return j
        e0 = (1 - alpha) * x + alpha * e0
        e1 = (x - e0) * (1 - beta) + beta * e1
        e2 = (e0 + ratio * e1 - j) * (1 - alpha) ** 2 + alpha * alpha * e2
        j += e2
        return j

    return step


@fold("x")
def ehlers_ecema(length=20, gain_limit=50, pine_compatible=False, confirmed_only=False):
    """The gain in tenths whose next value is nearest to x; the first such if several are."""
    a, e, ec, mean, before = 2 / (length + 1), NAN, NAN, EmaMean(length), NAN
    n = 0

    def step(x):
        nonlocal e, ec, n, before
        src, before = (before if confirmed_only and before == before else x), x
        n += 1
        if pine_compatible:
            e = a * src + (1 - a) * (0.0 if e != e else e)
        else:
            e = mean(src)
            if n < length:
                return NAN
        last = (0.0 if pine_compatible else e) if ec != ec else ec
        best, least = 0.0, float("inf")
        for k in range(-gain_limit, gain_limit + 1):
            g = k / 10
            d = abs(src - (a * (e + g * (src - last)) + (1 - a) * last))
            if d < least:
                least, best = d, g
        ec = a * (e + best * (src - last)) + (1 - a) * last
        return ec

    return step


def _hilbert(q, adj):
    """Ehlers' four-tap Hilbert transform of a queue, newest first."""
    return (0.0962 * q[0] + 0.5769 * q[2] - 0.5769 * q[4] - 0.0962 * q[6]) * adj


class _Cycle:
    """Dominant cycle by homodyne discrimination; phase of the in-phase and quadrature parts."""

    def __init__(self) -> None:
        self.x, self.s, self.d, self.i1, self.q1 = (deque([0.0] * 7, maxlen=7) for _ in range(5))
        self.i2 = self.q2 = self.re = self.im = self.period = self.smooth = 0.0

    def __call__(self, x: float) -> tuple[float, float]:
        if self.x[0] == 0.0 and not any(self.x):
            self.x.extend([x] * 7)
        self.x.appendleft(x)
        adj = 0.075 * self.period + 0.54
        self.s.appendleft((4 * self.x[0] + 3 * self.x[1] + 2 * self.x[2] + self.x[3]) / 10)
        self.d.appendleft(_hilbert(self.s, adj))
        self.q1.appendleft(_hilbert(self.d, adj))
        self.i1.appendleft(self.d[3])
        i2 = 0.2 * (self.i1[0] - _hilbert(self.q1, adj)) + 0.8 * self.i2
        q2 = 0.2 * (self.q1[0] + _hilbert(self.i1, adj)) + 0.8 * self.q2
        self.re = 0.2 * (i2 * self.i2 + q2 * self.q2) + 0.8 * self.re
        self.im = 0.2 * (i2 * self.q2 - q2 * self.i2) + 0.8 * self.im
        self.i2, self.q2 = i2, q2
        p = 2 * pi / atan(self.im / self.re) if self.re and self.im else self.period
        p = clamp(clamp(p, 0.67 * self.period, 1.5 * self.period), 6.0, 50.0)
        self.period = 0.2 * p + 0.8 * self.period
        self.smooth = 0.33 * self.period + 0.67 * self.smooth
        i, q = self.i1[0], self.q1[0]
        return self.smooth, atan(q / i) * 180 / pi if i else 0.0


@fold("x", "mama", "fama")
def mama(fast_limit=0.5, slow_limit=0.05):
    cycle, before, m, f, n = _Cycle(), 0.0, NAN, NAN, 0

    def step(x):
        nonlocal before, m, f, n
        n += 1
        _, phase = cycle(x)
        d, before = max(1.0, before - phase), phase
        a = clamp(fast_limit / d, slow_limit, fast_limit)
        m = x if m != m else a * x + (1 - a) * m
        f = m if f != f else 0.5 * a * m + (1 - 0.5 * a) * f
        return (m, f) if n > 10 else (NAN, NAN)

    return step


@fold("x")
def ehlers_itrend(warmup_bars=12, max_dc_period=50):
    cycle, q, t, n = _Cycle(), deque(maxlen=max_dc_period), deque(maxlen=4), 0

    def step(x):
        nonlocal n
        n += 1
        p, _ = cycle(x)
        q.append(x)
        k = int(clamp(floor(p + 0.5), 1, min(max_dc_period, len(q))))
        t.appendleft(sum(list(q)[-k:]) / k)
        if n <= warmup_bars:
            return x if n == warmup_bars else NAN
        return (4 * t[0] + 3 * t[1] + 2 * t[2] + t[3]) / 10 if len(t) == 4 else NAN

    return step


@fold("h l c")
def frama(window=10, sc=300, fc=1):
    """The window is made even; the seed is the mean of its closes."""
    n = window + window % 2
    hs, ls, cs = deque(maxlen=n), deque(maxlen=n), deque(maxlen=n)
    w, d1, y = log(2 / (sc + 1)), NAN, NAN

    def step(h, l, c):  # noqa: E741
        nonlocal d1, y
        if len(hs) < n:
            hs.append(h), ls.append(l), cs.append(c)
            if len(hs) == n:
                y = sum(cs) / n
            return y
        half, a, b = n // 2, list(hs), list(ls)
        n1 = (max(a[half:]) - min(b[half:])) / half
        n2 = (max(a[:half]) - min(b[:half])) / half
        n3 = (max(a) - min(b)) / n
        d = (log(n1 + n2) - log(n3)) / log(2) if n1 > 0 and n2 > 0 and n3 > 0 else (d1 if d1 == d1 else 1.0)
        d1 = d
        alpha = clamp(exp(w * (d - 1)), 0.1, 1.0)
        m = (sc - fc) * ((2 - alpha) / alpha - 1) / (sc - 1) + fc
        alpha = clamp(2 / (m + 1), 2 / (sc + 1), 1.0)
        y = alpha * c + (1 - alpha) * y
        hs.append(h), ls.append(l), cs.append(c)
        return y

    return step


@fold("x")
def nama(period=30):
    """Alpha is the window's range over the way travelled in it; starts at alpha * x."""
    q, y = deque(maxlen=period + 1), NAN

    def step(x):
        nonlocal y
        q.append(x)
        last = list(q)[-period:]
        if len(last) < period:
            return NAN
        full = list(q)
        way = sum(abs(b - a) for a, b in zip(full[-period - 1 :], full[-period:])) if len(full) > period else sum(abs(b - a) for a, b in zip(last, last[1:]))
        a = (max(last) - min(last)) / way if way else 0.0
        y = a * x if y != y else a * x + (1 - a) * y
        return y

    return step


@fold("x")
def sama(length=200, maj_length=14, min_length=6):
    """From the first bar on, over as many bars as there are."""
    q, major, minor, y = deque(maxlen=length + 1), 2 / (maj_length + 1), 2 / (min_length + 1), NAN

    def step(x):
        nonlocal y
        q.append(x)
        top, low = max(q), min(q)
        m = abs(2 * x - low - top) / (top - low) if top != low else 0.0
        a = (m * (minor - major) + major) ** 2
        y = x if y != y else y + a * (x - y)
        return y

    return step


@fold("x")
def dma(hull_length=7, ema_length=20, ema_gain_limit=50, hull_ma_type="WMA"):
    half, root = max(1, hull_length // 2), max(1, round(sqrt(hull_length)))
    wma = hull_ma_type.upper() == "WMA"
    a, b = (Fir(W.wma(half)), Fir(W.wma(hull_length))) if wma else (Seeded(half), Seeded(hull_length))
    end = Fir(W.wma(root)) if wma else Seeded(root)
    ec = ehlers_ecema(ema_length, ema_gain_limit)

    def step(x):
        return (end(2 * a(x) - b(x)) + ec(x)) / 2

    return step


@fold("h l c")
def tradjema(length=40, mult=10.0):
    alpha, tr, top, low, y, before = 2 / (length + 1), TrueRange(), Max(length), Min(length), NAN, NAN

    def step(h, l, c):  # noqa: E741
        nonlocal y, before
        t = tr(h, l, c)
        hi, lo = top(t), low(t)
        src, before = before, c
        if hi != hi or src != src:
            return NAN
        k = alpha * (1 + ((t - lo) / (hi - lo) if hi != lo else 0.0) * mult)
        y = src if y != y else y + k * (src - y)
        return y

    return step


@fold("x v")
def uma(accelerator=1.0, min_length=5, max_length=50, smooth_length=4):
    """The length grows while x is near its mean and shrinks while it is far off; weights are
    a power of the place, the power follows the money flow (or the RSI without volume)."""
    n, length = max_length, float(max_length)
    q, vq = deque(maxlen=n + 1), deque(maxlen=n + 1)
    sd, mean, end = Std(n), Sma(n), Fir(W.wma(smooth_length)) if smooth_length > 1 else (lambda y: y)

    def strength(p):
        xs, vs = list(q)[-p - 1 :], list(vq)[-p - 1 :]
        flow = any(vs)
        up = sum((b * w if flow else b - a) for a, b, w in zip(xs, xs[1:], vs[1:]) if b > a)
        down = sum((b * w if flow else a - b) for a, b, w in zip(xs, xs[1:], vs[1:]) if b < a)
        return 100 * up / (up + down) if up + down else 50.0

    def step(x, v):
        nonlocal length
        q.append(x), vq.append(0.0 if v != v else v)
        m, s = mean(x), sd(x)
        if m != m:
            return NAN
        if m - 0.25 * s <= x <= m + 0.25 * s:
            length += 1
        elif x < m - 1.75 * s or x > m + 1.75 * s:
            length -= 1
        length = clamp(length, min_length, max_length)
        p = round(length)
        power = accelerator + abs(2 * strength(p) - 100) / 25
        last = list(q)[-p:]
        w = [(i + 1) ** power for i in range(len(last))]
        return end(sum(a * b for a, b in zip(w, last)) / sum(w))

    return step


@fold("x")
def volatility_adjusted_ma(base_period=113, vol_period=51, smoothing=True, smooth_type=3, smooth_period=5):
    base, top, low = EmaMean(base_period), Max(vol_period), Min(vol_period)
    kinds = {1: lambda p: Sma(p), 2: lambda p: EmaMean(p), 3: lambda p: Fir(W.wma(p))}
    end, n = kinds[smooth_type](smooth_period) if smoothing else None, 0

    def step(x):
        nonlocal n
        n += 1
        e = base(x)
        if n < base_period:
            return NAN
        y = e + (top(x - e) + low(x - e)) / 2
        return end(y) if end else y

    return step


@fold("x")
def vidya(short_period=2, long_period=5, alpha=0.2):
    a, b, y, n = Std(short_period), Std(long_period), NAN, 0

    def step(x):
        nonlocal y, n
        n += 1
        s, l = a(x), b(x)  # noqa: E741
        if n < long_period - 1:
            return NAN
        if y != y:
            y = x
            return y
        k = alpha * s / l if l == l and l > 0 else alpha if l != l else 0.0
        y += k * (x - y)
        return y

    return step


@fold("x")
def vlma(min_period=5, max_period=50, matype="sma", devtype=0):
    from ..functions.steps import average

    mean, dev, p, y, n = average(matype, max_period), _deviation(max_period, devtype), float(max_period), NAN, 0

    def step(x):
        nonlocal p, y, n
        n += 1
        m, s = mean(x), dev(x)
        if y != y:
            y = x
            return y if n >= max_period else NAN
        if s == s and n >= max_period:
            if x < m - 1.75 * s or x > m + 1.75 * s:
                p -= 1
            elif m - 0.25 * s <= x <= m + 0.25 * s:
                p += 1
            p = clamp(p, min_period, max_period)
        y += 2 / (p + 1) * (x - y)
        return y if n >= max_period else NAN

    return step


def _deviation(period, devtype):
    if devtype == 0:
        return Std(period)
    ring = Ring(period)

    def step(x):
        if not ring.push(x):
            return NAN
        q = sorted(ring.q)
        mid = lambda v: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
        if devtype == 1:
            m = sum(q) / period
            return sum(abs(v - m) for v in q) / period
        m = mid(q)
        return mid(sorted(abs(v - m) for v in q))

    return step


@fold("x")
def laguerre(gamma=0.02):
    """The four-stage Laguerre filter that macz can use."""
    l0 = l1 = l2 = l3 = NAN

    def step(x):
        nonlocal l0, l1, l2, l3
        if l0 != l0:
            l0 = l1 = l2 = l3 = x
        a, b, c = l0, l1, l2
        l0 = (1 - gamma) * x + gamma * a
        l1 = -gamma * l0 + a + gamma * b
        l2 = -gamma * l1 + b + gamma * c
        l3 = -gamma * l2 + c + gamma * l3
        return (l0 + 2 * l1 + 2 * l2 + l3) / 6

    return step
