"""Recursive trend, stop, band and volatility operators."""

from __future__ import annotations

from collections import deque
from math import cos, pi, sin, sqrt

from ..functions.steps import NAN, Atr, Ema0, HighPass1, Lag, Max, Min, Rma, Rsi, Sma, Std, Sum, TrueRange, Wilder, average
from .folds_averages import _Cycle, clamp
from .registry import fold


class _Moves:
    """True range and directional moves against the bar before; nans on the first bar."""

    def __init__(self) -> None:
        self.h = self.l = self.c = NAN

    def __call__(self, h, l, c):  # noqa: E741
        ph, pl, pc, self.h, self.l, self.c = self.h, self.l, self.c, h, l, c
        if ph != ph:
            return NAN, NAN, NAN
        up, down = h - ph, pl - l
        return max(h - l, abs(h - pc), abs(l - pc)), (up if up > down and up > 0 else 0.0), (down if down > up and down > 0 else 0.0)


def _dx(plus, minus):
    return 100 * abs(plus - minus) / (plus + minus) if plus + minus else 0.0


@fold("h l c")
def atr(length=14):
    return Atr(length)


@fold("h l c")
def natr(period=14):
    a = Atr(period)

    def step(h, l, c):  # noqa: E741
        y = a(h, l, c)
        return 100 * y / c if c else NAN

    return step


@fold("h l c")
def adx(period=14):
    moves, tr, p, m, mean = _Moves(), Wilder(period, period), Wilder(period, period), Wilder(period, period), Rma(period)

    def step(h, l, c):  # noqa: E741
        t, u, d = moves(h, l, c)
        t, u, d = tr(t), p(u), m(d)
        if t != t:
            return NAN
        return mean(_dx(100 * u / t, 100 * d / t) if t else 0.0)

    return step


@fold("h l c")
def adxr(period=14):
    a, old = adx(period), Lag(period)

    def step(h, l, c):  # noqa: E741
        y = a(h, l, c)
        return (y + old(y)) / 2

    return step


@fold("h l c", "plus", "minus")
def di(period=14):
    moves, tr, p, m = _Moves(), *(Wilder(period, max(1, period - 1)) for _ in range(3))

    def step(h, l, c):  # noqa: E741
        t, u, d = moves(h, l, c)
        t, u, d = tr(t), p(u), m(d)
        return (100 * u / t, 100 * d / t) if t == t and t else ((0.0, 0.0) if t == 0 else (NAN, NAN))

    return step


@fold("h l", "plus", "minus")
def dm(period=14):
    moves, p, m = _Moves(), Wilder(period, max(1, period - 1)), Wilder(period, max(1, period - 1))

    def step(h, l):  # noqa: E741
        _, u, d = moves(h, l, l)
        return p(u), m(d)

    return step


@fold("h l c", gap="hold")
def dx(period=14):
    moves, p, m, last = _Moves(), Wilder(period, max(1, period - 1)), Wilder(period, max(1, period - 1)), NAN

    def step(h, l, c):  # noqa: E741
        nonlocal last
        _, u, d = moves(h, l, c)
        u, d = p(u), m(d)
        if u == u:
            last = 100 * abs(u - d) / (u + d) if u + d else (last if last == last else 0.0)
        return last

    return step


@fold("x", "jaw", "teeth", "lips", x="hl2")
def alligator(jaw_period=13, jaw_offset=8, teeth_period=8, teeth_offset=5, lips_period=5, lips_offset=3):
    lines = [(Rma(p), Lag(k)) for p, k in ((jaw_period, jaw_offset), (teeth_period, teeth_offset), (lips_period, lips_offset))]
    return lambda x: tuple(old(m(x)) for m, old in lines)


@fold("o h l c v", "k1", "k2")
def alphatrend(coeff=1.0, period=14, no_volume=False):
    tr, mean, r, pos, neg, tp0 = TrueRange(), Sma(period), Rsi(period), Sum(period), Sum(period), NAN
    ks = deque(maxlen=3)

    def step(o, h, l, c, v):  # noqa: E741
        nonlocal tp0
        a, rs, tp = mean(tr(h, l, c)), r(c), (h + l + c) / 3
        p = q = NAN
        if tp0 == tp0:
            p, q = pos(tp * v if tp > tp0 else 0.0), neg(tp * v if tp < tp0 else 0.0)
        tp0 = tp
        m = rs if no_volume else (NAN if p != p else 100 * p / (p + q) if p + q > 1e-14 else 0.0)
        if a != a or m != m:
            return NAN, NAN
        up, down = l - coeff * a, h + coeff * a
        k = up if m >= 50 else down
        if ks:
            k = max(up, ks[-1]) if m >= 50 else min(down, ks[-1])
        ks.append(k)
        return k, ks[0] if len(ks) == 3 else NAN

    return step


@fold("x", "bp", "bp_normalized", "signal", "trigger")
def bandpass(period=20, bandwidth=0.3):
    b, g = cos(2 * pi / period), cos(2 * pi * bandwidth / period)
    a = 1 / g - sqrt(1 / (g * g) - 1)
    hp, trig = HighPass1(max(1, round(4 * period / bandwidth))), HighPass1(max(2, round(period / bandwidth / 1.5)))
    hs, ys, peak = deque(maxlen=3), deque(maxlen=2), 0.0

    def step(x):
        nonlocal peak
        hs.append(hp(x))
        y = hs[-1] if len(hs) < 3 else 0.5 * (1 - a) * (hs[2] - hs[0]) + b * (1 + a) * ys[1] - a * ys[0]
        ys.append(y)
        peak = max(0.991 * peak, abs(y))
        n = y / peak if peak else 0.0
        t = trig(n)
        return y, n, (1.0 if n < t else -1.0 if n > t else 0.0), t

    return step


@fold("h l c")
def chande(period=22, mult=3.0, direction="long"):
    a, top, low = Atr(period), Max(period), Min(period)

    def step(h, l, c):  # noqa: E741
        y = a(h, l, c)
        hi, lo = top(h), low(l)
        return hi - mult * y if direction == "long" else lo + mult * y

    return step


@fold("h l c", "long_stop", "short_stop")
def chandelier_exit(period=22, mult=3.0, use_close=True):
    a, top, low = Atr(period), Max(period), Min(period)
    ls = ss = pc = NAN
    way = 1

    def step(h, l, c):  # noqa: E741
        nonlocal ls, ss, pc, way
        y = a(h, l, c)
        hi, lo = top(c if use_close else h), low(c if use_close else l)
        if y != y:
            pc = c
            return NAN, NAN
        nl, ns = hi - mult * y, lo + mult * y
        l1, s1 = (nl if ls != ls else ls), (ns if ss != ss else ss)
        if pc > l1:
            nl = max(nl, l1)
        if pc < s1:
            ns = min(ns, s1)
        way = 1 if c > s1 else -1 if c < l1 else way
        ls, ss, pc = nl, ns, c
        return (nl, NAN) if way == 1 else (NAN, ns)

    return step


@fold("h l c", "long", "short")
def cksp(p=10, x=1.0, q=9):
    a, top, low, mx, mn = Atr(p), Max(q), Min(q), Max(q), Min(q)

    def step(h, l, c):  # noqa: E741
        y = a(h, l, c)
        hi, lo = top(h), low(l)
        return mx(hi - x * y), mn(lo + x * y)

    return step


@fold("h l c", "vol", "anti")
def damiani_volatmeter(vis_atr=13, vis_std=20, sed_atr=40, sed_std=100, threshold=1.4):
    tr, a, b, sa, sb = TrueRange(), Rma(vis_atr), Rma(sed_atr), Std(vis_std), Std(sed_std)
    old, n, need = deque([0.0, 0.0, 0.0], maxlen=3), 0, max(vis_atr, vis_std, sed_atr, sed_std, 3) + 1

    def step(h, l, c):  # noqa: E741
        nonlocal n
        n += 1
        t = tr(h, l, c)
        u, w, p, q = a(t), b(t), sa(c), sb(c)
        if n < need:
            return NAN, NAN
        y = (u / w if w else 0.0) + 0.5 * (old[-1] - old[0])
        old.append(y)
        return y, threshold - (p / q if q else 0.0)

    return step


@fold("h l", "upper", "middle", "lower")
def emd(period=20, delta=0.5, fraction=0.1):
    b, g = cos(2 * pi / period), 1 / cos(4 * pi * delta / period)
    a = g - sqrt(max(g * g - 1, 0.0))
    up, low, mid = Sma(50), Sma(50), Sma(2 * period)
    xs, ys, peak, valley = deque(maxlen=3), deque(maxlen=3), NAN, NAN

    def step(h, l):  # noqa: E741
        nonlocal peak, valley
        x = (h + l) / 2
        xs.append(x)
        if peak != peak:
            peak = valley = x
        y = x if len(xs) < 3 else 0.5 * (1 - a) * (x - xs[0]) + b * (1 + a) * ys[-1] - a * ys[-2]
        ys.append(y)
        if len(ys) == 3:
            if ys[1] > ys[2] and ys[1] > ys[0]:
                peak = ys[1]
            if ys[1] < ys[2] and ys[1] < ys[0]:
                valley = ys[1]
        return up(fraction * peak), mid(y), low(fraction * valley)

    return step


@fold("h l c", "upper", "lower", "upper_ts", "lower_ts")
def fvg_trailing_stop(unmitigated_fvg_lookback=5, smoothing_length=9, reset_on_cross=False):
    """Open gaps stay in their list until a close fills them. A side without gaps stands at the
    mean of the closes since it has none."""
    bars, closes = deque(maxlen=3), deque(maxlen=smoothing_length)

    def side(fills):
        gaps, mean, bare = deque(maxlen=unmitigated_fvg_lookback), Sma(smoothing_length), None

        def level(new, c):
            nonlocal bare
            if new == new:
                gaps.append(new)
            for g in [g for g in gaps if fills(g, c)]:
                gaps.remove(g)
            if gaps:
                bare = 0
                return mean(sum(gaps) / len(gaps))
            if bare is None:
                return mean(c)
            bare = min(bare + 1, smoothing_length)
            last = list(closes)[-bare:]
            return mean(sum(last) / len(last))

        return level

    bull, bear = side(lambda g, c: g > c), side(lambda g, c: g < c)
    way, ts, ts0 = 0, NAN, NAN

    def step(h, l, c):  # noqa: E741
        nonlocal way, ts, ts0
        bars.append((h, l, c))
        closes.append(c)
        up = down = NAN
        if len(bars) == 3:
            (h2, l2, _), (_, _, c1) = bars[0], bars[1]
            up = h2 if l > h2 and c1 > h2 else NAN
            down = l2 if h < l2 and c1 < l2 else NAN
        u, d = bull(up, c), bear(down, c)
        before, way = way, 1 if c > d else -1 if c < u else way
        if way and before and way != before:
            ts = u if way == 1 else d
        elif ts == ts:
            ts = max(ts, u) if way == 1 else min(ts, d) if way == -1 else ts
        if reset_on_cross and way:
            if way * (c - ts) < 0:
                ts = NAN
            elif ts != ts and (c > d if way == 1 else c < u):
                ts = u if way == 1 else d
        shown = ts if ts == ts else ts0
        ts0 = ts
        if shown != shown or not way:
            return NAN, NAN, NAN, NAN
        return (NAN, u, NAN, shown) if way == 1 else (d, NAN, shown, NAN)

    return step


@fold("h l c", "halftrend", "trend", "atr_high", "atr_low", "buy", "sell")
def halftrend(amplitude=2, channel_deviation=2.0, atr_period=100):
    a, top, low, hm, lm = Atr(atr_period), Max(amplitude), Min(amplitude), Sma(amplitude), Sma(amplitude)
    n, need = 0, max(amplitude, atr_period)
    trend = nxt = 0
    up = down = 0.0
    floor_ = roof = ph = pl = NAN

    def step(h, l, c):  # noqa: E741
        nonlocal n, trend, nxt, up, down, floor_, roof, ph, pl
        n += 1
        y, hi, lo, mh, ml = a(h, l, c), top(h), low(l), hm(h), lm(l)
        if n < need:
            ph, pl = h, l
            return (NAN,) * 6
        first, was = floor_ != floor_, trend
        if first:
            floor_, roof = (pl if pl == pl else l), (ph if ph == ph else h)
            ph, pl = (h if ph != ph else ph), (l if pl != pl else pl)
        if nxt == 1:
            floor_ = max(floor_, lo)
            if mh < floor_ and c < pl:
                trend, nxt, roof = 1, 0, hi
        else:
            roof = min(roof, hi)
            if ml > roof and c > ph:
                trend, nxt, floor_ = 0, 1, lo
        ph, pl = h, l
        flip, reach, buy, sell = not first and was != trend, channel_deviation * y / 2, NAN, NAN
        if trend == 0:
            if flip:
                up = down
                buy = up - y / 2
            else:
                up = floor_ if first or up == 0 else max(up, floor_)
            line = up
        else:
            if flip:
                down = up
                sell = down + y / 2
            else:
                down = roof if first or down == 0 else min(down, roof)
            line = down
        return line, float(trend), line + reach, line - reach, buy, sell

    return step


@fold("h l c x", "upper", "middle", "lower")
def keltner(period=20, multiplier=2.0, ma_type="ema"):
    a, m, n = Atr(period), average(ma_type, period), 0

    def step(h, l, c, x):  # noqa: E741
        nonlocal n
        n += 1
        y, mid = a(h, l, c), m(x)
        if n < period:
            return NAN, NAN, NAN
        return mid + multiplier * y, mid, mid - multiplier * y

    return step


@fold("h l c x", "filter", "high_band", "low_band")
def lpc(cutoff_type="adaptive", fixed_period=20, max_cycle_limit=60, cycle_mult=1.0, tr_mult=1.0):
    """One-pole low-pass of the price and of the true range; adaptive: at the dominant cycle."""
    tr, cycle = TrueRange(), _Cycle()
    xs, y, t0, ty = deque(maxlen=2), NAN, NAN, NAN

    def step(h, l, c, x):  # noqa: E741
        nonlocal y, t0, ty
        t = tr(h, l, c)
        p = float(fixed_period)
        dominant, _ = cycle(x)
        if cutoff_type == "adaptive":
            p = clamp(round(dominant * cycle_mult), 3.0, float(max_cycle_limit)) if dominant > 0 else p
        w = 2 * pi / p
        a = (1 - sin(w)) / cos(w) if abs(cos(w)) > 1e-12 else 0.0
        xs.append(x)
        if y != y:
            y, ty = x, t
        else:
            y = 0.5 * (1 - a) * (xs[1] + xs[0]) + a * y
            ty = 0.5 * (1 - a) * (t + t0) + a * ty
        t0 = t
        return y, y + tr_mult * ty, y - tr_mult * ty

    return step


def _var(period):
    """The average weighted by the absolute CMO over nine bars."""
    ups, downs, x0, y, a = deque(maxlen=9), deque(maxlen=9), NAN, 0.0, 2 / (period + 1)

    def step(x):
        nonlocal x0, y
        d, x0 = (0.0 if x0 != x0 else x - x0), x
        ups.append(max(d, 0.0)), downs.append(max(-d, 0.0))
        u, w = sum(ups), sum(downs)
        k = a * (abs((u - w) / (u + w)) if u + w else 0.0)
        y = k * x + (1 - k) * y
        return y

    return step


def _ratchet(percent):
    """The optimised trend line of a mean: stops that only follow, and the side it is on."""
    ls = ss = NAN
    way = 1

    def step(m):
        nonlocal ls, ss, way
        f = percent / 100 * m
        lo, hi = m - f, m + f
        l1, s1 = (lo if ls != ls else ls), (hi if ss != ss else ss)
        ls = max(lo, l1) if m > l1 else lo
        ss = min(hi, s1) if m < s1 else hi
        way = 1 if way == -1 and m > s1 else -1 if way == 1 and m < l1 else way
        stop = ls if way == 1 else ss
        return stop * (200 + percent) / 200 if m > stop else stop * (200 - percent) / 200

    return step


@fold("x")
def ott(period=2, percent=1.4, ma_type="VAR"):
    m, line = _var(period) if ma_type.upper() == "VAR" else average(ma_type, period), _ratchet(percent)

    def step(x):
        y = m(x)
        return line(y) if y == y else NAN

    return step


@fold("x", "hott", "lott")
def otto(ott_period=2, ott_percent=0.6, fast_vidya_length=10, slow_vidya_length=25, correcting_constant=100000.0, ma_type="VAR"):
    a, b, c = _var(slow_vidya_length / 2), _var(slow_vidya_length), _var(slow_vidya_length * fast_vidya_length)
    m, line = _var(ott_period) if ma_type.upper() == "VAR" else average(ma_type, ott_period), _ratchet(ott_percent)

    def step(x):
        u, v, w = a(x), b(x), c(x)
        d = v - w + correcting_constant
        lott = u / d if d else NAN
        y = m(lott)
        return (line(y) if y == y else NAN), lott

    return step


@fold("x", "filter", "high_band", "low_band")
def range_filter(range_size=2.618, range_period=14, smooth_range=True, smooth_period=27):
    e, s, x0, f = Ema0(range_period), Ema0(smooth_period), NAN, NAN

    def step(x):
        nonlocal x0, f
        d, x0 = abs(x - x0), x
        if d != d:
            f = x
            return NAN, NAN, NAN
        r = range_size * e(d)
        if smooth_range:
            r = s(r)
        f = clamp(f, x - r, x + r)
        return f, f + r, f - r

    return step


@fold("h l")
def safezonestop(period=22, mult=2.5, max_lookback=3, direction="long"):
    mean, ph, pl, q = Rma(period), NAN, NAN, deque(maxlen=max_lookback)

    def step(h, l):  # noqa: E741
        nonlocal ph, pl
        h0, l0, ph, pl = ph, pl, h, l
        if h0 != h0:
            return NAN
        up, down = h - h0, l0 - l
        if direction == "long":
            m = mean(down if down > up and down > 0 else 0.0)
            q.append(l0 - mult * m)
        else:
            m = mean(up if up > down and up > 0 else 0.0)
            q.append(h0 + mult * m)
        if m != m or len(q) < max_lookback or any(v != v for v in q):
            return NAN
        return max(q) if direction == "long" else min(q)

    return step


@fold("h l")
def sar(acceleration=0.02, maximum=0.2):
    bars, up, s, ep, acc = deque(maxlen=3), True, NAN, NAN, acceleration

    def step(h, l):  # noqa: E741
        nonlocal up, s, ep, acc
        bars.append((h, l))
        if len(bars) == 1:
            return NAN
        if s != s:
            (h0, l0), up = bars[0], h > bars[0][0]
            s, ep = (l0, h) if up else (h0, l)
            return s
        nxt = s + acc * (ep - s)
        if up:
            if l < nxt:
                up, nxt, ep, acc = False, ep, l, acceleration
            else:
                if h > ep:
                    ep, acc = h, min(acc + acceleration, maximum)
                nxt = min(nxt, *(b[1] for b in list(bars)[:-1]))
        elif h > nxt:
            up, nxt, ep, acc = True, ep, h, acceleration
        else:
            if l < ep:
                ep, acc = l, min(acc + acceleration, maximum)
            nxt = max(nxt, *(b[0] for b in list(bars)[:-1]))
        s = nxt
        return s

    return step


@fold("h l c", "trend", "changed")
def supertrend(period=10, factor=3.0):
    a, u1, l1, c1, up = Atr(period), NAN, NAN, NAN, True

    def step(h, l, c):  # noqa: E741
        nonlocal u1, l1, c1, up
        y, mid = a(h, l, c), (h + l) / 2
        if y != y:
            return NAN, NAN
        ub, lb = mid + factor * y, mid - factor * y
        if u1 != u1:
            u1, l1, c1, up = ub, lb, c, c > ub
            return (lb if up else ub), 0.0
        cu = min(ub, u1) if c1 <= u1 else ub
        cl = max(lb, l1) if c1 >= l1 else lb
        was = up
        up = c >= cl if was else c > cu
        u1, l1, c1 = cu, cl, c
        return (cl if up else cu), float(up != was)

    return step


@fold("x", "voss", "filt")
def voss(period=20, predict=3, bandwidth=0.25):
    order, f, g = 3 * predict, cos(2 * pi / period), cos(2 * pi * bandwidth / period)
    s = 1 / g - sqrt(1 / (g * g) - 1)
    xs, ys, vs, n = deque(maxlen=3), deque([0.0, 0.0], maxlen=2), deque([0.0] * order, maxlen=order), 0
    need = max(period, 5, order)

    def step(x):
        nonlocal n
        n += 1
        xs.append(x)
        y = 0.0 if n <= need else 0.5 * (1 - s) * (x - xs[0]) + f * (1 + s) * ys[1] - s * ys[0]
        ys.append(y)
        v = (3 + order) / 2 * y - sum((k + 1) / order * w for k, w in enumerate(vs))
        vs.append(v)
        return (v, y) if n > need else (NAN, NAN)

    return step
