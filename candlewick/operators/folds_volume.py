"""Recursive volume operators."""

from __future__ import annotations

from ..functions.steps import NAN, Ema0, EmaMean, Sum
from .registry import fold


@fold("h l c v")
def adosc(short_period=3, long_period=10):
    if short_period >= long_period:
        raise ValueError("adosc: short_period must be less than long_period")
    a, b, total = Ema0(short_period), Ema0(long_period), 0.0

    def step(h, l, c, v):  # noqa: E741
        nonlocal total
        total += ((c - l) - (h - c)) / (h - l) * v if h != l else 0.0
        return a(total) - b(total)

    return step


@fold("c v", gap="hold")
def efi(period=13):
    e, before = Ema0(period), NAN

    def step(c, v):
        nonlocal before
        d, before = c - before, c
        return e(d * v)

    return step


@fold("h l c v")
def kvo(short_period=2, long_period=5):
    a, b = Ema0(short_period), Ema0(long_period)
    hlc = dm = NAN
    trend, cm = -1, 0.0

    def step(h, l, c, v):  # noqa: E741
        nonlocal hlc, dm, trend, cm
        s, d = h + l + c, h - l
        if hlc != hlc:
            hlc, dm = s, d
            return NAN
        if s > hlc and trend != 1:
            trend, cm = 1, dm
        elif s < hlc and trend != 0:
            trend, cm = 0, dm
        cm += d
        vf = v * abs(2 * d / cm - 1) * 100 * (1 if trend == 1 else -1) if cm else 0.0
        hlc, dm = s, d
        return a(vf) - b(vf)

    return step


def _index(start, moves):
    y, c0, v0 = start, NAN, NAN

    def step(c, v):
        nonlocal y, c0, v0
        if c0 == c0 and c0 and moves(v, v0):
            y *= c / c0
        c0, v0 = c, v
        return y

    return step


@fold("c v")
def nvi():
    return _index(1000.0, lambda v, before: v < before)


@fold("c v")
def pvi(initial_value=1000.0):
    return _index(initial_value, lambda v, before: v > before)


@fold("c v", "macd", "signal", "hist")
def vwmacd(fast_period=12, slow_period=26, signal_period=9):
    sums = [(Sum(p), Sum(p)) for p in (fast_period, slow_period)]
    signal, n = EmaMean(signal_period), 0

    def step(c, v):
        nonlocal n
        (a, b), (p, q) = ((x(c * v), y(v)) for x, y in sums)
        if p != p or not b or not q:
            return NAN, NAN, NAN
        m = a / b - p / q
        s = signal(m)
        n += 1
        return (m, s, m - s) if n >= signal_period else (m, NAN, NAN)

    return step


@fold("o h l c v", "dvdi", "fast_tl", "slow_tl", "center")
def dvdiqqe(period=13, smoothing_period=6, fast_multiplier=3.0, slow_multiplier=5.0, volume_type="default", center_type="dynamic", tick_size=0.0001):
    """Dual volume divergence with trailing lines; tick volume counts the body in ticks."""
    long = 2 * period - 1
    pe, ne, ps, ns = EmaMean(period), EmaMean(period), EmaMean(smoothing_period), EmaMean(smoothing_period)
    r1, r2 = EmaMean(long), EmaMean(long)
    pvi_ = nvi_ = total = 0.0
    c0 = v0 = d0 = fast = slow = NAN
    ticks, n, m = tick_size, 0, 0

    def trail(line, d, before, reach):
        if line != line:
            return d
        if d > line:
            return max(line, d - reach) if before > line else d - reach
        return min(line, d + reach) if before < line else d + reach

    def step(o, h, l, c, v):  # noqa: E741
        nonlocal pvi_, nvi_, total, c0, v0, d0, fast, slow, ticks, n, m
        n += 1
        body = c - o
        ticks = body if abs(body) >= tick_size else ticks
        volume = abs(ticks) / tick_size if volume_type == "tick" or v != v else v
        if c0 == c0:
            if volume > v0:
                pvi_ += c - c0
            elif volume < v0:
                nvi_ -= c - c0
        c0, v0 = c, volume
        d = ps(pvi_ - pe(pvi_)) - ns(nvi_ - ne(nvi_))
        before, d0 = d0, d
        if before != before:
            return NAN, NAN, NAN, NAN
        reach = r2(r1(abs(d - before)))
        fast, slow = trail(fast, d, before, fast_multiplier * reach), trail(slow, d, before, slow_multiplier * reach)
        if n <= long:
            return NAN, NAN, NAN, NAN
        m += 1
        total += d
        return d, fast, slow, total / m if center_type == "dynamic" else 0.0

    return step
