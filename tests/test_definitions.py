"""Operators without SQL against their definitions, spelled out over plain lists."""

import math
import random

import pytest

from candlewick.plans import runner


def bars(n, seed):
    rng, out, c = random.Random(seed), [], 50.0
    for i in range(n):
        c = max(1.0, c + rng.gauss(0, 0.8))
        out.append(("a", i, c - rng.random() / 2, c + rng.random(), c - rng.random(), c, float(rng.randint(1, 500))))
    return out


def applied(spark, rows, name, **params):
    df = spark.createDataFrame(rows, "series string, ts long, open double, high double, low double, close double, volume double")
    return [tuple(r)[7:] for r in runner.apply(df, name, **params).orderBy("ts").collect()]


def same(ours, theirs):
    assert len(ours) == len(theirs)
    for i, (a, b) in enumerate(zip(ours, theirs)):
        a = None if a is None or math.isnan(a) else a
        assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7)), (i, a, b)


def smoothed(v, f):
    a = b = 0.0
    out = []
    for x in v:
        a = f * x + (1 - f) * a
        b = f * a + (1 - f) * b
        out.append(1.5 * a - 0.5 * b)
    return out


@pytest.mark.parametrize("period, flat", [(14, 0), (4, 0), (6, 30)])
def test_rsx(spark, period, flat):
    rows = [(*r[:5], 7.0 if i < flat else r[5], r[6]) for i, r in enumerate(bars(80, 3))]
    x = [r[5] for r in rows]
    top = bottom = None
    steps = [100 * (x[i] - x[i - 1]) for i in range(period, len(x))]
    top, bottom = steps, [abs(d) for d in steps]
    for _ in range(3):
        top, bottom = smoothed(top, 3 / (period + 2)), smoothed(bottom, 3 / (period + 2))
    want = [None] * period
    wait = max(period - 1, 5)
    moved = next((i for i, d in enumerate(steps) if d), len(steps))
    # the value shows once `wait` bars have gone by since a start; a wait without any move starts anew
    start = -1
    while moved > start + wait - 1:
        start += wait if start >= 0 else wait - 1
    for i in range(len(steps)):
        shown = i >= start + wait and bottom[i] > 1e-10
        want.append(min(100.0, max(0.0, 50 * (top[i] / bottom[i] + 1))) if shown else 50.0)
    got = [r[0] for r in applied(spark, rows, "rsx", period=period)]
    if not flat:
        same(got, want)
    else:  # no value but 50 before the first move, and the smoothed ratio in the end
        assert set(got[period : flat + 1]) == {50.0}
        same(got[-20:], want[-20:])


@pytest.mark.parametrize("strict, sample", [(True, 0), (False, 0), (True, 9)])
def test_volume_adjusted_ma(spark, strict, sample):
    rows, length, factor = bars(70, 5), 6, 0.67
    x, v = [r[5] for r in rows], [r[6] for r in rows]
    want = []
    for t in range(len(rows)):
        mean = sum(v[: t + 1]) / (t + 1) if not sample else (sum(v[t + 1 - sample : t + 1]) / sample if t + 1 >= sample else None)
        if t < length - 1 or mean is None:
            want.append(None)
            continue
        weights = []
        while len(weights) < min(t + 1, 10 * length if strict else length) and (not strict or sum(weights) < length):
            weights.append(v[t - len(weights)] / (mean * factor))
        n = len(weights)
        rest = length - sum(weights)
        want.append((sum(w * x[t - k] for k, w in enumerate(weights)) + rest * x[t - n]) / length if t >= n else None)
    same([r[0] for r in applied(spark, rows, "volume_adjusted_ma", length=length, vi_factor=factor, strict=strict, sample_period=sample)], want)


def test_avsl(spark):
    rows, fast, slow, k = bars(120, 7), 4, 9, 2.0
    c, low, v = ([r[i] for r in rows] for i in (5, 4, 6))
    pre, part = [], []
    for t in range(len(rows)):
        if t < slow - 1:
            part.append(low[t])
            pre.append(None)
            continue
        mean = lambda xs, p: sum(xs[t + 1 - p : t + 1]) / p
        weighted = lambda p: sum(a * b for a, b in zip(c[t + 1 - p : t + 1], v[t + 1 - p : t + 1])) / sum(v[t + 1 - p : t + 1])
        vpc, vpr, vm = weighted(slow) - mean(c, slow), weighted(fast) / mean(c, fast), mean(v, fast) / mean(v, slow)
        vpci = vpc * vpr * vm
        reach = abs(vpci - 3) if vpc < 0 else vpci + 3
        n = min(200, max(1, math.floor(abs(reach) + 0.5) if reach >= 0 else 1))
        unit = -1 if -1 < vpc < 0 else 1 if 0 <= vpc < 1 else vpc
        part.append(low[t] / (unit * vpr))
        pre.append(low[t] - sum(part[max(0, t + 1 - n) :]) / n / 100 + k * vpci * vm)
    want = [None if t < 2 * slow - 2 else sum(pre[t + 1 - slow : t + 1]) / slow for t in range(len(rows))]
    same([r[0] for r in applied(spark, rows, "avsl", fast_period=fast, slow_period=slow, multiplier=k)], want)


@pytest.mark.parametrize("volume", [False, True])
def test_mod_god_mode_parts(spark, volume):
    """tradition = mean of TCI, MF and RSI; godmode without a falling bar has MF at 100."""
    rows, n1, n2, n3 = bars(60, 11), 7, 5, 4
    c, h, low, v = ([r[i] for r in rows] for i in (5, 3, 4, 6))
    ema = lambda xs, n: [y := x if i == 0 else y + 2 / (n + 1) * (x - y) for i, x in enumerate(xs)]  # noqa: E731, F821
    y = 0.0
    e = ema(c, n1)
    d = ema([abs(a - b) for a, b in zip(c, e)], n1)
    at = [i for i, x in enumerate(d) if x]
    tci = dict(zip(at, ema([(c[i] - e[i]) / (0.025 * d[i]) for i in at], n2)))
    gain = loss = 0.0
    rsi, mf = {}, {}
    for i in range(1, len(c)):
        up, down = max(0.0, c[i] - c[i - 1]), max(0.0, c[i - 1] - c[i])
        gain, loss = (gain + up / n3, loss + down / n3) if i <= n3 else ((gain * (n3 - 1) + up) / n3, (loss * (n3 - 1) + down) / n3)
        if i >= n3:
            rsi[i] = 100 * gain / (gain + loss) if loss else 100.0
    tp = [(a + b + x) / 3 for a, b, x in zip(h, low, c)]
    for i in range(n3, len(c)):
        flows = [(tp[k] - tp[k - 1], tp[k] * v[k]) for k in range(i - n3 + 1, i + 1)]
        p, q = sum(f for m, f in flows if m > 0), sum(f for m, f in flows if m < 0)
        mf[i] = 100 * p / (p + q) if q else 100.0
    want = []
    for i in range(len(c)):
        parts = [g[i] + o for g, o in ((tci, 50), (mf if volume else rsi, 0), (rsi, 0)) if i in g]
        want.append(sum(parts) / len(parts) if i >= max(n1, n2, n3) - 1 and parts else None)
    same([r[0] for r in applied(spark, rows, "mod_god_mode", n1=n1, n2=n2, n3=n3, mode="tradition", use_volume=volume)], want)
