"""Steps of the window averages, for streams: what a window plan gives bar by bar, with only
the bars that it looks back on as state.

Unlike folds, these steps see bars with missing values (nan): as in a window, such a bar
takes its place and leaves the outputs that look back on it without a value.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from datetime import datetime, timezone
from math import floor, log, sqrt
from typing import Any

from ..functions import weights as W

NAN = float("nan")


class Tail:
    """The last p values, oldest first, and how many of all so far were there."""

    def __init__(self, p: int):
        self.q: deque[float] = deque(maxlen=p)
        self.valid = 0

    def push(self, x: float) -> bool:
        """Whether p values, none of them missing, are there now."""
        self.q.append(x)
        self.valid += x == x
        return len(self.q) == self.q.maxlen and all(v == v for v in self.q)


class Weighted(Tail):
    """A weighted sum, newest value first, once `bars` values have been there."""

    def __init__(self, w: list[float], bars: int = 0):
        super().__init__(len(w))
        self.w, self.bars = w[::-1], bars

    def __call__(self, x: float) -> float:
        full = self.push(x)
        return sum(a * b for a, b in zip(self.w, self.q)) if full and self.valid >= self.bars else NAN


class Mean(Tail):
    def __call__(self, x: float) -> float:
        return sum(self.q) / len(self.q) if self.push(x) else NAN


class Total(Tail):
    def __call__(self, x: float) -> float:
        return sum(self.q) if self.push(x) else NAN


class Hull:
    def __init__(self, period: int):
        self.half, self.full = Weighted(W.wma(max(1, period // 2))), Weighted(W.wma(period))
        self.root = Weighted(W.wma(max(1, floor(sqrt(period)))))

    def __call__(self, x: float) -> float:
        return self.root(2 * self.half(x) - self.full(x))


class Cora:
    def __init__(self, period: int, r_multi: float, smooth: bool):
        self.y = Weighted(W.cora(period, r_multi))
        self.smooth = Weighted(W.wma(max(1, round(sqrt(period))))) if smooth else None

    def __call__(self, x: float) -> float:
        return self.smooth(self.y(x)) if self.smooth else self.y(x)


class Jsa(Tail):
    def __init__(self, period: int):
        super().__init__(period + 1)

    def __call__(self, x: float) -> float:
        self.push(x)
        return (x + self.q[0]) / 2 if len(self.q) == self.q.maxlen else NAN


class Line(Tail):
    """The least-squares line's value at the newest of p bars."""

    def __call__(self, x: float) -> float:
        p = self.q.maxlen
        if not self.push(x) or p < 2:
            return NAN
        mid, mean = (p - 1) / 2, sum(self.q) / p
        slope = sum((i - mid) * (v - mean) for i, v in enumerate(self.q)) / (p * (p * p - 1) / 12)
        return mean + slope * (p - 1 - mid)


class Edcf(Tail):
    """Weights are squared distances to the bars before; from the bar 2p after the first on."""

    def __init__(self, period: int):
        super().__init__(period)
        self.period, self.weighted, self.weights = period, Total(period), Total(period)

    def __call__(self, x: float) -> float:
        w = sum((x - v) ** 2 for v in self.q) if self.push(x) else NAN
        num, den = self.weighted(w * x), self.weights(w)
        return num / den if self.valid > 2 * self.period and den == den and den else NAN


class Nma(Tail):
    def __init__(self, period: int):
        super().__init__(period + 1)

    def __call__(self, x: float) -> float:
        if not self.push(x) or min(self.q) <= 0:
            return NAN
        ln = [log(v) * 1000 for v in reversed(self.q)]
        d = [abs(a - b) for a, b in zip(ln, ln[1:])]
        den = sum(d)
        ratio = sum(v * (sqrt(k + 1) - sqrt(k)) for k, v in enumerate(d)) / den if den else 0.0
        return self.q[1] * ratio + self.q[0] * (1 - ratio)


class ByVolume:
    """sum(x * v) / sum(v) of the last p bars."""

    def __init__(self, period: int):
        self.weighted, self.volume = Total(period), Total(period)

    def __call__(self, x: float, v: float) -> float:
        num, den = self.weighted(x * v), self.volume(v if x == x else NAN)
        return num / den if den == den and den else NAN


class Buff:
    def __init__(self, fast: int, slow: int):
        self.fast, self.slow = ByVolume(fast), ByVolume(slow)

    def __call__(self, x: float, v: float) -> tuple[float, float]:
        return self.fast(x, v), self.slow(x, v)


class Predictive:
    def __init__(self, before: bool):
        self.first, self.second, self.trigger = Weighted(W.wma(7)), Weighted(W.wma(7)), Weighted(W.wma(4))
        self.before, self.x = before, NAN

    def __call__(self, x: float) -> tuple[float, float]:
        self.x, x = x, self.x if self.before else x
        w = self.first(x)
        p = 2 * w - self.second(w)
        return p, self.trigger(p)


class Vwap:
    """Since the start of the anchor's bucket (months in UTC); ts is in seconds from the epoch."""

    def __init__(self, anchor: str):
        self.n, self.unit = int(anchor[:-1] or 1), anchor[-1]
        self.bucket, self.weighted, self.volume = None, 0.0, 0.0

    def __call__(self, ts: float, x: float, v: float) -> float:
        if self.unit == "M":
            t = datetime.fromtimestamp(ts, timezone.utc)
            bucket = (t.year * 12 + t.month - 1) // self.n
        else:
            bucket = int(floor(ts) // (self.n * {"m": 60, "h": 3600, "d": 86400}[self.unit]))
        if bucket != self.bucket:
            self.bucket, self.weighted, self.volume = bucket, 0.0, 0.0
        if x == x and v == v:
            self.weighted, self.volume = self.weighted + x * v, self.volume + v
        return self.weighted / self.volume if self.volume > 0 else NAN


class VolumeAdjusted:
    """Bars count by volume over vi_factor * mean volume, newest first, as in the window plan."""

    def __init__(self, length: int, vi_factor: float, strict: bool, sample_period: int):
        self.length, self.vi_factor, self.strict = length, vi_factor, strict
        self.most = 10 * length if strict else length
        self.q: deque[tuple[float, float]] = deque(maxlen=self.most + 1)
        self.recent = Mean(sample_period) if sample_period else None
        self.total, self.count, self.valid = 0.0, 0, 0

    def __call__(self, x: float, v: float) -> float:
        self.q.append((x, v))
        self.valid += x == x
        if v == v:
            self.total, self.count = self.total + v, self.count + 1
        mean = self.recent(v) if self.recent else self.total / self.count if self.count else NAN
        unit, weighted, weights, bars = mean * self.vi_factor, 0.0, 0.0, 0
        newest_first = list(self.q)[::-1]
        for price, volume in newest_first[: self.most]:
            if self.strict and weights >= self.length:
                break
            w = volume / unit if unit > 0 and volume == volume else 0.0
            weighted, weights, bars = weighted + (price * w if price == price else 0.0), weights + w, bars + 1
        if bars == len(newest_first) or self.valid < self.length:
            return NAN
        return (weighted - (weights - self.length) * newest_first[bars][0]) / self.length


#: Plain weighted sums, with the bars after which they start where that is not at once.
WEIGHTED: dict[str, Callable[[dict[str, Any]], int]] = {
    **dict.fromkeys(("wma", "alma", "ehma", "fwma", "pwma", "sinwma", "swma", "trima"), lambda p: 0),
    "cwma": lambda p: p["period"],
    "epma": lambda p: p["period"] + p["offset"] + 1,
    **dict.fromkeys(("sqwma", "srwma"), lambda p: p["period"] + 2),
    "vpwma": lambda p: p["period"] + 1,
}
OTHERS: dict[str, Callable[..., Any]] = {
    "sma": lambda period: Mean(period),
    "hma": Hull,
    "cora_wave": Cora,
    "jsa": Jsa,
    "linreg": lambda period: Line(period),
    "edcf": Edcf,
    "nma": Nma,
    "vwma": ByVolume,
    "buff_averages": lambda fast_period, slow_period: Buff(fast_period, slow_period),
    "pma": lambda: Predictive(False),
    "ehlers_pma": lambda: Predictive(True),
    "vwap": Vwap,
    "volume_adjusted_ma": VolumeAdjusted,
}
STEPS = (*WEIGHTED, *OTHERS)


def step(name: str, **params: Any) -> Callable[..., Any]:
    """A step of a window average; params are all of its parameters."""
    if name in WEIGHTED:
        return Weighted(getattr(W, name)(**params), WEIGHTED[name](params))
    return OTHERS[name](**params)
