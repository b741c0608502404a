"""Small recursive pieces that folds are made of. Each takes one value a bar and returns one;
nan until it is warm. A nan that comes in leaves the state as it was and gives nan."""

from __future__ import annotations

from collections import deque
from math import cos, exp, nan, pi, sin, sqrt

NAN = nan


class Ema0:
    """Exponential mean that starts with the first value."""

    def __init__(self, period: float = 0, alpha: float | None = None):
        self.a, self.y = 2 / (period + 1) if alpha is None else alpha, NAN

    def __call__(self, x: float) -> float:
        if x == x:
            self.y = x if self.y != self.y else self.y + self.a * (x - self.y)
            return self.y
        return NAN


class EmaMean:
    """Running mean of the first p values, exponential from then on; no warm-up."""

    def __init__(self, period: int):
        self.p, self.a, self.n, self.y = period, 2 / (period + 1), 0, NAN

    def __call__(self, x: float) -> float:
        if x != x:
            return NAN
        self.n += 1
        if self.n == 1:
            self.y = x
        elif self.n <= self.p:
            self.y = ((self.n - 1) * self.y + x) / self.n
        else:
            self.y = (1 - self.a) * self.y + self.a * x
        return self.y


class Seeded:
    """Exponential mean that starts with the plain mean of the first p values."""

    def __init__(self, period: int, alpha: float | None = None):
        self.p, self.a, self.n, self.s, self.y = period, 2 / (period + 1) if alpha is None else alpha, 0, 0.0, NAN

    def __call__(self, x: float) -> float:
        if x != x:
            return NAN
        self.n += 1
        if self.n <= self.p:
            self.s += x
            if self.n == self.p:
                self.y = self.s / self.p
        else:
            self.y += self.a * (x - self.y)
        return self.y


class Rma(Seeded):
    """Wilder's mean: alpha 1 / p."""

    def __init__(self, period: int):
        super().__init__(period, 1 / period)


class Wilder:
    """Wilder's sum: that of the first n values, then s - s / p + x."""

    def __init__(self, period: int, first: int):
        self.p, self.first, self.n, self.s = period, first, 0, 0.0

    def __call__(self, x: float) -> float:
        if x != x:
            return NAN
        self.n += 1
        self.s = self.s + x if self.n <= self.first else self.s - self.s / self.p + x
        return self.s if self.n >= self.first else NAN


class Ring:
    """The last p values, newest last."""

    def __init__(self, period: int):
        self.p, self.q = period, deque(maxlen=period)

    def push(self, x: float) -> bool:
        if x == x:
            self.q.append(x)
            return len(self.q) == self.p
        return False


class Sma(Ring):
    def __call__(self, x: float) -> float:
        return sum(self.q) / self.p if self.push(x) else NAN


class Sum(Ring):
    def __call__(self, x: float) -> float:
        return sum(self.q) if self.push(x) else NAN


class Max(Ring):
    def __call__(self, x: float) -> float:
        return max(self.q) if self.push(x) else NAN


class Min(Ring):
    def __call__(self, x: float) -> float:
        return min(self.q) if self.push(x) else NAN


class Std(Ring):
    """Population standard deviation."""

    def __call__(self, x: float) -> float:
        if not self.push(x):
            return NAN
        m = sum(self.q) / self.p
        return sqrt(sum((v - m) * (v - m) for v in self.q) / self.p)


class Fir(Ring):
    """Weighted sum; weights start with the newest value's."""

    def __init__(self, weights: list[float]):
        super().__init__(len(weights))
        self.w = weights[::-1]

    def __call__(self, x: float) -> float:
        return sum(a * b for a, b in zip(self.w, self.q)) if self.push(x) else NAN


class Lag:
    """The value k bars ago; nan counts as a bar."""

    def __init__(self, k: int):
        self.q = deque(maxlen=k + 1)

    def __call__(self, x: float) -> float:
        self.q.append(x)
        return self.q[0] if len(self.q) == self.q.maxlen else NAN


class Linreg(Ring):
    """Least-squares line: (slope, value at the newest bar)."""

    def __call__(self, x: float) -> tuple[float, float]:
        if not self.push(x):
            return NAN, NAN
        p, m = self.p, sum(self.q) / self.p
        if p == 1:
            return 0.0, m
        c = (p - 1) / 2
        b = sum((i - c) * v for i, v in enumerate(self.q)) / (p * (p * p - 1) / 12)
        return b, m + b * c


class TrueRange:
    """The first bar's is high - low."""

    def __init__(self) -> None:
        self.c = NAN

    def __call__(self, h: float, l: float, c: float) -> float:  # noqa: E741
        tr = h - l if self.c != self.c else max(h - l, abs(h - self.c), abs(l - self.c))
        self.c = c
        return tr


class Atr:
    def __init__(self, period: int):
        self.tr, self.mean = TrueRange(), Rma(period)

    def __call__(self, h: float, l: float, c: float) -> float:  # noqa: E741
        return self.mean(self.tr(h, l, c))


class GainLoss:
    """Wilder's means of gains and losses; nan, nan for the first p values."""

    def __init__(self, period: int):
        self.up, self.down, self.x = Rma(period), Rma(period), NAN

    def __call__(self, x: float) -> tuple[float, float]:
        if x != x:
            return NAN, NAN
        d, self.x = x - self.x, x
        return (self.up(max(d, 0.0)), self.down(max(-d, 0.0))) if d == d else (NAN, NAN)


class Rsi:
    def __init__(self, period: int, flat: float = 50.0):
        self.gl, self.flat = GainLoss(period), flat

    def __call__(self, x: float) -> float:
        g, l = self.gl(x)  # noqa: E741
        return NAN if g != g else (100 * g / (g + l) if g + l else self.flat)


class HighPass2:
    """Two-pole high-pass; the first two values stand for themselves."""

    def __init__(self, period: float, k: float = 0.707):
        t = 2 * pi * k / period
        a = 1 + (sin(t) - 1) / cos(t)
        self.c, self.b1, self.b2 = (1 - a / 2) ** 2, 2 * (1 - a), -((1 - a) ** 2)
        self.x1 = self.x2 = self.y1 = self.y2 = NAN

    def __call__(self, x: float) -> float:
        if x != x:
            return NAN
        y = x if self.x2 != self.x2 else self.c * (x - 2 * self.x1 + self.x2) + self.b1 * self.y1 + self.b2 * self.y2
        self.x2, self.x1, self.y2, self.y1 = self.x1, x, self.y1, y
        return y


class HighPass1:
    def __init__(self, period: float):
        t = 2 * pi / period
        self.a = 1 + (sin(t) - 1) / cos(t)
        self.x1 = self.y1 = NAN

    def __call__(self, x: float) -> float:
        if x != x:
            return NAN
        y = x if self.x1 != self.x1 else (1 - self.a / 2) * (x - self.x1) + (1 - self.a) * self.y1
        self.x1, self.y1 = x, y
        return y


class SuperSmoother:
    """Two-pole Butterworth; the first two values stand for themselves."""

    def __init__(self, period: float):
        a = exp(-1.414 * pi / period)
        self.b, self.a2 = 2 * a * cos(1.414 * pi / period), a * a
        self.c = (1 + self.a2 - self.b) / 2
        self.x1 = self.y1 = self.y2 = NAN

    def __call__(self, x: float) -> float:
        if x != x:
            return NAN
        y = x if self.y2 != self.y2 else self.c * (x + self.x1) + self.b * self.y1 - self.a2 * self.y2
        self.x1, self.y2, self.y1 = x, self.y1, y
        return y


def average(kind: str, period: int):
    """A step of a moving average by name, for folds."""
    from ..operators.registry import operator
    from . import weights as W

    kind = kind.lower()
    plain = {"sma": Sma, "ema": EmaMean, "smma": Rma, "wilders": Rma}
    if kind in plain:
        return plain[kind](period)
    if kind in ("wma", "alma", "cwma", "ehma", "epma", "fwma", "pwma", "sinwma", "sqwma", "srwma", "swma", "trima", "vpwma"):
        return Fir(getattr(W, kind)(period))
    op = operator(kind)
    key = next((k for k in op.params if k in ("period", "length")), None)
    if op.native or len(op.inputs) != 1 or key is None:
        raise ValueError(f"{kind} cannot run inside a fold")
    step = op.make(**(op.params | {key: period}))
    return lambda x: NAN if x != x else (y[0] if isinstance(y := step(x), tuple) else y)
