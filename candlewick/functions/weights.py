"""Weights of moving averages with a finite memory, newest bar first, summing to one."""

from __future__ import annotations

from math import comb, exp, pi, sin, sqrt


def normalised(w: list[float]) -> list[float]:
    s = sum(w)
    return [x / s for x in w]


def wma(period: int) -> list[float]:
    return normalised([float(period - k) for k in range(period)])


def alma(period: int, offset: float = 0.85, sigma: float = 6.0) -> list[float]:
    centre, width = offset * (period - 1), period / sigma
    oldest_first = [exp(-((i - centre) ** 2) / (2 * width * width)) for i in range(period)]
    return normalised(oldest_first[::-1])


def cwma(period: int) -> list[float]:
    return normalised([float((period - k) ** 3) for k in range(max(1, period - 1))])


def ehma(period: int) -> list[float]:
    return normalised([2 * sin(pi * i / (period + 1)) ** 2 / (period + 1) for i in range(1, period + 1)])


def epma(period: int, offset: int = 4) -> list[float]:
    return normalised([float(period - k - offset) for k in range(max(1, period - 1))])


def fwma(period: int) -> list[float]:
    f = [1.0, 1.0]
    while len(f) < period:
        f.append(f[-1] + f[-2])
    return normalised(f[:period][::-1])


def pwma(period: int) -> list[float]:
    return normalised([float(comb(period - 1, k)) for k in range(period)])


def sinwma(period: int) -> list[float]:
    return normalised([sin((k + 1) * pi / (period + 1)) for k in range(period)])


def sqwma(period: int) -> list[float]:
    return normalised([float((period - k) ** 2) for k in range(max(1, period - 1))])


def srwma(period: int) -> list[float]:
    return normalised([sqrt(period - k) for k in range(max(1, period - 1))])


def _triangle(a: int, b: int) -> list[float]:
    """Weights of a mean of a bars of means of b bars."""
    return normalised([float(sum(1 for i in range(a) if 0 <= k - i < b)) for k in range(a + b - 1)])


def swma(period: int) -> list[float]:
    half = (period + 1) // 2
    return _triangle(half, period - half + 1)


def trima(period: int) -> list[float]:
    first = (period + 1) // 2
    return _triangle(first, period - first + 1)


def vpwma(period: int, power: float = 0.382) -> list[float]:
    return normalised([(period - k) ** power for k in range(max(1, period - 1))])


def cora(period: int, r_multi: float = 2.0) -> list[float]:
    if period == 1:
        return [1.0]
    r = (period / 0.01) ** (1 / (period - 1)) - 1
    return normalised([0.01 * (1 + r * r_multi) ** (j + 1) for j in range(period)][::-1])
