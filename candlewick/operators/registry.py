"""What an operator is, and the table of all of them.

A native operator is a function of a `Bars` frame and input columns that returns columns:
window expressions that stay inside the JVM. A fold is a function of parameters that returns
a step: a closure that takes one bar's inputs and returns one bar's outputs, for recursions
that no window expresses. Steps serve batch, sweep and stream alike; their state is whatever
they close over and can be pickled between micro-batches.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from math import isfinite
from typing import Any

#: Input letter -> column, or derived source, that it stands for unless the caller says so.
SOURCES = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "x": "close", "main": "close", "other": "open", "ts": "ts"}


@dataclass(frozen=True)
class Operator:
    name: str
    make: Callable[..., Any]
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    params: dict[str, Any]
    native: bool
    sources: dict[str, str] = field(default_factory=dict)
    #: What a fold shows on a bar with a missing input: nothing ("skip") or the last value ("hold").
    gap: str = "skip"
    #: Bars that a native operator looks back on, or None if it sums from the first bar on.
    memory: Callable[..., int | None] | None = None
    #: Bars that it looks ahead on.
    ahead: str | None = None

    def source(self, letter: str) -> str:
        return self.sources.get(letter, SOURCES.get(letter, letter))

    def checked(self, given: dict[str, Any]) -> dict[str, Any]:
        """All parameters, those given in place of defaults; wrong ones are refused at once."""
        for k, v in given.items():
            if k not in self.params:
                raise TypeError(f"{self.name} has no parameter {k}; it has {', '.join(self.params) or 'none'}")
            if isinstance(self.params[k], bool):
                given = given | {k: bool(v)}
            elif isinstance(self.params[k], int):
                if float(v) != int(v):
                    raise ValueError(f"{self.name}: {k} must be a whole number, not {v}")
                given = given | {k: int(v)}
            elif isinstance(self.params[k], float):
                if not isfinite(float(v)):
                    raise ValueError(f"{self.name}: {k} must be finite, not {v}")
                given = given | {k: float(v)}
        out = self.params | given
        for k, v in out.items():
            if isinstance(v, int) and not isinstance(v, bool) and ("period" in k or "length" in k or k in ("lookback", "order")) and k != "sample_period" and v < 1:
                raise ValueError(f"{self.name}: {k} must be at least 1, not {v}")
        return out


OPERATORS: dict[str, Operator] = {}


def _params(f: Callable[..., Any]) -> tuple[list[str], dict[str, Any]]:
    free, given = [], {}
    for k, p in inspect.signature(f).parameters.items():
        if p.default is inspect.Parameter.empty:
            free.append(k)
        else:
            given[k] = p.default
    return free, given


def native(*outputs: str, memory: Callable[..., int | None] | None = None, ahead: str | None = None, **sources: str):
    """Registers f(bars, inputs..., params...) -> {output: Column}, or one Column for `values`."""

    def register(f: Callable[..., Any]) -> Callable[..., Any]:
        name = f.__name__.rstrip("_")
        free, params = _params(f)
        OPERATORS[name] = Operator(name, f, tuple(free[1:]), outputs or ("values",), params, True, sources, memory=memory, ahead=ahead)
        return f

    return register


def fold(inputs: str, *outputs: str, gap: str = "skip", **sources: str):
    """Registers f(params...) -> step(inputs...) -> one float or a tuple of them."""

    def register(f: Callable[..., Any]) -> Callable[..., Any]:
        name = f.__name__.rstrip("_")
        OPERATORS[name] = Operator(name, f, tuple(inputs.split()), outputs or ("values",), _params(f)[1], False, sources, gap)
        return f

    return register


def operator(name: str) -> Operator:
    if name.lower() not in OPERATORS:
        raise ValueError(f"there is no operator {name!r}")
    return OPERATORS[name.lower()]
