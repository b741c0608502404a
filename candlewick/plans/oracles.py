"""DuckDB SQL of the operators, written apart from their Spark code: layers of expressions
over the bars o, h, l, c, v. Recursions are folds over the list of all values so far."""

from __future__ import annotations

from math import comb, cos, exp, pi, sin, sqrt

HOURLY = """SELECT event_type AS series, date_trunc('hour', ts) AS ts, arg_min(value, struct_pack(a := ts, b := event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, struct_pack(a := ts, b := event_id)) AS close, sum(value) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2"""
DAILY = """SELECT o_orderpriority AS series, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, arg_min(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
 arg_max(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS close, CAST(count(o_totalprice) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2"""

S = "PARTITION BY series ORDER BY ts"
ALL = f"OVER ({S} ROWS UNBOUNDED PRECEDING)"
MED, TYP = "((h + l) / 2)", "((h + l + c) / 3)"
#: Layers: each a dict of name -> expression that may use the names of those before.
Layers = list[dict[str, str]]


def over(p: int) -> str:
    return f"OVER ({S} ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, p: int) -> str:
    return f"(CASE WHEN count({x}) {over(p)} = {p} THEN {f}({x}) {over(p)} END)"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({S})" if k else x


def fir(x: str, w: list[float]) -> str:
    """w[0] is the newest bar's weight; weights are scaled to one here."""
    t = sum(w)
    return "(" + " + ".join(f"{lag(x, k)} * {v / t!r}" for k, v in enumerate(w)) + ")"


def so_far(x: str) -> str:
    return f"list({x}) FILTER (({x}) IS NOT NULL) {ALL}"


def now(x: str, e: str) -> str:
    """e only where x has a value: folds keep their state over gaps but show nothing there."""
    return f"(CASE WHEN ({x}) IS NOT NULL THEN {e} END)"


def ema0(x: str, p: float = 0, a: float | None = None) -> str:
    a = 2 / (p + 1) if a is None else a
    return now(x, f"list_reduce({so_far(x)}, lambda y, z: y + {a!r} * (z - y))")


def seeded(x: str, p: int, a: float | None = None) -> str:
    a = 2 / (p + 1) if a is None else a
    values = so_far(x)
    return now(x, f"(CASE WHEN len({values}) >= {p} THEN list_reduce(list_prepend(list_avg(({values})[1:{p}]), ({values})[{p + 1}:]), lambda y, z: y + {a!r} * (z - y)) END)")


def rma(x: str, p: int) -> str:
    return seeded(x, p, 1 / p)


def ema_mean(x: str, p: int) -> str:
    values = so_far(x)
    return now(x, f"(CASE WHEN len({values}) <= {p} THEN list_avg({values}) ELSE list_reduce(list_prepend(list_avg(({values})[1:{p}]), ({values})[{p + 1}:]), lambda y, z: y + {2 / (p + 1)!r} * (z - y)) END)")


def wilder(x: str, p: int, first: int) -> str:
    values = so_far(x)
    return now(x, f"(CASE WHEN len({values}) >= {first} THEN list_reduce(list_prepend(list_sum(({values})[1:{first}]), ({values})[{first + 1}:]), lambda y, z: y - y / {p} + z) END)")


def machine(inputs: dict[str, str], start: dict[str, str], step: dict[str, str], outputs: dict[str, str]) -> Layers:
    """A state machine: structs of inputs and state are folded in the order of time. start
    and step are expressions of the state s and the bar e; start only sees e."""
    names = list(start)
    e = ", ".join([*(f"{k} := CAST({x} AS DOUBLE)" for k, x in inputs.items()), *(f"{k} := CAST(0 AS DOUBLE)" for k in names)])
    keep = ", ".join(f"{k} := e.{k}" for k in inputs)
    first = f"struct_pack({keep}, " + ", ".join(f"{k} := CAST({start[k]} AS DOUBLE)" for k in names) + ")"
    then = f"struct_pack({keep}, " + ", ".join(f"{k} := CAST({step[k]} AS DOUBLE)" for k in names) + ")"
    return [
        {"_e": f"struct_pack({e})"},
        {"_l": f"list(_e) {ALL}"},
        {"_s": f"list_reduce(list_prepend(list_transform(_l[1:1], lambda e: {first})[1], _l[2:]), lambda s, e: {then})"},
        outputs,
    ]


def n_valid(x: str) -> str:
    return f"count({x}) {ALL}"


TR = "greatest(h - l, coalesce(abs(h - pc), h - l), coalesce(abs(l - pc), h - l))"
PREV = {"pc": lag("c"), "ph": lag("h"), "pl": lag("l")}
MOVES = {
    "tr1": "CASE WHEN pc IS NOT NULL THEN greatest(h - l, abs(h - pc), abs(l - pc)) END",
    "up": "CASE WHEN ph IS NOT NULL THEN CASE WHEN h - ph > pl - l AND h - ph > 0 THEN h - ph ELSE 0 END END",
    "dn": "CASE WHEN ph IS NOT NULL THEN CASE WHEN pl - l > h - ph AND pl - l > 0 THEN pl - l ELSE 0 END END",
}


def linear(p: int) -> list[float]:
    return [p - k for k in range(p)]


def line(x: str, p: int) -> tuple[str, str]:
    """Slope and newest value of the least-squares line, as weighted sums."""
    mid = (p - 1) / 2
    ss = sum((k - mid) ** 2 for k in range(p))
    at = lambda k: (p - 1 - k) - mid
    slope = "(" + " + ".join(f"{lag(x, k)} * {at(k) / ss!r}" for k in range(p)) + ")"
    end = "(" + " + ".join(f"{lag(x, k)} * {1 / p + mid * at(k) / ss!r}" for k in range(p)) + ")"
    return slope, end


def values(e: str, *layers: dict[str, str]) -> Layers:
    return [*layers, {"values": e}]


def rsi_layers(x: str, p: int, out: str = "rsi") -> Layers:
    return [{"d_": f"{x} - {lag(x)}"}, {"g_": "greatest(d_, 0)", "w_": "greatest(-d_, 0)"}, {"g_": rma("CASE WHEN d_ IS NOT NULL THEN g_ END", p), "w_": rma("CASE WHEN d_ IS NOT NULL THEN w_ END", p)},
            {out: "CASE WHEN g_ + w_ = 0 THEN 50 ELSE 100 * g_ / (g_ + w_) END"}]


def dx_of(p: str, m: str) -> str:
    return f"CASE WHEN {p} + {m} = 0 THEN 0 ELSE 100 * abs({p} - {m}) / ({p} + {m}) END"


def ma_list(x: str, p: int, e: str) -> str:
    """e over the list _ of the last p values."""
    return f"(CASE WHEN count({x}) {over(p)} = {p} THEN list_transform([list({x}) {over(p)}], lambda _v: {e})[1] END)"


MEAN_DEV = "list_avg(list_transform(_v, lambda u: abs(u - list_avg(_v))))"
MEDIAN_DEV = "list_median(list_transform(_v, lambda u: abs(u - list_median(_v))))"
FIB = [1.0, 1.0, 2.0, 3.0, 5.0]


def stoch_part(k: int) -> dict[str, str]:
    return {"top": roll("max", "h", k), "low": roll("min", "l", k)}


def _supersmoother() -> Layers:
    p = 14
    a = exp(-1.414 * pi / p)
    b, a2 = 2 * a * cos(1.414 * pi / p), a * a
    k = (1 + a2 - b) / 2
    return machine({"x": "c"}, {"n": "1", "x1": "e.x", "y1": "e.x", "y2": "e.x"},
                   {"n": "s.n + 1", "x1": "e.x", "y2": "s.y1", "y1": f"CASE WHEN s.n + 1 <= {p + 1} THEN e.x ELSE {k!r} * (e.x + s.x1) + {b!r} * s.y1 - {a2!r} * s.y2 END"},
                   {"values": f"CASE WHEN _s.n >= {p} THEN _s.y1 END"})


def _high2(p: float, k: float) -> tuple[float, float, float]:
    t = 2 * pi * k / p
    a = 1 + (sin(t) - 1) / cos(t)
    return (1 - a / 2) ** 2, 2 * (1 - a), (1 - a) ** 2


def _highpass2(p: float, k: float, out: str) -> Layers:
    c, b, d = _high2(p, k)
    return machine({"x": "c"}, {"n": "1", "x1": "e.x", "x2": "e.x", "y1": "e.x", "y2": "e.x"},
                   {"n": "s.n + 1", "x2": "s.x1", "x1": "e.x", "y2": "s.y1", "y1": f"CASE WHEN s.n < 2 THEN e.x ELSE {c!r} * (e.x - 2 * s.x1 + s.x2) + {b!r} * s.y1 - {d!r} * s.y2 END"},
                   {"values": out})


def _hp1(p: int) -> Layers:
    t = 2 * pi / p
    a = 1 + (sin(t) - 1) / cos(t)
    return machine({"x": "c"}, {"x1": "e.x", "y": "e.x"}, {"x1": "e.x", "y": f"{1 - a / 2!r} * (e.x - s.x1) + {1 - a!r} * s.y"}, {"values": "_s.y"})


def _kaufman(p: int, rate: str) -> Layers:
    steps = {"d": f"abs(c - {lag('c')})"}
    er = {"er": f"CASE WHEN {roll('sum', 'd', p)} = 0 THEN 0 ELSE abs(c - {lag('c', p)}) / {roll('sum', 'd', p)} END"}
    m = machine({"x": "c", "er": "er"}, {"y": "e.x"}, {"y": f"CASE WHEN e.er IS NULL THEN e.x WHEN s.er IS NULL THEN e.x ELSE s.y + ({rate}) * (e.x - s.y) END"}, {"values": "CASE WHEN er IS NOT NULL THEN _s.y END"})
    return [steps, er, *m]


def _supertrend() -> Layers:
    atr = [PREV, {"tr": TR}, {"a": rma("tr", 10)}]
    ub, lb = "((e.h + e.l) / 2 + 3.0 * e.a)", "((e.h + e.l) / 2 - 3.0 * e.a)"
    cu = f"(CASE WHEN s.c <= s.cu THEN least({ub}, s.cu) ELSE {ub} END)"
    cl = f"(CASE WHEN s.c >= s.cl THEN greatest({lb}, s.cl) ELSE {lb} END)"
    fresh = "(e.a IS NULL)"
    begin = "(s.a IS NULL)"
    up = f"(CASE WHEN {fresh} THEN 0 WHEN {begin} THEN CAST(e.c > {ub} AS INT) WHEN s.up = 1 THEN CAST(e.c >= {cl} AS INT) ELSE CAST(e.c > {cu} AS INT) END)"
    return [*atr, *machine({"h": "h", "l": "l", "c": "c", "a": "a"}, {"cu": "0", "cl": "0", "up": "0", "chg": "0"},
            {"cu": f"CASE WHEN {fresh} THEN 0 WHEN {begin} THEN {ub} ELSE {cu} END", "cl": f"CASE WHEN {fresh} THEN 0 WHEN {begin} THEN {lb} ELSE {cl} END", "up": up, "chg": f"CASE WHEN {fresh} OR {begin} THEN 0 ELSE CAST({up} <> s.up AS INT) END"},
            {"trend": "CASE WHEN a IS NOT NULL THEN CASE WHEN _s.up = 1 THEN _s.cl ELSE _s.cu END END", "changed": "CASE WHEN a IS NOT NULL THEN _s.chg END"})]


def _pivot() -> dict[str, str]:
    out = {"pp": TYP}
    for i, k in enumerate((0.0916, 0.183, 0.275, 0.55), 1):
        out |= {f"r{i}": f"c + {k} * (h - l)", f"s{i}": f"c - {k} * (h - l)"}
    return out


def _msw(p: int = 5) -> Layers:
    re = " + ".join(f"{cos(2 * pi * k / p)!r} * {lag('c', k)}" for k in range(p))
    im = " + ".join(f"{sin(2 * pi * k / p)!r} * {lag('c', k)}" for k in range(p))
    return [{"re": re, "im": im}, {"f": "CASE WHEN abs(re) > 0.001 THEN atan(im / re) WHEN im < 0 THEN -pi() ELSE pi() END"}, {"f": "CASE WHEN re < 0 THEN f + pi() ELSE f END + pi() / 2"},
            {"f": "CASE WHEN f < 0 THEN f + 2 * pi() ELSE f END"}, {"f": "CASE WHEN re IS NOT NULL THEN CASE WHEN f > 2 * pi() THEN f - 2 * pi() ELSE f END END"}, {"sine": "sin(f)", "lead": "sin(f + pi() / 4)"}]


def _squeeze(n: int = 20) -> Layers:
    off = {"off": f"c - (({roll('max', 'h', n)} + {roll('min', 'l', n)}) / 2 + {roll('avg', 'c', n)}) / 2"}
    return [PREV, {"tr": TR}, off, {"m": line("off", n)[1], "sd": roll("stddev_pop", "c", n), "rr": roll("avg", "tr", n), "mid": roll("avg", "c", n)}]


def from_zero(x: str, a: float) -> str:
    """Exponential smoothing of the values of x that starts from 0."""
    return now(x, f"list_reduce(list_prepend(CAST(0 AS DOUBLE), {so_far(x)}), lambda y, z: y + {a!r} * (z - y))")


def _rsx(p: int) -> Layers:
    out: Layers = [{"n": f"row_number() OVER ({S})", "d": f"100 * (c - {lag('c')})"}, {"a": f"CASE WHEN n > {p} THEN d END", "b": f"CASE WHEN n > {p} THEN abs(d) END"}]
    for k in range(3):
        for x in "ab":
            y = f"{x}{k or ''}"
            out += [{f"{x}_s": from_zero(y, 3 / (p + 2))}, {f"{x}_t": from_zero(f"{x}_s", 3 / (p + 2))}, {f"{x}{k + 1}": f"1.5 * {x}_s - 0.5 * {x}_t"}]
    return [*out, {"values": f"CASE WHEN n >= {p + max(p - 1, 5)} AND b3 > 1e-10 THEN least(100, greatest(0, 50 * (a3 / b3 + 1))) WHEN n > {p} THEN 50 END"}]


def _volume_adjusted(p: int, k: float) -> Layers:
    newest = lambda x: f"list_reverse(list({x}) {over(10 * p + 1)})"
    return [{"n": f"row_number() OVER ({S})", "u": f"{k} * avg(v) {ALL}", "xs": newest("c"), "vs": newest("v")}, {"ws": "list_transform(vs, lambda z: z / u)"},
            {"m": f"coalesce(list_filter(range(1, least(len(ws), {10 * p}) + 1), lambda i: list_sum(ws[1:i]) >= {p})[1], least(len(ws), {10 * p}))"},
            {"values": f"CASE WHEN n >= {p} THEN (list_sum(list_transform(range(1, m + 1), lambda i: ws[i] * xs[i])) + ({p} - list_sum(ws[1:m])) * xs[m + 1]) / {p} END"}]


def _avsl(p: int, q: int, k: float) -> Layers:
    mean = lambda x, n: roll("avg", x, n)
    return [{"cv": "c * v"}, {"vpc": f"{roll('sum', 'cv', q)} / {roll('sum', 'v', q)} - {mean('c', q)}", "vpr": f"{roll('sum', 'cv', p)} / {roll('sum', 'v', p)} / {mean('c', p)}", "vm": f"{mean('v', p)} / {mean('v', q)}"},
            {"vpci": "vpc * vpr * vm"}, {"reach": "least(200, greatest(1, round(CASE WHEN vpc < 0 THEN abs(vpci - 3) ELSE vpci + 3 END)))",
             "part": "CASE WHEN vpc IS NULL THEN l ELSE l / (vpr * CASE WHEN vpc > -1 AND vpc < 0 THEN -1 WHEN vpc >= 0 AND vpc < 1 THEN 1 ELSE vpc END) END"},
            {"ps": f"list_reverse(list(part) {over(200)})"}, {"pre": f"CASE WHEN vpc IS NOT NULL THEN l - list_sum(ps[1:CAST(reach AS INT)]) / reach / 100 + {k} * vpci * vm END"}, {"values": mean("pre", q)}]


def _vpc(f: int, s: int) -> Layers:
    a = lambda p: f"({roll('sum', 'xv', p)} / {roll('sum', 'v', p)})"
    return [{"xv": "c * v"}, {"vpc": f"{a(s)} - {roll('avg', 'c', s)}", "vpr": f"{a(f)} / {roll('avg', 'c', f)}", "vm": f"{roll('avg', 'v', f)} / {roll('avg', 'v', s)}"}]


def _tilson(p: int = 5) -> Layers:
    names = [f"e{k}" for k in range(1, 7)]
    layers, x = [], "c"
    for n in names:
        layers.append({n: seeded(x, p)})
        x = n
    return [*layers, {"values": "CASE WHEN e6 IS NOT NULL THEN e3 END"}]  # the factor is 0


def _trix(p: int = 18) -> Layers:
    return [{"q": "ln(c)"}, {"q1": seeded("q", p)}, {"q2": seeded("q1", p)}, {"q3": seeded("q2", p)}, {"values": f"10000 * (q3 - {lag('q3')})"}]


def _wave(n1: int, n2: int, n3: int, x: str) -> Layers:
    return [{"x": x}, {"esa": ema0("x", n1)}, {"dv": ema0("abs(x - esa)", n1)}, {"ci": "CASE WHEN dv = 0 THEN 0 ELSE (x - esa) / (0.015 * dv) END"}, {"w1": ema0("ci", n2)}, {"w2": roll("avg", "w1", n3)}]


def _zscore() -> str:
    sd = roll("stddev_pop", "c", 14)
    return f"CASE WHEN {sd} * {sd} > 1e-30 THEN (c - {roll('avg', 'c', 14)}) / {sd} END"


def _corr_cycle(p: int = 20) -> Layers:
    def corr(w: list[float]) -> str:
        m = sum(w) / p
        d = sqrt(sum((v - m) ** 2 for v in w) / p)
        s = " + ".join(f"{lag('b', k)} * {v!r}" for k, v in enumerate(w))
        return f"CASE WHEN mb IS NOT NULL THEN CASE WHEN sb > 0 THEN (({s}) / {p} - mb * {m!r}) / (sb * {d!r}) ELSE 0 END END"

    return [{"b": lag("c")}, {"mb": roll("avg", "b", p), "sb": roll("stddev_pop", "b", p)}, {"real": corr([cos(2 * pi * k / p) for k in range(p)]), "imag": corr([-sin(2 * pi * k / p) for k in range(p)])},
            {"an": "CASE WHEN imag = 0 THEN 0 ELSE degrees(atan(real / imag) + pi() / 2) END"}, {"angle": "CASE WHEN real IS NOT NULL THEN CASE WHEN imag > 0 THEN an - 180 ELSE an END END"},
            {"la": lag("angle")}, {"state": "CASE WHEN la IS NOT NULL AND angle IS NOT NULL THEN CASE WHEN abs(angle - la) < 9 THEN CASE WHEN angle >= 0 THEN 1.0 ELSE -1.0 END ELSE 0.0 END END"}]


def _swma(p: int) -> list[float]:
    a = (p + 1) // 2
    b = p - a + 1
    return [float(min(k + 1, a, b, a + b - 1 - k)) for k in range(a + b - 1)]


def _mfi(p: int = 14) -> Layers:
    return [{"tp": TYP}, {"tb": lag("tp")}, {"pf": "CASE WHEN tb IS NOT NULL THEN CASE WHEN tp > tb THEN tp * v ELSE 0 END END", "nf": "CASE WHEN tb IS NOT NULL THEN CASE WHEN tp < tb THEN tp * v ELSE 0 END END"},
            {"pf": roll("sum", "pf", p), "nf": roll("sum", "nf", p)}, {"values": "CASE WHEN pf + nf <= 1e-14 THEN 0 ELSE 100 * pf / (pf + nf) END"}]


def _ult() -> Layers:
    part = lambda p: f"({roll('sum', 'bp', p)} / {roll('sum', 'rg', p)})"
    return [PREV, {"bp": "CASE WHEN pc IS NOT NULL THEN c - least(l, pc) END", "rg": "CASE WHEN pc IS NOT NULL THEN greatest(h - l, abs(h - pc), abs(l - pc)) END"}, {"values": f"100 * (4 * {part(7)} + 2 * {part(14)} + {part(28)}) / 7"}]


def _kst() -> Layers:
    rocs = {f"r{i}": f"100 * (c / {lag('c', r)} - 1)" for i, r in enumerate((10, 15, 20, 30), 1)}
    total = " + ".join(f"{i} * {roll('avg', f'r{i}', s)}" for i, s in enumerate((10, 10, 10, 15), 1))
    return [rocs, {"line": total}, {"line": "line", "signal": roll("avg", "line", 9)}]


def _minmax(k: int = 3) -> Layers:
    left, right = f"OVER ({S} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)", f"OVER ({S} ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"
    is_ = lambda x, f, op: f"CASE WHEN count({x}) {left} = {k} AND count({x}) {right} = {k} AND {x} {op} {f}({x}) {left} AND {x} {op} {f}({x}) {right} THEN {x} END"
    return [{"is_min": is_("l", "min", "<"), "is_max": is_("h", "max", ">")}, {"is_min": "is_min", "is_max": "is_max", "last_min": f"last_value(is_min IGNORE NULLS) {ALL}", "last_max": f"last_value(is_max IGNORE NULLS) {ALL}"}]


def _aso(p: int = 10) -> Layers:
    pair = lambda t, b, o: (f"50 * ((c - {b}) + ({t} - {o})) / (CASE WHEN {t} = {b} THEN 1 ELSE {t} - {b} END)", f"50 * (({t} - c) + ({o} - {b})) / (CASE WHEN {t} = {b} THEN 1 ELSE {t} - {b} END)")
    (ib, ir), (gb, gr) = pair("h", "l", "o"), pair("gh", "gl", "go")
    return [{"gh": roll("max", "h", p), "gl": roll("min", "l", p), "go": lag("o", p - 1)}, {"b_": f"CASE WHEN gh IS NOT NULL THEN ({ib} + {gb}) / 2 END", "r_": f"CASE WHEN gh IS NOT NULL THEN ({ir} + {gr}) / 2 END"},
            {"bulls": f"CASE WHEN gh IS NOT NULL THEN avg(b_) {over(p)} END", "bears": f"CASE WHEN gh IS NOT NULL THEN avg(r_) {over(p)} END"}]


def _boll(dev: str = "stddev_pop") -> Layers:
    return [{"m": roll("avg", "c", 20), "d": roll(dev, "c", 20)}, {"upper": "m + 2 * d", "middle": "m", "lower": "m - 2 * d"}]


def _hma(p: int = 5) -> Layers:
    return [{"d": f"2 * {fir('c', linear(p // 2))} - {fir('c', linear(p))}"}, {"values": fir("d", linear(int(sqrt(p))))}]


def _stc() -> Layers:
    sto = lambda x: f"CASE WHEN {roll('max', x, 10)} > {roll('min', x, 10)} THEN 100 * ({x} - {roll('min', x, 10)}) / ({roll('max', x, 10)} - {roll('min', x, 10)}) END"
    return [{"m": f"{seeded('c', 23)} - {seeded('c', 50)}"}, {"a": sto("m")}, {"b": ema_mean("a", 3)}, {"d": sto("b")}, {"values": ema_mean("d", 3)}]


def _ao(x: str) -> str:
    return f"({roll('avg', x, 5)} - {roll('avg', x, 34)})"


P_SUM = "sum({x}) " + ALL
FLOW = "CASE WHEN h = l THEN 0 ELSE ((c - l) - (h - c)) / (h - l) * v END"
LIN14, LIN20 = line("c", 14), line("c", 20)
R14 = rsi_layers("c", 14)
D14 = {"pp_": wilder("up", 14, 13), "mm_": wilder("dn", 14, 13), "tt_": wilder("tr1", 14, 13)}
A14 = {"tt_": wilder("tr1", 14, 14), "pp_": wilder("up", 14, 14), "mm_": wilder("dn", 14, 14)}
ADX = [PREV, MOVES, A14, {"dx_": "CASE WHEN tt_ IS NOT NULL THEN " + dx_of("(100 * pp_ / tt_)", "(100 * mm_ / tt_)") + " END"}, {"adx_": rma("dx_", 14)}]
ATR = [PREV, {"tr": TR}]

EXPRESSIONS: dict[str, Layers] = {
    # prices, momentum, oscillators
    "acosc": [{"m": MED}, {"ao": _ao("m")}, {"osc": f"ao - {roll('avg', 'ao', 5)}"}, {"osc": "osc", "change": f"osc - coalesce({lag('osc')}, 0)"}],
    "ao": values(_ao("m"), {"m": MED}),
    "apo": values(f"{ema0('c', 10)} - {ema0('c', 20)}"),
    "bop": values("CASE WHEN h - l <= 0 THEN 0 ELSE (c - o) / (h - l) END"),
    "cci": values(f"CASE WHEN {ma_list('x', 14, MEAN_DEV)} = 0 THEN 0 ELSE (x - {roll('avg', 'x', 14)}) / (0.015 * {ma_list('x', 14, MEAN_DEV)}) END", {"x": TYP}),
    "cfo": values(f"CASE WHEN c <> 0 THEN 100 * (c - {LIN14[1]}) / c END"),
    "cg": values(f"CASE WHEN {n_valid('c')} > 10 THEN -({' + '.join(f'{k + 1} * {lag("c", k)}' for k in range(9))}) / ({' + '.join(lag('c', k) for k in range(9))}) END"),
    "cmo": [*R14[:-1], {"values": "CASE WHEN g_ + w_ = 0 THEN 0 ELSE 100 * (g_ - w_) / (g_ + w_) END"}],
    "coppock": values(fir("b", linear(10)), {"b": f"100 * (c / {lag('c', 11)} - 1) + 100 * (c / {lag('c', 14)} - 1)"}),
    "cvi": values(f"CASE WHEN {n_valid('c')} >= 20 AND {lag('q', 10)} <> 0 THEN 100 * (q - {lag('q', 10)}) / {lag('q', 10)} END", {"q": ema0("(h - l)", 10)}),
    "dpo": values(f"{lag('c', 3)} - {roll('avg', 'c', 5)}"),
    "dti": values("CASE WHEN q3 = 0 THEN 0 ELSE 100 * p3 / q3 END", PREV, {"x": "CASE WHEN ph IS NOT NULL THEN greatest(h - ph, 0) - greatest(pl - l, 0) END"},
                  {"p1": f"CASE WHEN x IS NOT NULL THEN list_reduce(list_prepend(0.0, {so_far('x')}), lambda y, z: y + {2 / 15!r} * (z - y)) END", "q1": f"CASE WHEN x IS NOT NULL THEN list_reduce(list_prepend(0.0, {so_far('abs(x)')}), lambda y, z: y + {2 / 15!r} * (z - y)) END"},
                  {"p2": f"CASE WHEN x IS NOT NULL THEN list_reduce(list_prepend(0.0, {so_far('p1')}), lambda y, z: y + {2 / 11!r} * (z - y)) END", "q2": f"CASE WHEN x IS NOT NULL THEN list_reduce(list_prepend(0.0, {so_far('q1')}), lambda y, z: y + {2 / 11!r} * (z - y)) END"},
                  {"p3": f"CASE WHEN x IS NOT NULL THEN list_reduce(list_prepend(0.0, {so_far('p2')}), lambda y, z: y + {2 / 6!r} * (z - y)) END", "q3": f"CASE WHEN x IS NOT NULL THEN list_reduce(list_prepend(0.0, {so_far('q2')}), lambda y, z: y + {2 / 6!r} * (z - y)) END"}),
    "emv": values(f"CASE WHEN h <> l AND v <> 0 THEN (m - {lag('m')}) / (v / 10000 / (h - l)) END", {"m": MED}),
    "er": values(f"CASE WHEN {lag('c', 4)} IS NOT NULL THEN CASE WHEN {roll('sum', 'd', 4)} > 0 THEN least(1.0, abs(c - {lag('c', 4)}) / {roll('sum', 'd', 4)}) ELSE 0 END END", {"d": f"abs(c - {lag('c')})"}),
    "eri": [{"m": ema_mean("c", 13)}, {"bull": "h - m", "bear": "l - m"}],
    "fisher": [{"m": MED}, {"n": f"(m - {roll('min', 'm', 9)}) / greatest({roll('max', 'm', 9)} - {roll('min', 'm', 9)}, 0.001) - 0.5"},
               *machine({"n": "n"}, {"v": "CASE WHEN e.n IS NULL THEN 0 ELSE greatest(-0.999, least(0.999, 0.66 * e.n)) END", "f": "CASE WHEN e.n IS NULL THEN 0 ELSE atanh(greatest(-0.999, least(0.999, 0.66 * e.n))) END", "g": "0"},
                        {"v": "CASE WHEN e.n IS NULL THEN 0 ELSE greatest(-0.999, least(0.999, 0.67 * s.v + 0.66 * e.n)) END", "f": "CASE WHEN e.n IS NULL THEN 0 ELSE atanh(greatest(-0.999, least(0.999, 0.67 * s.v + 0.66 * e.n))) + 0.5 * s.f END", "g": "s.f"},
                        {"fisher": "CASE WHEN n IS NOT NULL THEN _s.f END", "signal": "CASE WHEN n IS NOT NULL THEN _s.g END"})],
    "fosc": values(f"CASE WHEN c <> 0 AND t IS NOT NULL THEN 100 * (c - CASE WHEN {n_valid('c')} = 5 THEN 0 ELSE {lag('t')} END) / c END", {"t": f"{line('c', 5)[0]} + {line('c', 5)[1]}"}),
    "gatorosc": [{"j": ema0("c", 13), "t": ema0("c", 8), "p": ema0("c", 5)}, {"j": lag("j", 8), "t": lag("t", 5), "p": lag("p", 3)}, {"upper": "CASE WHEN j IS NOT NULL THEN abs(j - t) END", "lower": "CASE WHEN j IS NOT NULL THEN -abs(t - p) END", "k_": n_valid("c")},
                 {"upper": "CASE WHEN k_ >= 21 THEN upper END", "lower": "CASE WHEN k_ >= 21 THEN lower END"}, {"upper": "upper", "lower": "lower", "upper_change": f"upper - {lag('upper')}", "lower_change": f"lower - {lag('lower')}"}],
    "ift_rsi": [*rsi_layers("c", 5), {"y": "0.1 * (rsi - 50)"}, {"w": fir("y", linear(9))}, {"values": "tanh(w)"}],
    "kdj": [stoch_part(9), {"f": "CASE WHEN top <> low THEN 100 * (c - low) / (top - low) END"}, {"k": roll("avg", "f", 3)}, {"k": "k", "d": roll("avg", "k", 3)}, {"k": "k", "d": "d", "j": "3 * k - 2 * d"}],
    "kst": _kst(),
    "macd": [{"macd": f"{seeded('c', 12)} - {seeded('c', 26)}"}, {"macd": "macd", "signal": seeded("macd", 9)}, {"macd": "macd", "signal": "signal", "hist": "macd - signal"}],
    "marketefi": values("CASE WHEN v <> 0 THEN (h - l) / v END"),
    "mass": [{"q": ema0("(h - l)", 9)}, {"q": f"CASE WHEN {n_valid('c')} >= 9 THEN q END"}, {"w": ema0("q", 9)}, {"r": f"CASE WHEN {n_valid('c')} >= 17 AND w <> 0 THEN q / w END"}, {"values": roll("sum", "r", 5)}],
    "medprice": values(MED),
    "midpoint": values(f"({roll('max', 'c', 14)} + {roll('min', 'c', 14)}) / 2"),
    "midprice": values(f"({roll('max', 'h', 14)} + {roll('min', 'l', 14)}) / 2"),
    "mom": values(f"c - {lag('c', 10)}"),
    "msw": _msw(),
    "pfe": [{"d": f"c - {lag('c')}"}, {"w": roll("sum", "sqrt(1 + d * d)", 10), "m": f"c - {lag('c', 10)}"}, {"r": "CASE WHEN m > 0 THEN 100 * sqrt(m * m + 100) / w ELSE -100 * sqrt(m * m + 100) / w END"}, {"values": ema0("r", 5)}],
    "ppo": values(f"CASE WHEN {roll('avg', 'c', 26)} <> 0 THEN 100 * ({roll('avg', 'c', 12)} / {roll('avg', 'c', 26)} - 1) END"),
    "qstick": values(roll("avg", "(c - o)", 5)),
    "roc": values(f"CASE WHEN {lag('c', 9)} = 0 THEN 0 ELSE c / {lag('c', 9)} * 100 - 100 END"),
    "rocp": values(f"CASE WHEN {lag('c', 10)} <> 0 THEN (c - {lag('c', 10)}) / {lag('c', 10)} END"),
    "rocr": values(f"CASE WHEN {lag('c', 10)} = 0 THEN 0 ELSE c / {lag('c', 10)} END"),
    "rsi": [*rsi_layers("c", 14), {"values": "rsi"}],
    "rsmk": [{"y": "ln(c / o)"}, {"z": f"y - {lag('y', 90)}"}, {"indicator": f"100 * {ema_mean('z', 3)}"}, {"indicator": "indicator", "signal": ema_mean("indicator", 20)}],
    "squeeze_momentum": [*_squeeze(), {"b_": lag("m")}, {"squeeze": "CASE WHEN m IS NULL AND sd IS NULL THEN NULL WHEN 2 * sd < 1.5 * rr THEN -1.0 WHEN 2 * sd > 1.5 * rr THEN 1.0 WHEN rr IS NOT NULL THEN 0.0 END", "momentum": "m",
                         "momentum_signal": "CASE WHEN b_ IS NOT NULL THEN CASE WHEN m > 0 THEN CASE WHEN m > b_ THEN 1.0 ELSE 2.0 END ELSE CASE WHEN m < b_ THEN -1.0 ELSE -2.0 END END END"}],
    "srsi": [*rsi_layers("c", 14), {"f": f"CASE WHEN {roll('max', 'rsi', 14)} = {roll('min', 'rsi', 14)} THEN 50 ELSE 100 * (rsi - {roll('min', 'rsi', 14)}) / ({roll('max', 'rsi', 14)} - {roll('min', 'rsi', 14)}) END"}, {"k": roll("avg", "f", 3)}, {"k": "k", "d": roll("avg", "k", 3)}],
    "stoch": [stoch_part(14), {"f": "CASE WHEN top = low THEN 50 ELSE 100 * (c - low) / (top - low) END"}, {"k": roll("avg", "f", 3)}, {"k": "k", "d": roll("avg", "k", 3)}],
    "stochf": [stoch_part(5), {"k": "CASE WHEN top = low THEN CASE WHEN c = top THEN 100 ELSE 0 END ELSE 100 * (c - low) / (top - low) END"}, {"k": "k", "d": roll("avg", "k", 3)}],
    "stc": _stc(),
    "trix": _trix(),
    "tsi": [{"m": f"c - {lag('c')}"}, {"a": ema0("m", 25), "b": ema0("abs(m)", 25)}, {"a": ema0("a", 13), "b": ema0("b", 13)}, {"values": f"CASE WHEN {n_valid('m')} >= 37 AND b <> 0 THEN greatest(-100, least(100, 100 * a / b)) END"}],
    "ttm_squeeze": [*_squeeze(), {"momentum": "m", "squeeze": "CASE WHEN sd IS NOT NULL AND rr IS NOT NULL THEN CASE WHEN 2 * sd <= rr THEN 3.0 WHEN 2 * sd <= 1.5 * rr THEN 2.0 WHEN 2 * sd <= 2 * rr THEN 1.0 ELSE 0.0 END END"}],
    "ttm_trend": values(f"coalesce(c > {roll('avg', 'm', 5)}, false)", {"m": MED}),
    "ultosc": _ult(),
    "wavetrend": [*_wave(9, 12, 3, TYP), {"k_": n_valid("x")}, {"wt1": "CASE WHEN k_ >= 22 THEN w1 END", "wt2": "CASE WHEN k_ >= 22 THEN w2 END", "wt_diff": "CASE WHEN k_ >= 22 THEN w2 - w1 END"}],
    "wclprice": values("(h + l + 2 * c) / 4"),
    "willr": values("CASE WHEN top = low THEN 0 ELSE -100 * (top - c) / (top - low) END", stoch_part(14)),
    "wto": [*_wave(10, 21, 4, "c"), {"wt1": "w1", "wt2": "w2", "hist": "w1 - w2"}],
    "decycler": _highpass2(125, 0.707, "CASE WHEN _s.n > 2 THEN c - _s.y1 END"),
    # trend, bands, stops
    "adx": [*ADX, {"values": "adx_"}],
    "adxr": [*ADX, {"values": f"(adx_ + {lag('adx_', 14)}) / 2"}],
    "alligator": [{"m": MED}, {"jaw": rma("m", 13), "teeth": rma("m", 8), "lips": rma("m", 5)}, {"jaw": lag("jaw", 8), "teeth": lag("teeth", 5), "lips": lag("lips", 3)}],
    "aroon": [{"hh": f"CASE WHEN count(h) {over(15)} = 15 THEN list_reverse(list(h) {over(15)}) END", "ll": f"CASE WHEN count(l) {over(15)} = 15 THEN list_reverse(list(l) {over(15)}) END"},
              {"up": "100 * (1 - (list_position(hh, list_max(hh)) - 1) / 14.0)", "down": "100 * (1 - (list_position(ll, list_min(ll)) - 1) / 14.0)"}],
    "aroonosc": [{"hh": f"CASE WHEN count(h) {over(15)} = 15 THEN list(h) {over(15)} END", "ll": f"CASE WHEN count(l) {over(15)} = 15 THEN list(l) {over(15)} END"}, {"values": "100.0 / 14 * (list_position(hh, list_max(hh)) - list_position(ll, list_min(ll)))"}],
    "aso": _aso(),
    "atr": [*ATR, {"values": rma("tr", 14)}],
    "bollinger_bands": _boll(),
    "bollinger_bands_width": values("4 * d / m", {"m": roll("avg", "c", 20), "d": roll("stddev_pop", "c", 20)}),
    "chande": [*ATR, {"a": rma("tr", 22)}, {"values": f"{roll('max', 'h', 22)} - 3 * a"}],
    "chop": [PREV, {"tr": TR}, {"t": roll("sum", "tr", 14), "r": f"{roll('max', 'h', 14)} - {roll('min', 'l', 14)}"}, {"values": "CASE WHEN t > 0 AND r > 0 THEN 100 * log2(t / r) / log2(14) END"}],
    "cksp": [*ATR, {"a": rma("tr", 10)}, {"p1": f"{roll('max', 'h', 9)} - a", "q1": f"{roll('min', 'l', 9)} + a"}, {"long": roll("max", "p1", 9), "short": roll("min", "q1", 9)}],
    "correlation_cycle": _corr_cycle(),
    "devstop": [{"two": f"CASE WHEN {lag('h')} IS NOT NULL THEN greatest(h, {lag('h')}) - least(l, {lag('l')}) END"}, {"base": f"h - {roll('avg', 'two', 20)}"}, {"values": f"CASE WHEN base IS NOT NULL THEN max(base) {over(20)} END"}],
    "di": [PREV, MOVES, D14, {"plus": "100 * pp_ / tt_", "minus": "100 * mm_ / tt_"}],
    "dm": [PREV, MOVES, {"plus": wilder("up", 14, 13), "minus": wilder("dn", 14, 13)}],
    "donchian": [stoch_part(20), {"upper": "top", "middle": "(top + low) / 2", "lower": "low"}],
    "dx": [PREV, MOVES, D14, {"values": dx_of("pp_", "mm_")}],
    "kaufmanstop": values(f"l - 2 * {roll('avg', '(h - l)', 22)}"),
    "keltner": [*ATR, {"a": rma("tr", 20), "m": ema_mean("c", 20)}, {"upper": "m + 2 * a", "middle": "CASE WHEN a IS NOT NULL THEN m END", "lower": "m - 2 * a"}],
    "mab": [{"f": roll("avg", "c", 10), "s": roll("avg", "c", 50)}, {"r": f"sqrt({roll('avg', '((f - s) * (f - s))', 10)})"}, {"upper": "s + r", "middle": "f", "lower": "s - r"}],
    "minmax": _minmax(),
    "nadaraya_watson_envelope": [{"w": f"CASE WHEN count(c) {over(500)} = 500 THEN list_sum(list_transform(list(c) {over(500)}, lambda u, i: u * exp(-power(500 - i, 2) / 128.0))) / list_sum(list_transform(range(500), lambda k: exp(-power(k, 2) / 128.0))) END"}, {"q": f"3 * {roll('avg', 'abs(c - w)', 499)}"}, {"upper": "w + q", "lower": "w - q"}],
    "natr": [*ATR, {"a": rma("tr", 14)}, {"values": "100 * a / c"}],
    "pivot": [_pivot()],
    "pma": [{"m": MED}, {"w1": fir("m", linear(7))}, {"predict": f"2 * w1 - {fir('w1', linear(7))}"}, {"predict": "predict", "trigger": fir("predict", linear(4))}],
    "range_filter": [{"d": f"abs(c - {lag('c')})"}, {"r": f"2.618 * {ema0('d', 14)}"}, {"r": ema0("r", 27)}, *machine({"x": "c", "r": "r"}, {"f": "e.x"}, {"f": "greatest(e.x - e.r, least(e.x + e.r, s.f))"}, {"filter": "CASE WHEN r IS NOT NULL THEN _s.f END", "high_band": "_s.f + r", "low_band": "_s.f - r"})],
    "safezonestop": [PREV, MOVES, {"m": rma("dn", 22)}, {"q": "pl - 2.5 * m"}, {"values": roll("max", "q", 3)}],
    "supertrend": _supertrend(),
    "ui": [{"t": roll("max", "c", 14)}, {"d": "power(100 * (c - t) / t, 2)"}, {"values": f"sqrt({roll('avg', 'd', 14)})"}],
    "vi": [PREV, MOVES, {"plus": f"{roll('sum', 'abs(h - pl)', 14)} / {roll('sum', 'tr1', 14)}", "minus": f"{roll('sum', 'abs(l - ph)', 14)} / {roll('sum', 'tr1', 14)}"}],
    # volume, statistics, regression
    "ad": values(P_SUM.format(x="f"), {"f": FLOW}),
    "adosc": [{"f": FLOW}, {"q": P_SUM.format(x="f")}, {"values": f"{ema0('q', 3)} - {ema0('q', 10)}"}],
    "correl_hl": values(f"CASE WHEN count(h) {over(5)} = 5 THEN CASE WHEN {roll('stddev_pop', 'h', 5)} = 0 OR {roll('stddev_pop', 'l', 5)} = 0 THEN 0 ELSE corr(h, l) {over(5)} END END"),
    "deviation": values(roll("stddev_pop", "c", 9)),
    "efi": values(ema0("q", 13), {"q": f"(c - {lag('c')}) * v"}),
    "kurtosis": values(ma_list("c", 5, "list_avg(list_transform(_v, lambda u: power(u - list_avg(_v), 4))) / power(list_avg(list_transform(_v, lambda u: power(u - list_avg(_v), 2))), 2) - 3")),
    "linearreg_angle": values(f"degrees(atan({LIN14[0]}))"),
    "linearreg_intercept": values(f"{LIN14[1]} - 13 * {LIN14[0]}"),
    "linearreg_slope": values("CASE WHEN abs(b) <= 1.1e-8 THEN 0 ELSE b END", {"b": LIN14[0]}),
    "mean_ad": values(roll("avg", "q", 5), {"q": f"abs(c - {roll('avg', 'c', 5)})"}),
    "medium_ad": values(ma_list("c", 5, MEDIAN_DEV)),
    "mfi": _mfi(),
    "nvi": machine({"c": "c", "v": "v"}, {"y": "1000"}, {"y": "CASE WHEN e.v < s.v AND s.c <> 0 THEN s.y * (e.c / s.c) ELSE s.y END"}, {"values": "_s.y"}),
    "pvi": machine({"c": "c", "v": "v"}, {"y": "1000"}, {"y": "CASE WHEN e.v > s.v AND s.c <> 0 THEN s.y * (e.c / s.c) ELSE s.y END"}, {"values": "_s.y"}),
    "obv": values(P_SUM.format(x="q"), {"b_": lag("c")}, {"q": "CASE WHEN b_ IS NULL THEN 0 WHEN c > b_ THEN v WHEN c < b_ THEN -v ELSE 0 END"}),
    "percentile_nearest_rank": values(f"CASE WHEN row_number() OVER ({S}) >= 15 THEN list_sort(list(c) {over(15)})[8] END"),
    "stddev": values(roll("stddev_pop", "c", 5)),
    "tsf": values(f"{LIN14[0]} + {LIN14[1]}"),
    "var": values(roll("var_pop", "c", 14)),
    "vosc": values(f"100 * ({roll('avg', 'v', 2)} - {roll('avg', 'v', 5)}) / {roll('avg', 'v', 5)}"),
    "rsx": _rsx(14),
    "volume_adjusted_ma": _volume_adjusted(13, 0.67),
    "avsl": _avsl(12, 26, 2.0),
    "vpci": [*_vpc(5, 25), {"vpci": "vpc * vpr * vm"}, {"vpci": "vpci", "vpcis": f"{roll('sum', '(vpci * v)', 5)} / {roll('sum', 'v', 5)}"}],
    "vpt": values(f"CASE WHEN m IS NOT NULL THEN sum(m) {ALL} END", {"m": f"(c - {lag('c')}) / {lag('c')} * v"}),
    "vwmacd": [{"xv": "c * v"}, {"macd": f"{roll('sum', 'xv', 12)} / {roll('sum', 'v', 12)} - {roll('sum', 'xv', 26)} / {roll('sum', 'v', 26)}"}, {"macd": "macd", "s_": ema_mean("macd", 9), "k_": n_valid("macd")}, {"macd": "macd", "signal": "CASE WHEN k_ >= 9 THEN s_ END", "hist": "CASE WHEN k_ >= 9 THEN macd - s_ END"}],
    "wad": values(P_SUM.format(x="q"), PREV, {"q": "CASE WHEN pc IS NULL OR c = pc THEN 0 WHEN c > pc THEN c - least(l, pc) ELSE c - greatest(h, pc) END"}),
    "zscore": values(_zscore()),
    # moving averages
    "sma": values(roll("avg", "c", 9)),
    "wma": values(fir("c", linear(30))),
    "alma": values(fir("c", [exp(-((8 - k - 0.85 * 8) ** 2) / (2 * 1.5 * 1.5)) for k in range(9)])),
    "cwma": values(f"CASE WHEN {n_valid('c')} >= 14 THEN {fir('c', [(14.0 - k) ** 3 for k in range(13)])} END"),
    "cora_wave": values(fir("y", linear(4)), {"y": fir("c", [(1 + 2 * (2000 ** (1 / 19) - 1)) ** (20 - k) for k in range(20)])}),
    "ehma": values(fir("c", [sin(pi * k / 15) ** 2 for k in range(1, 15)])),
    "epma": values(f"CASE WHEN {n_valid('c')} >= 16 THEN {fir('c', [7.0 - k for k in range(10)])} END"),
    "fwma": values(fir("c", FIB[::-1])),
    "pwma": values(fir("c", [float(comb(4, k)) for k in range(5)])),
    "sinwma": values(fir("c", [sin(k * pi / 15) for k in range(1, 15)])),
    "sqwma": values(f"CASE WHEN {n_valid('c')} >= 16 THEN {fir('c', [(14.0 - k) ** 2 for k in range(13)])} END"),
    "srwma": values(f"CASE WHEN {n_valid('c')} >= 16 THEN {fir('c', [(14.0 - k) ** 0.5 for k in range(13)])} END"),
    "swma": values(fir("c", _swma(5))),
    "trima": values(fir("c", _swma(30))),
    "vpwma": values(f"CASE WHEN {n_valid('c')} >= 15 THEN {fir('c', [(14.0 - k) ** 0.382 for k in range(13)])} END"),
    "hma": _hma(),
    "jsa": values(f"(c + {lag('c', 30)}) / 2"),
    "linreg": values(LIN14[1]),
    "edcf": values(f"CASE WHEN {n_valid('c')} > 30 AND {roll('sum', 'w', 15)} <> 0 THEN {roll('sum', '(w * c)', 15)} / {roll('sum', 'w', 15)} END", {"w": " + ".join(f"power(c - {lag('c', k)}, 2)" for k in range(1, 15))}),
    "nma": values(f"{lag('c', 39)} * r + {lag('c', 40)} * (1 - r)", {"d": f"abs(1000 * ln(c) - 1000 * ln({lag('c')}))"}, {"r": f"({' + '.join(f'{lag("d", k)} * {sqrt(k + 1) - sqrt(k)!r}' for k in range(40))}) / ({' + '.join(lag('d', k) for k in range(40))})"}),
    "buff_averages": [{"fast": f"{roll('sum', '(c * v)', 5)} / {roll('sum', 'v', 5)}", "slow": f"{roll('sum', '(c * v)', 20)} / {roll('sum', 'v', 20)}"}],
    "vwma": values(f"{roll('sum', '(c * v)', 20)} / {roll('sum', 'v', 20)}"),
    "vwap": values("sum(x * v) OVER (PARTITION BY series, dd ORDER BY ts ROWS UNBOUNDED PRECEDING) / sum(v) OVER (PARTITION BY series, dd ORDER BY ts ROWS UNBOUNDED PRECEDING)", {"x": TYP, "dd": "date_trunc('day', ts)"}),
    "ehlers_pma": [{"m": lag("c")}, {"w1": fir("m", linear(7))}, {"predict": f"2 * w1 - {fir('w1', linear(7))}"}, {"predict": "predict", "trigger": fir("predict", linear(4))}],
    "ema": values(ema_mean("c", 9)),
    "smma": values(rma("c", 7)),
    "wilders": values(rma("c", 5)),
    "dema": values(f"2 * q - {ema0('q', 30)}", {"q": ema0("c", 30)}),
    "tema": [{"a": ema0("c", 9), "k_": n_valid("c")}, {"a2": "CASE WHEN k_ >= 9 THEN a END"}, {"b": ema0("a2", 9)}, {"b2": "CASE WHEN k_ >= 17 THEN b END"}, {"d": ema0("b2", 9)}, {"values": "CASE WHEN k_ >= 25 THEN 3 * a - 3 * b + d END"}],
    "zlema": values(f"CASE WHEN {n_valid('c')} >= 14 THEN {ema0('q', 14)} END", {"q": f"CASE WHEN {lag('c', 6)} IS NULL THEN c ELSE 2 * c - {lag('c', 6)} END"}),
    "tilson": _tilson(),
    "mwdx": values(ema0("c", a=0.2)),
    "kama": _kaufman(30, "power(e.er * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2)"),
    "maaq": [*_kaufman(11, "0")[:2], *machine({"x": "c", "er": "er"}, {"y": "e.x"}, {"y": "CASE WHEN e.er IS NULL THEN e.x ELSE s.y + power(e.er * 2.0 / 3 + 2.0 / 31, 2) * (e.x - s.y) END"}, {"values": "_s.y"})],
    "highpass": _hp1(48),
    "highpass_2_pole": _highpass2(48, 0.707, "_s.y1"),
    "supersmoother": _supersmoother(),
    "hwma": machine({"x": "c"}, {"f": "e.x", "q": "0", "a": "0"}, {"f": "0.2 * e.x + 0.8 * (s.f + s.q + s.a / 2)", "q": "0.1 * (0.2 * e.x + 0.8 * (s.f + s.q + s.a / 2) - s.f) + 0.9 * (s.q + s.a)",
                    "a": "0.1 * (0.1 * (0.2 * e.x + 0.8 * (s.f + s.q + s.a / 2) - s.f) + 0.9 * (s.q + s.a) - s.q) + 0.9 * s.a"}, {"values": "CASE WHEN len(_l) = 1 THEN c ELSE _s.f + _s.q + _s.a / 2 END"}),
}


def shown(e: str, digits: int) -> str:
    """Rounded, if below 1e9; no minus zero."""
    return f"CASE WHEN abs({e}) < 1e9 THEN round({e}, {digits}) + 0.0 ELSE {e} END"


def sql_of(layers: Layers, bars: str, outputs: tuple[str, ...], digits: int) -> str:
    """The layers as nested queries; doubles are rounded as in the Spark query."""
    ctes, before = [f"bars AS ({bars})", "l0 AS (SELECT series, ts, open AS o, high AS h, low AS l, close AS c, volume AS v FROM bars)"], {"o", "h", "l", "c", "v"}
    for k, layer in enumerate(layers):
        keep = [f'"{c}"' for c in sorted(before) if c not in layer]
        ctes.append(f"l{k + 1} AS (SELECT series, ts, {', '.join([*keep, *(f'{e} AS {n}' for n, e in layer.items())])} FROM l{k})")
        before |= set(layer)
    last = f"l{len(layers)}"
    show = ", ".join(o if layers is EXPRESSIONS["ttm_trend"] else shown(f'CAST("{o}" AS DOUBLE)', digits) + f' AS "{o}"' for o in outputs)
    return f"WITH {', '.join(ctes)} SELECT series, ts, {show} FROM {last}"


def sweep_sql(bars: str, digits: int) -> dict[str, str]:
    parts = " UNION ALL ".join(f"SELECT series, ts, {i} AS combo_id, {p} AS period, round({roll('avg', 'close', p)}, {digits}) + 0.0 AS values FROM bars" for i, p in enumerate(range(5, 46, 5)))
    periods = [5, 10, 15, 20, 30, 40, 50]

    def alma(p: int) -> str:
        w = [exp(-((p - 1 - k - 0.85 * (p - 1)) ** 2) / (2 * (p / 6) ** 2)) for k in range(p)]
        return fir("close", w)

    wide = "SELECT series, ts, close - " + lag("close") + " AS change, " + ", ".join(f"{alma(p)} AS a{p}" for p in periods) + " FROM bars"
    pairs = " UNION ALL ".join(f"SELECT series, ts, change, {f} AS fast, {s} AS slow, a{f} > a{s} AS up FROM wide" for f in periods for s in periods if f < s)
    cross = f"""WITH bars AS ({bars}), wide AS ({wide}), r AS ({pairs}), w AS (SELECT *, lag(up) OVER (PARTITION BY series, fast, slow ORDER BY ts) AS was FROM r)
      SELECT series, fast, slow, count(*) FILTER (up <> was) AS crossings, round(sum(CASE WHEN was THEN change ELSE 0 END), 4) + 0.0 AS gain FROM w GROUP BY 1, 2, 3"""
    return {"sma_sweep": f"WITH bars AS ({bars}) {parts}", "double_alma_crossover": cross}
