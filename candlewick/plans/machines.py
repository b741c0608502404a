"""SQL of the operators whose state needs more than one number: folds of structs. In a step,
e is the bar, s the state after the bar before; s also has that bar's inputs."""

from __future__ import annotations

from math import comb, cos, exp, pi, sin, sqrt

from .oracles import ATR, MED, PREV, TYP, Layers, _high2, ema0, ema_mean, fir, lag, linear, machine, n_valid, over, rma, roll, rsi_layers, seeded

def case(*pairs: str) -> str:
    """case(condition, value, condition, value, ..., otherwise)."""
    whens = " ".join(f"WHEN {c} THEN {v}" for c, v in zip(pairs[::2], pairs[1::2]))
    return f"(CASE {whens} ELSE {pairs[-1]} END)"


def var_average(x: str, p: float, out: str) -> Layers:
    d = {"vd": f"coalesce({x} - {lag(x)}, 0)"}
    cmo = {"vu": f"sum(greatest(vd, 0)) {over(9)}", "vw": f"sum(greatest(-vd, 0)) {over(9)}"}
    k = {"vk": f"{2 / (p + 1)!r} * (CASE WHEN vu + vw = 0 THEN 0 ELSE abs((vu - vw) / (vu + vw)) END)"}
    return [d, cmo, k, *machine({"x": x, "k": "vk"}, {"y": "e.k * e.x"}, {"y": "e.k * e.x + (1 - e.k) * s.y"}, {out: "_s.y"})]


def ratchet(m: str, pct: float, out: str) -> Layers:
    lo, hi = f"(e.m - {pct / 100!r} * e.m)", f"(e.m + {pct / 100!r} * e.m)"
    way = case("s.way = -1 AND e.m > s.ss", "1", "s.way = 1 AND e.m < s.ls", "-1", "s.way")
    stop = "CASE WHEN _s.way = 1 THEN _s.ls ELSE _s.ss END"
    return [*machine({"m": m}, {"ls": lo, "ss": hi, "way": "1"}, {"ls": case("e.m > s.ls", f"greatest({lo}, s.ls)", lo), "ss": case("e.m < s.ss", f"least({hi}, s.ss)", hi), "way": way}, {"st": stop}),
            {out: f"CASE WHEN {m} > st THEN st * {200 + pct} / 200 ELSE st * {200 - pct} / 200 END"}]


def _kvo() -> Layers:
    up, down, d = "(e.h + e.l + e.c > s.h + s.l + s.c)", "(e.h + e.l + e.c < s.h + s.l + s.c)", "(e.h - e.l)"
    turn = f"(({up} AND s.t <> 1) OR ({down} AND s.t <> 0))"
    t = case(f"{up} AND s.t <> 1", "1", f"{down} AND s.t <> 0", "0", "s.t")
    cm = f"({case(turn, 's.h - s.l', 's.cm')} + {d})"
    vf = f"CASE WHEN {cm} = 0 THEN 0 ELSE e.v * abs(2 * {d} / {cm} - 1) * 100 * (CASE WHEN {t} = 1 THEN 1 ELSE -1 END) END"
    return [*machine({"h": "h", "l": "l", "c": "c", "v": "v"}, {"t": "-1", "cm": "0", "vf": "0"}, {"t": t, "cm": cm, "vf": vf}, {"q": "CASE WHEN len(_l) > 1 THEN _s.vf END"}), {"values": f"{ema0('q', 2)} - {ema0('q', 5)}"}]


def _sar() -> Layers:
    nxt, first = "(s.sv + s.acc * (s.ep - s.sv))", "s.n = 1"
    flip = f"(CASE WHEN s.up = 1 THEN e.l < {nxt} ELSE e.h > {nxt} END)"
    better = "(CASE WHEN s.up = 1 THEN e.h > s.ep ELSE e.l < s.ep END)"
    return machine({"h": "h", "l": "l"}, {"n": "1", "up": "1", "sv": "0", "ep": "0", "acc": "0.02", "ph": "e.h", "pl": "e.l"}, {
        "n": "s.n + 1", "ph": "s.h", "pl": "s.l",
        "up": case(first, "CAST(e.h > s.h AS INT)", flip, "1 - s.up", "s.up"),
        "sv": case(first, "CASE WHEN e.h > s.h THEN s.l ELSE s.h END", flip, "s.ep", "s.up = 1", f"least({nxt}, s.l, s.pl)", f"greatest({nxt}, s.h, s.ph)"),
        "ep": case(first, "CASE WHEN e.h > s.h THEN e.h ELSE e.l END", flip, "CASE WHEN s.up = 1 THEN e.l ELSE e.h END", better, "CASE WHEN s.up = 1 THEN e.h ELSE e.l END", "s.ep"),
        "acc": case(first, "0.02", flip, "0.02", better, "least(s.acc + 0.02, 0.2)", "s.acc"),
    }, {"values": "CASE WHEN len(_l) > 1 THEN _s.sv END"})


def _chandelier() -> Layers:
    nl, ns, fresh = "(e.hi - 3 * e.a)", "(e.lo + 3 * e.a)", "s.a IS NULL"
    l1, s1 = case(fresh, nl, "s.ls"), case(fresh, ns, "s.ss")
    return [*ATR, {"a": rma("tr", 22)}, {"hi": roll("max", "c", 22), "lo": roll("min", "c", 22)},
            *machine({"c": "c", "a": "a", "hi": "hi", "lo": "lo"}, {"ls": "0", "ss": "0", "way": "1"}, {
                "ls": case("e.a IS NULL", "0", f"s.c > {l1}", f"greatest({nl}, {l1})", nl), "ss": case("e.a IS NULL", "0", f"s.c < {s1}", f"least({ns}, {s1})", ns),
                "way": case("e.a IS NULL", "s.way", f"e.c > {s1}", "1", f"e.c < {l1}", "-1", "s.way")},
                {"long_stop": "CASE WHEN a IS NOT NULL AND _s.way = 1 THEN _s.ls END", "short_stop": "CASE WHEN a IS NOT NULL AND _s.way = -1 THEN _s.ss END"})]


def _lrsi(g: float = 0.8) -> Layers:
    a = f"({1 - g!r} * e.x + {g!r} * s.a)"
    b = f"(-{g!r} * {a} + s.a + {g!r} * s.b)"
    c = f"(-{g!r} * {b} + s.b + {g!r} * s.k)"
    d = f"(-{g!r} * {c} + s.k + {g!r} * s.d)"
    up = " + ".join(f"greatest(_s.{p} - _s.{q}, 0)" for p, q in ("ab", "bk", "kd"))
    down = " + ".join(f"greatest(_s.{q} - _s.{p}, 0)" for p, q in ("ab", "bk", "kd"))
    return [*machine({"x": MED}, {"a": "e.x", "b": "e.x", "k": "e.x", "d": "e.x"}, {"a": a, "b": b, "k": c, "d": d}, {"u": up, "w": down, "k_": "len(_l)"}), {"values": "CASE WHEN k_ > 1 THEN CASE WHEN u + w = 0 THEN 0 ELSE u / (u + w) END END"}]


def _jma(p: int = 7) -> Layers:
    beta = 0.45 * (p - 1) / (0.45 * (p - 1) + 2)
    a = beta**2
    e0 = f"({1 - a!r} * e.x + {a!r} * s.p)"
    e1 = f"((e.x - {e0}) * {1 - beta!r} + {beta!r} * s.q)"
    e2 = f"(({e0} + 2.0 * {e1} - s.j) * {(1 - a) ** 2!r} + {a * a!r} * s.r)"
    return machine({"x": "c"}, {"p": "e.x", "q": "0", "r": "0", "j": "e.x"}, {"p": e0, "q": e1, "r": e2, "j": f"s.j + {e2}"}, {"values": "_s.j"})


def _gaussian(p: int = 14, n: int = 4) -> Layers:
    beta = (1 - cos(2 * pi / p)) / (2 ** (1 / n) - 1)
    a = -beta + sqrt(beta * beta + 2 * beta)
    back = " + ".join(f"{(-1) ** (k + 1) * comb(n, k) * (1 - a) ** k!r} * s.y{k}" for k in range(1, n + 1))
    start = {f"y{k}": f"{a**n!r} * e.x" if k == 1 else "0" for k in range(1, n + 1)}
    return machine({"x": "c"}, start, {"y1": f"{a**n!r} * e.x + {back}"} | {f"y{k}": f"s.y{k - 1}" for k in range(2, n + 1)}, {"values": f"CASE WHEN len(_l) >= {p} THEN _s.y1 END"})


def _smooth3(p: int = 14) -> Layers:
    a = exp(-pi / p)
    b, c = 2 * a * cos(1.738 * pi / p), a * a
    y = case("s.n < 3", "e.x", f"{1 - c * c - b + b * c!r} * e.x + {b + c!r} * s.y1 + {-c - b * c!r} * s.y2 + {c * c!r} * s.y3")
    return machine({"x": "c"}, {"n": "1", "y1": "e.x", "y2": "e.x", "y3": "e.x"}, {"n": "s.n + 1", "y1": y, "y2": "s.y1", "y3": "s.y2"}, {"values": "_s.y1"})


def _laguerre(g: float = 0.02) -> Layers:
    a = f"({1 - g!r} * e.x + {g!r} * s.a)"
    b = f"(-{g!r} * {a} + s.a + {g!r} * s.b)"
    c = f"(-{g!r} * {b} + s.b + {g!r} * s.k)"
    d = f"(-{g!r} * {c} + s.k + {g!r} * s.d)"
    return machine({"x": "c"}, {"a": f"{1 - g!r} * e.x + {g!r} * e.x", "b": "e.x", "k": "e.x", "d": "e.x"}, {"a": a, "b": b, "k": c, "d": d}, {"values": "(_s.a + 2 * _s.b + 2 * _s.k + _s.d) / 6"})


def _qqe() -> Layers:
    up, down = "(e.f + 4.236 * e.r)", "(e.f - 4.236 * e.r)"
    slow = case("s.f IS NULL", "e.f", f"{up} < s.w", up, "e.f > s.w AND s.f < s.w", down, f"{down} > s.w", down, "e.f < s.w AND s.f > s.w", up, "s.w")
    return [*rsi_layers("c", 14), {"f": ema_mean("rsi", 5)}, {"d": f"CASE WHEN f IS NOT NULL THEN coalesce(abs(f - {lag('f')}), 0) END"}, {"r": ema0("d", a=1 / 14)}, {"r": ema0("r", a=1 / 14)},
            *machine({"f": "f", "r": "r"}, {"w": "0"}, {"w": case("e.f IS NULL", "0", slow)}, {"fast": "f", "slow": "CASE WHEN f IS NOT NULL THEN _s.w END"})]


def _vidya() -> Layers:
    return [{"k": f"0.2 * {roll('stddev_pop', 'c', 2)} / {roll('stddev_pop', 'c', 5)}"},
            *machine({"x": "c", "k": "k"}, {"n": "1", "y": "e.x"}, {"n": "s.n + 1", "y": "CASE WHEN s.n + 1 <= 4 THEN e.x ELSE s.y + coalesce(e.k, 0) * (e.x - s.y) END"}, {"values": "CASE WHEN _s.n >= 4 THEN _s.y END"})]


def _nama(p: int = 30) -> Layers:
    way = f"coalesce({roll('sum', 'd', p)}, {roll('sum', 'd', p - 1)})"
    return [{"d": f"abs(c - {lag('c')})"}, {"a": f"CASE WHEN count(c) {over(p)} = {p} THEN CASE WHEN {way} = 0 THEN 0 ELSE (max(c) {over(p)} - min(c) {over(p)}) / {way} END END"},
            *machine({"x": "c", "a": "a"}, {"y": "0"}, {"y": case("e.a IS NULL", "0", "s.a IS NULL", "e.a * e.x", "e.a * e.x + (1 - e.a) * s.y")}, {"values": "CASE WHEN a IS NOT NULL THEN _s.y END"})]


def _sama() -> Layers:
    top, low = f"max(c) {over(201)}", f"min(c) {over(201)}"
    return [{"a": f"power((CASE WHEN {top} = {low} THEN 0 ELSE abs(2 * c - {low} - {top}) / ({top} - {low}) END) * {2 / 7 - 2 / 15!r} + {2 / 15!r}, 2)"},
            *machine({"x": "c", "a": "a"}, {"y": "e.x"}, {"y": "s.y + e.a * (e.x - s.y)"}, {"values": "_s.y"})]


def _ehlers_kama(p: int = 20) -> Layers:
    return [{"d": f"abs(c - {lag('c')})"}, {"a": f"CASE WHEN {lag('c', p - 1)} IS NOT NULL THEN power(0.6667 * (CASE WHEN {roll('sum', 'd', p - 1)} = 0 THEN 0 ELSE least(1.0, abs(c - {lag('c', p - 1)}) / {roll('sum', 'd', p - 1)}) END) + 0.0645, 2) END"},
            *machine({"x": "c", "a": "a"}, {"y": "0"}, {"y": case("e.a IS NULL", "0", "s.a IS NULL", "s.x + e.a * (e.x - s.x)", "s.y + e.a * (e.x - s.y)")}, {"values": "CASE WHEN a IS NOT NULL THEN _s.y END"})]


def _tradjema() -> Layers:
    top, low = roll("max", "tr", 40), roll("min", "tr", 40)
    return [*ATR, {"k": f"{2 / 41!r} * (1 + 10 * (CASE WHEN {top} = {low} THEN 0 ELSE (tr - {low}) / ({top} - {low}) END))", "z": lag("c"), "ok": top},
            *machine({"x": "z", "k": "CASE WHEN ok IS NOT NULL THEN k END"}, {"y": "0"}, {"y": case("e.k IS NULL OR e.x IS NULL", "0", "s.k IS NULL", "e.x", "s.y + e.k * (e.x - s.y)")}, {"values": "CASE WHEN ok IS NOT NULL THEN _s.y END"})]


def _alphatrend() -> Layers:
    flow = lambda op: f"CASE WHEN tb IS NOT NULL THEN CASE WHEN tp {op} tb THEN tp * v ELSE 0 END END"
    up, down = "(e.l - e.a)", "(e.h + e.a)"
    k = case("e.m IS NULL OR e.a IS NULL", "0", "s.m IS NULL OR s.a IS NULL", case("e.m >= 50", up, down), "e.m >= 50", f"greatest({up}, s.k)", f"least({down}, s.k)")
    return [PREV, {"tr": ATR[1]["tr"], "tp": TYP}, {"tb": lag("tp"), "a": roll("avg", "tr", 14)}, {"p": flow(">"), "q": flow("<")}, {"p": roll("sum", "p", 14), "q": roll("sum", "q", 14)}, {"m": "CASE WHEN p + q > 1e-14 THEN 100 * p / (p + q) WHEN p IS NOT NULL THEN 0 END"},
            *machine({"h": "h", "l": "l", "a": "a", "m": "m"}, {"k": "0"}, {"k": k}, {"k1": "CASE WHEN m IS NOT NULL AND a IS NOT NULL THEN _s.k END"}), {"k1": "k1", "k2": f"CASE WHEN k1 IS NOT NULL THEN {lag('k1', 2)} END"}]


def _damiani() -> Layers:
    return [*ATR, {"u": f"{rma('tr', 13)} / {rma('tr', 40)}", "w": f"1.4 - {roll('stddev_pop', 'c', 20)} / {roll('stddev_pop', 'c', 100)}", "ok": n_valid("c")},
            *machine({"u": "CASE WHEN ok >= 101 THEN u END"}, {"a": "0", "b": "0", "d": "0"}, {"a": "CASE WHEN e.u IS NULL THEN 0 ELSE e.u + 0.5 * (s.a - s.d) END", "b": "s.a", "d": "s.b"},
                     {"vol": "CASE WHEN ok >= 101 THEN _s.a END", "anti": "CASE WHEN ok >= 101 THEN w END"})]


def _hp1(x: str, p: int, out: str) -> Layers:
    t = 2 * pi / p
    a = 1 + (sin(t) - 1) / cos(t)
    return machine({"x": x}, {"y": "e.x"}, {"y": f"{1 - a / 2!r} * (e.x - s.x) + {1 - a!r} * s.y"}, {out: "_s.y"})


def _bandpass() -> Layers:
    b, g = cos(2 * pi / 20), cos(2 * pi * 0.3 / 20)
    a = 1 / g - sqrt(1 / (g * g) - 1)
    y = case("s.n < 2", "e.x", f"{0.5 * (1 - a)!r} * (e.x - s.x1) + {b * (1 + a)!r} * s.y1 - {a!r} * s.y2")
    bp = machine({"x": "hp"}, {"n": "1", "x1": "e.x", "y1": "e.x", "y2": "0"}, {"n": "s.n + 1", "x1": "s.x", "y1": y, "y2": "s.y1"}, {"y": "_s.y1"})
    peak = machine({"y": "y"}, {"p": "abs(e.y)"}, {"p": "greatest(0.991 * s.p, abs(e.y))"}, {"pk": "_s.p"})
    return [*_hp1("c", round(80 / 0.3), "hp"), *bp, *peak, {"n_": "CASE WHEN pk = 0 THEN 0 ELSE y / pk END"}, *_hp1("n_", round(20 / 0.3 / 1.5), "t_"),
            {"bp": "y", "bp_normalized": "n_", "signal": "CASE WHEN n_ < t_ THEN 1.0 WHEN n_ > t_ THEN -1.0 ELSE 0.0 END", "trigger": "t_"}]


def _frama() -> Layers:
    high = lambda a, b: f"max(h) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING) - min(l) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING)"
    d = case("e.n1 > 0 AND e.n2 > 0 AND e.n3 > 0", "(ln(e.n1 + e.n2) - ln(e.n3)) / ln(2)", "s.n > 10", "s.d", "1")
    al = f"greatest(0.1, least(1.0, exp(ln(2.0 / 301) * ({d} - 1))))"
    al = f"greatest(2.0 / 301, least(1.0, 2 / ((299 * ((2 - {al}) / {al} - 1) / 299 + 1) + 1)))"
    return [{"n1": f"({high(5, 1)}) / 5", "n2": f"({high(10, 6)}) / 5", "n3": f"({high(10, 1)}) / 10", "m": roll("avg", "c", 10)},
            *machine({"c": "c", "n1": "n1", "n2": "n2", "n3": "n3", "m": "m"}, {"n": "1", "d": "1", "y": "0"}, {"n": "s.n + 1", "d": f"CASE WHEN s.n < 10 THEN 1 ELSE {d} END", "y": case("s.n < 9", "0", "s.n = 9", "e.m", f"{al} * e.c + (1 - {al}) * s.y")}, {"values": "CASE WHEN _s.n >= 10 THEN _s.y END"})]


def _dec_osc() -> Layers:
    def hp(x: str, period: float, out: str) -> Layers:
        c, b, d = _high2(period, 0.707)
        y = case("s.n < 2", "e.x", f"{c!r} * (e.x - 2 * s.x + s.x2) + {b!r} * s.y - {d!r} * s.y2")
        return machine({"x": x}, {"n": "1", "x2": "e.x", "y": "e.x", "y2": "e.x"}, {"n": "s.n + 1", "x2": "s.x", "y": y, "y2": "s.y"}, {out: "_s.y"})

    return [*hp("c", 125, "g"), {"k_": n_valid("c")}, {"r": "CASE WHEN k_ > 2 THEN c - g ELSE c END"}, *hp("r", 62.5, "q"), {"values": "CASE WHEN k_ > 2 AND c <> 0 THEN 100 * q / c END"}]


def _rvi() -> Layers:
    return [{"d": f"c - {lag('c')}", "s_": roll("stddev_pop", "c", 10)}, {"u": "CASE WHEN s_ IS NOT NULL THEN CASE WHEN d > 0 THEN s_ ELSE 0 END END", "w": "CASE WHEN s_ IS NOT NULL THEN CASE WHEN d < 0 THEN s_ ELSE 0 END END"},
            {"u": seeded("u", 14), "w": seeded("w", 14)}, {"values": "CASE WHEN u + w <> 0 THEN 100 * u / (u + w) END"}]


def _reverse_rsi() -> Layers:
    return [{"d": f"coalesce(c - {lag('c')}, 0)"}, {"u": "greatest(d, 0)", "w": "greatest(-d, 0)"}, {"u": seeded("u", 27), "w": seeded("w", 27)}, {"values": "c + 13 * (w - u)"}]


def _flex(p: int, deviation: str) -> Layers:
    a = exp(-1.414 * pi / (p / 2))
    b, a2 = 2 * a * cos(1.414 * pi / (p / 2)), a * a
    k = (1 + a2 - b) / 2
    smooth = machine({"x": "c"}, {"n": "1", "y": "e.x", "y2": "e.x"}, {"n": "s.n + 1", "y": case("s.n < 2", "e.x", f"{k!r} * (e.x + s.x) + {b!r} * s.y - {a2!r} * s.y2"), "y2": "s.y"}, {"f": "_s.y"})
    return [*smooth, {"d": deviation}, *machine({"d": "d"}, {"m": "0"}, {"m": "CASE WHEN e.d IS NULL THEN 0 ELSE 0.04 * e.d * e.d + 0.96 * s.m END"}, {"m": "_s.m"}), {"values": "CASE WHEN d IS NULL OR m <= 0 THEN 0 ELSE d / sqrt(m) END"}]


def _emd() -> Layers:
    b, g = cos(2 * pi / 20), 1 / cos(4 * pi * 0.5 / 20)
    a = g - sqrt(max(g * g - 1, 0.0))
    y = case("s.n < 2", "e.x", f"{0.5 * (1 - a)!r} * (e.x - s.x1) + {b * (1 + a)!r} * s.y - {a!r} * s.y1")
    turn = lambda op: f"(s.n >= 2 AND s.y {op} {y} AND s.y {op} s.y1)"
    m = machine({"x": MED}, {"n": "1", "x1": "e.x", "y": "e.x", "y1": "e.x", "pk": "e.x", "vl": "e.x"}, {"n": "s.n + 1", "x1": "s.x", "y": y, "y1": "s.y", "pk": case(turn(">"), "s.y", "s.pk"), "vl": case(turn("<"), "s.y", "s.vl")}, {"y": "_s.y", "pk": "0.1 * _s.pk", "vl": "0.1 * _s.vl"})
    return [*m, {"upper": roll("avg", "pk", 50), "middle": roll("avg", "y", 40), "lower": roll("avg", "vl", 50)}]


def _volatility_adjusted() -> Layers:
    return [{"q": f"CASE WHEN {n_valid('c')} >= 113 THEN {ema_mean('c', 113)} END"}, {"d": "c - q"}, {"y": f"q + ({roll('max', 'd', 51)} + {roll('min', 'd', 51)}) / 2"}, {"values": fir("y", linear(5))}]


def _otto() -> Layers:
    return [*var_average("c", 12.5, "a1"), *var_average("c", 25, "a2"), *var_average("c", 250, "a3"), {"lott": "a1 / (a2 - a3 + 100000)"}, *var_average("lott", 2, "m"), *ratchet("m", 0.6, "hott"), {"hott": "hott", "lott": "lott"}]


def _net_myrsi(p: int = 14) -> Layers:
    pairs = f"list_sum(list_transform(range(1, {p}), lambda i: list_sum(list_transform(range(0, i), lambda j: sign(q[i + 1] - q[j + 1])))))"
    return [{"d": f"c - {lag('c')}"}, {"u": f"CASE WHEN count(d) {over(p)} = {p} THEN sum(greatest(d, 0)) {over(p)} END", "w": f"CASE WHEN count(d) {over(p)} = {p} THEN sum(greatest(-d, 0)) {over(p)} END"},
            {"m": "CASE WHEN u + w = 0 THEN 0 ELSE (u - w) / (u + w) END"}, {"q": f"CASE WHEN count(m) {over(p)} = {p} THEN list(m) {over(p)} END"}, {"values": f"CASE WHEN {n_valid('c')} = {p + 1} THEN 0 WHEN q IS NOT NULL THEN {pairs} / {p * (p - 1) / 2} END"}]


def _macz() -> Layers:
    return [{"xv": "c * v"}, {"w": f"{roll('sum', 'xv', 20)} / {roll('sum', 'v', 20)}", "m1": roll("avg", "c", 20), "m2": roll("avg", "(c * c)", 20)}, {"sd": "sqrt(greatest(0, m2 - 2 * w * m1 + w * w))"},
            {"macz": f"CASE WHEN {roll('stddev_pop', 'c', 25)} > 0 THEN (CASE WHEN sd > 0 THEN (c - w) / sd ELSE 0 END) + ({roll('avg', 'c', 12)} - {roll('avg', 'c', 25)}) / {roll('stddev_pop', 'c', 25)} END"}, {"macz": "macz", "histogram": f"macz - {roll('avg', 'macz', 9)}"}]


MACHINES: dict[str, Layers] = {
    "kvo": _kvo(),
    "sar": _sar(),
    "chandelier_exit": _chandelier(),
    "ott": [*var_average("c", 2, "m"), *ratchet("m", 1.4, "values")],
    "otto": _otto(),
    "lrsi": _lrsi(),
    "jma": _jma(),
    "gaussian": _gaussian(),
    "supersmoother_3_pole": _smooth3(),
    "laguerre": _laguerre(),
    "qqe": _qqe(),
    "vidya": _vidya(),
    "nama": _nama(),
    "sama": _sama(),
    "ehlers_kama": _ehlers_kama(),
    "tradjema": _tradjema(),
    "alphatrend": _alphatrend(),
    "damiani_volatmeter": _damiani(),
    "bandpass": _bandpass(),
    "frama": _frama(),
    "dec_osc": _dec_osc(),
    "rvi": _rvi(),
    "reverse_rsi": _reverse_rsi(),
    "reflex": _flex(20, "(" + " + ".join(f"(f + {k} * ({lag('f', 20)} - f) / 20 - {lag('f', k)})" for k in range(1, 21)) + ") / 20"),
    "trendflex": _flex(20, "(" + " + ".join(f"(f - {lag('f', k)})" for k in range(1, 21)) + ") / 20"),
    "emd": _emd(),
    "volatility_adjusted_ma": _volatility_adjusted(),
    "net_myrsi": _net_myrsi(),
    "macz": _macz(),
}
