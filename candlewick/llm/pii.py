"""Personal data, also where it is disguised (operator 8).

Base spans come from the four plain patterns. A chain of transducers then rewrites the text
(look-alike letters, spelled digits, at/dot disguises); each keeps, for every character it
writes, the source characters it stands for. Identifiers found in the rewritten text are
mapped back, and those that needed a rewrite are added to the base spans.

Defined results: a null text counts as empty and has no spans; spans are in code points, end
exclusive; repeated rows each get a row; an empty table gives no rows; other columns are
ignored. Texts are handled whole; every pattern runs in time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int]
KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile(r"[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n", "ս": "u",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-", "。": ".", "﹒": ".",
}
#: Characters that show nothing; they are left out.
UNSEEN = frozenset("­​‌‍⁠﻿")
# The digits in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_POINT = r"(?:dot|point|punkt|punto)"
#: Runs of spelled digits, digits among them, and "dot" between them; four parts at least.
SPELLED = re.compile(rf"(?<![^\W_])(?:{_WORD}|[0-9]+)(?:[ \t,-]{{1,3}}(?:{_WORD}|{_POINT}|[0-9]+)){{3,}}(?![^\W_])", re.IGNORECASE)
PART = re.compile(r"[^\W_]+")
PLUS = re.compile(r"(?<![^\W_])plus[ \t]{1,3}(?=[0-9])", re.IGNORECASE)
AT = re.compile(r"[ \t]{0,3}(?:[\(\[\{<][ \t]{0,2}(?:at|@|arroba)[ \t]{0,2}[\)\]\}>]|(?<=[ \t])(?:at|arroba)(?=[ \t]))[ \t]{0,3}", re.IGNORECASE)
DOT = re.compile(r"[ \t]{0,3}(?:[\(\[\{<][ \t]{0,2}(?:dot|punkt|punto|point|\.)[ \t]{0,2}[\)\]\}>]|(?<=[ \t])(?:dot|punkt|punto)(?=[ \t]))[ \t]{0,3}", re.IGNORECASE)
#: What a text must hold, lower-cased, before the slower patterns are tried.
HINT = re.compile(r"[^\w](?:dot|punkt|punto)[^\w]|[\(\[\{<][ \t]{0,2}(?:at|arroba|point|[.@])[ \t]{0,2}[\)\]\}>]")
PAIR = re.compile(rf"{_WORD}[ \t,-]{{1,3}}(?:{_WORD}|{_POINT}|[0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches of the address pattern, found from each @ outwards."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def detect(text: str) -> dict[str, list[Span]]:
    """The base spans of each kind."""
    out: dict[str, list[Span]] = {"email": emails(text), "ip": [], "card": [], "phone": []}
    if DIGIT.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


class Tape:
    """A text with, for each of its characters, the span of source characters it stands for,
    and whether a rewrite made it."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.made = text, None, None, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, replacement) of this text, ascending and apart."""
        if not edits:
            return
        if self.start is None:
            n = len(self.text)
            self.start, self.end, self.made = list(range(n)), list(range(1, n + 1)), [False] * n
        text, start, end, made, at = [], [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            made += self.made[at:a]
            text.append(new)
            start += [self.start[a]] * len(new)
            end += [self.end[b - 1]] * len(new)
            made += [True] * len(new)
            if not new and made:
                made[-1] = True
            at = b
        self.text = "".join(text) + self.text[at:]
        self.start, self.end, self.made = start + self.start[at:], end + self.end[at:], made + self.made[at:]

    def source(self, span: Span) -> Span:
        return self.start[span[0]], self.end[span[1] - 1]


def _alike(c: str) -> str | None:
    if c in UNSEEN:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    flat = unicodedata.normalize("NFKC", c)
    return flat if len(flat) == 1 and "!" <= flat <= "~" else None


def lookalikes(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    to = {c: a for c in set(text) if not c.isascii() and (a := _alike(c)) is not None}
    if not to:
        return []
    return [(m.start(), m.end(), to[m[0]]) for m in re.finditer("[" + re.escape("".join(to)) + "]", text)]


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    if not PAIR.search(text.lower()):
        return out
    for m in SPELLED.finditer(text):
        parts, was = [p.span() for p in PART.finditer(text, *m.span())], None
        if sum(text[a:b].lower() in DIGIT_WORDS for a, b in parts) < 4:
            continue
        for a, b in parts:
            low = text[a:b].lower()
            new = DIGIT_WORDS.get(low, text[a:b] if low.isdigit() else ".")
            if was is not None:
                out.append((was, a, ""))
            if new != text[a:b]:
                out.append((a, b, new))
            was = b
    return out


def plus_signs(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "+") for m in PLUS.finditer(text)]


def _disguises(text: str) -> list[tuple[int, int, str]]:
    """at/dot disguises of addresses: a name, "at", and labels, with "dot" between the parts of
    name and domain, of which one at least is in disguise; and "dot" between numbers."""
    if not HINT.search(text.lower()):
        return []
    dots = {m.start(): m for m in DOT.finditer(text)}
    ends = {m.end(): m for m in dots.values()}
    out: list[tuple[int, int, str]] = []
    marks = sorted([(m.start(), m.end()) for m in AT.finditer(text)] + [(i, i + 1) for i, c in enumerate(text) if c == "@"])
    label = re.compile(r"[A-Za-z0-9-]+")

    def domain(a: int, b: int, plain: bool = False) -> tuple[list[tuple[int, int, str]], int] | None:
        """Edits of "at" and the domain after it, and its end; plain: up to its first "dot"."""
        edits, at, labels, spoken = ([] if text[a:b] == "@" else [(a, b, "@")]), b, 0, False
        while m := label.match(text, at):
            labels += 1
            at = m.end()
            if text.startswith(".", at) and label.match(text, at + 1):
                at += 1
            elif not plain and at in dots and label.match(text, dots[at].end()):
                edits.append((at, dots[at].end(), "."))
                spoken, at = True, dots[at].end()
            else:
                break
        bare = bool(edits) and edits[0][2] == "@" and text[a:b].strip().isalpha()
        return None if labels < 2 or (bare and not spoken) else (edits, at)

    heads = {a: b for a, b in marks if a and text[a - 1] in LOCAL}
    found: dict[int, tuple[list[tuple[int, int, str]], int] | None] = {}
    floor = passed = 0
    for a, b in heads.items():
        if a < passed:
            continue
        if (d := found.pop(a) if a in found else domain(a, b)) is None:
            continue
        edits, at = d
        passed = at
        if at in heads and (nxt := domain(at, heads[at])):  # what follows is the name of the next address
            found[at] = nxt
            if (d := domain(a, b, plain=True)) is None:
                floor = b
                continue
            edits, at = d
        name = a  # names may hold disguised dots too
        while True:
            while name > floor and text[name - 1] in LOCAL:
                name -= 1
            before = ends.get(name)
            if before is None or before.start() <= floor or text[before.start() - 1] not in LOCAL:
                break
            edits.insert(0, (before.start(), before.end(), "."))
            name = before.start()
        out += edits
        floor = at
    starts, stops = (sorted(x[k] for x in out) for k in (0, 1))  # edits do not overlap
    for m in dots.values():
        a, b = m.span()
        if a and b < len(text) and text[a - 1].isdigit() and text[b].isdigit() and bisect_left(starts, b) == bisect_right(stops, a):
            out.append((a, b, "."))
    return sorted(out)


def disguised(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the rewritten text shows and that no base span of their kind holds."""
    tape = Tape(text)
    for transducer in (lookalikes, spelled_digits, plus_signs, _disguises):
        tape.rewrite(transducer(tape.text))
    if tape.start is None:
        return {}
    out: dict[str, list[Span]] = {}
    for kind, spans in detect(tape.text).items():
        for a, b in spans:
            if not any(tape.made[a:b]) or kind == "email" and not re.search(r"\.[A-Za-z]{2,}$", tape.text[a:b]):
                continue
            x, y = tape.source((a, b))
            # base spans do not overlap: only the last that starts by x can hold the span
            i = bisect_right(base[kind], x, key=lambda s: s[0])
            if not i or base[kind][i - 1][1] < y:
                out.setdefault(kind, []).append((x, y))
    return out


def spans(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and all spans of a text, by kind, in order."""
    text = text or ""
    base = detect(text)
    more = disguised(text, base)
    return base, {k: sorted(base[k] + more.get(k, [])) for k in KINDS}


def joined(found: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in found[k])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: how many base spans of each kind, a digest of them, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [spans(t.as_py()) for t in batch.column(1)]
            cols = [pa.array([len(b[k]) for b, _ in rows], pa.int64()) for k in KINDS]
            cols.append(pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in rows], pa.string()))
            cols.append(pa.array([joined(a) for _, a in rows], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
