"""Quality classifier: a factorisation machine (operator 6).

A text becomes a sparse vector: hashed words (square roots of counts, scaled to length 1),
structure statistics cut into bins, and bins of metadata columns. The machine scores it as
w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2): all pairwise interactions
in time linear in the number of features. It is trained by AdaGrad on the driver, on at most
`sample` labelled texts (those with the least hashes of their ids, so any size of corpus
gives a sample of the same make), whose features, not texts, are gathered.

Defined results: null and empty texts have no words and are scored by their structure; a
null metadata value is a bin of its own; labels that are null are ignored, several labels of
one document count as their least; without labels of both kinds every score is the share of
label 1 in the sample (0.5 without labels); repeated rows each get a row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written

ASCII_SPACE = " \t\n\r\x0b\x0c"
SIGNS = re.compile(r"[^\w\s]")
DIGITS = re.compile(r"[0-9]")
UPPER = re.compile(r"[A-Z]")


@dataclass(frozen=True)
class Machine:
    """Sizes and training of the machine; `sample` bounds what it is trained on."""

    buckets: int = 1 << 14
    rank: int = 8
    sample: int = 8192
    epochs: int = 6
    rate: float = 0.1
    decay: float = 1e-5
    seed: int = 11
    metadata: tuple[str, ...] = ("n_chars",)


#: Bins of each statistic.
BINS = 16
STATS = ("words", "word_length", "signs", "digits", "upper", "repeated_lines", "distinct_words", "line_length", "top_word", "adjacent")


def statistics(text: str, words: list[bytes], counts: Counter) -> list[int]:
    """The bin of each of STATS."""
    n, chars = len(words), max(1, sum(map(len, words)))
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    share = lambda k, of, scale=1.0: min(BINS - 1, math.ceil(BINS * scale * k / max(1, of)))
    log2 = lambda x: min(BINS - 1, int(math.log2(1 + x)))
    return [
        log2(n),
        min(BINS - 1, int(chars / max(1, n))),
        share(len(SIGNS.findall(text)), chars, 4),
        share(len(DIGITS.findall(text)), chars, 4),
        share(len(UPPER.findall(text)), chars, 4),
        share(len(lines) - len(set(lines)), len(lines)),
        share(len(counts), n),
        log2(n / max(1, len(lines))),
        share(max(counts.values(), default=0), n, 2),
        share(sum(a == b for a, b in zip(words, words[1:])), n, 2),
    ]


class Features:
    """Text and metadata -> (indices, values). Hashes of words are kept by each worker."""

    def __init__(self, machine: Machine):
        self.machine, self.hashes = machine, {}
        self.size = machine.buckets + len(STATS) * BINS + len(machine.metadata) * (BINS * 4 + 2)

    def __call__(self, text: str | None, metadata: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
        text, m = text or "", self.machine
        words = text.encode("utf-8", "surrogatepass").split()
        counts = Counter(words)
        found = np.fromiter((self.bucket(w) for w in counts), np.int64, len(counts))
        times = np.fromiter(counts.values(), np.float64, len(counts))
        at, where = np.unique(found, return_inverse=True)
        values = np.sqrt(np.bincount(where, times, len(at))) if len(at) else np.zeros(0)
        values /= np.linalg.norm(values) if len(at) else 1.0
        extra = [m.buckets + k * BINS + b for k, b in enumerate(statistics(text, words, counts))]
        base = m.buckets + len(STATS) * BINS
        for k, v in enumerate(metadata):
            extra.append(base + k * (BINS * 4 + 2) + self.metadata_bin(v))
        scale = 1 / math.sqrt(len(STATS) + len(m.metadata))
        return np.concatenate((at, extra)).astype(np.int64), np.concatenate((values, np.full(len(extra), 2 * scale)))

    def bucket(self, word: bytes) -> int:
        b = self.hashes.get(word)
        if b is None:
            b = zlib.crc32(word) % self.machine.buckets
            if len(self.hashes) < 300_000:
                self.hashes[word] = b
        return b

    @staticmethod
    def metadata_bin(v) -> int:
        """Numbers by size (quarter powers of two), anything else by hash, null apart."""
        if v is None or isinstance(v, float) and not math.isfinite(v):
            return 0
        if isinstance(v, (int, float)):
            return 1 + min(BINS * 4 - 1, int(4 * math.log2(1 + abs(v)) / 2))
        return 1 + zlib.crc32(str(v).encode()) % (BINS * 4)


@dataclass
class Fitted:
    w0: float
    w: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        """Chance of label 1, in time linear in the features (sum-of-squares identity)."""
        z = self.w0
        if len(self.w):
            p = self.v[at] * x[:, None]
            s = p.sum(0)
            z += float(self.w[at] @ x) + 0.5 * float(s @ s - (p * p).sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, machine: Machine) -> Fitted:
    """AdaGrad on the logistic loss, one text at a time, in a seeded order each epoch."""
    ones = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or not 0 < ones < 1:
        return Fitted(math.log(max(ones, 1e-6) / max(1 - ones, 1e-6)) if len(labels) else 0.0)
    rng = np.random.default_rng(machine.seed)
    w, v = np.zeros(size), rng.normal(0, 0.05, (size, machine.rank))
    w0, g0 = math.log(ones / (1 - ones)), 1e-6
    gw, gv = np.full(size, 1e-6), np.full((size, machine.rank), 1e-6)
    for _ in range(machine.epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            va = v[at]
            p = va * x[:, None]
            s = p.sum(0)
            z = w0 + w[at] @ x + 0.5 * (s @ s - (p * p).sum())
            e = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - labels[i]
            g0 += e * e
            w0 -= machine.rate * e / math.sqrt(g0)
            d = e * x + machine.decay * w[at]
            gw[at] += d * d
            w[at] -= machine.rate * d / np.sqrt(gw[at])
            d = e * (x[:, None] * s - va * (x * x)[:, None]) + machine.decay * va
            gv[at] += d * d
            v[at] = va - machine.rate * d / np.sqrt(gv[at])
    return Fitted(w0, w.astype(np.float32), v.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, machine: Machine = Machine(), id_col: str = "doc_id", text_col: str = "text") -> Fitted:
    """labels: (doc_id, label 0 or 1). Of them, the `sample` with the least hashes are used."""
    spark = docs.sparkSession
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen, path = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(machine.sample), "labelled")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"m{k}") for k, c in enumerate(machine.metadata)))
    # one row a doc_id, that of the least hash of its text: at most `sample` rows, however often an id is repeated
    names = [c for c in texts.columns if c != "doc_id"]
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), *names, "label")).alias("x"))
    picked = one.select("doc_id", *(f"x.{c}" for c in names), "x.label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(machine)
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            found = [make(t, m) for t, m in zip(cols[1], zip(*cols[2:-1]) if machine.metadata else ((),) * len(cols[1]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[-1], pa.int32()), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))], ["doc_id", "label", "at", "x"])

    got = picked.mapInArrow(run, "doc_id long, label int, at array<int>, x array<float>").toArrow().sort_by("doc_id").slice(0, machine.sample)
    drop(spark, path)
    rows = [(np.asarray(a.values, np.int64), np.asarray(x.values, np.float64)) for a, x in zip(got.column("at"), got.column("x"))]
    return fit(rows, got.column("label").to_numpy().astype(float), Features(machine).size, machine)


def score(docs: DataFrame, fitted: Fitted, machine: Machine = Machine(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row. The machine (about 0.6 MB by default, whatever the
    corpus) is sent to every executor once."""
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, f = Features(machine), model.value
        for batch in batches:
            meta = [batch.column(2 + k).to_pylist() for k in range(len(machine.metadata))]
            scores = [f.score(*make(t.as_py(), tuple(m[i] for m in meta))) for i, t in enumerate(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"m{k}") for k, c in enumerate(machine.metadata))]
    return docs.select(*cols).mapInArrow(run, "doc_id long, score double")
