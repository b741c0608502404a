"""Quality rules with risk-controlled thresholds (operator 5).

Every document gets counts over its whole text, and from them a few rule scores (higher is
worse). The cutoffs of all rules go through one fixed sequence: the rules in their order, each
from its most lenient cutoff down to 0, what is reached staying in force. In each stratum a
step is certified while the exact binomial test rejects "more than `false_rejection` of the
good documents are turned away by the rules together"; the sequence ends at the first step
that is not. A fixed sequence needs no correction within a stratum; the error `delta` is
shared out over the strata (Bonferroni). As all certified steps hold at once, any may be
taken: the first with the largest difference between the shares of bad and of good labelled
documents turned away. A stratum needs log(delta / strata) / log(1 - false_rejection) good
labels (217 of four strata by default) to certify anything; with fewer, or without bad
labels, it turns nothing away.

Defined results: null and empty texts have no words and fail the base rules; a null stratum
is a stratum of its own; null labels are ignored and a document labelled more than once is
good only if all its labels are; repeated rows each get a row; an empty table gives no rows;
without labels only the base rules hold; extra columns are passed through or ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, give_back, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = re.compile(r"[#*$%&|<>]")
ASCII_SPACE = " \t\n\r\x0b\x0c"
WINDOW = 5

#: Rule -> largest score told apart; scores are cut into BINS equal steps below it.
RULES = {"symbols": 0.5, "dup_lines": 1.0, "repeats": 0.2, "long_words": 32.0}
BINS = 200
STEPS = BINS * len(RULES)
FALSE_REJECTION = 0.02
DELTA = 0.05
#: Up to so many strata the cutoffs are sent to every executor; beyond, they are joined.
SMALL = 20_000


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that the text has twice or more. Windows are numbered
    exactly (pairs of numbered parts), not hashed."""
    if len(words) <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
        values, inverse = np.unique(a * (len(words) + 1) + b, return_inverse=True)
        return inverse if len(values) < len(a) else None

    two = paired(x[:-1], x[1:])
    four = paired(two[:-2], two[2:]) if two is not None else None
    five = paired(four[:-1], x[4:]) if four is not None else None
    if five is None:
        return 0
    again = np.flatnonzero(np.bincount(five)[five] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    blank = sum(map(text.count, ASCII_SPACE))
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    return len(words), len(text) - blank, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def _with_counts(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with a struct of counts in a new column."""
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts(t.as_py()) for t in batch.column(at)], np.int64).reshape(-1, len(COUNTS))
            made = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(COUNTS))], names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*(f"c{i}" for i in range(batch.num_columns)), name])
        give_back()

    return docs.mapInArrow(run, schema)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def _scores(c: dict[str, Column]) -> dict[str, Column]:
    one = F.lit(1)
    return {
        "symbols": c["n_symbols"] / F.greatest(c["word_chars"], one),
        "dup_lines": c["n_dup_lines"] / F.greatest(c["n_lines"], one),
        "repeats": c["n_repeat_words"] / F.greatest(c["n_words"], one),
        "long_words": c["word_chars"] / F.greatest(c["n_words"], one),
    }


def _turn(c: dict[str, Column]) -> Column:
    """The number of the first step of the sequence that turns a document away: the rules in
    their order, each from its highest cutoff down to 0, what is reached staying in force.
    `STEPS` if none does."""
    bins = {k: F.least(F.ceil(v / RULES[k] * BINS), F.lit(BINS)).cast("int") for k, v in _scores(c).items()}
    return F.least(F.lit(STEPS), *(F.when(x > 0, (r + 1) * BINS - x) for r, x in enumerate(bins[k] for k in RULES)))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial in n and p, exactly, summed in logarithms."""
    if k >= n:
        return 1.0
    base = lgamma(n + 1)
    return min(1.0, sum(exp(base - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1)))


def certified(rejected: np.ndarray, n: int, epsilon: float, level: float) -> int:
    """How many steps of the fixed sequence are certified before the first that is not.
    rejected[i]: how many of n good documents step i and those before it turn away."""
    for i, k in enumerate(rejected):
        if k > epsilon * n or binomial_tail(int(k), n, epsilon) > level:
            return i
    return len(rejected)


def chosen(good: np.ndarray, bad: np.ndarray, epsilon: float, level: float) -> int:
    """The number of steps to take, of good and bad documents by the step that first turns
    them away (the last number: none does)."""
    n, out = int(good.sum()), np.concatenate(([0], np.cumsum(good)))[:-1]
    most = certified(out[1:], n, epsilon, level)
    gain = np.concatenate(([0], np.cumsum(bad)))[:-1] / max(1, int(bad.sum())) - out / max(1, n)
    return int(np.argmax(gain[: most + 1]))


def cutoffs(features: DataFrame, labels: DataFrame, false_rejection: float = FALSE_REJECTION, delta: float = DELTA) -> tuple[DataFrame, str, int]:
    """(stratum, steps taken) over every stratum with labelled documents.
    features: doc_id, stratum and COUNTS."""
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    c = {k: F.col(k) for k in COUNTS}
    held = features.where(~base_failed(c["n_words"], c["n_repeat_words"])).join(known, "doc_id")
    counted = held.groupBy("stratum", _turn(c).alias("turn")).agg(F.count(F.when(F.col("q") == 1, 1)).alias("good"), F.count(F.when(F.col("q") != 1, 1)).alias("bad"))
    counted, path = written(counted, "turns")
    strata = counted.select("stratum").distinct().count()
    level = delta / max(strata, 1)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros(STEPS + 1, np.int64), np.zeros(STEPS + 1, np.int64)
        for at, k in ((good, "good"), (bad, "bad")):
            np.add.at(at, pdf["turn"].to_numpy(), pdf[k].to_numpy())
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "steps": [chosen(good, bad, false_rejection, level)]})

    out, out_path = written(counted.groupBy("stratum").applyInPandas(fit, "stratum string, steps int"), "cutoffs")
    drop(labels.sparkSession, path)
    return out, out_path, strata


def _stratum(col: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("null"))


def _verdict(df: DataFrame, c: dict[str, Column], stratum: Column, cuts: DataFrame, strata: int) -> tuple[DataFrame, Column, Column]:
    """df with the cutoffs of its stratum, whether the base rules fail, whether it is kept."""
    cuts = F.broadcast(cuts) if strata <= SMALL else cuts
    out = df.join(cuts, stratum == cuts["stratum"], "left")
    failed = base_failed(c["n_words"], c["n_repeat_words"])
    kept = ~failed & (_turn(c) >= F.coalesce(cuts["steps"], F.lit(0)))
    return out, failed, kept


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **risk) -> DataFrame:
    """(doc_id, stratum, counts, base_failed, kept) for every row of docs."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), _stratum(F.col(stratum_col)).alias("stratum"))
    feats, _ = written(_with_counts(own, "text", "counts").select("doc_id", "stratum", "counts.*"), "counts")
    cuts, _, strata = cutoffs(feats, labels, **risk)
    out, failed, kept = _verdict(feats, {k: feats[k] for k in COUNTS}, feats["stratum"], cuts, strata)
    return out.select(feats["doc_id"], feats["stratum"], *(feats[k] for k in COUNTS), failed.alias("base_failed"), kept.alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **risk) -> DataFrame:
    """The rows of docs that pass, with their columns. Counts are taken again while the texts
    are read for the result, so that no text is moved between executors."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), _stratum(F.col(stratum_col)).alias("stratum"))
    feats, path = written(_with_counts(own, "text", "counts").select("doc_id", "stratum", "counts.*"), "counts")
    cuts, _, strata = cutoffs(feats, labels, **risk)
    drop(docs.sparkSession, path)
    name = f"_counts_{uuid.uuid4().hex}"
    seen = _with_counts(docs, text_col, name)
    out, _, kept = _verdict(seen, {k: seen[name][k] for k in COUNTS}, _stratum(seen[stratum_col]), cuts, strata)
    return out.where(kept).select(*(seen[c] for c in docs.columns))
