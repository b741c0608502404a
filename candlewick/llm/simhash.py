"""Near-duplicates by SimHash with a generalised pigeonhole search (operator 10).

Fingerprints of 64 bits; two texts are linked when at most `radius` bits differ. Bits that
go together are grouped into partitions, each partition gets its own threshold by dynamic
programming on the candidates that counts over all fingerprints foretell, and fingerprints
that agree on a partition up to its threshold are compared bit by bit.

Defined results: null and empty texts have fingerprint zero and are linked like any other;
texts of fewer words than a shingle count as one shingle; repeated rows each get a row;
rows with a null id get their group's component (null if no row of it has an id); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, give_back, partitions, written
from .components import components

BITS = 64
#: What a probe costs next to comparing one candidate: it is moved and sorted.
PROBE_COST = 60.0
#: Largest bucket that one task holds at a time; larger ones are split by further bits.
BUCKET = 32_768
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash over XXH64 of the text's word shingles; A-Z are lower-cased first."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    view, h64, counts = memoryview(line), xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([h64(view[a:b], seed) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, key: Column | None = None) -> DataFrame:
    """(doc_id long, fp long) for every row of docs, and `key`, a string, where one is given."""
    keys = [] if key is None else [key.alias("key")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]], ["doc_id", "fp", "key"][: batch.num_columns])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keys)
    return rows.mapInArrow(run, "doc_id long, fp long" + ", key string" * len(keys))


def _bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and in how many of them each two bits are both set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            f = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            bits = np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(f)
        if n:
            values = np.concatenate((both.ravel(), [n])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["k", "v"])

    rows = nodes.select("fp").mapInArrow(run, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(BITS * BITS + 1)
    for k, v in rows:
        out[k] = v
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """64 bits in `parts` groups of like size; a bit joins the group it is most correlated with."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        first = max(left, key=lambda b: (corr[b, list(left)].sum(), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            nxt = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            left.remove(nxt)
        groups.append(sorted(group))
    return groups


def _apart(p: np.ndarray, upto: int) -> list[float]:
    """Chance that two fingerprints differ in exactly 0..upto of the bits, each set with chance p."""
    out = [1.0] + [0.0] * upto
    for q in 2 * p * (1 - p):
        out = [out[d] * (1 - q) + (out[d - 1] * q if d else 0) for d in range(upto + 1)]
    return out


def plan(n: int, both: np.ndarray, radius: int = 4) -> list[tuple[int, int]]:
    """Masks to probe with, as (mask, kept bits' number): every two fingerprints that differ
    in at most `radius` bits agree under one of them.

    For 2 to radius + 1 groups of bits, thresholds t >= -1 with sum(t + 1) = radius + 1 are
    dealt out by dynamic programming so that foretold probes and candidates are cheapest (by
    the generalised pigeonhole principle one group has at most t differing bits); -1 leaves a
    group out. A group with threshold t is probed once for each way to leave out t bits.
    """
    p, best = np.diag(both) / max(n, 1), None
    for parts in range(2, radius + 2):
        groups = grouped_bits(n, both, parts)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            apart, costs = _apart(p[g], radius), {-1: 0.0}
            for t in range(min(radius, len(g) - 1) + 1):
                ways = comb(len(g), t)
                if ways > 600:
                    break
                pairs = n * n / 2 * sum(apart[d] * comb(len(g) - d, t - d) for d in range(t + 1))
                costs[t] = PROBE_COST * n * ways + pairs
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, ts) in table.items():
                for t, more in costs.items():
                    if (u := used + t + 1) <= radius + 1 and (u not in step or cost + more < step[u][0]):
                        step[u] = (cost + more, [*ts, t])
            table = step
        if radius + 1 in table and (best is None or table[radius + 1][0] < best[0]):
            best = (table[radius + 1][0], groups, table[radius + 1][1])
    _, groups, thresholds = best
    out = []
    for g, t in zip(groups, thresholds):
        if t >= 0:
            out += [sum(1 << b for b in g if b not in gone) for gone in combinations(g, t)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(f: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join what is within radius of one another: one for each fingerprint reached."""
    a, b, left = [], [], f
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                hit = left[near]
                a.append(np.full(len(hit), x))
                b.append(hit)
                queue.extend(hit)
                left = left[~near]
    return a, b


def _linker(radius: int):
    """Sorted (mask, key, fp) rows -> links, and the rows of buckets too large for one task."""

    def links(f: np.ndarray, cuts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a, b = [], []
        sizes = np.diff(cuts)
        for size in np.unique(sizes[sizes > 1]).tolist():
            starts = cuts[:-1][sizes == size]
            if size > 64:
                hot = starts
            else:
                m, flag = f[starts[:, None] + np.arange(size)], np.zeros(len(starts), bool)
                for i in range(size - 1):
                    flag |= (np.bitwise_count(m[:, i : i + 1] ^ m[:, i + 1 :]) <= radius).any(1)
                hot = starts[flag]
                if size == 2:
                    a.append(f[hot]), b.append(f[hot + 1])
                    continue
            for s in hot.tolist():
                x, y = _forest(f[s : s + size], radius)
                a += x
                b += y
        return a, b

    def out(kind: int, *cols: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int32)), *(pa.array(c.view(np.int64)) for c in cols)], ["kind", "a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64)] * 3
        large = None
        for batch in batches:
            rows = [np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64))) for i, h in enumerate(held)]
            mask, key, f = rows
            if not len(f):
                continue
            cuts = np.concatenate(([0], np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1, [len(f)]))
            if large is not None and len(cuts) >= 2:  # goes on with the bucket that was too large
                if (int(mask[0]), int(key[0])) == large:
                    yield out(1, *(c[: cuts[1]] for c in rows))
                    if len(cuts) == 2:
                        held = [c[:0] for c in rows]
                        continue
                    cuts = cuts[1:]
                large = None
            last = cuts[-2]
            if len(f) - last > BUCKET:
                yield out(1, *(c[last:] for c in rows))
                large, held = (int(mask[-1]), int(key[-1])), [c[:0] for c in rows]
            else:
                held = [c[last:] for c in rows]
            done = cuts[:-1]
            big = np.flatnonzero(np.diff(done) > BUCKET)
            for k in big.tolist():
                yield out(1, *(c[done[k] : done[k + 1]] for c in rows))
            if len(big):
                keep = [slice(done[k], done[k + 1]) for k in range(len(done) - 1) if k not in set(big.tolist())]
                f = np.concatenate([f[s] for s in keep]) if keep else f[:0]
                done = np.concatenate(([0], np.cumsum([s.stop - s.start for s in keep]))).astype(int)
            a, b = links(f, done)
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield out(0, a, b, b)
        if len(held[2]) > 1:
            a, b = links(held[2], np.array([0, len(held[2])]))
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield out(0, a, b, b)

    return run


def _probed(rows: DataFrame, radius: int) -> DataFrame:
    n = partitions(rows.sparkSession)
    return rows.repartition(n, "mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_linker(radius), "kind int, a long, b long, c long")


def _refine(hot: DataFrame, radius: int) -> DataFrame:
    """Rows of large buckets under longer masks: of the bits that a mask leaves open, split
    into radius + 1 shares, two near fingerprints agree on all of one share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares: dict[int, list[int]] = {}
        for batch in batches:
            mask, f = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            for m in np.unique(mask).tolist():
                if m not in shares:
                    free = [b for b in range(BITS) if not m >> b & 1]
                    shares[m] = [m | sum(1 << b for b in free[k :: radius + 1]) for k in range(min(radius + 1, len(free)))]
                own = f[mask == m]
                for x in shares[m]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), x, np.uint64).view(np.int64)), pa.array((own & np.uint64(x)).view(np.int64)), pa.array(own.view(np.int64))], ["mask", "key", "fp"])

    return hot.select(F.col("a").alias("mask"), F.col("c").alias("fp")).mapInArrow(run, "mask long, key long, fp long")


def links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(fp) distinct fingerprints -> (a, b) links that join every two within radius, not all
    pairs: inside a bucket each fingerprint is linked once to what reached it."""
    spark = nodes.sparkSession
    n, both = _bit_statistics(nodes)
    masks = [_signed(m) for m in plan(n, both, radius)]
    probes = nodes.select("fp", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    found, _ = written(_probed(probes, radius), "probes")
    out = found.where("kind = 0").select("a", "b")
    while not found.where("kind = 1").isEmpty():
        found, _ = written(_probed(_refine(found.where("kind = 1"), radius), radius), "probes")
        out = out.unionByName(found.where("kind = 0").select("a", "b"))
    return out


def _placed(nodes: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints with the root of their component."""
    roots = components(links(nodes, radius)).withColumnsRenamed({"node": "fp"})
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest id reachable over links."""
    spark = docs.sparkSession
    fps, _ = written(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    nodes, nodes_path = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    placed = _placed(nodes, radius)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of, _ = written(placed.select("fp", "root").join(named, "root").select("fp", "component_id"), "components")
    drop(spark, nodes_path)
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def _id_and_text(id_col: str, text_col: str) -> Column:
    """What rows of one id and one text have in common, and no others."""
    text = F.md5(F.col(text_col).cast("string").cast("binary"))
    return F.concat_ws(":", *(F.coalesce(c, F.lit("null")) for c in (F.col(id_col).cast("long").cast("string"), text)))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """One row of docs for each component: the one with the smallest id; of several texts
    with this id, or where no row of the component has an id, the one with the smallest MD5,
    a null text last. Rows with this id and text are alike: any one of them stays."""
    spark, key = docs.sparkSession, _id_and_text(id_col, text_col)
    fps, fps_path = written(fingerprints(docs, id_col, text_col, width, seed, key), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    nodes, nodes_path = written(fps.groupBy("fp").agg(first), "nodes")
    kept, _ = written(_placed(nodes, radius).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("_kept")), "kept")
    drop(spark, fps_path, nodes_path)
    return docs.withColumn("_kept", key).join(kept, "_kept", "left_semi").dropDuplicates(["_kept"]).select(*docs.columns)
