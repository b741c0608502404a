"""Nearest neighbours by stable projections, a kd-tree and a chi-square stop (operator 7).

Nearness is the inner product. Vectors get one more coordinate that brings all to the
largest norm M, queries are scaled to norm M; the largest inner product is then the least
Euclidean distance. Both are projected by a seeded Gaussian matrix to a few dimensions,
where squared projected over squared true distance is chi-square distributed. A kd-tree
over the projections (fitted on at most `sample` vectors, then filled with every vector)
cuts them into cells. A query takes up cells in order of their projected distance, in
growing batches; every vector of a cell is verified by its true inner product. A query is
done when the next cell is so far that a vector better than its k-th best would lie there
with chance 1 - `certainty` at most.

Equal vectors are one candidate that holds its k + 1 smallest ids: more can never be among
k neighbours, as ties go to smaller ids. That makes a vector shared by many rows as cheap
as any other.

Defined results: null and zero vectors, and vectors with null or non-finite components, take
no part, nor do rows with a null id; vectors are compared with vectors of their own length;
rows that repeat an id and vector count once, and rows with the query's own id are never its
neighbours; with fewer candidates than k all are returned; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, written

#: Vector lengths whose results are in one plan; with more, they are written group by group.
WIDTHS = 100


@dataclass(frozen=True)
class Index:
    k: int = 20
    dims: int = 8
    cell: int = 1024
    depth: int = 14
    sample: int = 16_384
    certainty: float = 0.97
    first: int = 2
    block: int = 50_000
    seed: int = 5


def chi_square(x: float, dims: int) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    term = total = math.exp(-x / 2)
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1 - total


def quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < p else (low, mid)
    return high


class Tree:
    """A complete kd-tree of medians; cell numbers are its leaves."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, self.dim, self.at = depth, np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        parts = {1: points}
        for node in range(1, 1 << depth):
            own = parts.pop(node)
            d = int(np.argmax(own.max(0) - own.min(0))) if len(own) else 0
            v = float(np.median(own[:, d])) if len(own) else 0.0
            self.dim[node], self.at[node] = d, v
            right = own[:, d] > v
            parts[2 * node], parts[2 * node + 1] = own[~right], own[right]

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.dim[node]] > self.at[node])
        return node - (1 << self.depth)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, queries: Column, index: Index = Index(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of vectors for which `queries` holds.
    score is the inner product of the original vectors, summed in order in doubles."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(_usable(F.col("v")) & F.col("vec_id").isNotNull()).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), "v"))
    slim = rows.select("vec_id", "h1", "h2", "asks").distinct()
    by = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = rows.select("vec_id", "v", "h1", "h2").distinct().withColumn("r", F.row_number().over(by)).where(F.col("r") <= index.k + 1)
    base, _ = written(few.groupBy("h1", "h2").agg(F.min("vec_id").alias("key"), F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    asked, _ = written(slim.where("asks").select(F.col("vec_id").alias("query_id"), "h1", "h2").join(base, ["h1", "h2"]).select("query_id", "key", F.size("v").alias("width")), "queries")
    widths = [w for (w,) in asked.select("width").distinct().orderBy("width").collect()]
    out = spark.createDataFrame([], "q long, key long")
    for at in range(0, len(widths), WIDTHS):
        found = [_search(base.where(F.size("v") == w).select("key", "v"), asked.where(F.col("width") == w).select("key").distinct(), w, index) for w in widths[at : at + WIDTHS]]
        some = reduce(DataFrame.unionByName, found)
        out = some if len(widths) <= WIDTHS else out.unionByName(written(some, "neighbours")[0])
    near = out.join(base.select("key", F.col("v").alias("x"), "ids"), "key").join(base.select(F.col("key").alias("q"), "v"), "q")
    near = near.withColumn("score", F.aggregate(F.zip_with("v", "x", lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t))
    each = asked.select("query_id", F.col("key").alias("q")).join(near.select("q", "ids", "score"), "q").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.distinct().withColumn("rank", rank).where(F.col("rank") <= index.k).select("query_id", "rank", "vec_id", "score")


def _search(base: DataFrame, asked: DataFrame, width: int, index: Index) -> DataFrame:
    """(q, key): for each asked vector its k + 1 best vectors, itself among them."""
    spark, keep = base.sparkSession, index.k + 1
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n, top = base.agg(F.count("*"), F.max(norm)).first()
    rng = np.random.default_rng(index.seed)
    project = rng.normal(size=(width + 1, index.dims))
    depth = min(index.depth, max(0, math.ceil(math.log2(max(1, n) / index.cell))))
    stop = quantile(index.certainty, index.dims)

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(0, top * top - (x * x).sum(1)))[:, None]), axis=1) @ project

    picked = base.orderBy(F.xxhash64("key"), "key").limit(index.sample).toArrow()
    tree = Tree(lifted(_matrix(picked.column("v"), width)), depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = lifted(_matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.cells(p)), *(pa.array(p[:, k]) for k in range(index.dims))], ["key", "v", "cell", *(f"p{k}" for k in range(index.dims))])

    placed, placed_path = written(base.mapInArrow(place, "key long, v array<double>, cell long, " + ", ".join(f"p{k} double" for k in range(index.dims))), "cells")
    boxes = placed.groupBy("cell").agg(*(f(f"p{k}") for f in (F.min, F.max) for k in range(index.dims)), F.count("*").alias("n")).orderBy("cell").toArrow()
    cells = boxes.column(0).to_numpy()
    low, high = (np.stack([boxes.column(1 + s * index.dims + k).to_numpy() for k in range(index.dims)], 1) for s in (0, 1))
    shares = max(1, math.ceil(max(boxes.column(len(boxes.column_names) - 1).to_pylist()) / index.block))
    asked_rows = asked.join(base, "key").select(F.col("key").alias("q"), "v")
    parts = max(1, math.ceil(asked.count() / index.block))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The next cells of every query that is not done: (q, v, cell, least score of use)."""
        for batch in batches:
            q = _matrix(batch.column(1), width)
            size = np.linalg.norm(q, axis=1)
            p = np.concatenate((q * (top / size)[:, None], np.zeros((len(q), 1))), axis=1) @ project
            seen, worst = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            at, cell = [], []
            for i in range(len(q)):
                gap = (np.maximum(0, np.maximum(low - p[i], p[i] - high)) ** 2).sum(1)
                order = np.argsort(gap, kind="stable")
                todo = order[seen[i] : max(index.first, 2 * seen[i])]
                if np.isfinite(worst[i]):  # k + 1 are known: the worst one's squared distance
                    far = max(0.0, 2 * top * top - 2 * top * worst[i] / size[i])
                    todo = todo[gap[todo] < stop * far]
                at += [i] * len(todo)
                cell += cells[todo].tolist()
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(cell, pa.int64()), batch.column(3).take(take)], ["q", "v", "cell", "worst"])

    def verify(cell: pa.Table, asks: pa.Table) -> pa.Table:
        out_q, out_key, out_s = [], [], []
        if cell.num_rows and asks.num_rows:
            x, keys = _matrix(cell.column("v"), width), cell.column("key").to_numpy()
            ids, worst = asks.column("q").to_numpy(), asks.column("worst").to_numpy()
            q = _matrix(asks.column("v"), width)
            for a in range(0, len(q), 256):
                s = q[a : a + 256] @ x.T
                for i, row in enumerate(s):
                    ok = np.flatnonzero(row >= worst[a + i] - 1e-9 * abs(worst[a + i]) if np.isfinite(worst[a + i]) else row == row)
                    if len(ok) > keep:
                        cut = np.partition(row[ok], -keep)[-keep]
                        ok = ok[row[ok] >= cut]
                        ok = ok[np.lexsort((keys[ok], -row[ok]))][:keep]
                    out_q.append(np.full(len(ok), ids[a + i]))
                    out_key.append(keys[ok])
                    out_s.append(row[ok])
        cat = lambda parts, t: pa.array(np.concatenate(parts) if parts else [], t)
        return pa.table({"q": cat(out_q, pa.int64()), "key": cat(out_key, pa.int64()), "s": cat(out_s, pa.float64())})

    cellwise = placed.select("key", "v", "cell", F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int").alias("share"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    best, best_path = None, ""
    seen = 0
    pending = asked_rows.withColumn("seen", F.lit(0)).withColumn("worst", F.lit(float("-inf")))
    while True:
        todo, todo_path = written(pending.select("q", "v", "seen", "worst").mapInArrow(choose, "q long, v array<double>, cell long, worst double"), "visits")
        if todo.isEmpty():
            drop(spark, todo_path)
            break
        asks = todo.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        got = cellwise.groupBy("cell", "share", "part").cogroup(asks.groupBy("cell", "share", "part")).applyInArrow(verify, "q long, key long, s double")
        order = Window.partitionBy("q").orderBy(F.desc("s"), "key")
        fresh, fresh_path = written((got if best is None else got.unionByName(best)).withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).select("q", "key", "s"), "best")
        seen = max(index.first, 2 * seen)
        state = fresh.groupBy("q").agg(F.when(F.count("*") >= keep, F.min("s")).otherwise(float("-inf")).alias("worst"))
        going = todo.select("q").distinct()
        pending = asked_rows.join(going, "q", "left_semi").join(state, "q", "left").select("q", "v", F.lit(seen).alias("seen"), F.coalesce("worst", F.lit(float("-inf"))).alias("worst"))
        drop(spark, *([best_path] if best_path else []))
        best, best_path = fresh, fresh_path
    return best.select("q", "key")
