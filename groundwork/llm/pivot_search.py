"""Exact top-k inner product search by pivot-table elimination.

The pivot table holds every vector's distances to the pivots. It is computed and written once, in
order of the nearest pivot. By the triangle inequality |d(q, p) - d(x, p)| bounds d(q, x) from below
for every pivot p, the largest of them is used, and q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 turns it into
an upper bound of the score. A run of neighbours in the table has bounds as a whole, by the least and
largest distances in it, so a query passes over whole runs; of others it evaluates candidates in the
order of their bounds and stops at the first bound under its k-th best score. What is left cannot
enter, so the result is exact. A query's k-th best score in the pivots' sample, whose vectors are
candidates themselves, is where it starts from.

Components become floor(scale * x), x as double, and scores are integers, computed as such: in
doubles while these hold all sums exactly, in 64-bit integers beyond. Scores beyond 64 bits
saturate. Queries are sent to the candidates in blocks of at most ``query_block`` vectors, each
block with its own pass over the table, so what is broadcast is bounded at any size. Bounds only
help where the data has clusters; without any, nearly all candidates are evaluated.

Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids. A
query does not meet candidates of its own id. Rows that repeat an id and vector are one query but as
many candidates. Vectors of another length than the query are no candidates of it. Ties go to the
smaller id. Other columns are not read. An empty table, or no query, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import Scratch, hash_sample

#: Candidates in a run of the table.
BLOCK = 1024


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Vectors far from one another, greedily."""
    sample = sample.astype(np.float64)
    if not len(sample):
        return sample
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        k = int(near.argmax())
        if near[k] == 0:
            break
        chosen.append(k)
        near = np.minimum(near, ((sample - sample[k]) ** 2).sum(1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def scores(x: np.ndarray, q: np.ndarray, size: float | None = None) -> np.ndarray:
    """Exact inner products of integer vectors ``x`` with ``q``, as integers or as doubles that hold
    them. ``size`` bounds their sums of absolute products."""
    if size is None:
        size = _size(x) * _size(q) * len(q)
    if size < 2.0**52:
        return x.astype(np.float64, copy=False) @ q.astype(np.float64, copy=False)
    if size < 2.0**62:
        return x.astype(np.int64, copy=False) @ q.astype(np.int64, copy=False)
    limit = (1 << 63) - 1
    return np.array([max(-limit, min(limit, int(s))) for s in x.astype(object) @ q.astype(object)], np.int64)


def _size(x: np.ndarray) -> float:
    return float(np.abs(x.astype(np.float64)).max(initial=0))


class Best:
    """The best k (score, id) of some queries so far. ``sample``: (vectors, ids) of some candidates,
    from which each query takes the score that its k-th best has at least."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, pivots: np.ndarray, k: int, sample: tuple[np.ndarray, np.ndarray] | None = None):
        self.q, self.ids, self.k, self.most = queries, ids, k, _size(queries)
        self.table, real = distances(queries, pivots), queries.astype(np.float64)
        self.real = real
        self.square = (real * real).sum(1)
        self.score: list[np.ndarray] = [np.empty(0, np.int64) for _ in ids]
        self.other: list[np.ndarray] = [np.empty(0, np.int64) for _ in ids]
        self.floor = np.full(len(ids), -(1 << 63) + 1, np.int64)
        self.met = self.evaluated = 0
        if sample is not None and len(sample[0]):
            for i in range(len(ids)):
                own = scores(sample[0][sample[1] != ids[i]], queries[i])
                if len(own) >= k:
                    self.floor[i] = int(np.partition(own, len(own) - k)[len(own) - k])

    def add(self, x: np.ndarray, ids: np.ndarray, table: np.ndarray, step: int = 64) -> None:
        """Candidates ``x`` with their rows of the pivot table."""
        real = x.astype(np.float64)
        square = (real * real).sum(1)
        low, high, most = table.min(0), table.max(0), square.max(initial=0)
        # Slack for the rounding of distances and squares: bounds may only grow.
        slack = 1e-6 * np.maximum(high.max(initial=0), self.table.max(1, initial=0)) + 1e-2
        away = np.maximum(0, np.maximum(self.table - high, low - self.table).max(1) - slack)
        whole = (self.square + most - away * away) / 2 + 1 + 1e-12 * (self.square + most)
        self.met += len(x) * len(self.q)
        # Doubles where they hold every sum exactly, else the integers themselves.
        size = _size(x) * self.most * x.shape[1]
        own, asked = (real, self.real) if size < 2.0**52 else (x, self.q)
        for i in np.flatnonzero(whole >= self.floor).tolist():
            apart = np.maximum(np.abs(table - self.table[i]).max(1) - slack[i], 0)
            bound = (self.square[i] + square - apart * apart) / 2 + 1 + 1e-12 * (self.square[i] + square)
            left = np.flatnonzero((bound >= self.floor[i]) & (ids != self.ids[i]))
            left = left[np.argsort(-bound[left], kind="stable")]
            at, width = 0, step
            while at < len(left) and bound[left[at]] >= self.floor[i]:
                part = left[at : at + width]
                at, width = at + width, 2 * width
                self.evaluated += len(part)
                score = scores(own[part], asked[i], size)
                good = score >= self.floor[i]
                if not good.any():
                    continue
                score = np.concatenate([self.score[i], score[good].astype(np.int64)])
                other = np.concatenate([self.other[i], ids[part[good]]])
                top = np.lexsort((other, -score))[: self.k]
                self.score[i], self.other[i] = score[top], other[top]
                if len(top) == self.k:
                    self.floor[i] = max(self.floor[i], score[top[-1]])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score)."""
        rows = np.repeat(np.arange(len(self.ids)), [len(s) for s in self.score])
        empty = [np.empty(0, np.int64)]
        return rows, np.concatenate(empty + self.other), np.concatenate(empty + self.score)


def _matrix(col: pa.Array, dtype) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(col), -1)


def _measure(sent):
    """Adds to vectors their rows of the pivot table and the nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = np.array(batch["v"].value_lengths())
            for n in np.unique(dim).tolist():
                part = batch.filter(pa.array(dim == n))
                d = distances(_matrix(part["v"], np.int64), sent.value[n])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part["id"], part["v"], pa.array([n] * len(d), pa.int32()), pa.array(d.argmin(1), pa.int32()), lists], ["id", "v", "dim", "cell", "d"])

    return run


def _search(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, ids, key, pivots, k, sample = sent.value
        best = Best(queries, ids, pivots, k, sample)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                best.add(_matrix(part["v"], np.int64), part["id"].to_numpy(), _matrix(part["d"], np.float64))
        rows, other, score = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(ids[rows]), pa.array(other), pa.array(score)], ["key", "query_id", "id", "score"])

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
    scale: int = 256, n_pivots: int = 32, pivot_sample: int = 2048, query_block: int = 4096,
) -> DataFrame:
    """(query_id, rank, ``id_col``, score) of every vector of ``queries`` against ``vectors``."""
    spark = vectors.sparkSession
    tmp = Scratch(spark)

    def whole(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
        bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
        ok = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, bad) & F.col(id_col).isNotNull()
        return df.where(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    cands, asked = whole(vectors), tmp.write(whole(queries).distinct(), "queries")
    n_blocks = max(1, -(-asked.count() // query_block))
    dims = [r["dim"] for r in asked.select(F.size("v").alias("dim")).distinct().orderBy("dim").collect()]
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)))
    picked = hash_sample(cands, F.concat_ws(":", F.col("id").cast("string"), F.col("v").cast("string")), pivot_sample)
    sample = sorted((tuple(r["v"]), r["id"]) for r in picked.collect())
    mine = {dim: [(v, i) for v, i in sample if len(v) == dim] for dim in dims}
    matrix = {dim: np.array([v for v, _ in rows], np.int64).reshape(-1, dim) for dim, rows in mine.items()}
    pivots = {dim: choose_pivots(m, n_pivots) if len(m) else np.zeros((1, dim)) for dim, m in matrix.items()}
    # The pivot table: only vectors of a length that is asked for, in order of the nearest pivot.
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    measured = cands.where(F.size("v").isin(dims)).mapInArrow(_measure(spark.sparkContext.broadcast(pivots)), "id long, v array<long>, dim int, cell int, d array<double>")
    table = tmp.write(measured.repartition(n_tasks, "id").sortWithinPartitions("dim", "cell", "id"), "pivots")
    parts = []
    for block in range(n_blocks):
        rows = asked.where(F.col("block") == block).select("id", "v").collect()
        for dim in dims:
            own = sorted((r["id"], tuple(r["v"])) for r in rows if len(r["v"]) == dim)
            if not own:
                continue
            key = np.arange(len(own)) * n_blocks + block
            known = (matrix[dim], np.array([i for _, i in mine[dim]], np.int64))
            sent = spark.sparkContext.broadcast((np.array([v for _, v in own], np.int64), np.array([i for i, _ in own]), key, pivots[dim], k, known))
            found = table.where(F.col("dim") == dim).select("id", "v", "d").mapInArrow(_search(sent), "key long, query_id long, id long, score long")
            order = Window.partitionBy("key").orderBy(F.col("score").desc(), "id")
            top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            parts.append(tmp.write(top.select("query_id", "rank", F.col("id").alias(id_col), "score"), "top"))
    if not parts:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return tmp.result(out, "top")
