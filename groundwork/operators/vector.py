"""Similarity, exact nearest neighbours per collection, and a hashed embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .tables import Tables

#: Queries go to all tasks up to this many rows; more are searched block by block.
MAX_QUERIES = 10_000
#: Stands for the collection of rows without one: collections travel as text.
_NULL = "\0"


def inner(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, x: s + x)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 3, *, by: str = "collection", digits: int = 5) -> DataFrame:
    """(query_id, ``by``, rank, vec_id, score): the best ``k`` per query and collection.

    A scan, for few queries: see :class:`VectorIndex` for many, or for many searches of one table.
    ``queries``: query_id, query_vector; ``vectors``: vec_id, ``by``, embedding. Each task keeps its best
    ``k`` per query before the shuffle. More than ``MAX_QUERIES`` are dealt by hash into blocks, one pass
    each, whose results are written. Scores are rounded before they rank; ties go to the lower id. Vectors
    that are null, of another length or not finite take no part."""
    if queries.limit(MAX_QUERIES + 1).count() <= MAX_QUERIES:
        return _best(queries, vectors, k, by, digits)
    tables = Tables(queries.sparkSession)
    queries = tables.write(queries, "queries")
    # A fifth is left free, as blocks by hash differ in size.
    n_blocks = -(-queries.count() * 5 // (MAX_QUERIES * 4))
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    parts = [tables.write(_best(queries.where(block == i), vectors, k, by, digits), "nearest") for i in range(n_blocks)]
    tables.drop(queries)
    return reduce(DataFrame.unionByName, parts)


def _best(queries: DataFrame, vectors: DataFrame, k: int, by: str, digits: int) -> DataFrame:
    """The queries are one array of at most ``MAX_QUERIES`` rows, and each task multiplies its vectors with
    it, batch by batch; what is left per task is ``k`` rows for a query and collection."""
    rows = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("v")).where("v IS NOT NULL").collect()
    schema = f"query_id {dict(queries.dtypes)['query_id']}, by string, vec_id {dict(vectors.dtypes)['vec_id']}, score double"
    found = vectors.select(F.coalesce(F.col(by).cast("string"), F.lit(_NULL)).alias("by"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    found = found.mapInPandas(_scanner([r[0] for r in rows], [r[1] for r in rows], k, digits), schema)
    found = found.select("query_id", F.nullif("by", F.lit(_NULL)).cast(vectors.schema[by].dataType).alias(by), "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id", by).orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _stacked(vectors: pd.Series, dim: int) -> np.ndarray:
    """Vectors as rows; those of another length, or with numbers that are not finite, are rows of NaN."""
    out = np.full((len(vectors), dim), np.nan)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dim:
            out[i] = v
    out[~np.isfinite(out).all(axis=1)] = np.nan
    return out


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the best ``k`` of each row, by score and then the smaller id."""
    n = scores.shape[1]
    scores = np.where(np.isnan(scores), -np.inf, scores)
    if n > k:
        edge = np.partition(scores, n - k, axis=1)[:, n - k]
        row, col = np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
    else:
        row, col = np.nonzero(scores > -np.inf)
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], col[nth < k]


def _scanner(ids: list, queries: list, k: int, digits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_id, kept = np.array(ids, dtype=object), {}
        sizes = {len(q) for q in queries}
        dims = {d: np.flatnonzero([len(q) == d for q in queries]) for d in sizes}
        for batch in batches:
            for name, part in batch.groupby("by", sort=False):
                for d, at in dims.items():
                    q = _stacked(pd.Series([queries[i] for i in at]), d)
                    for lo in range(0, len(part), 1000):
                        some = part.iloc[lo : lo + 1000]
                        scores = np.round(q @ _stacked(some.v, d).T, digits)
                        row, col = _top(scores, some.vec_id.to_numpy(), k)
                        new = pd.DataFrame({"at": at[row], "vec_id": some.vec_id.to_numpy()[col], "score": scores[row, col]})
                        old = kept.get((name, d))
                        both = new if old is None else pd.concat([old, new])
                        kept[name, d] = both.sort_values(["at", "score", "vec_id"], ascending=[True, False, True]).groupby("at").head(k)
        for (name, _), rows in kept.items():
            yield pd.DataFrame({"query_id": q_id[rows["at"].to_numpy()], "by": name, "vec_id": rows.vec_id.to_numpy(), "score": rows.score.to_numpy()})

    return run


@dataclass
class VectorIndex:
    """Vectors in cells, searched exactly.

    Centres are fitted on at most ``2 * sample`` vectors; every vector is in the cell of its nearest centre,
    and a cell knows its radius. For a query q no inner product in a cell exceeds <q, centre> + |q| * radius.
    A search first probes, per collection, the cells with the largest such bounds until they hold
    ``first * k`` vectors; the k-th best score found there rules out all cells with a lower bound, and the
    others are probed as well. So results are those of a scan, ties included.

    A cell of many vectors, and a cell that many queries probe, is cut into parts of ``PART`` rows: what
    meets in a task is bounded. Centres (``max_cells``) and the counts of cells go to all tasks; collections
    are few. Vectors that are null, of another length than most, or not finite, take no part."""

    table: DataFrame
    centres: np.ndarray
    cells: pd.DataFrame
    by: T.StructField
    tables: Tables

    PART = 20_000

    @classmethod
    def fit(cls, vectors: DataFrame, by: str = "collection", *, sample: int = 20_000, max_cells: int = 2048) -> VectorIndex:
        tables = Tables(vectors.sparkSession)
        rows = vectors.select(F.coalesce(F.col(by).cast("string"), F.lit(_NULL)).alias("by"), "vec_id", F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL")
        n = rows.count()
        steps = 1 << 30
        low = F.pmod(F.xxhash64("vec_id"), F.lit(steps)) < F.lit(steps if n <= sample else int(sample / n * steps))
        some = rows.where(low).limit(2 * sample).select("v").toPandas().v
        dim = int(some.map(len).mode().iloc[0]) if len(some) else 0
        centres = _fitted(_stacked(some, dim), max(1, min(max_cells, int(n**0.5 / 2))))
        table = tables.write(rows.mapInPandas(_assigner(centres), f"by string, vec_id {dict(rows.dtypes)['vec_id']}, v array<double>, cell int, far double"), "cells")
        cells = table.groupBy("by", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).toPandas()
        return cls(table, centres, cells, vectors.schema[by], tables)

    def search(self, queries: DataFrame, k: int = 3, digits: int = 5, *, first: int = 8) -> DataFrame:
        """(query_id, by, rank, vec_id, score), as :func:`nearest` gives it, a written table."""
        q = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("v")).where("v IS NOT NULL")
        kind = dict(q.dtypes)["query_id"]
        probe = f"query_id {kind}, v array<double>, by string, cell int, late boolean"
        near = self._probed(q.withColumn("least", F.lit(None).cast("map<string,double>")).mapInPandas(_prober(self.centres, self.cells, k, first, digits), probe), q, k, digits)
        near = self.tables.write(near, "probed")
        worst = near.where(F.col("rank") == k).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("by", "score"))).alias("least"))
        later = q.join(worst, "query_id", "left").select("query_id", "v", F.coalesce("least", F.create_map().cast("map<string,double>")).alias("least"))
        rest = self._probed(later.mapInPandas(_prober(self.centres, self.cells, k, first, digits), probe).where("late"), q, k, digits)
        found = self._ranked(near.drop("rank").unionByName(rest.drop("rank")), k).select("query_id", F.nullif("by", F.lit(_NULL)).cast(self.by.dataType).alias(self.by.name), "rank", "vec_id", "score")
        out = self.tables.write(found, "nearest")
        self.tables.drop(near)
        return out

    def probes(self, queries: DataFrame, k: int = 3, digits: int = 5, *, first: int = 8) -> float:
        """The share of all vectors that a query's first probe reads, on average."""
        q = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("v"), F.lit(None).cast("map<string,double>").alias("least"))
        probe = f"query_id {dict(q.dtypes)['query_id']}, v array<double>, by string, cell int, late boolean"
        read = q.mapInPandas(_prober(self.centres, self.cells, k, first, digits), probe)
        sizes = self.table.groupBy("by", "cell").count()
        return read.join(sizes, ["by", "cell"]).agg(F.sum("count")).first()[0] / (q.count() * self.table.count())

    @staticmethod
    def _ranked(found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id", "by").orderBy(F.col("score").desc(), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def _probed(self, probes: DataFrame, queries: DataFrame, k: int, digits: int) -> DataFrame:
        q_parts = -(-max(1, queries.count()) // self.PART)
        self.cells["parts"] = -(-self.cells.n // self.PART)
        parts = self.table.sparkSession.createDataFrame(self.cells[["by", "cell", "parts"]], "by string, cell int, parts int")
        rows = self.table.join(F.broadcast(parts), (self.table["by"] == parts["by"]) & (self.table["cell"] == parts["cell"])).select(
            self.table["by"], self.table["cell"], "vec_id", "v", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("q_part"))
        asked = probes.join(F.broadcast(parts), (probes["by"] == parts["by"]) & (probes["cell"] == parts["cell"])).select(
            probes["by"], probes["cell"], "query_id", "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(q_parts)).cast("int").alias("q_part"))
        key = ["by", "cell", "part", "q_part"]
        schema = f"query_id {dict(asked.dtypes)['query_id']}, by string, vec_id {dict(rows.dtypes)['vec_id']}, score double"
        met = rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_meeter(self.centres.shape[1], k, digits), schema)
        return self._ranked(met, k)


def _fitted(points: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly spaced points; an empty cell keeps its centre."""
    points = points[~np.isnan(points).any(axis=1)] if len(points) else points
    if not len(points):
        return np.zeros((1, points.shape[1] if points.ndim == 2 else 0))
    centres = points[np.linspace(0, len(points) - 1, min(n, len(points))).astype(int)].copy()
    for _ in range(rounds):
        at = _closest(points, centres)[0]
        sums, count = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, points)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def _closest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, far = np.empty(len(points), np.int32), np.empty(len(points))
    square = (centres**2).sum(axis=1)
    for lo in range(0, len(points), 4096):
        some = points[lo : lo + 4096]
        at[lo : lo + 4096] = np.argmin(square - 2 * some @ centres.T, axis=1)
        far[lo : lo + 4096] = np.sqrt(((some - centres[at[lo : lo + 4096]]) ** 2).sum(axis=1))
    return at, far


def _assigner(centres: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = _stacked(batch.v, centres.shape[1])
            good = ~np.isnan(v).any(axis=1) if centres.shape[1] else np.zeros(len(v), bool)
            at, far = _closest(v[good], centres)
            yield batch[good].assign(cell=at, far=far)

    return run


def _prober(centres: np.ndarray, cells: pd.DataFrame, k: int, first: int, digits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Queries to the cells that they probe: without ``least`` (k-th scores by collection) the first ones,
    else those that it does not rule out, ``late`` ones marked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = [(name, g.cell.to_numpy(), g.n.to_numpy(), g.far.to_numpy()) for name, g in cells.groupby("by", sort=False)]
        for batch in batches:
            v = _stacked(batch.v, centres.shape[1])
            length = np.sqrt((v**2).sum(axis=1))
            for i in np.flatnonzero(~np.isnan(length)).tolist():
                q_id, vector, least = batch.query_id.iloc[i], batch.v.iloc[i], batch.least.iloc[i]
                inner = centres @ v[i]
                for name, cell, n, far in groups:
                    bound = inner[cell] + length[i] * far
                    order = np.argsort(-bound, kind="stable")
                    before = np.cumsum(n[order]) - n[order] < first * k
                    late = np.zeros(len(order), bool)
                    if least is not None:
                        known = dict(least)
                        edge = known.get(name, -np.inf)
                        late = ~before & (bound[order] >= edge - 2 * 10.0**-digits)
                    probed = order[before | late]
                    yield pd.DataFrame({"query_id": q_id, "v": [vector] * len(probed), "by": name, "cell": cell[probed], "late": late[before | late]})

    return run


def _meeter(dim: int, k: int, digits: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        ids = rows.vec_id.to_numpy()
        matrix = _stacked(rows.v, dim)
        for lo in range(0, len(asked) if len(rows) else 0, 500):
            some = asked.iloc[lo : lo + 500]
            scores = np.round(_stacked(some.v, dim) @ matrix.T, digits)
            row, col = _top(scores, ids, k)
            out.append(pd.DataFrame({"query_id": some.query_id.to_numpy()[row], "by": rows.by.iloc[0], "vec_id": ids[col], "score": scores[row, col]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "by", "vec_id", "score"], dtype=object)

    return run


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic bag-of-words embedding of unit length, for offline use."""
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    slots = F.transform(tokens, lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(dim)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))
