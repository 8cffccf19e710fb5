import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwork.operators import vector

ROW = "vec_id long, collection int, embedding array<double>"


def brute(rows, queries, k):
    out = set()
    for q_id, q in queries:
        for c in {r[1] for r in rows}:
            scored = [(round(float(np.dot(q, v)), 5), i) for i, x, v in rows if x == c and v is not None and len(v) == len(q) and np.isfinite(v).all()]
            out |= {(q_id, c, n, i, s) for n, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k], 1)}
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = [(i, int(rng.integers(0, 2)) if i % 17 else None, [round(float(x), 3) for x in centres[i % 12] + 0.05 * rng.normal(size=8)]) for i in range(900)]
    rows += [(1000 + i, 1, rows[5][2]) for i in range(60)]  # ties
    rows += [(2000, 1, None), (2001, 1, [1.0]), (2002, 0, [float("nan")] * 8), (2003, 0, [0.0] * 8)]
    queries = [(i, [float(x) for x in centres[i % 12] + 0.1 * rng.normal(size=8)]) for i in range(40)] + [(77, [0.0] * 8), (78, rows[5][2])]
    return rows, queries


@pytest.mark.parametrize("part", [20_000, 13])
def test_index_and_scan_equal_brute_force(spark, data, monkeypatch, part):
    rows, queries = data
    monkeypatch.setattr(vector.VectorIndex, "PART", part)
    df, q = spark.createDataFrame(rows, ROW), spark.createDataFrame(queries + [(79, None)], "query_id long, query_vector array<double>")
    want = brute(rows, queries, 3)
    index = vector.VectorIndex.fit(df, sample=500)
    for got in (index.search(q), index.search(q, first=1), vector.nearest(q, df)):
        assert {tuple(r) for r in got.select("query_id", "collection", "rank", "vec_id", "score").collect()} == want
    assert index.probes(q.where("query_vector IS NOT NULL")) < 0.4


def test_empty_tables(spark, data):
    df = spark.createDataFrame(data[0][:20], ROW)
    q = spark.createDataFrame(data[1][:3], "query_id long, query_vector array<double>")
    assert vector.VectorIndex.fit(df.limit(0)).search(q).count() == 0 and vector.VectorIndex.fit(df).search(q.limit(0)).count() == 0
    assert vector.nearest(q, df.limit(0)).count() == 0 and vector.nearest(q.limit(0), df).count() == 0
    assert vector.VectorIndex.fit(df.withColumn("n", F.lit(1)).withColumn("cell", F.lit("x"))).search(q, k=100).count() == 3 * len([r for r in data[0][:20]])
