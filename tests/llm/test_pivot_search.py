import math
import random

import numpy as np

from groundwork.llm import pivot_search as ps

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(rows, k):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in ok if i % 50 == 0}:
        s = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v)))[:k]
        out += [(q, r, i, -d) for r, (d, i) in enumerate(s, 1)]
    return sorted(out)


def table(n, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.25, rng.random()]) for _ in range(8)], 1) for i in range(n)]
    rows += [(3, rows[7][1], 1), (50, rows[50][1], 1), (n, None, 1), (n + 1, [None] * 8, 1), (n + 2, [float("nan")] * 8, 1)]
    return rows + [(n + 3, [float("inf")] * 8, 1), (n + 4, [], 1), (n + 5, [1.0, 2.0], 1), (None, rows[0][1], 1)]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, ps.top_k(df, df.where("vec_id % 50 = 0"), **kw).collect()))


def test_equals_brute_force_and_blocks_change_nothing(spark, monkeypatch):
    rows = table(420, 4)
    want = brute(rows, 5)
    assert run(spark, rows) == want
    monkeypatch.setattr(ps, "BLOCK", 17)
    assert run(spark, rows, query_block=3, n_pivots=4) == want


def test_few_or_no_candidates(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1)]) == [(0, 1, 1, 65536)]


def test_elimination_skips_candidates():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 200, (20, 16))
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 5, (4000, 16)))
    x = x.astype(np.int64)
    pivots = ps.choose_pivots(x[:500], 32)
    table = ps.distances(x, pivots)
    order = np.argsort(table.argmin(1), kind="stable")
    best = ps.Best(x[:50], np.arange(50), pivots, 5, (x[:500], np.arange(500)))
    for at in range(0, 4000, 100):
        part = order[at : at + 100]
        best.add(x[part], part, table[part])
    assert best.met == 50 * 4000 and best.evaluated < 0.05 * best.met
    rows, other, score = best.found()
    for i in range(50):
        want = sorted((-int(s), j) for j, s in enumerate(x @ x[i]) if j != i)[:5]
        assert [(-int(s), int(o)) for s, o in zip(score[rows == i], other[rows == i])] == want


def test_large_scores_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-400_000, 400_000)) for _ in range(8)], 1) for i in range(150)]
    assert run(spark, rows) == brute(rows, 5)
    big = np.array([[1 << 31, 3], [1 << 30, -5]], np.int64)
    assert ps.scores(big, big[0]).tolist() == [(1 << 62) + 9, (1 << 61) - 15]
    huge = np.array([[1 << 40, 1 << 40]], np.int64)
    assert ps.scores(huge, huge[0]).tolist() == [(1 << 63) - 1] and ps.scores(-huge, huge[0]).tolist() == [-(1 << 63) + 1]
