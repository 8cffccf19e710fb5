import random

import numpy as np

from groundwork.llm import toxicity as tx

WORDS = ["the", "house", "stood", "hills", "river", "old", "green", "walked", "slowly", "market", "morning", "light"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = rng.choices(WORDS, k=rng.randint(5, 150))
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["grobble", "snarkish", "grobbly"])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = tx.fresh(1, 0.1)
    vec = rng.normal(0, 1, (9, tx.DIM)).astype(np.float32)
    idx, live = rng.integers(0, 9, (4, tx.WINDOW)), np.ones((4, tx.WINDOW), bool)
    live[1, 20:], live[2, 1:] = False, False
    r = rng.normal(0, 1, 4).astype(np.float32)
    loss = lambda: float(tx.forward(net, tx.gate_sums(net, vec).astype(np.float64), idx, live) @ r)
    d_pre, d_wh, d_att, d_out, d_bias = tx.backward(net, tx.forward(net, tx.gate_sums(net, vec), idx, live, keep=True), r)
    for part, grad in ((net.wh, d_wh), (net.att, d_att), (net.out, d_out), (net.bias, d_bias)):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in part.shape)
            keep = part[at]
            part[at] = keep + 1e-2
            up = loss()
            part[at] = keep - 1e-2
            down = loss()
            part[at] = keep
            assert abs((up - down) / 2e-2 - grad[at]) < 2e-3 + 0.02 * abs(grad[at])


def test_windows_cover_every_word():
    first = np.array([0, 0, 1, 33, 133, 400])
    doc, at = tx.windows(first)
    for d in range(5):
        seen = set()
        for x in at[doc == d]:
            seen |= set(range(x, min(x + tx.WINDOW, first[d + 1])))
        assert seen == set(range(first[d], first[d + 1])) and (doc == d).any()
        starts = at[doc == d]
        for x in range(first[d], max(first[d], first[d + 1] - tx.STRIDE) + 1):  # half a window in a row
            assert any(s <= x and min(x + tx.STRIDE, first[d + 1]) <= s + tx.WINDOW for s in starts)


def test_held_out_and_odd_rows(spark):
    train, test = corpus(600, 1), corpus(200, 2)
    schema = "doc_id long, text string, toxic int"
    docs = spark.createDataFrame(train, schema)
    labels = docs.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (5, None), (7, 0)], "doc_id long, toxic int"))
    deep = " ".join(WORDS * 3000 + ["grobble"] + WORDS * 3000)
    odd = [(900, None, 5), (901, "", 5), (902, "!!", 5), (903, deep, 5), (903, deep, 5), (None, "the old house", None)]
    got = tx.fit_and_score(spark.createDataFrame([(i, t, 5) for i, t, _ in test] + odd, "doc_id long, text string, score long"), docs, labels)
    assert got.columns == ["doc_id", "text", "score"]
    rows = got.collect()
    score = {r["doc_id"]: r["score"] for r in rows}
    assert np.mean([(score[i] >= 0.3) == bool(y) for i, _, y in test]) > 0.97
    assert all(score[i] < 0.3 for i in (900, 901, 902, None)) and score[903] >= 0.3 and len(rows) == 206
    assert score[900] == score[901] == score[902] and abs(score[901] - 0.25) < 0.02
    none = tx.fit_and_score(docs, docs, labels.where("false"))
    assert {r["score"] for r in none.collect()} == {0.0}
    assert tx.fit_and_score(docs.where("false"), docs, labels.where("false")).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.fit_and_score(docs.limit(0), docs.limit(0), labels).count() == 0
    got = tx.fit_and_score(docs, docs, labels)  # nothing to learn from: nothing is toxic
    assert [r["score"] for r in got.orderBy("doc_id").collect()] == [0.0, 0.0, 0.0]
    one = spark.createDataFrame([(1, 1)], labels.schema)
    assert all(0 <= r["score"] <= 1 for r in tx.fit_and_score(docs, docs, one).collect())
