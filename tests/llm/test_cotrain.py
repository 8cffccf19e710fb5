import random

import numpy as np

from groundwork.llm import cotrain as ct

DOC = "doc_id long, text string, lang string, source string, score string"


def corpus(n=400):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        words = [rng.choice(["the", "house", "stood", "upon", "hills", "and", "was", "old"]) for _ in range(rng.randint(20, 60))]
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words[:1] * len(words))
        source = f"s{rng.randint(0, 4)}" if rng.random() < 0.2 else ("good" if good else "bad")
        docs.append((i, text, "en", source, "x"))
        if i % 2:
            labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(None, None, None, None, None), (9001, "", None, "new", None), (9002, "x " * 50000, "en", "good", None), (1, docs[1][1], "en", "good", "x")]
    d = spark.createDataFrame(docs + odd, DOC)
    views = ct.fit(d, spark.createDataFrame(labels + [(1, 1), (2, None), (None, 1)], "doc_id long, quality int"))
    got = ct.score(d, views)
    assert got.columns == ["doc_id", "text", "lang", "source", "score"]
    rows = got.collect()
    assert len(rows) == len(docs) + 4 and all(0 <= r["score"] <= 1 for r in rows)
    held = [(r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in rows if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 2 == 0]
    assert np.mean(held) > 0.97


def test_no_labels_and_empty_table(spark):
    docs, _ = corpus(10)
    d = spark.createDataFrame(docs, DOC)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert ct.fit(d, none) is None
    assert {r["score"] for r in ct.score(d, None).collect()} == {0.5}
    assert ct.score(d.where("false"), None).count() == 0


def test_views_teach_one_another():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 1200)
    views = [y[:, None] * 2 + rng.normal(0, 1, (1200, 2)), y[:, None] * 1.5 + rng.normal(0, 1, (1200, 3))]
    few = np.arange(40)
    got = ct.cotrain([v[few] for v in views], y[few], [v[40:1000] for v in views])
    p = ct.sigmoid(sum(g.weight * g.calibrated(v[1000:]) for g, v in zip(got, views)))
    assert ((p > 0.5) == y[1000:]).mean() > 0.9


def test_repeated_ids_and_many_sources(spark):
    docs, labels = corpus()
    again = [(1, f"quite another text {k} !!", "en", f"x{k}", "x") for k in range(300)]
    clash = spark.createDataFrame([(*d, 1, 2) for d in docs + again], DOC + ", y int, own int")
    views = ct.fit(clash, spark.createDataFrame(labels, "doc_id long, quality int"), max_labelled=50, max_pool=50)
    got = ct.score(clash, views).collect()
    assert len(got) == len(docs) + 300 and all(0 <= r["score"] <= 1 for r in got)
    size = np.array([3, 4, 5])
    one = ct.meta_features([["a", None, "a"], ["x", "y", None]], size)
    assert (one[0, :64] == one[2, :64]).all() and (one[:, :-3].sum(1) == 2).all() and not (one[0, :64] == one[1, :64]).all()
