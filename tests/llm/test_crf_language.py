import itertools

import numpy as np
import pytest

from groundwork.llm import crf_language as cl


def brute(emit, trans):
    n, k = emit.shape
    out = np.zeros((n, k))
    for ys in itertools.product(range(k), repeat=n):
        s = sum(emit[i, y] for i, y in enumerate(ys)) + sum(trans[a, b] for a, b in zip(ys, ys[1:]))
        for i, y in enumerate(ys):
            out[i, y] += np.exp(s)
    return out / out.sum(1, keepdims=True)


@pytest.mark.parametrize("block", [2, 3, 64])
def test_marginals_equal_enumeration(monkeypatch, block):
    monkeypatch.setattr(cl, "BLOCK", block)
    rng = np.random.default_rng(1)
    lengths = [1, 0, 7, 2, 5, 6]
    first = np.cumsum([0, *lengths])
    emit, trans = rng.normal(0, 1, (first[-1], 3)).astype(np.float32), rng.normal(0, 1, (3, 3))
    got = cl.marginals(emit, first, trans)
    for a, b in zip(first, first[1:]):
        if b > a:
            assert np.allclose(got[a:b], brute(emit[a:b], trans), atol=1e-4)


def test_long_chain_is_exact(monkeypatch):
    rng = np.random.default_rng(2)
    emit, trans = rng.normal(0, 1, (5000, 4)).astype(np.float32), rng.normal(0, 1, (4, 4))
    a = cl.marginals(emit, np.array([0, 5000]), trans)
    monkeypatch.setattr(cl, "BLOCK", 10000)
    assert np.allclose(a, cl.marginals(emit, np.array([0, 5000]), trans), atol=1e-3)


EN = "the house of the man is on the hill and they went with the others to that place "
DE = "das haus und der mann ist auf dem berg und sie gehen mit den anderen zu diesem ort "


def test_code_switched_words_are_labelled():
    model = cl.train([EN, DE] * 30, ["en", "de"] * 30)
    got = {w: y for w, y, _ in cl.label_words(model, "the man with the house und der mann mit dem haus")}
    assert got["the"] == "en" and got["dem"] == "de" and got["und"] == "de"
    assert cl.label_words(model, "12 3") == []


def test_operator_on_odd_rows(spark):
    train = spark.createDataFrame([(i, t, y) for i in range(20) for t, y in ((EN, "en"), (DE, "de"))] + [(99, None, "fr"), (98, "x", None)], "doc_id long, text string, lang string")
    rows = [(1, None, 5), (2, "", 5), (3, "123 !!", 5), (4, "“”—", 5), (5, EN * 3000, 5), (5, DE, 5), (None, DE, None)]
    df = cl.fit_and_identify(spark.createDataFrame(rows, "doc_id long, text string, score long"), train)
    assert df.columns == ["doc_id", "text", "lang_pred", "score"]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in df.collect()]
    assert [g for g in got if g[0] in (1, 2, 3, 4)] == [(i, "und", 0.0) for i in (1, 2, 3, 4)]
    assert sorted(g[1] for g in got if g[0] == 5) == ["de", "en"] and all(0 <= g[2] <= 1 for g in got)
    none = cl.fit_and_identify(spark.createDataFrame(rows, "doc_id long, text string, n long"), train.where("false"))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def brute_pairs(emit, trans, gold):
    """(log-likelihood of gold, probability of each pair of neighbours' labels)."""
    n, k = emit.shape
    pairs, total, mine = np.zeros((n - 1, k, k)), 0.0, 0.0
    for ys in itertools.product(range(k), repeat=n):
        s = np.exp(sum(emit[i, y] for i, y in enumerate(ys)) + sum(trans[a, b] for a, b in zip(ys, ys[1:])))
        total += s
        mine += s * (ys == tuple(gold))
        for i, (a, b) in enumerate(zip(ys, ys[1:])):
            pairs[i, a, b] += s
    return np.log(mine / total), pairs / total


@pytest.mark.parametrize("block", [2, 3, 64])
def test_pair_marginals_equal_enumeration(monkeypatch, block):
    monkeypatch.setattr(cl, "BLOCK", block)
    rng = np.random.default_rng(4)
    emit, trans = rng.normal(0, 1, (5, 3)).astype(np.float32), rng.normal(0, 1, (3, 3))
    e, fwd, behind, t = cl.messages(emit, np.array([0, 5]), trans)
    got = cl.pair_marginals(e, fwd, behind, t, np.arange(4))
    assert np.allclose(got, brute_pairs(emit, trans, [0] * 5)[1], atol=1e-4)


def test_gradients_equal_differences():
    rng = np.random.default_rng(5)
    first, gold = np.array([0, 4, 4, 5, 8]), rng.integers(0, 3, 8)
    emit, trans = rng.normal(0, 1, (8, 3)), rng.normal(0, 1, (3, 3))

    def loss(e, t):
        return sum(brute_pairs(e[a:b], t, gold[a:b])[0] for a, b in zip(first, first[1:]) if b > a)

    by_word, by_pair, pairs = cl.gradients(emit.astype(np.float32), first, trans, gold)
    assert pairs == 5
    for x, grad, of in ((emit, by_word, lambda v: loss(v, trans)), (trans, by_pair, lambda v: loss(emit, v))):
        for at in np.ndindex(x.shape):
            up, down = x.copy(), x.copy()
            up[at] += 1e-4
            down[at] -= 1e-4
            assert abs((of(up) - of(down)) / 2e-4 - grad[at]) < 2e-3


def test_repeated_rows_long_labelled_texts_and_empty_table(spark):
    rows = [(i, (EN if i % 2 else DE) * 400, "en" if i % 2 else "de") for i in range(6)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string")
    got = cl.fit_and_identify(docs, docs, max_chars=2000)
    assert sorted((r["doc_id"], r["lang_pred"]) for r in got.collect()) == sorted((i, y) for i, _, y in rows + rows[:2])
    assert cl.fit_and_identify(docs.where("false"), docs).count() == 0
