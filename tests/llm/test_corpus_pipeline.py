import hashlib
import random
import re

import corpus_pipeline as cp
import numpy as np

from groundwork.llm import bytetext as bt, crf_language, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
EN = ["the", "house", "of", "man", "hill", "they", "went", "with", "others", "place", "and", "was", "green", "river", "old", "stone"]
DE = ["das", "haus", "und", "der", "mann", "ist", "auf", "dem", "berg", "sie", "gehen", "mit", "anderen", "ort", "alt", "stein"]


def corpus():
    rng = random.Random(9)
    rows = []
    for i in range(300):
        words = EN if i % 2 else DE
        rows.append([i, " ".join(rng.choices(words, k=60)), "en" if i % 2 else "de", f"s{i % 4}"])
    for i in range(0, 300, 6):
        rows[i][1] += " grobble snark grobble"
    passage = " ".join(f"bench{k}" for k in range(14))
    rows += [[400, rows[1][1], "en", "s1"], [401, rows[1][1] + " extra", "en", "s1"], [402, rows[7][1] + " " + passage + " " + rows[9][1], "en", "s0"]]
    rows += [[403, None, "en", "s0"], [404, "12 34", "en", "s0"], [405, "", None, None], [None, rows[11][1] + " null id", "en", None]]
    docs = [(i, t, l, s, len(t or "")) for i, t, l, s in rows]
    return docs, [(i, int(i % 6 == 0)) for i in range(0, 300)], [(1, passage)]


def save(spark, path):
    docs, labels, bench = corpus()
    spark.createDataFrame(docs, DOC).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def test_stages_decide_as_planted(spark, tmp_path):
    docs = save(spark, tmp_path)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    after = {}
    for name, stage in cp.STAGES:
        df = stage(spark, df, str(tmp_path))
        df = cp.written(df, f"test-{name}")
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after[name] = ids(df)
    every = {d[0] for d in docs}
    assert every - after["language"] == {403, 404, 405}
    gone = after["language"] - after["toxicity"]
    toxic = {i for i in range(0, 300, 6)}
    assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 3
    assert after["toxicity"] - after["near_duplicates"] == {400, 401, None}  # the row without id is a near copy of 11
    assert after["near_duplicates"] - after["decontamination"] == {402}
    assert after["mixing"] <= after["decontamination"] and df.count() > 0


def brute_near(rows):
    """One row of every group of near copies, all pairs compared; equal rows are one."""
    rows = list(dict.fromkeys(rows))
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for g in set(group):
        mine = [rows[i] for i in range(len(rows)) if group[i] == g]
        low = min((r[0] is None, r[0] or 0) for r in mine)
        out.append([r for r in mine if (r[0] is None, r[0] or 0) == low])  # which of equal ids stays is free
    return out


def brute_mix(rows):
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted({r[3] for r in rows if r[3] is not None}) + ([None] if any(r[3] is None for r in rows) else [])
    own = {n: sum(size(r) for r in rows if r[3] == n) for n in names}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    left, open_, target = 1.5 * sum(own.values()), set(names), {}
    while open_:
        level = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if 2 * own[n] <= level * weight[n]}
        if not full:
            target |= {n: level * weight[n] for n in open_}
            break
        target |= {n: 2.0 * own[n] for n in full}
        left -= sum(2.0 * own[n] for n in full)
        open_ -= full
    out = []
    for r in rows:
        rate = target[r[3]] / own[r[3]] if own[r[3]] else 0.0
        key = str(r[0]) if r[0] is not None else (r[1] or "")
        coin = int(hashlib.md5(f"mix:{key}".encode()).hexdigest()[:12], 16) / 2**48
        out += [r] * (int(rate) + (coin < rate - int(rate)))
    return out


def brute_run(spark, rows, labels, bench):
    """The pipeline on the driver: models on one text at a time, all pairs, every window."""
    known = sorted((r[1], r[2]) for r in rows if r[1] is not None and r[2] is not None)
    crf = crf_language.train([t for t, _ in known], [y for _, y in known])
    letters = bt.byte_class("letters")

    def share(text):
        raw = (text or "").encode()
        w = bt.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), letters)
        if not len(w.hash) or not any(c.isalpha() for c in text):
            return 0.0
        mass = (crf_language.marginals(crf_language.word_emissions(crf, w), w.first, crf.trans) * (w.end - w.start)[:, None]).sum(0)
        return mass.max() / mass.sum()

    rows = [r for r in rows if share(r[1]) >= cp.MIN_LANGUAGE_SHARE]
    df = spark.createDataFrame(rows, DOC)
    sample, base = toxicity.training_rows(
        df, spark.createDataFrame(labels, "doc_id long, toxic int"), text_col="text", id_col="doc_id", label_col="toxic", max_docs=1500, max_chars=6000)
    texts = sorted((r["y"], r["k"], r["t"]) for r in sample.collect())
    net, alnum = toxicity.train([t for *_, t in texts], [y for y, *_ in texts], base_rate=base), bt.byte_class("alnum")

    def toxic(text):
        raw = text.encode()
        return toxicity.score_words(net, bt.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), alnum))[0]

    rows = [r for r in rows if toxic(r[1]) < cp.MAX_TOXICITY]
    groups = brute_near(rows)
    windows = {tuple(w[i : i + 10]) for w in (b[1].lower().split() for b in bench) for i in range(max(1, len(w) - 9))}
    clean = lambda t: not any(tuple(w[i : i + len(x)]) == x for w in [re.findall("[a-z0-9]+", t.lower())] for x in windows for i in range(len(w)))
    assert all(len({clean(r[1]) for r in g}) == 1 for g in groups)
    return [[r for r in g] for g in groups if clean(g[0][1])]


def test_run_equals_brute_force(spark, tmp_path):
    docs = save(spark, tmp_path)
    _, labels, bench = corpus()
    got = [tuple(r) for r in cp.run(spark, str(tmp_path)).collect()]
    groups = brute_run(spark, docs, labels, bench)
    assert all(len(g) == 1 for g in groups)
    assert sorted(got, key=str) == sorted(brute_mix([g[0] for g in groups]), key=str)


def near(spark, rows, schema=DOC):
    return [tuple(r) for r in cp.near_duplicates(spark, spark.createDataFrame(rows, schema), "").collect()]


def test_copies_are_judged_by_row(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choices([f"w{k}" for k in range(200)], k=40))
    a, b, c = text(), text(), text()
    rows = [
        (2, a, "en", "s", 1), (5, a + " more", "en", "s", 1), (5, b, "en", "s", 1), (5, b, "de", "s", 1), (6, b, "en", "s", 1), (None, c, "en", "s", 1),
        (None, c + " more", "en", "s", 1), (None, a, "en", "s", 1), (7, "", "en", "s", 1), (7, "", "en", "s", 1), (8, None, None, "s", 1), (8, None, "s", None, 1),
    ]
    got = near(spark, rows)
    assert sorted(map(str, got)) == sorted(map(str, near(spark, rows[::-1])))
    want = brute_near(rows)
    assert len(got) == len(want) and all(sum(r in g for r in got) == 1 for g in want)
    assert (2, a, "en", "s", 1) in got and not any(r[1] == a + " more" for r in got)


def test_odd_tables(spark, tmp_path):
    docs = save(spark, tmp_path / "x")
    wide = spark.createDataFrame([(*d, "k", d[0]) for d in docs], DOC + ", score string, key long")
    for name, stage in cp.STAGES:
        out = stage(spark, wide, str(tmp_path / "x"))
        assert out.columns == wide.columns and out.count() > 0, name
        assert stage(spark, wide.where("false"), str(tmp_path / "x")).count() == 0, name
