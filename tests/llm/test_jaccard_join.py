import random
import re

import numpy as np

from groundwork.llm import jaccard_join as jj


def brute(rows, num=75, den=100):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    n = len(rows)
    comp = list(range(n))
    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), low.get(find(i))) for i in range(n))


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(400)]
    passage = rng.choices(words, k=30)
    seeds = [rng.choices(words, k=rng.randint(5, 120)) for _ in range(25)]
    rows = []
    for i in range(n):
        t = list(rng.choice(seeds))
        for _ in range(rng.randint(0, max(1, len(t) // 12))):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.4:
            t = t + passage
        rows.append((i, " ".join(t).replace("w", "W" if rng.random() < 0.2 else "w")))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "One  two"), (n + 5, "one two three"), (0, "one two"), (n + 6, "x " * 4000)]


def run(spark, rows, **kw):
    df = jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), **kw)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_components_equal_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


def test_small_blocks_split_askers_and_frequent_lists_stay_rows(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_SETS", 4)
    monkeypatch.setattr(jj, "MAX_PICK_BITS", 18)
    monkeypatch.setattr(jj, "HEAVY_CLASS", 1)
    monkeypatch.setattr(jj, "SLOT_BITS", 16)
    monkeypatch.setattr(jj, "BLOCK_SHINGLES", 300)
    rows = corpus(2, 180)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_null_ids_extra_columns_and_repeated_rows(spark):
    rng = random.Random(8)
    base = rng.choices([f"v{i}" for i in range(90)], k=40)
    near = " ".join(base[:-1] + ["end"])
    rows = [(None, " ".join(base), 1, "a"), (7, near, 2, None), (7, near, 2, None), (7, "other words that link with nothing here", 3, "b"),
            (None, "a text of its own without any id", 4, "c"), (None, None, None, None), (5, "", 5, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag int, component_id string")
    out = jj.jaccard_components(df, carry=("tag", "component_id"))
    assert out.columns == ["doc_id", "n_shingles", "class_key", "group_key", "component_id", "tag"]
    got = sorted(((r[5], r[0], r[4]) for r in map(tuple, out.collect())), key=str)
    assert got == sorted([(1, None, 7), (2, 7, 7), (2, 7, 7), (3, 7, 7), (4, None, None), (None, None, None), (5, 5, 5)], key=str)
    groups = {r[5]: r[3] for r in map(tuple, out.collect())}
    assert groups[1] == groups[2] != groups[3] and groups[5] is None


def _posted(rng, n_sets, words, size):
    return [np.sort(rng.choice(words, size, replace=False)).astype(np.uint64) for _ in range(n_sets)]


def test_postings_are_skipped_by_position():
    rng = np.random.default_rng(1)
    sets = _posted(rng, 60, 4000, 200)
    tail = np.arange(10_000, 10_060, dtype=np.uint64)  # a passage that stands at other positions in short sets
    sets += [np.concatenate([s[:k], tail]) for k, s in zip(range(10, 150), _posted(rng, 140, 4000, 200))]
    listed = jj._Listed([(i, len(s), i, s, np.arange(len(s))) for i, s in enumerate(sets)], 75, 100)
    for i, s in enumerate(sets):
        n = len(s)
        listed.hit[:] = False
        listed.candidates(i, n, i, s, np.arange(n))
        for j, o in enumerate(sets):
            both = len(np.intersect1d(s, o))
            if j != i and 100 * both >= 75 * (n + len(o) - both):
                assert listed.hit[j]
    assert listed.index.skipped > 0.2 * (listed.index.skipped + listed.index.read)


def test_block_lists_are_passed_over_by_position(spark):
    from pyspark.sql import functions as F

    band = int(np.floor(np.log(100) / np.log(jj.BAND)))
    df = spark.createDataFrame([(100, p, 256 + band, a, b) for p, a, b in ((0, 0, 3), (0, 60, 80), (70, 0, 3), (70, 60, 80))], "n int, pos int, block long, a int, b int")
    got = [r[0] for r in df.select(jj._reachable(F.col("n"), F.col("pos"), F.col("block"), F.col("a"), F.col("b"), 75, 100)).collect()]
    assert got == [True, False, False, True]


def test_answers_are_derived_from_similar_sets():
    rng = np.random.default_rng(2)
    base = [np.sort(rng.choice(100_000, 300, replace=False)).astype(np.uint64) for _ in range(3)]
    near = [np.unique(np.concatenate([b[rng.random(300) < 0.97], rng.choice(100_000, 5).astype(np.uint64)])) for b in base for _ in range(40)]
    block = jj._Block(list(range(len(near))), near, list(range(len(near))))
    for m, s in enumerate(near):
        want = [len(np.intersect1d(s, o)) for o in near]
        assert block.answer(s, m).tolist() == want
    assert block.computed <= 6 and block.derived >= len(near) - 6
    odd = np.sort(rng.choice(100_000, 300, replace=False)).astype(np.uint64)
    assert block.answer(odd, None).tolist() == [len(np.intersect1d(odd, o)) for o in near]
