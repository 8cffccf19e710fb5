import random
import re
import zlib
from collections import Counter

import duckdb

from groundwork.llm import variants as sv

DOC = "doc_id long, text string"


def one_edit(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    short, long = sorted((u, v), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, drop=97, least=5, count=3):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= least
    n = {w: c for w, c in n.items() if c >= count}
    near = {w: sorted((x for x in n if one_edit(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: x[0] if x and n[x[0]] >= 2 * n[w] else None for w, x in near.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def run(spark, rows, **kw):
    docs = spark.createDataFrame(rows, DOC)
    return {tuple(r) for r in sv.spelling_variants(docs, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_composition_gives_each_pair_once():
    rng = random.Random(1)
    for t in range(200):
        size = rng.randint(1, 5)
        words = sorted({"".join(rng.choice("ab" if t % 2 else "abcé") for _ in range(rng.randint(0, size))) for _ in range(40)})
        a = sv.Acceptor(words)
        got = [(words[i], words[j]) for i, j in sv.near_pairs(a, a)]
        want = {frozenset((u, v)) for u in words for v in words if one_edit(u, v)}
        assert len(got) == len(want) and {frozenset(p) for p in got} == want
        left = sorted(rng.sample(words, len(words) // 2))
        right = [w for w in words if w not in left]
        got = [(left[i], right[j]) for i, j in sv.near_pairs(sv.Acceptor(left), sv.Acceptor(right))]
        assert sorted(got) == sorted((u, v) for u in left for v in right if one_edit(u, v))


def test_acceptor_is_minimal():
    a = sv.Acceptor(sorted(x + y for x in "abcdef" for y in ("ing", "ed", "")))
    assert len(a.arcs) == 6 and a.words[a.start] == 18  # start, after x, i, n (with e before d apart), end


def test_words_against_brute_force(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abeéÿ×") for _ in range(rng.randint(4, 8))) for _ in range(25)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 30)):
            w = rng.choices(stems, weights=[1 + 4 * (x < 3) for x in range(25)])[0]
            k = rng.randint(0, len(w))
            words.append(rng.choice([w, w.upper(), w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + "a" + w[k + 1 :]]))
        rows.append((i if i % 7 else None, rng.choice([" ", ", ", "1"]).join(words)))
    rows += [(1, None), (2, ""), (3, "中文 12 İ"), rows[0], rows[0], (5, "x" * 100_000 + " "), (6, "x" * 100_000), (6, "x" * 100_000), (7, "x" * 99_999), (7, "x" * 99_999), (8, "x" * 99_999)]
    for drop in (97, 3):
        want = brute(rows, drop)
        assert sum(w[1] is not None for w in want) > 10
        assert run(spark, rows, drop_every=drop) == want
    assert run(spark, rows, block_words=2) == brute(rows)


def test_ties_chains_and_no_words(spark):
    text = " ".join(["house"] * 24 + ["housr"] * 12 + ["hoasr"] * 6 + ["mouse"] * 24 + ["hause"] * 3)
    rows = [(i, w) for i, w in enumerate(text.split())]
    got = {r[0]: r[1:3] for r in run(spark, rows, drop_every=1 << 40)}
    assert got["hoasr"] == ("housr", "house") and got["housr"] == ("house", "house") and got["mouse"] == (None, "mouse")
    assert run(spark, []) == set() and run(spark, [(1, None), (2, "a b c")]) == set()


def test_other_columns_and_many_words_of_one_state(spark):
    docs = spark.createDataFrame([(i, f"prefix{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(26 * 26)] * 3, DOC).selectExpr("*", "1 AS word", "2 AS n", "3 AS state")
    got = sv.spelling_variants(docs, block_words=50, drop_every=1 << 40)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r.n_near for r in got.collect()} == {50} and got.count() == 676


def test_run_checksums_match_the_library():
    import numpy as np

    data = np.frombuffer(b"alpha" + b"z" * 300 + b"q", np.uint8)
    start, end = np.array([0, 5, 305]), np.array([5, 305, 306])
    seed = np.array([zlib.crc32(b"7:"), zlib.crc32(b"8:"), zlib.crc32(b":")], np.uint32)
    assert sv.run_crc(data, start, end, seed).tolist() == [zlib.crc32(x) for x in (b"7:alpha", b"8:" + b"z" * 300, b":q")]


def test_crc_in_sql():
    from groundwork.llm.oracle import crc32_sql

    text = "naïve 中"
    assert duckdb.sql(f"SELECT {crc32_sql('t')} FROM (VALUES ('{text}'), ('')) AS v(t)").fetchall() == [(zlib.crc32(text.encode()),), (0,)]
