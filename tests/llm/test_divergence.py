import random
import re
from collections import Counter

import pytest

from groundwork.llm import divergence as dv

DOC = "text string, lang string, source string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, min_docs=10, top=10, scale=10**9):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        own = [(s, Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t)))) for t, x, s in rows if x == lang]
        df = Counter(w for _, c in own for w in c)
        kept = sorted(w for w in df if df[w] >= min_docs)
        count = {s: Counter() for s, _ in own}
        for s, c in own:
            count[s].update({w: c[w] for w in kept if w in c})
        whole = sum(count.values(), Counter())

        def p(c, w):
            return 1 + scale * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))

        def f(a, b, w):
            return (p(a, w) - p(b, w)) ** 2 // (p(a, w) + p(b, w))

        for s in count:
            pair = [(o, sum(f(count[s], count[o], w) for w in kept)) for o in count if o != s]
            term = [(w, f(count[s], whole, w)) for w in kept if count[s][w] and p(count[s], w) > p(whole, w)]
            for part, found, most in (("pair", pair, 1 << 60), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, k) for k, (item, v) in enumerate(ranked, 1) if k <= most}
    return out


def run(spark, rows, **kw):
    return {tuple(r) for r in dv.divergence(spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS n", "2 AS term", "'x' AS value"), **kw).collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = [w for w in ["alpha", "Beta", "gamé", "中文", "İx", "delta", "eps", "zeta", "eta", "theta", "iota", "k9k"]]
    texts = [" ".join(rng.choices(vocab, weights=range(1, 13), k=rng.randint(0, 25))) for _ in range(40)]
    return [(rng.choice(texts), rng.choice(["en", "en", "de"]), rng.choice("abcdef")) for _ in range(300)]


def test_against_brute_force(spark, rows):
    odd = [(None, "en", "a"), ("", None, None), ("alpha", None, "a"), ("1 2 3", "fr", "x"), ("alpha", "fr", "y"), ("eta", "en", "only"), ("!", "en", "bare"), ("solo", "it", "one")]
    assert run(spark, rows + odd) == brute(rows + odd)
    assert run(spark, rows, min_docs=1, top=3) == brute(rows, 1, 3)


def test_hot_text_over_many_sources_and_blocks(spark, rows):
    hot = [("alpha beta beta", "en", f"s{i % 37}") for i in range(2000)]
    want = brute(rows + hot)
    assert run(spark, rows + hot) == want
    assert run(spark, rows + hot, block_terms=3, block_sources=5) == want


def test_small_slices_give_the_same_counts(rows):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in (1, 2, 0)], ["lang", "source", "text"])
    want = Counter()
    for t, lang, s in rows:
        for w, n in Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))).items():
            want[lang, s, w, "n"] += n
            want[lang, s, w, "df"] += 1
    for size, counts in ((8 << 20, 4_000_000), (50, 7)):
        dv.SLICE_BYTES, dv.SLICE_COUNTS, before = size, counts, (dv.SLICE_BYTES, dv.SLICE_COUNTS)
        try:
            halves = [b for part in (batch.slice(0, 150), batch.slice(150)) for b in dv.fold(iter([part]))]
            folded = pa.Table.from_batches(halves).sort_by([("lang", "ascending"), ("digest", "ascending")]).combine_chunks()
            got = Counter()
            for b in dv.count_terms(iter(folded.to_batches(max_chunksize=9))):
                for r in b.to_pylist():
                    if r["term"] is not None:
                        got[r["lang"], r["source"], r["term"], "n"] += r["n"]
                        got[r["lang"], r["source"], r["term"], "df"] += r["df"]
            assert got == want
        finally:
            dv.SLICE_BYTES, dv.SLICE_COUNTS = before


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    n, total, v = 3 * 10**12 + 7, 9 * 10**14 + 1, 12345
    got = spark.range(1).select(dv.share(F.lit(n).cast("long"), F.lit(total).cast("long"), F.lit(v).cast("long"), 10**9).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOC)
    assert dv.divergence(docs).count() == 0
    docs = spark.createDataFrame([(None, None, None)] * 3, DOC)
    assert dv.divergence(docs).count() == 0
