import random
import re

import numpy as np

from groundwork.llm import decontaminate as dc, mixing, url_filter as uf

DOC = "doc_id long, text string, n_hit string"


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, bench):
    out = []
    for i, t, _ in docs:
        w, hit, items = words(t), set(), set()
        for item, text in bench:
            b = words(text)
            m = min(10, len(b))
            for k in range(len(b) - m + 1 if m else 0):
                for at in range(len(w) - m + 1):
                    if w[at : at + m] == b[k : k + m]:
                        hit |= set(range(at, at + m))
                        if item is not None:
                            items.add(str(item))
        out.append((i, len(w), len(hit), tuple(sorted(items))))
    return sorted(out, key=str)


def case(seed):
    rng = random.Random(seed)
    v = ["a", "b", "c", "dé", "e1", "漢", "F"]
    bench = [(i, " ".join(rng.choices(v, k=rng.choice([0, 1, 2, 5, 10, 14])))) for i in range(8)] + [(3, None), (None, " ".join(v * 2)), (10, "x-y"), (2, "zz")]
    docs = []
    for i in range(60):
        t = rng.choices(v, k=rng.randint(0, 40))
        if i % 3 == 0:
            t[5:5] = bench[rng.randrange(8)][1].upper().split()
        docs.append((i, rng.choice([" ", "-", "\n"]).join(t), "z"))
    return docs + [(1, None, None), (None, "", None), (7, "x y " * 2000, None), (7, "x y " * 2000, None)], bench


def run(spark, docs, bench, **kw):
    df = dc.decontaminate(spark.createDataFrame(docs, DOC), spark.createDataFrame(bench, "item_id long, text string"), **kw)
    assert df.columns == ["doc_id", "text", "n_words", "n_hit", "spans", "items"]
    rows = df.collect()
    assert all(r["n_hit"] == sum(s["last"] - s["first"] + 1 for s in r["spans"]) for r in rows)
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows), key=str)


def test_search_equals_brute_force(spark):
    for seed in (1, 2):
        docs, bench = case(seed)
        assert run(spark, docs, bench) == brute(docs, bench)


def test_blocks_change_nothing(spark):
    docs, bench = case(3)
    assert run(spark, docs, bench, block_bytes=40) == brute(docs, bench)


def test_empty_sides(spark):
    docs, bench = case(4)
    assert all(r[2] == 0 for r in run(spark, docs, [])) and run(spark, [], bench) == []


def test_most_positions_are_skipped_at_any_size():
    rng = np.random.default_rng(0)
    letters = [a + b + c for a in "bcdfghklmn" for b in "aeiou" for c in "bcdfghklmnprst"]
    text = lambda n: " ".join(rng.choice(letters, n) + rng.choice(letters, n))
    for n_items in (100, 4000):
        items = [(str(i), text(40)) for i in range(n_items)]
        table = dc.Patterns(items, 10).tables[0]
        raw = [text(5000).encode(), (items[7][1] + " zz " + text(50)).encode()]
        w = dc.bt.words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), dc.bt.byte_class("alnum"))
        end, window = table.search(w)
        assert len(end) == 31 and set(table.items[table.items_at[window]]) == {sorted(i for i, _ in items).index("7")}
        assert table.looked < 0.25 * len(w.hash)
        held = sum(x.nbytes for x in vars(table).values() if isinstance(x, np.ndarray))
        assert held < 30 * sum(len(t) for _, t in items) + (1 << 20)


def test_windows_shared_by_many_items_and_equal_ends():
    passage = " ".join(f"p{k}" for k in range(10))
    items = [(str(i), f"start{i} one {passage}") for i in range(300)] + [(str(1000 + i), " ".join(f"q{i}x{k}" for k in range(7)) + " p7 p8 p9") for i in range(300)]
    raw = f"a b {passage} c " + items[450][1]
    w = dc.bt.words(np.frombuffer(raw.encode(), np.uint8), np.array([0, len(raw)]), dc.bt.byte_class("alnum"))
    p = dc.Patterns(items, 10)
    first, last, named = p.occurrences(w)
    assert sorted(zip(first.tolist(), last.tolist())) == [(2, 11), (13, 22)]
    assert {p.names[k] for _, own in named for k in own} == {str(i) for i in range(300)} | {"1150"}


def test_url_rules(spark):
    cases = {
        "http://a.example.net/x": ("net/", "block"), "https://EXAMPLE.net/en/1?q": ("example.net/en/", "allow"), "http://example.net/en": ("net/", "block"),
        "http://m.example.com/de/2#x": ("example.com/de/", "block"), "http://notexample.com/de/": (None, "allow"), "http://x.org/fr/": ("org/fr/", "allow"),
        "http://net": (None, "allow"), "http://spam-farm.org/a": (None, "block"), "no scheme": (None, "allow"), None: (None, "allow"), "": (None, "allow"),
        "http://net/" + "a" * 50000: ("net/", "block"), "x://y://net/": (None, "allow"), "http://a\nb.net/": ("net/", "block"),
    }
    rows = [(i, u, "old") for i, u in enumerate(cases)] + [(0, "http://a.example.net/x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = uf.GIVEN_RULES + uf.METHOD_RULES
    cases |= {
        "http://10.0.0.7:8080/x": (None, "block"), "http://a.org/x/Casino-night": (None, "block"), "http://a.org/?a=1&PHPSESSID=2": (None, "block"),
        "http://a.org/casinos?q=casino": (None, "allow"), "http://a.org/wp-login.php": (None, "block"), "http://a.org/fr/setup.EXE": ("org/fr/", "allow"),
    }
    rows += [(100 + i, u, "old") for i, u in enumerate(list(cases)[-6:])]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    for bound in (2000, 1):
        out = uf.judge_urls(df, rules, max_inline_rules=bound)
        assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and out.count() == len(rows)
        for r in out.collect():
            assert (r["rule"], r["verdict"]) == cases[r["url"]], r
    assert uf.judge_urls(df.where("false"), rules).count() == 0
    assert {r["verdict"] for r in uf.judge_urls(df, ()).collect()} == {"allow"}


def test_rules_stand_under_the_token_that_is_rarest_in_urls(spark):
    rule = uf.host_rule("block", "shop.example.com", "/deals/")
    index = uf.rarest_index([rule], {"shop": 2, "example": 90, "com": 100, "deals": 50})
    assert list(index) == ["shop"]
    urls = spark.createDataFrame([(f"http://a.example.com/deals/{i}",) for i in range(5)] + [("http://shop.example.com/",)], "url string")
    tokens = urls.select(uf.url_tokens(uf.host_of(urls.url), uf.path_of(urls.url), uf.query_of(urls.url)).alias("tokens"))
    for bound in (1000, 0):
        assert uf.count_tokens_of([rule], tokens, bound) == {"shop": 1, "example": 6, "com": 6, "deals": 5}


def test_equal_weights_go_to_the_last_name(spark):
    rules = [uf.Rule(n, v, r"\Aa\.org\z", "", ("org",), 5) for n, v in (("one", "block"), ("two", "allow"))]
    df = spark.createDataFrame([("http://a.org/",)], "url string")
    for bound in (10, 0):
        for order in (rules, rules[::-1]):
            r = uf.judge_urls(df, order, max_inline_rules=bound).first()
            assert (r["rule"], r["verdict"]) == ("two", "allow")


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 60)), f"s{min(rng.randrange(9), 4)}", "t") for i in range(3000)]
    rows += [(None, "a b", None, "t"), (None, None, "s0", "t"), (1, "  ", "empty", "t"), (2, "x " * 5000, None, "t"), (2, "x " * 5000, None, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    a = mixing.mix(df)
    assert a.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies"]
    got = a.collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect())) and len(got) == len(rows)
    per = {}
    for r in got:
        x = per.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        x[2] += r["copies"] * r["size"]
        x[3] += r["size"]
        assert r["copies"] <= 2
    total = sum(x[0] for x in per.values())
    assert abs(sum(x[1] for x in per.values()) - 1.5 * total) < 1e-6 * total
    for s, (size, target, taken, own) in per.items():
        assert size == own and target <= 2 * size + 1e-6
        if s not in (None, "empty"):
            assert abs(taken - target) < 0.1 * max(target, 1)
    # Weights 5, 2, 1 in code point order, null last: uncapped sources share in these ratios.
    names = sorted(k for k in per if k is not None) + [None]
    level = {per[n][1] / (5, 2, 1)[i % 3] for i, n in enumerate(names) if per[n][1] < 2 * per[n][0] - 1e-6}
    assert max(level) - min(level) < 1e-6 * max(level)
    n = a.agg({"copies": "sum"}).first()[0]
    assert mixing.repeat_rows(a, df.columns[:3]).count() == n
    assert mixing.mix(df.where("false")).count() == 0
