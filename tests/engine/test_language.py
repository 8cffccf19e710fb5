from collections import Counter

from groundwork.operators import language

ROW = "doc_id long, text string, lang string"


def grams(t):
    t = " " + " ".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).split()) + " "
    return [t[i : i + 3] for i in range(len(t) - 2)]


def test_profiles_and_languages_equal_brute_force(spark):
    rows = [(1, "the house and the garden, the sea", "en"), (2, "der Garten und das Haus über dem Meer", "de"), (3, "la maison et le jardin à côté", "fr"),
            (4, "The SEA!", None), (5, "über das Meer", None), (6, None, "en"), (7, "", None), (8, "12 34", None), (9, "à côté", None), (9, "à côté", None), (None, "garden", None), (10, "日本 語", None)]
    df = spark.createDataFrame(rows, ROW)
    for top in (300, 5):
        known = language.profiles(df, top=top)
        want = {}
        for lang in ("en", "de", "fr"):
            n = Counter(g for _, t, x in rows if x == lang for g in grams(t) if t is not None)
            order = sorted(n, key=lambda g: (-n[g], g.encode()))[:top]
            want |= {(lang, g): top - i for i, g in enumerate(order)}
        assert {(r["lang"], r["gram"]): r["points"] for r in known.collect()} == want

        def best(t):
            score = Counter()
            for g in grams(t) if t is not None else []:
                for lang in ("de", "en", "fr"):
                    score[lang] += want.get((lang, g), 0)
            top_score = max(score.values(), default=0)
            return min((x for x in score if score[x] == top_score), default="en") if top_score else "en"

        got = {r["doc_id"]: r["lang"] for r in language.detected(df.withColumn("gram", df["text"]), known, "doc_id").collect()}
        assert got == {i: best((t or "") * (1 if i != 9 else 1)) for i, t, _ in rows}
    assert language.detected(df.limit(0), known, "doc_id").count() == 0 and language.profiles(df.limit(0)).count() == 0


def test_tasks_count_sequences_and_both_ways_agree(spark, monkeypatch):
    rows = [(i, f"{'der Garten' if i % 2 else 'the garden'} {chr(97 + i % 26)} 日本 x𝒳y " * (i % 9), ("de" if i % 2 else "en") if i % 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, ROW)
    known = language.profiles(df)
    quick = language.detected(df, known, "doc_id")
    for plan in (known, quick):
        assert "Generate" not in plan._jdf.queryExecution().optimizedPlan().toString()  # no row for every character
    monkeypatch.setattr(language, "MAX_BROADCAST", 10)
    slow = language.detected(df, known, "doc_id")
    assert "Generate" in slow._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(quick.collect()) == sorted(slow.collect())


def test_parts_lose_no_sequence():
    texts = [" abcdefghij ", None, "", "ab", " 日本語𝒳 ", "  ", " x " * 7]
    want = Counter((i, t[j : j + 3]) for i, t in enumerate(texts) if t for j in range(len(t) - 2))
    for most, rows in ((1, 9), (3, 9), (4, 1), (10, 2), (99, 99)):
        got = Counter()
        for of, held in language._parts(iter(texts), most, rows):
            codes, at = language._codes(held)
            assert len(held) <= rows and len(codes) <= 2 * most
            got.update(zip(of[at].tolist(), language._grams(codes).tolist()))
        assert got == want
