import random
import re

from groundwork.sources import hybrid

ROW = "k long, pos int, level int, text string"


#: A counter of tokens of a small vocabulary, syllables of two letters; tasks get it by value.
words = lambda: lambda texts: [sum(-(-len(w) // 2) for w in t.split()) for t in texts]


def brute(rows, most):
    """Chunks by trying every length, and the rules on them."""
    count = words()
    out = {}
    for k in sorted({r[0] for r in rows if r[0] is not None}):
        path, held, done = [], None, []

        def size(t, h):
            return count(["\n".join([*h, t])])[0]

        def fitting(h):
            while h and size("", h) > most // 2:
                h = h[1:] if len(h) > 1 else [h[0][: len(h[0]) // 2]] if len(h[0]) > 1 else []
            return h

        def split(t, h):
            if size(t, h) <= most:
                return [t]
            parts = next(p for p in (re.split(r"(?<=[.!?])\s+", t), t.split(), list(t)) if len(p) > 1)
            joint = " " if " " in t else ""
            found = []
            while parts:
                n = max([i for i in range(1, len(parts) + 1) if size(joint.join(parts[:i]), h) <= most] or [1])
                part = joint.join(parts[:n])
                found += split(part, h) if n == 1 and size(part, h) > most and len(part) > 1 else [part]
                parts = parts[n:]
            return found

        for _, _, level, text in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            text = " ".join((text or "").split())
            if not text:
                continue
            h = fitting([x for _, x in path])
            if level:
                if held is not None:
                    done.append((h, held))
                held = None
                path = [(n, x) for n, x in path if n < level] + [(level, text)]
                continue
            for piece in split(text, h):
                joined = piece if held is None else f"{held}\n{piece}"
                if held is not None and size(joined, h) > most:
                    done.append((h, held))
                    joined = piece
                held = joined
        if held is not None:
            done.append((fitting([x for _, x in path]), held))
        out[k] = [(h, c, size(c, h)) for h, c in done]
    return {(k, i, tuple(h), c, n) for k, v in out.items() for i, (h, c, n) in enumerate(v)}


def test_chunks_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for k in range(30):
        for pos in range(rng.randint(0, 25)):
            level = rng.choice([0, 0, 0, 1, 2, 3])
            n = rng.randint(1, 3) if level else rng.randint(1, 60)
            rows.append((k, pos, level, " ".join(rng.choice(["ab", "abcd", "x.", "word", "a" * 9, "end!"]) for _ in range(n))))
    rows += [(50, 0, 0, None), (50, 1, 0, "  "), (50, 2, 1, "only a heading"), (51, 0, 0, "z" * 500), (None, 0, 0, "no key")]
    df = spark.createDataFrame(rows, ROW).selectExpr("*", "'c' AS chunk", "1 AS ord")
    for most in (40, 17):
        got = hybrid.hybrid_chunks(df, "k", words, most).collect()
        assert {(r["k"], r["ord"], tuple(r["headings"]), r["chunk"], r["tokens"]) for r in got} == brute(rows, most)
        assert all(r["tokens"] <= most for r in got)
    assert hybrid.hybrid_chunks(df.limit(0), "k", words).count() == 0


def test_vocabulary_and_long_headings(spark):
    import public_tokenizers

    count = hybrid.vocabulary_counter(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, 0, 1, "Doses"), (1, 1, 2, "limits " * 300), (1, 2, 0, "The limit is <|endoftext|> 20 mSv. " * 80), (1, 3, 0, "中文" * 400)]
    got = hybrid.hybrid_chunks(spark.createDataFrame(rows, ROW), "k", count, 100).orderBy("ord").collect()
    assert len(got) > 10 and all(0 < r["tokens"] <= 100 for r in got)
    assert all(count()(["\n".join([*r["headings"], r["chunk"]])])[0] == r["tokens"] for r in got)
    assert "".join("".join(r["chunk"] for r in got).split()) == "".join((rows[2][3] + rows[3][3]).split())


def folded(fold, count, blocks, most):
    state = fold(count, most)
    steps = [state.heading(level, text) if level else state.text(text) for level, text in blocks]
    return [(list(h), c, n) for step in [*steps, state.end()] for h, c, n in step]


def test_counts_that_add_up_give_the_same_chunks():
    """The fold on sums beside the one that counts what is joined, on texts with odd borders; it reads a text
    a few times at most."""
    import public_tokenizers

    count = hybrid.vocabulary_counter(public_tokenizers.path("byte_bpe_50k.json"))()
    assert count.adds
    words = ["the", "limit.", "mSv's", "'s", "don't", "中文", "<|endoftext|>", "!!", "x" * 50, "$$$", "é.###", "Q?", "🙂", "\u0301", "\u200b", "\ufeff", "12.5%", "z" * 700]
    rng = random.Random(3)
    for most in (8, 17, 40, 512):
        for _ in range(12):
            blocks = [(level, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 60] if level else [1, 3, 20, 200])))) for level in rng.choices([0, 0, 0, 1, 2, 3], k=rng.randint(1, 20))]
            assert folded(hybrid._Sums, count, blocks, most) == folded(hybrid._Chunks, count, blocks, most)
    blocks = [(0, "The limit is 20 mSv. " * n) for n in [2] * 200 + [2000]]
    read = {}
    for fold in (hybrid._Sums, hybrid._Chunks):
        folded(fold, lambda texts: read.update({fold: read.get(fold, 0) + sum(map(len, texts))}) or count(texts), blocks, 512)
    assert read[hybrid._Sums] < 3 * sum(len(t) for _, t in blocks) < read[hybrid._Chunks]


def test_other_vocabularies_count_what_is_joined(tmp_path):
    import json

    import public_tokenizers

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "use_regex": False}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}, {"pre_tokenizer": None},
                   {"added_tokens": [{**spec["added_tokens"][0], "special": False}]}):
        path = tmp_path / "v.json"
        path.write_text(json.dumps({**spec, **change}), encoding="utf-8")
        assert not hybrid.counts_add(str(path))
