import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from groundwork.llm.token_counts import PrefixCounter, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  a", "a  ", "\n\n x\t\t", "don't we'll I'M they're ''s", "x" * 3000, "-" * 700, "é" * 50, "汉字かな交じり文 한국어",
    "a<|endoftext|>b", "<|endoftext|>", "\u0085  x ᠎ \x1c\x1d y", "0123 ４５ ²½ ٣", "👩‍👩‍👧‍👦 family", "﻿bom\x00\x01", "á̧ ǅ ª º",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_match_the_library(library):
    rng = random.Random(5)
    of = PrefixCounter(PATH)
    alphabet = "abcdefgh ETAOIN'.,-_=\n\t0123456789éüß漢字  👍"
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        assert of.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_every_code_point_is_cut_alike(library):
    of = PrefixCounter(PATH)
    for block in range(0, 0x30000, 64):
        t = "".join(f"a{chr(c)}1" for c in range(block, block + 64) if not 0xD800 <= c < 0xE000)
        if of.count(t) != len(library.encode(t, add_special_tokens=False).ids):
            bad = [hex(c) for c in range(block, block + 64) if of.count(f"a{chr(c)}1") != len(library.encode(f"a{chr(c)}1", add_special_tokens=False).ids)]
            raise AssertionError(bad)


def test_prefix_counts_of_a_piece(library):
    of = PrefixCounter(PATH)
    for piece in [" internationalization", "antidisestablishmentarianism", "zzzzzzzzzzzz", " thorreou"]:
        got = of.prefixes(piece.encode())
        assert got == [len(library.encode(piece[:i], add_special_tokens=False).ids) for i in range(len(piece) + 1)]


def test_fit_stays_within_the_budget(library):
    of = PrefixCounter(PATH)
    text = "The internationalization of thorreou, ndernt; 12345 re."
    for budget in range(25):
        n = of.fit(text, [budget])[0]
        assert len(library.encode(text[:n], add_special_tokens=False).ids) <= budget


def test_operator_keeps_columns_and_nulls(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "hello world", None), (None, "hello world", "z")]
    df = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, budgets=[1])
    got = sorted(map(tuple, df.collect()), key=str)
    assert df.columns == ["doc_id", "text", "n_bytes", "n_tokens", "fits"]
    assert (1, None, 0, 0, [0]) in got and (2, "hello world", 11, 2, [5]) in got and len(got) == 4
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_other_vocabulary_files_are_refused(tmp_path):
    import json

    spec = json.load(open(PATH))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"id": 1, "content": "[X]", "special": False}]}):
        p = tmp_path / "v.json"
        p.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            PrefixCounter(str(p))


def test_special_tokens_of_any_spelling(tmp_path):
    import json

    spec = json.load(open(PATH))
    added = [dict(spec["added_tokens"][0], content="[PAD]")]
    spec["model"]["vocab"] = {("[PAD]" if k == "<|endoftext|>" else k): v for k, v in spec["model"]["vocab"].items()}
    p = tmp_path / "pad.json"
    p.write_text(json.dumps(spec | {"added_tokens": added}))
    of, library = PrefixCounter(str(p)), Tokenizer.from_file(str(p))
    for t in ("a[PAD]b", "[PAD][PAD] x", "[PA D]", "<|endoftext|>"):
        assert of.count(t) == len(library.encode(t, add_special_tokens=False).ids), t
