"""Retries, throttles, structured chunks."""

import pytest
from pyspark.sql import functions as F

from groundwork.functions import errors
from groundwork.sources import chunking


def test_calls_are_tried_again():
    seen, waited = [], []

    def call(x):
        seen.append(x)
        if len(seen) < 3:
            raise OSError("429 slow down")
        return x

    assert errors.retried(call, sleep=waited.append)(7) == 7 and waited == [1.0, 3.0]

    def broken():
        seen.append("b")
        raise ValueError("other")

    with pytest.raises(ValueError):
        errors.retried(broken, errors.RATE_WAITS, errors.rate_limited, waited.append)()
    assert seen.count("b") == 1 and waited == [1.0, 3.0]
    with pytest.raises(ValueError):
        errors.retried(broken, sleep=waited.append)()
    assert seen.count("b") == 4


def test_throttle_keeps_the_interval():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    t = errors.Throttle(10, clock=lambda: now[0], sleep=sleep)
    t.wait()
    now[0] += 4
    t.wait()
    now[0] += 30
    t.wait()
    assert slept == [6.0]


def test_structured_chunks_stay_within_limit_and_heading(spark):
    html = "<h1> One </h1><p>" + "a " * 130 + "</p><p>b c</p><h2>Two</h2><li>d</li><p> </p>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "plain")], "k int, html string").select("k", F.posexplode(chunking.html_blocks(F.col("html"))).alias("pos", "b")).select("k", "pos", "b.*")
    rows = chunking.structured_chunks(df, "k", 60).orderBy("section", "part").collect()
    assert all(r["tokens"] <= 60 for r in rows) and {r["heading"] for r in rows if r["section"] == 1} == {"One"}
    assert " ".join(r["chunk"] for r in rows if r["section"] == 1).split() == ["a"] * 130 + ["b", "c"]
    assert [(r["heading"], r["chunk"]) for r in rows if r["section"] == 2] == [("Two", "d")] and {r["k"] for r in rows} == {1}


def test_documents_and_caches(spark, tmp_path):
    from groundwork.functions import documents as dc
    from groundwork.sources import files

    m = spark.range(1).select(F.parse_json(F.lit('{"source": "s", "headings": ["a", "b"], "deep": {"x": 1}}')).alias("v")).select(dc.plain_metadata(F.col("v")).alias("m")).first()["m"]
    assert (m["source"], m["headings"], m["num_pages"]) == ("s", ["a", "b"], None)
    assert spark.range(1).select(dc.from_text(F.lit("no json"))).first()[0] in ([], [None])
    golden = spark.createDataFrame([("b", 1), ("a", 0)], "id string, ord int")
    files.write_cache(spark.createDataFrame([("a", "x")], "id string, generation string"), f"{tmp_path}/c", "g", "1")
    cache = spark.read.parquet(f"{tmp_path}/c")
    got = files.with_cache(golden, files.valid_cache(cache, "g", "1"))
    assert [(r["id"], r["generation"]) for r in files.in_order(got.drop("ord"), golden).collect()] == [("a", "x"), ("b", None)]
    assert files.with_cache(golden, files.valid_cache(cache, "g", "2")).where("generation IS NOT NULL").count() == 0
    assert [r["id"] for r in files.first_items(golden, 1).collect()] == ["a"]
    for _ in range(2):
        files.trail(golden, f"{tmp_path}/t")
    assert spark.read.json(f"{tmp_path}/t").count() == 4
