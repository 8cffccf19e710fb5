import random

import pytest
from pyspark.sql import functions as F

from groundwork.operators import limits
from groundwork.streaming import streams

ROW = "user_id long, event_id long, m long"


def plain(rows, width, limit, last=None):
    last, out = dict(last or {}), {}
    for user, event, m in sorted(rows, key=lambda r: (r[0] or -1, r[2], r[1])):
        start, n = last.get(user, (None, 0))
        if start is None or m - start >= width:
            start, n = m, 0
        last[user] = start, n + 1
        over = n + 1 > limit
        out[event] = (n + 1, 429 if over else 200, max(1, (width - (m - start)) // 1_000_000) if over else None)
    return out, last


def some(seed, n, at, until):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, None]), i + at, rng.randrange(at * 1_000_000, until * 1_000_000)) for i in range(n)]
    return [(u, i, m // 3_000_000 * 3_000_000 if u == 2 else m) for u, i, m in rows]


def got(df):
    return {r["event_id"]: (r["n_in_window"], r["status"], r["retry_after"]) for r in df.collect()}


@pytest.mark.parametrize("span_rows", [1_000_000, 40, 3])
def test_spans_equal_the_fold(spark, span_rows):
    rows = some(1, 700, 0, 900) + [(9, 5000 + i, 7_000_000 * i) for i in range(90)] + [(8, 6000 + i, 5 * i) for i in range(80)] + [(8, 6100, 10**12)]
    df = spark.createDataFrame(rows, ROW).repartition(3)
    assert got(limits.anchored_limit(df, "user_id", F.col("m"), "event_id", 10, 3, span_rows=span_rows)) == plain(rows, 10_000_000, 3)[0]


def test_a_hot_key_is_not_one_row(spark):
    """One key's whole history as one array took a time that grew with its square."""
    df = spark.range(300_000).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("event_id"), (F.col("id") * 500_000).alias("m"))
    out = limits.anchored_limit(df, "user_id", F.col("m"), "event_id", 60, 20, span_rows=20_000)
    assert out.groupBy("n_in_window").count().agg(F.min("count"), F.max("count"), F.count("*")).first()[:] == (2500, 2500, 120)


def test_open_windows_go_on(spark, tmp_path):
    first, then = some(2, 300, 0, 300), some(3, 300, 300, 700)
    want, last = plain(first, 10_000_000, 3)
    state = spark.createDataFrame([(u, s, n) for u, (s, n) in last.items()], "user_id long, start long, n int")
    df = spark.createDataFrame(then, ROW)
    for span_rows in (1_000_000, 20):
        assert got(limits.anchored_limit(df, "user_id", F.col("m"), "event_id", 10, 3, state=state, span_rows=span_rows)) == plain(then, 10_000_000, 3, last)[0]
    for i, part in enumerate((first, then)):
        spark.createDataFrame(part, ROW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i == 0:
            import time
            time.sleep(1.1)
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("time", F.timestamp_micros("m"))
    out = streams.run_anchored(stream, 10, 3)
    want |= plain(then, 10_000_000, 3, last)[0]
    assert {r["event_id"]: (r["n_in_window"], r["status"]) for r in out.collect()} == {k: v[:2] for k, v in want.items()}
