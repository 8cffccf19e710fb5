"""Queries and operators whose results or costs went wrong with the size of their tables."""

import datetime

import duckdb
from pyspark.sql import functions as F

from groundwork.operators import registry
from groundwork.plans import discovery, editions


def test_files_meet_each_hint_of_a_folder_once(spark):
    files = spark.createDataFrame([("f", f"{i}_x", f"f/{i}_x") for i in range(50)] + [("g", "only", "g/only")], "folder string, name string, path string")
    rows = [(i, "f", f"{i % 5}_") for i in range(400)] + [(400, "g", None), (401, "g", ""), (402, "f", None), (403, None, "1_"), (404, "none", "")]
    sources = spark.createDataFrame(rows, "id long, folder string, filename_hint string")
    got = registry.local_file(sources, files)
    least = lambda h: min(f"f/{i}_x" for i in range(50) if h in f"{i}_x")
    want = {i: least(f"{i % 5}_") for i in range(400)} | {400: "g/only", 401: "g/only", 402: None, 403: None, 404: None}
    assert {r["id"]: r["path"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") > plan.index("Join LeftOuter")  # files are joined below the sources, to hints


def test_path_order_over_many_ranges(spark):
    n = 60_000
    df = spark.range(0, n, 1, 16).select(F.col("id").alias("page_id"), F.sha2(F.col("id").cast("string"), 256).alias("path"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = discovery.path_order(df).toPandas().sort_values("path")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got["ord"].tolist() == list(range(n))


def test_metrics_round_exact_sums(spark, tmp_path):
    """Sums that lie halfway between two tenths, and times halfway between two hundredths."""
    at = datetime.datetime(2024, 1, 1)
    last = at + datetime.timedelta(microseconds=1_005_000)
    for values in ([0.7, 0.1, 0.05], [0.05, 0.1, 0.7], [1.1, 2.2, 0.05], [2.2, 0.05, 1.1], [0.15, 0.1, 0.1]):
        d = str(tmp_path / "_".join(map(str, values)))
        spark.createDataFrame([(i, last if i else at, i, "view", v, "{}") for i, v in enumerate(values)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        con = duckdb.connect()
        for t in ("events", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
        got = [tuple(r) for r in editions.metrics_page(spark, d).collect()]
        assert got == sorted(con.execute(editions.ORACLE["metrics_page"]).fetchall())
        lines = dict(x.rsplit(" ", 1) for _, x in got)
        tenth = (round(sum(int(v * 100 + 0.5) for v in values)) + 5) // 10
        assert lines["service_http_request_duration_seconds_sum"] == f"{tenth // 10}.{tenth % 10}" and lines["service_uptime_seconds"] == "1.01"


def counted(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_json_and_amendments_are_read_once_per_row(spark):
    from groundwork.functions import web
    from groundwork.plans import versions_web

    assert counted(versions_web.event_normalise(spark, "/root/testdata/sf0.001"), "get_json_object") <= 25
    assert counted(spark.range(1).select(web.newest_amendment(F.col("id").cast("string"), F.lit("x"))), "regexp_extract_all") <= 12


def test_labels_are_read_by_one_search(spark):
    from groundwork.functions import versions as vs

    rows = [("BEK nr 7 af 29/2/2024",), ("bek NR 7 af 29/2/2023",), ("BEK nr 7 af 31/12/49",), ("BEK nr 7 af 1/1/50",), ("BEK nr 7 af 0/1/2000",), ("BEK nr 7 af 1/13/2000",), ("x",), ("",), (None,)]
    df = spark.createDataFrame(rows, "label string")
    got = [r[0] and (str(r[0]["issue_date"]), r[0]["nr"]) for r in df.select(vs.label_date_nr(F.col("label"))).collect()]
    assert got == [("2024-02-29", 7), None, ("2049-12-31", 7), ("1950-01-01", 7), None, None, None, None, None]
    assert counted(df.select(vs.label_date_nr(F.col("label")).alias("d")), "regexp_extract(") <= 4


def test_reachable_equals_a_walk(spark):
    """Chains, a cycle through a start, diamonds, repeated edges and loose ends; met nodes are not shuffled on chains."""
    from groundwork.operators import lineage

    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (20, 21), (20, 22), (21, 23), (22, 24), (24, 23), (23, 25), (25, 21), (30, 31), (30, 31), (None, 5), (40, None), (50, 50)]
    starts, to = [1, 3, 10, 20, 30, 40, 50, 24, 60], {}
    for a, b in edges:
        if a is not None and b is not None:
            to.setdefault(a, set()).add(b)
    for most in (12, 2):
        want = set()
        for s in starts:
            met, front = {s: 0}, {s}
            for d in range(1, most + 1):
                front = {b for a in front for b in to.get(a, ())} - set(met)
                met |= dict.fromkeys(front, d)
            want |= {(s, n, d) for n, d in met.items()}
        got = lineage.reachable(spark.createDataFrame([(s,) for s in starts], "start long"), spark.createDataFrame(edges, "src long, dst long"), most)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_chunks_leave_a_task_in_parts(spark, monkeypatch):
    import pyarrow as pa

    from groundwork.sources import chunking

    monkeypatch.setattr(chunking, "PART_CHARS", 6000)
    run = {}
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: run.setdefault("f", f))
    chunking.split_documents(df, "text")
    texts = ["word " * 2000, None, "", "short", "word " * 3000]
    out = list(run["f"](iter([pa.RecordBatch.from_pydict({"id": list(range(5)), "text": texts})])))
    assert len(out) > 3 and max(b.num_rows for b in out) <= 5
    want = [(i, n, c) for i, t in enumerate(texts) for n, c in enumerate(chunking.split_text(t or ""))]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want
