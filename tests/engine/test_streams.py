"""Feeds, states and limits that go on after a restart."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from groundwork.operators.registry import upsert
from groundwork.operators.state import StateTable
from groundwork.sources import harvest
from groundwork.streaming import arrivals, streams

ROW = "user_id long, event_id long, m long"


@pytest.fixture()
def feed():
    """A provider that notes its calls; the second day fails as often as ``fail`` says."""
    seen, fail = [], [0]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            day = self.path.strip("/")
            seen.append((time.time(), day))
            broken = day == "2024-03-09" and fail[0] > 0
            fail[0] -= broken
            self.send_response(500 if broken else 200)
            self.end_headers()
            if not broken:
                self.wfile.write(json.dumps([{"id": day}]).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/{{date}}", seen, fail
    server.shutdown()


def test_calls_keep_their_distance(spark, feed, tmp_path):
    url, seen, _ = feed
    slot = str(tmp_path / "slot")
    for last, today in (("2024-03-07", "2024-03-10"), ("2024-03-10", "2024-03-11")):
        got = harvest.harvest(spark, url, last=last, today=today, interval=1.0, slot=slot)
        assert got.count() == len(harvest.window(last, harvest.date.fromisoformat(today)))
    assert [d for _, d in seen] == ["2024-03-08", "2024-03-09", "2024-03-10", "2024-03-11"]
    assert min(b[0] - a[0] for a, b in zip(seen, seen[1:])) >= 0.8  # across runs, too; the server sees a call a little after it is made


def test_a_failed_day_comes_again(spark, feed, tmp_path):
    url, seen, fail = feed
    fail[0] = 1
    spark.dataSource.register(harvest.HarvestSource)

    def run():
        s = spark.readStream.format("harvest").option("path", url).option("interval", "0").option("last", "2024-03-07").option("today", "2024-03-10").load()
        q = s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start(str(tmp_path / "out"))
        q.awaitTermination()

    with pytest.raises(Exception, match="500"):
        run()
    run()
    days = [r["day"] for r in spark.read.schema(harvest.SCHEMA).parquet(str(tmp_path / "out")).orderBy("day").collect()]
    assert days == ["2024-03-08", "2024-03-09", "2024-03-10"]
    assert [d for _, d in seen].count("2024-03-09") == 2


def merged(state, changes):
    return upsert(state, changes, "id", "at")


def test_state_by_buckets(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "id long, version string, at long")
    t = StateTable(spark, str(tmp_path / "t"), frame([]).schema, "id", 8)
    rows = lambda: {r["id"]: r["version"] for r in t.read().collect()}
    assert rows() == {} and t.merge(frame([(i, "a", 1) for i in range(40)] + [(None, "n", 1)]), merged, 0)
    first = t.entry()
    assert t.merge(frame([(3, "b", 2)]), merged, 1) and rows() == {**{i: "a" for i in range(40)}, 3: "b", None: "n"}
    moved = {b for b, v in t.entry()["buckets"].items() if v != first["buckets"][b]}
    assert len(moved) == 1  # one key, one bucket written
    assert not t.merge(frame([(3, "late", 9)]), merged, 1) and rows()[3] == "b"  # the batch is done
    # A crash between write and commit: the table is as before, and the next merge writes over the rest.
    commit = StateTable._commit
    StateTable._commit = lambda *_: (_ for _ in ()).throw(OSError("lost"))
    try:
        with pytest.raises(OSError):
            t.merge(frame([(4, "lost", 5)]), merged, 2)
    finally:
        StateTable._commit = commit
    assert rows()[4] == "a" and t.merge(frame([(4, "c", 5), (500, "d", 1)]), merged, 2) and rows()[4] == "c" and rows()[500] == "d"
    t.merge(frame([(4, "e", 6)]), lambda state, _: state.where("id <> 4"), 3)
    assert 4 not in rows()
    t.vacuum(1)
    assert t.versions() == [4] and len(rows()) == 41
    with pytest.raises(RuntimeError):
        t._commit({"version": 4, "batch": 9, "buckets": {}})


def test_sync_goes_on_and_keeps_its_state(spark, tmp_path):
    schema = "id long, version string, at long"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([(1, "a", 1), (2, "b", 1)])

    def run():
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        got = streams.run_sync(s, str(tmp_path / "state"), merged, spark.createDataFrame([(9, "old", 0)], schema), buckets=4)
        return {r["id"]: r["version"] for r in got.collect()}

    want = {1: "a", 2: "b", 9: "old"}
    assert run() == want and run() == want  # nothing new: the state stays
    put([(2, "c", 2)])
    assert run() == {**want, 2: "c"}


def requests(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(path).withColumn("time", F.timestamp_micros("m"))


def test_limits_as_requests_arrive(spark, tmp_path):
    s, at = 1_000_000, 500  # the first watermark is 0
    first = [(1, i, (at + i) * s) for i in range(5)] + [(u, 100 + u, (at + u) * s) for u in range(2, 12)] + [(1, 99, None)]
    then = [(1, 10, (at + 9) * s), (1, 11, (at + 12) * s), (1, 12, (at + 13) * s)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    got, q = arrivals.run_arrivals(requests(spark, path, [first]), 10, 3, path=out, delay="5 seconds")
    said = lambda df: {r["event_id"]: (r["n_in_window"], r["status"]) for r in df.collect()}
    want = {0: (1, 200), 1: (2, 200), 2: (3, 200), 3: (4, 429), 4: (5, 429), 99: (None, 200), **{100 + u: (1, 200) for u in range(2, 12)}}
    assert said(got) == want
    size = lambda q: [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    most = max(size(q))
    # From the checkpoint: the window that is open goes on, then a new one begins.
    got, q = arrivals.run_arrivals(requests(spark, path, [then]), 10, 3, path=out, delay="5 seconds")
    want |= {10: (6, 429), 11: (1, 200), 12: (2, 200)}
    assert said(got) == want
    got, q = arrivals.run_arrivals(requests(spark, path, [[(50, 900, 1000 * s)], [(51, 901, 2000 * s)]]), 10, 3, path=out, delay="5 seconds")
    assert size(q)[-1] < most and said(got)[900] == (1, 200)  # ended windows are gone
    again, _ = arrivals.run_arrivals(requests(spark, path, []), 10, 3, path=out, delay="5 seconds")
    assert again.count() == len(want) + 2
    assert {r["event_id"]: r["retry_after"] for r in got.where("status = 429").collect()} == {3: 7, 4: 6, 10: 1}


def test_a_broken_state_refuses_nothing():
    import pandas as pd

    class Broken:
        def exists(self):
            raise OSError("no store")

    p = arrivals.Arrivals(10, 1)
    p.window = Broken()
    rows = pd.DataFrame({"user_id": [1, 1], "event_id": [1, 2], "time": pd.to_datetime(["2024-01-01", "2024-01-01"])})
    (out,) = p.handleInputRows((1,), iter([rows]), None)
    assert out.status.tolist() == [200, 200] and out.n_in_window.isna().all()


def test_updates_keep_the_last_row_of_a_key(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    s = 1_000_000
    rows = requests(spark, path, [[(1, 1, s), (1, 2, 2 * s), (2, 3, s)], [(1, 4, 3 * s)]])
    count = lambda: {(r["user_id"], r["passed"], r["refused"]) for r in streams.limited(streams.run_available(streams.aligned(rows, 60), ("user_id", "start"), path=out), 2).collect()}
    assert count() == {(1, 2, 1), (2, 1, 0)}
    requests(spark, path, [[(2, 5, 5 * s)]])
    assert count() == {(1, 2, 1), (2, 2, 0)}
