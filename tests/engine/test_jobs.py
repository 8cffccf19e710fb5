import json

from pyspark.sql import functions as F

from groundwork.plans import ingest, updates
from groundwork.sources import files, harvest


def test_ingest_refresh_append(spark, tmp_path):
    docs = spark.createDataFrame([("a.pdf", "IAEA", "Dose limits. " * 400), ("b.xml", "Danish law", "§ 1. Text"), ("c", "IAEA", "  ")], "source string, document_type string, text string")
    rows = ingest.embedded(ingest.chunks(docs))
    path = str(tmp_path / "store")
    ingest.refresh(rows, path, "cloud")
    assert ingest.ready(spark, path, "cloud").first()["ready"] and not ingest.ready(spark, path, "local").first()["ready"]
    n = spark.read.parquet(path).count()
    ingest.refresh(rows.where("collection = 'agency'"), path, "cloud")
    assert spark.read.parquet(path).count() == n
    assert ingest.append(rows, path, "cloud") == 0
    more = ingest.embedded(ingest.chunks(spark.createDataFrame([("d", "IAEA", "new")], docs.schema)))
    assert ingest.append(more, path, "cloud") == 1 and spark.read.parquet(path).count() == n + 1
    norm = spark.read.parquet(path).select(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x).alias("q")).collect()
    assert all(abs(r["q"] - 1) < 1e-9 for r in norm)
    ingest.write_report(spark.createDataFrame([("q", 0.5)], "id string, recall double"), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report/markdown")).first()[0] == "| q | 0.500 |"


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 page one\fpage two\f ")
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    (tmp_path / "x_version.txt").write_text("BEK nr 1 af 1/1/2020\n")
    (tmp_path / "doc.xml").write_text("<a>t <b>u</b></a>")
    (tmp_path / "v.json").write_text(json.dumps({"x": {"version": "1", "updated_at": "2024"}}))
    (tmp_path / "bad.json").write_text("{oops")
    (tmp_path / "g.json").write_text(json.dumps([{"question": "q?", "key_facts": ["a"]}]))
    pdfs = files.pdf_files(spark, str(tmp_path), "IAEA")
    pages = files.pdf_pages(pdfs, lambda b: b.decode().split("\f")).orderBy("page").collect()
    assert [(r["page"], r["text"]) for r in pages] == [(0, "%PDF-1.4 page one"), (1, "page two")]
    assert files.xml_documents(spark, str(tmp_path), "law").first()["text"] == "t u"
    assert [tuple(r) for r in files.version_markers(spark, str(tmp_path)).collect()] == [("x", "BEK nr 1 af 1/1/2020")]
    assert files.version_state(spark, str(tmp_path / "v.json")).first()["version"] == "1" and files.version_state(spark, str(tmp_path / "bad.json")).count() == 0
    item = files.golden_items(spark, str(tmp_path / "g.json")).first()
    assert item["question"] == "q?" and len(item["id"]) == 64
    got = files.registry_rows(spark, [{"id": "a", "name": "A"}, {"id": "b"}, {"id": "c", "name": "C", "url": " u "}]).collect()
    assert [(r["id"], r["url"], r["folder"]) for r in got] == [("a", "", "IAEA"), ("c", "u", "IAEA")]
    parts = spark.createDataFrame([("p", [("n", b"x"), ("m", None)])], "path string, parts array<struct<name:string,content:binary>>")
    assert [r["path"] for r in files.attachments(parts).collect()] == ["p (Anhang: n)"]


def test_harvest_batch_and_stream(spark, tmp_path):
    for day, payload in (("2024-03-09", [{"id": "1"}]), ("2024-03-10", {"documents": [{"documentId": "2", "eli": "/e"}, {}]})):
        (tmp_path / f"{day}.json").write_text(json.dumps(payload))
    got = harvest.harvest(spark, str(tmp_path), last="2024-03-08", today="2024-03-10").orderBy("day").collect()
    assert [(r["day"], r["identifier"]) for r in got] == [("2024-03-09", "1"), ("2024-03-10", "2")]
    assert harvest.harvest(spark, str(tmp_path), last="2024-03-10", today="2024-03-10").count() == 0

    def run(today):
        s = spark.readStream.format("harvest").option("path", str(tmp_path)).option("last", "2024-03-08").option("today", today).load()
        q = s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        return spark.read.schema(harvest.SCHEMA).parquet(str(tmp_path / "out")).count()

    assert run("2024-03-09") == 1 and run("2024-03-10") == 3
    feed = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>a</id><updated>2024</updated><link href='/x'/></entry></feed>"
    assert spark.range(1).select(F.explode(harvest.atom_events(F.lit(feed))).alias("e")).first()["e"]["url"] == "/x"


def test_updates(spark):
    cands = spark.createDataFrame([
        ("a", 1, "BEK nr 1 af 1/1/2010", "/eli/lta/2010/1"), ("a", 2, "BEK nr 2 af 1/1/2021", "/eli/lta/2021/2"), ("a", 3, "BEK nr 3 af 1/1/2022", "/eli/lta/2022/3"),
        ("b", None, None, "/eli/lta/2000/9"),
    ], "id string, priority int, label string, url string").withColumns({"current_url": F.lit("/eli/lta/2019/670"), "current_version": F.lit("BEK nr 670 af 1/1/2019")})
    got = {r["id"]: r["url"] for r in updates.first_accepted(cands).collect()}
    assert got == {"a": "/eli/lta/2021/2", "b": "/eli/lta/2000/9"}
    hits = spark.createDataFrame([
        ("s", 0, "Bekendtgørelse om dosis (historisk)", "/eli/lta/2025/1", "dosis"), ("s", 1, "Om dosis BEK nr 5 af 1/2/2020", "/eli/lta/2020/5", "dosis"),
        ("s", 2, "Om dosis BEK nr 6 af 1/2/2021", "/eli/lta/2021/6", "dosis"), ("s", 3, "andet", "/eli/lta/2024/7", "dosis"),
    ], "id string, ord int, title string, url string, wanted string")
    assert [tuple(r) for r in updates.best_hits(hits).collect()] == [("s", "/eli/lta/2021/6")]
    site = spark.createDataFrame([("s", 0, "//sst.dk/a"), ("s", 1, "https://sst.dk/b.PDF"), ("s", 2, "https://x.dk/c.pdf")], "id string, ord int, url string")
    assert updates.first_pdf(site).first()["url"] == "https://sst.dk/b.PDF"
    mode = spark.createDataFrame([("shadow", "g"), ("enforce", "g"), ("enforce", None), ("x", "g")], "m string, g string")
    assert [r[0] for r in mode.select(updates.arbitrate(F.col("m"), F.col("g"))).collect()] == ["legacy", "graph", "legacy", "graph"]
    src = spark.createDataFrame([("a", "A", "/eli/lta/2019/670", "f", "BEK nr 670 af 1/1/2019"), ("l", "L", "", "f", "v"), ("e", "E", "u", "f", None)], "id string, name string, url string, folder string, current_version string")
    res = spark.createDataFrame([("a", "BEK nr 2 af 1/1/2021", "/eli/lta/2021/2", None), ("e", None, None, "boom")], "id string, label string, url string, error string")
    status = updates.check_updates(src, res)
    assert {r["id"]: (r["update_available"], r["remote_version"]) for r in status.collect()} == {"a": (True, "BEK nr 2 af 1/1/2021"), "l": (False, "Local only"), "e": (False, None)}
    state = spark.createDataFrame([("a", "old", "2019-01-01")], "id string, version string, updated_at string")
    new, report = updates.sync(state, status, F.lit("2024-01-01"))
    assert new.first()["version"] == "BEK nr 2 af 1/1/2021" and tuple(report.first()) == (3, 1, 0, 2)
