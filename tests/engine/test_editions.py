"""Fetching, resolution, discovery and requests on small tables."""

import json

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from groundwork.plans import asking, discovery, flow, resolution
from groundwork.sources import fetch
from groundwork.streaming import streams

ELI = "https://www.retsinformation.dk/eli/lta"


def one(spark, col, **cols):
    return spark.createDataFrame([tuple(cols.values()) or (1,)], list(cols) or ["x"]).select(col).first()[0]


def test_fetch_says_why_nothing_came(spark):
    asked = spark.createDataFrame([(1, f"{ELI}/2020/1"), (2, f"{ELI}/2020/1"), (3, "https://evil.example/"), (4, f"{ELI}/2020/2"), (5, f"{ELI}/2020/9"), (6, None)], "id int, url string")
    bodies = spark.createDataFrame([(f"{ELI}/2020/1", bytearray("blå \n".encode() + b"\xff")), (f"{ELI}/2020/2", bytearray(b"x" * 50)), ("https://evil.example/", bytearray(b"y"))], "url string, body binary")
    got = {r["id"]: (r["text"], r["error"]) for r in fetch.fetched(asked, bodies, limit=40).collect()}
    assert got[1] == got[2] == ("blå \n�", None)
    assert [got[i] for i in (3, 4, 5, 6)] == [(None, "not allowed"), (None, "too large"), (None, "not found"), (None, "not allowed")]


def test_files_and_metadata(spark):
    asked = spark.createDataFrame([(1, f"{ELI}/2020/1"), (2, f"{ELI}/2020/2")], "id int, url string")
    bodies = spark.createDataFrame([(f"{ELI}/2020/1/pdf", bytearray(b"%PDF-1")), (f"{ELI}/2020/2/pdf", bytearray(b"<html>")), (f"{ELI}/2020/2/xml", bytearray(b"<?xml?>" + b"a" * 6000))], "url string, body binary")
    assert {r["id"]: r["content"] for r in fetch.files_of(asked, bodies, "pdf").collect()} == {1: b"%PDF-1", 2: None}
    assert [r["id"] for r in fetch.files_of(asked, bodies, "xml").where("content IS NOT NULL").collect()] == [2]
    snaps = spark.createDataFrame([(f"{ELI}/2020/1.json", json.dumps({"title": " T "})), (f"{ELI}/2020/2.json", "[1]")], "url string, json string")
    assert {r["id"]: (r["label"], r["metadata"] is None) for r in fetch.node_metadata(asked, snaps).collect()} == {1: ("T", False), 2: (None, True)}
    text = "<a>BEK  nr 12 af 1/2/2020</a>"
    assert one(spark, fetch.xml_label(F.lit(text).cast("binary"))) == "BEK  nr 12 af 1/2/2020"
    assert one(spark, fetch.xml_label(F.lit(" " * 2048 + text).cast("binary"))) is None
    assert one(spark, fetch.encoded_query(F.lit("a b/~*å"))) == "a%20b%2F~%2A%C3%A5"


def law(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, url string, folder string, current_version string")


def test_law_chain_by_priority(spark):
    s = law(spark, [("a", "Om straaling", f"{ELI}/2018/10", "Bekendtgørelse", "BEK nr 10 af 1/1/2018"), ("b", "", f"{ELI}/2018/20", "Bekendtgørelse", None), ("c", "x", f"{ELI}/2019/30", "Bekendtgørelse", "BEK nr 30 af 2/2/2019")])
    hits = spark.createDataFrame([("a", 0, "Om straaling", f"{ELI}/2017/9"), ("a", 1, "Om straaling (historisk)", f"{ELI}/2024/1"), ("a", 2, "Om straaling", f"{ELI}/2021/11")], "id string, ord int, title string, url string")
    page = f'<a href="/eli/lta/2022/12">BEK nr 12 af 3/4/2022</a> <a href="/eli/lta/2020/8">BEK nr 8 af 3/4/2020</a>'
    pages = spark.createDataFrame([(f"{ELI}/2021/11", page), (f"{ELI}/2019/30", '<a href="/eli/lta/2018/7">BEK nr 7 af 1/1/2018</a>')], "url string, html string")
    editions = spark.createDataFrame([(20, 2019, "BEK nr 20 af 5/5/2019", f"{ELI}/2019/20"), (20, 2018, "BEK nr 20 af 5/5/2018", f"{ELI}/2018/20")], "nr int, year int, label string, url string")
    got = {r["id"]: (r["label"], r["url"]) for r in resolution.law_chain(s, hits, pages, editions).collect()}
    assert got["a"] == ("BEK nr 12 af 3/4/2022", f"{ELI}/2022/12")  # the search hit's page names a newer one
    assert got["b"] == ("BEK nr 20 af 5/5/2019", f"{ELI}/2019/20")  # probing
    assert got["c"] == ("BEK nr 7 af 1/1/2018", f"{ELI}/2018/7")  # its own page, even though it is older


def test_status_modes_and_branches(spark):
    s = law(spark, [
        ("law", "n", f"{ELI}/2018/10", "Bekendtgørelse", "BEK nr 10 af 1/1/2018"), ("sst", "Sikkerhedsvurdering", "https://www.sst.dk/a", "Bekendtgørelse", None), ("none", "n", "", "IAEA", None),
        ("old", "n", "https://www.iaea.org/p/1", "IAEA", "SSG-1"), ("same", "n", "https://www.iaea.org/p/2", "IAEA", "SSG-2"), ("gone", "n", "https://www.iaea.org/p/3", "IAEA", None)])
    pages = spark.createDataFrame([("https://www.iaea.org/p/1", 'Superseded by: <a href="/p/9">SSG-1 (Rev. 1)</a>'), ("https://www.iaea.org/p/2", "current")], "url string, html string")
    chain = spark.createDataFrame([("law", "BEK nr 11 af 1/1/2019", f"{ELI}/2019/11")], "id string, label string, url string")
    chosen = spark.createDataFrame([("law", "BEK nr 12 af 1/1/2020", f"{ELI}/2020/12", 0.9, [f"{ELI}/2018/10"])], "id string, label string, url string, confidence double, visited array<string>")
    graph = resolution.by_graph(s, chosen)
    rows = {r["id"]: r for r in resolution.status_rows(s, chain, graph, pages).collect()}
    assert (rows["law"]["remote_version"], rows["law"]["resolver_source"], rows["law"]["evidence"]["confidence"]) == ("BEK nr 12 af 1/1/2020", "graph", 0.9)
    assert rows["sst"]["remote_version"] == resolution.MANUAL and not rows["sst"]["update_available"]
    assert rows["none"]["remote_version"] == resolution.LOCAL and rows["none"]["download_url"] == ""
    assert (rows["old"]["remote_version"], rows["old"]["update_available"], rows["old"]["download_url"]) == ("SSG-1 (Rev. 1)", True, "https://www.iaea.org/p/9")
    assert (rows["same"]["remote_version"], rows["same"]["update_available"]) == ("Current", False)
    assert rows["gone"]["error"] == "page not found" and rows["gone"]["remote_version"] is None
    shadow = {r["id"]: r for r in resolution.status_rows(s, chain, graph, pages, mode="shadow").collect()}
    assert shadow["law"]["download_url"] == f"{ELI}/2019/11" and shadow["law"]["evidence"]["chosen_url"] == f"{ELI}/2020/12"
    ids = spark.createDataFrame([(" law",), ("old",), ("x",)], "id string").select(F.trim("id").alias("id"))
    found = spark.createDataFrame([("old", "u")], "id string, url string")
    assert {r["id"]: (r["url"], r["error"]) for r in resolution.looked_up(ids, s, chain, found).collect()} == {"law": (f"{ELI}/2019/11", None), "old": ("u", None), "x": (None, "Source not found")}
    files = spark.createDataFrame([(f"{ELI}/2018/10", bytearray(b"own"))], "url string, content binary")
    got = {r["id"]: (r["url"], r["content"]) for r in resolution.newest_or_own(s, resolution.status_rows(s, chain, graph, pages), files).collect()}
    assert got["law"] == (f"{ELI}/2018/10", b"own") and got["old"] == (None, None)


def test_registry_from_a_folder(spark, tmp_path):
    (tmp_path / "Bekendtgørelse").mkdir()
    (tmp_path / "a_version.txt").write_text("BEK nr 5 af 1/2/2020")
    for name, page in (("Bekendtgørelse/Lov 1.pdf", "BEK"), ("b.pdf", "SSG-7 text"), ("x-b.pdf", "bad")):
        (tmp_path / name).write_bytes(b"%PDF" + page.encode())

    def reader(raw):
        if raw.endswith(b"bad"):
            raise ValueError
        return [raw[4:].decode()]

    got = discovery.disk_registry(spark, str(tmp_path), reader)
    rows = {r["id"]: r for r in got.collect()}
    assert set(rows) == {"a", "lov-1", "b"} and rows["a"]["url"] == f"{ELI}/2020/5" and rows["lov-1"]["folder"] == "Bekendtgørelse" and rows["b"]["version"] == "SSG-7"
    discovery.write_registry(got, str(tmp_path / "registry"))
    lines = [json.loads(r[0])["id"] for r in spark.read.text(str(tmp_path / "registry")).collect()]
    assert sorted(lines) == ["a", "b", "lov-1"]
    order = discovery.path_order(spark.createDataFrame([(p,) for p in "dbac"], "path string")).collect()
    assert sorted((r["ord"], r["path"]) for r in order) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_downloads_keep_two_backups(spark):
    status = spark.createDataFrame([("a", True, "v2"), ("b", False, "v1")], "id string, update_available boolean, remote_version string")
    fresh = spark.createDataFrame([("a", bytearray(b"new")), ("b", bytearray(b"z"))], "id string, content binary")
    have = [("a", "a.pdf", bytearray(b"old"), False, "2024-01-05"), ("a", "a.pdf.bak-1", bytearray(b"1"), True, "2024-01-01"), ("a", "a.pdf.bak-2", bytearray(b"2"), True, "2024-01-02")]
    existing = spark.createDataFrame(have, "id string, path string, content binary, is_backup boolean, day string").withColumn("modified", F.to_timestamp("day")).drop("day")
    files, backups = discovery.updated_files(status, fresh, existing, F.to_timestamp(F.lit("2024-02-01")))
    assert [tuple(r) for r in files.collect()] == [("a", "a.pdf", b"new", "v2")]
    assert sorted(r["content"] for r in backups.collect()) == [b"2", b"old"]


def test_registry_load_branches_on_folder(spark):
    s = spark.createDataFrame([("l", "Law", "u", discovery.LAW), ("p", "Pub", "u", "IAEA"), ("q", "None", "", "IAEA")], "id string, name string, url string, folder string")
    contents = spark.createDataFrame([("l", bytearray(b"<a>text <b>more</b></a>")), ("p", bytearray(b"%PDF")), ("q", bytearray(b"%PDF"))], "id string, content binary")
    laws, pubs = discovery.loaded(s, contents, lambda df: df.select(F.col("path").alias("source"), "document_type", F.lit("page").alias("text")))
    assert [(r["source"], r["chunk"]) for r in laws.collect()] == [("Law", "text more")] and [r["source"] for r in pubs.collect()] == ["Pub"]
    assert discovery.all_chunks(laws.withColumnRenamed("chunk", "text"), pubs).count() == 2


def test_asking_helpers(spark):
    who = asking.provider_of(F.lit("OpenAI"), F.create_map(F.lit("openai"), F.lit("k")))
    assert tuple(one(spark, who)) == ("openai", "k") and tuple(one(spark, asking.provider_of(F.lit("?"), F.create_map(F.lit("openai"), F.lit("k"))))) == ("mistral", None)
    asked = spark.createDataFrame([(i, " dose? ", "", h) for i, h in enumerate(("limits", " ", "Retry", None))], "id int, question string, context string, hint string")
    assert [r["answer"] for r in flow.hinted_question()(asked).orderBy("id").collect()] == ["dose? limits", "dose?", "dose?", "dose?"]
    assert [one(spark, asking.language_label(F.lit(x))) for x in ("de", "xx", None)] == ["Quellen inkl. Websuche"] + ["Sources incl. web search"] * 2


def test_limits_fall_back_to_own_windows(spark, monkeypatch, tmp_path):
    rows = [(i, i // 4, f"2024-01-01 00:00:{i:02d}") for i in range(12)]
    spark.createDataFrame(rows, "event_id long, user_id long, s string").withColumn("ts", F.to_timestamp("s")).drop("s").write.parquet(f"{tmp_path}/events.parquet")

    def fail(*_):
        raise StreamingQueryException("no counter")

    want = {(u, 3, 1) for u in range(3)}
    rows_of = lambda df: {(r["user_id"], r["passed"], r["refused"]) for r in df.collect()}
    assert rows_of(streams.run_limited(streams.events(spark, str(tmp_path)), 60, 3)) == want
    monkeypatch.setattr(streams, "run_available", fail)
    assert rows_of(streams.run_limited(streams.events(spark, str(tmp_path)), 60, 3)) == want


def test_feeds_are_reconciled(spark):
    a = spark.createDataFrame([("harvest_api", "1", "u1", None, "r")], "source string, identifier string, url string, changed_at string, reason string")
    b = spark.createDataFrame([("eli_atom_feed", "1", "u1", "2024")], "source string, identifier string, url string, changed_at string")
    assert [r["source"] for r in streams.reconciled(a, b).orderBy("source").collect()] == ["eli_atom_feed", "harvest_api"]


def test_anti_merge_keeps_what_is_new(spark):
    from groundwork.operators import dedupe

    have = spark.createDataFrame([(1, "s|t|x")], "i int, key string")
    more = spark.createDataFrame([(2, "s|t|x"), (3, "s2|t|x"), (4, "s2|t|x")], "i int, key string")
    _, added = dedupe.anti_merge(have, more, "key", ["i"])
    assert [r["i"] for r in added.collect()] == [3]

