from datetime import date

import pytest
from pyspark.sql import Row, functions as F

from groundwork.functions import routing as rt, text as tx, versions as vs, web
from groundwork.operators import context as ctx, dedupe, evals, lineage, registry
from groundwork.sources import chunking, relations


def one(spark, col, **values):
    return spark.createDataFrame([Row(**values)]).select(col.alias("x")).first()["x"] if values else spark.range(1).select(col.alias("x")).first()["x"]


def test_unicode_spaces_and_slug(spark):
    assert one(spark, tx.collapse(F.lit(" a b\t\n c "))) == "a b c"
    assert one(spark, tx.slug(F.lit("Æbler & pærer - 2!"))) == "æbler-pærer-2"
    assert one(spark, tx.slug(F.lit("!!"))) == "doc"
    assert one(spark, tx.ascii_fold(F.lit(" Åbne Ærø kilder "))) == "Abne Aero kilder"


@pytest.mark.parametrize("text,small", [("Thanks", True), (" ok ", True), ("??!", True), ("How much?", False), ("tschüss", True), ("dose", False)])
def test_small_talk(spark, text, small):
    assert one(spark, tx.is_small_talk(F.lit(text))) is small


@pytest.mark.parametrize("label,want", [
    ("BEK nr 1385 af 18/11/2025", (date(2025, 11, 18), 1385)), ("bek  NR 7 af 1/2/49", (date(2049, 2, 1), 7)), ("BEK nr 7 af 1/2/50", (date(1950, 2, 1), 7)),
    ("BEK nr 7 af 31/2/2020", None), ("", None), ("nr 7", None),
])
def test_label_dates(spark, label, want):
    got = one(spark, vs.label_date_nr(F.lit(label)))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("label,url,cur_url,cur_label,rejected", [
    ("BEK nr 2 af 1/1/2020", "/eli/lta/2020/2", "/eli/lta/2019/670", "BEK nr 670 af 1/1/2019", False),
    ("BEK nr 2 af 1/1/2018", "/eli/lta/2018/2", "/eli/lta/2019/670", "BEK nr 670 af 1/1/2019", True),
    (None, "/eli/lta/2019/670", "/eli/lta/2019/670", None, True), (None, "/eli/lta/2020/1", "/eli/lta/2019/670", None, False),
    ("x", "/other", "/eli/lta/2019/670", None, False), (None, None, "/eli/lta/2019/670", None, False),
])
def test_recency(spark, label, url, cur_url, cur_label, rejected):
    s = lambda v: F.lit(v).cast("string")
    assert one(spark, vs.is_not_newer(s(label), s(url), s(cur_url), s(cur_label))) is rejected


def test_day_window(spark):
    day = lambda last: one(spark, vs.day_window(F.lit(last).cast("string"), F.to_date(F.lit("2026-03-12"))))
    assert [d.day for d in day("2026-03-10")] == [11, 12] and [d.day for d in day(None)] == [11, 12]
    assert day("2026-03-12") == [] and len(day("2026-01-01")) == 11


PAGE = """<a href='/eli/lta/2024/100'> BEK nr 100 af 5/6/2024</a> <a class="x" href="/eli/lta/2025/7"><b>BEK nr 7 af 1/2/2025</b></a>
<a href="/eli/lta/2023/9">BEK nr 9 af 30/12/2023</a>"""


def test_amendments(spark):
    assert tuple(one(spark, web.newest_amendment(F.lit(PAGE), F.lit("https://h/eli/lta/2000/1")))) == ("BEK nr 100 af 5/6/2024", "https://h/eli/lta/2024/100")
    apart = '<a href="/eli/lta/2020/5">a</a>' + "-" * 100 + "BEK nr 5 af 1/1/2020 " + '<a href="/eli/lta/2021/5">b</a>'
    assert one(spark, web.newest_amendment(F.lit(apart), F.lit("x")))["url"].endswith("/eli/lta/2021/5")
    assert one(spark, web.newest_amendment(F.lit("<p>none</p>"), F.lit("x"))) is None


def test_publication_links(spark):
    assert one(spark, web.publication_pdf(F.lit('<a href="https://x.org/a.pdf">'))) is None
    assert one(spark, web.publication_pdf(F.lit('<a href="/MTCD/Publications/PDF/P1.pdf">'))) == "https://www-pub.iaea.org/MTCD/Publications/PDF/P1.pdf"
    assert one(spark, web.publication_link(F.lit("<a href='/publications/12/abc'>"))) == "https://www.iaea.org/publications/12/abc"
    assert tuple(one(spark, web.superseded_by(F.lit("Superseded by: SSG-20\n")))) == ("SSG-20", None)


def test_allowlists_differ(spark):
    url = F.lit("https://fake-iaea.org.example/x")
    assert one(spark, web.allowed_a(url)) and not one(spark, web.allowed_b(url))
    assert one(spark, web.allowed_b(F.lit("https://WWW.iaea.org/x")))
    assert one(spark, web.xml_url(F.lit("https://www.retsinformation.dk/eli/lta/2019/670/pdf/"))) == "https://www.retsinformation.dk/eli/lta/2019/670/xml"


def test_search_results_and_events(spark):
    got = one(spark, web.search_results(F.lit('{"results":[{"title":"t","url":"u","description":"d"}]}')))
    assert [tuple(r) for r in got] == [("t", "u", "d")] and one(spark, web.search_results(F.lit("oops"))) == []
    assert one(spark, web.change_event(F.lit('{"eli":" /e "}')))["identifier"] == "/e" and one(spark, web.change_event(F.lit("{}"))) is None


def test_relations():
    text = '{"x":{"eli:changed_by":["/a",{"@id":"/b"}]},"is_changed_by":{"href":"/a"},"consolidated_by":"/c"}'
    assert relations.relations_of(text) == [("changed_by", "/a"), ("changed_by", "/b"), ("consolidated_by", "/c")]
    assert relations.relations_of("{") == []


def test_budget_boundary(spark):
    df = spark.createDataFrame([(1, i, "x" * 420) for i in range(3)] + [(2, 0, None), (2, 1, "")], "g int, o int, text string")
    got = {r["g"]: r["context"] for r in ctx.budgeted(df, ["g"], F.col("text"), ["o"], 420, 900).collect()}
    assert len(got[1]) == 883 and got[1].endswith("...") and 2 not in got
    assert len(ctx.budgeted(df, ["g"], F.col("text"), ["o"], 420, 844).first()["context"]) == 842


@pytest.mark.parametrize("on,tried,retries,want", [(False, False, 0, "end"), (True, True, 0, "end"), (True, False, 0, "retry"), (True, False, 1, "retry"), (True, False, 2, "web_search")])
def test_retry_table(spark, on, tried, retries, want):
    assert one(spark, rt.after_generation(F.lit(False), F.lit(on), F.lit(tried), F.lit(retries), F.lit(False))) == want


def test_private_questions_never_search(spark):
    assert one(spark, rt.after_generation(F.lit(False), F.lit(True), F.lit(False), F.lit(2), F.lit(True))) == "end"
    assert one(spark, rt.after_documents(rt.web_flag(F.lit(False), F.lit(False), F.lit(True)), F.lit(True))) == "generate"


def test_precision(spark):
    p = lambda *v: one(spark, evals.precision_at(F.array(*map(F.lit, v)).cast("array<int>")))
    assert p(1, 0, 1) == pytest.approx((1 + 2 / 3) / 2) and p() == 0.0
    assert one(spark, evals.fit_verdicts(tx.digits_list(F.lit("1, 0 x 1")), F.lit(5))) == [1, 0, 1, 0, 0]
    assert one(spark, evals.fact_recall(F.lit("Dose LIMIT 20"), F.array(F.lit("limit"), F.lit("30")))) == 0.5


def test_dedupe(spark):
    old = spark.createDataFrame([(1, "a")], "o int, key string")
    new = spark.createDataFrame([(2, "a"), (3, "b"), (4, "b")], "o int, key string")
    merged, added = dedupe.anti_merge(old, new, "key", ["o"])
    assert sorted(r["o"] for r in merged.collect()) == [1, 3] and added.count() == 1
    assert one(spark, dedupe.next_free_id(F.lit("a"), F.array(F.lit("a"), F.lit("a-1")))) == "a-2"


def test_lineage(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    got = lineage.reachable(spark.createDataFrame([("a",)], "start string"), edges)
    assert sorted((r["node"], r["depth"]) for r in got.collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_registry(spark):
    state = spark.createDataFrame([("a", "1", "x"), ("b", "1", None)], "id string, version string, url string")
    change = spark.createDataFrame([("a", "", "y"), ("c", "2", None)], "id string, version string, url string")
    got = {r["id"]: (r["version"], r["url"]) for r in registry.partial_upsert(state, change, "id", ["version", "url"]).collect()}
    assert got == {"a": ("1", "y"), "b": ("1", None), "c": ("2", None)}
    rows = spark.createDataFrame([("a", "u", 1), ("a", "v", 2)], "id string, url string, ord int")
    assert sorted(r["url"] for r in registry.set_field(rows, "a", "url", F.lit("z")).collect()) == ["v", "z"]


def test_splitter_and_xml(spark):
    text = ("Sentence one. " * 300).strip()
    parts = chunking.split_text(text)
    assert len(parts) == 2 and all(len(p) <= 2500 for p in parts)
    assert "".join(chunking.split_text("y" * 6000, overlap=0)) == "y" * 6000 and chunking.split_text("  ") == []
    xml = b"<a>one <b>two</b> three</a>"
    got = spark.createDataFrame([(xml,), (b"<broken",)], "c binary").select(chunking.xml_text("c").alias("t")).collect()
    assert [r["t"] for r in got] == ["one two three", ""]


def test_dedupe_key_of_long_and_blank_texts(spark):
    n = 240
    texts = [None, "", " a  b ", "x " * n, " " * 5 * n + "late" + " \n" * n + "r" * n, "a" * n, "a" * (n - 1) + "  b", " " * (4 * n - 2) + "ab cd", "w\t\t" * 3 * n]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.dedupe_key(F.col("t"), F.lit("s"), F.lit("k")).alias("key"))
    assert {r["i"]: r["key"] for r in got.collect()} == {i: "s|k|" + " ".join((t or "").split())[:n] for i, t in enumerate(texts)}
