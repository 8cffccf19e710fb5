import duckdb

from groundwork.operators import containment
from groundwork.plans import service

FACTS = [(1, "Short one"), (2, "cd efgh starts within a word and goes on"), (3, ", after a comma there is more text"), (4, "x"), (5, ""), (6, None),
         (7, "Ärger über Öl und viel mehr davon"), (7, "abc"), (8, "never anywhere in any of the texts")]
DOCS = [(1, "a SHORT one here"), (2, "abcd efgh starts within a word and goes on"), (3, "well, after a comma there is more text"), (4, "ends in sho"), (5, "rt one"),
        (6, None), (7, ""), (8, "so ärger über öl und viel mehr davon"), (8, "abc abc"), (8, "abc abc"), (None, "short one")]


def test_containment_equals_its_sql(spark, tmp_path, monkeypatch):
    spark.createDataFrame(DOCS, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(FACTS, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(map(str, con.execute(service.ORACLE["fact_containment_join"]).fetchall()))
    for block, texts in ((containment.FACT_BYTES, containment.TEXT_BYTES), (70, 5)):
        monkeypatch.setattr(containment, "FACT_BYTES", block)
        monkeypatch.setattr(containment, "TEXT_BYTES", texts)
        got = service.fact_containment_join(spark, str(tmp_path))
        assert sorted(str(tuple(r)) for r in got.select("item_id", "doc_id").collect()) == want


def test_facts_with_one_opening_stay_linear():
    """Facts and texts share an opening: an offset is compared with the facts of its own rare gram alone."""
    import numpy as np

    open_, close = b"what is the dose limit that holds for ", b" according to the decree in force?"
    facts = [(i, open_ + b"worker %05d" % (i * 7919 % 100_000) + close) for i in range(3000)]
    table = containment._Facts(facts + [(9000, facts[5][1])])
    texts = [b"asked: " + facts[i][1] + b" " + open_ + close for i in range(0, 3000, 3)]
    end = np.cumsum([len(t) for t in texts])
    hits = table.held(b"".join(texts), end - np.array([len(t) for t in texts]), end)
    assert {(t, i) for t, f in hits for i in table.ids[f]} == {(t, 3 * t) for t in range(1000)} | ({(t, 9000) for t in range(1000) if 3 * t == 5})
    assert table.compared <= 4 * len(texts)
