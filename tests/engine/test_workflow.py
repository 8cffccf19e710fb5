"""The workflow by stages, with retrieval inside; the ledger of paid calls."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from groundwork.plans import asking, flow
from groundwork.plans.ledger import Ledger

QUESTION = "id long, question string, history array<struct<q:string,a:string>>, private boolean, web_enabled boolean"


def noted(path, name):
    """A call that leaves a line per call, whichever task makes it."""

    def call(row, answer):
        with open(os.path.join(path, name), "a") as f:
            f.write(f"{row.get('question') or row.get('generation') or row.get('query')}\n")
        return answer

    return call


def calls(path):
    return {n: Counter(open(os.path.join(path, n)).read().split("\n")[:-1]) for n in os.listdir(path)}


def paid(ledger, stage, call, kind="string"):
    def model(asked):
        got = ledger.ask(asked, stage, call)
        return got.withColumn("answer", F.from_json("answer", kind) if kind.startswith("struct") else F.col("answer").cast(kind))

    return model


def models(spark, path, ledger, sufficient=lambda q: True, passed=lambda q, g: True, grounded=lambda g: True):
    os.makedirs(path, exist_ok=True)
    note = {n: noted(path, n) for n in ("sufficient", "missing_query", "search_query", "generate", "grade", "grounded")}
    docs = spark.createDataFrame([(i, 1, f"text of {i}", "s", "law") for i in range(200)], "id long, ord int, text string, source string, document_type string")
    web = docs.select("id", "ord", F.lit("web text").alias("text"), F.lit("w").alias("source"), F.lit("web").alias("document_type"))
    return flow.Models(
        retrieve=flow.table_search(docs), search=flow.table_search(web),
        sufficient=paid(ledger, "sufficient", lambda r: note["sufficient"](r, str(sufficient(r["question"])).lower()), "boolean"),
        missing_query=paid(ledger, "missing_query", lambda r: note["missing_query"](r, "more " + r["question"])),
        search_query=paid(ledger, "search_query", lambda r: note["search_query"](r, "web " + r["question"])),
        generate=paid(ledger, "generate", lambda r: note["generate"](r, f"answer to {r['question']} {r['retries']}")),
        grade=paid(ledger, "grade", lambda r: note["grade"](r, '{"passed": %s, "missing_info": "m"}' % str(passed(r["question"], r["generation"])).lower()), "struct<passed:boolean,missing_info:string>"),
        grounded=paid(ledger, "grounded", lambda r: note["grounded"](r, str(grounded(r["generation"])).lower()), "boolean"))


def test_each_model_is_called_once_per_row_and_stage(spark, tmp_path):
    rows = [(i, f"q{i}", [], False, True) for i in range(100)]
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    m = models(spark, str(tmp_path / "calls"), ledger)
    out = flow.run_batch(spark.createDataFrame(rows, QUESTION), m).collect()
    assert len(out) == 100 and {(r["generations"], r["retrievals"], r["outcome"]) for r in out} == {(1, 1, "trusted_only_verified")}
    assert {r["generation"] for r in out} == {f"answer to q{i} 0" for i in range(100)}
    got = calls(tmp_path / "calls")
    assert {n: (sum(c.values()), max(c.values())) for n, c in got.items()} == {n: (100, 1) for n in ("sufficient", "generate", "grade", "grounded")}
    again = flow.run_batch(spark.createDataFrame(rows, QUESTION), models(spark, str(tmp_path / "calls"), ledger))
    assert again.count() == 100 and calls(tmp_path / "calls") == got  # a second run asks nothing


def test_every_path_and_its_calls(spark, tmp_path):
    """Questions by what goes wrong: nothing, no documents, not enough, never passed, never grounded, private."""
    kinds = {"good": 1, "bare": 500, "thin": 2, "weak": 3, "loose": 4, "own": 5}
    rows = [(i, k, [("a", "b")] if k == "good" else None, k == "own", True) for k, i in kinds.items()] + [(None, "no id", [], False, True), (6, None, [], False, False)]
    m = models(
        spark, str(tmp_path / "calls"), Ledger(spark, str(tmp_path / "ledger")), sufficient=lambda q: q not in ("thin", "own"),
        passed=lambda q, g: q not in ("weak", "own"), grounded=lambda g: "loose" not in g and "weak" not in g)
    out = {r["question"]: r for r in flow.run_batch(spark.createDataFrame(rows, QUESTION), m).collect()}
    said = {q: (r["generations"], r["retrievals"], r["retries"], r["attempted"], r["verified"], r["warning"], r["outcome"]) for q, r in out.items()}
    assert said == {
        "good": (1, 1, 0, False, True, None, "trusted_only_verified"),
        "bare": (1, 3, 0, True, False, "no_trusted_sources", "web_search_unverified"),
        "thin": (1, 3, 0, True, True, None, "web_search_verified"),
        "weak": (4, 1, 2, True, False, "not_verified_after_web", "web_search_unverified"),
        "loose": (1, 1, 0, False, False, "not_verified_trusted_only", "trusted_only_unverified"),
        "own": (1, 1, 0, False, True, None, "trusted_only_verified"),
        "": (1, 1, 0, False, True, None, "trusted_only_verified"),
    }
    assert [d["document_type"] for d in out["thin"]["documents"]] == ["law", "web"] and out["bare"]["documents"] == []
    got = calls(tmp_path / "calls")
    assert got["generate"]["weak"] == 4 and got["grade"]["weak"] == 4 and got["generate"]["thin"] == 1 and "bare" not in got["sufficient"]
    assert got["sufficient"]["thin"] == 1  # the same context thrice is one call
    assert got["missing_query"] == {"thin": 1, "bare": 1, "weak": 1} and "own" not in got["search_query"]


def test_findings_of_a_list_are_not_gathered_again(spark, monkeypatch):
    """Retrieval for what is missing finds the same rows of a table: nothing of them is written again."""
    yes, no = (flow.by_column(lambda *_, v=v: F.lit(v), native=True) for v in (True, False))
    docs = spark.createDataFrame([(i, n, f"text {min(n, 1)} of {i}", "s", "law") for i in range(20) for n in range(3)], "id long, ord int, text string, source string, document_type string")
    said = flow.by_column(lambda question, *_: question, native=True)
    grade = flow.by_column(lambda *_: F.struct(F.lit(True).alias("passed"), F.lit("").alias("missing_info")), native=True)
    web = docs.where("ord = 0").withColumn("document_type", F.lit("web"))
    names = []
    write = flow.Tables.write
    monkeypatch.setattr(flow.Tables, "write", lambda self, df, name: names.append(name) or write(self, df, name))
    m = flow.Models(flow.table_search(docs), flow.table_search(web), no, flow.hinted_question(), flow.question_alone(), said, grade, yes)
    out = flow.run_batch(spark.createDataFrame([(i, f"q{i}", [], False, True) for i in range(25)], QUESTION), m).collect()
    assert {r["retrievals"] for r in out} == {3} and names.count("lacking") == 3
    assert names.count("documents") == 3  # of retrieval, of the web, and at the end
    assert {r["id"]: [(d["text"], d["document_type"]) for d in r["documents"]] for r in out} == {
        i: [(f"text {n} of {i}", "law") for n in range(2)] + [(f"text 0 of {i}", "web")] if i < 20 else [] for i in range(25)}


def test_python_models_run_for_waiting_rows_alone(spark, tmp_path):
    path = str(tmp_path / "n")

    @F.udf("string")
    def generate(question, context, history, retries):
        with open(path, "a") as f:
            f.write("x\n")
        return question

    yes = flow.by_column(lambda *_: F.lit(True), native=True)
    docs = spark.createDataFrame([(i, 1, "t", "s", "law") for i in range(30)], "id long, ord int, text string, source string, document_type string")
    grade = flow.by_column(lambda *_: F.struct(F.lit(True).alias("passed"), F.lit("").alias("missing_info")), native=True)
    m = flow.Models(flow.table_search(docs), flow.table_search(docs), yes, flow.hinted_question(), flow.question_alone(), flow.by_column(generate), grade, yes)
    out = flow.run_batch(spark.createDataFrame([(i, f"q{i}", [], False, True) for i in range(30)], QUESTION), m)
    assert out.where("verified").count() == 30 and len(open(path).readlines()) == 30


def test_a_failed_call_is_a_response(spark, tmp_path):
    def broken(row):
        if row["question"] == "busy?":
            raise OSError("HTTP 429 slow down")
        if row["question"] == "broken?":
            raise ValueError("no such model")
        return "true"

    ledger = Ledger(spark, str(tmp_path / "l"), waits=())
    m = models(spark, str(tmp_path / "calls"), ledger)
    m.sufficient = paid(ledger, "sufficient", broken, "boolean")
    schema = "id long, gate string, question string, history array<struct<q:string,a:string>>, privacy_mode boolean"
    r = spark.createDataFrame([(1, None, "busy?", [], False), (2, None, "broken?", [], False), (3, None, "fine?", [("q", "a")], False), (4, "small_talk", "thanks", [], False)], schema)
    got = {x["id"]: x for x in asking.answered(r, m).collect()}
    assert {i: x["code"] for i, x in got.items()} == {1: 429, 2: 500, 3: 200, 4: 200}
    assert got[1]["answer"] == asking.BUSY and got[2]["answer"] == "ValueError: no such model" and got[3]["chat_history"][-1] == ["fine?", "answer to fine? 0"]
    assert {(x["name"], x["label"]): x["value"] for x in asking.answer_counters(asking.answered(r, m)).collect()} == {
        ("query_web_search_attempts", ""): 0, ("query_outcomes_total", "trusted_only_verified"): 1}
    assert sum(calls(tmp_path / "calls")["generate"].values()) == 1  # the failed rows went no further


def test_without_collections_nothing_is_retrieved(spark, tmp_path):
    m = models(spark, str(tmp_path / "calls"), Ledger(spark, str(tmp_path / "l")))
    m.retrieve = None
    out = flow.run_batch(spark.createDataFrame([(1, "q", [], True, True)], QUESTION), m, ready=False).first()
    assert out["documents"] == [] and out["warning"] == "no_trusted_sources"
    assert flow.run_batch(spark.createDataFrame([], QUESTION), models(spark, str(tmp_path / "c2"), Ledger(spark, str(tmp_path / "l2")))).count() == 0


def test_a_lost_task_asks_nothing_twice(spark, tmp_path):
    """The task dies after some calls, and is started again: one call per input in all."""
    log = str(tmp_path / "calls.txt")

    def call(row):
        made = len(open(log).readlines()) if os.path.exists(log) else 0
        if made == 7 and not os.path.exists(log + ".died"):
            open(log + ".died", "w").close()
            os._exit(1)
        with open(log, "a") as f:
            f.write(f"{row['question']}\n")
        return row["question"].upper()

    asked = spark.createDataFrame([(i, f"q{i % 20}") for i in range(40)] + [(99, None)], "id long, question string").coalesce(1)
    ledger = Ledger(spark, str(tmp_path / "ledger"))

    def upper(row):
        return "none" if row["question"] is None else call(row)

    try:
        got = ledger.ask(asked, "upper", upper).collect()
    except Exception:  # local mode has no second attempt: the job is run again
        got = ledger.ask(asked, "upper", upper).collect()
    assert {(r["id"], r["answer"], r["error"]) for r in got} == {(i, f"Q{i % 20}", None) for i in range(40)} | {(99, "none", None)}
    assert os.path.exists(log + ".died") and Counter(open(log).read().split()) == {f"q{i}": 1 for i in range(20)}
    more = ledger.ask(spark.createDataFrame([(1, "q3"), (2, "new")], "id long, question string"), "upper", upper).collect()
    assert {r["answer"] for r in more} == {"Q3", "NEW"} and len(open(log).readlines()) == 21
    assert ledger.ask(asked.limit(0), "upper", upper).count() == 0


def test_calls_wait_and_are_tried_again(spark, tmp_path):
    path = str(tmp_path / "n")

    def call(row):
        with open(path, "a") as f:
            f.write("x")
        if len(open(path).read()) < 3:
            raise OSError("429")
        return "ok"

    ledger = Ledger(spark, str(tmp_path / "l"), waits=(0.01, 0.01, 0.01))
    asked = spark.createDataFrame([(1, "q")], "id long, question string")
    assert ledger.ask(asked, "s", call).first()["answer"] == "ok" and open(path).read() == "xxx"
    with pytest.raises(ValueError):
        Ledger(type("S", (), {"conf": type("C", (), {"get": staticmethod(lambda *_: "true")})})(), "x")


def test_rows_with_one_finding_share_their_list(spark, tmp_path):
    """Forty questions of one vector: the vector is searched once, and each list of documents is written once."""
    chunks = spark.createDataFrame([(i, f"text {i}", "s", "law") for i in range(4)], "vec_id long, text string, source string, document_type string")
    asked, lists = [], []

    def search(queries):
        asked.append(queries.count())
        return queries.crossJoin(chunks.select("vec_id")).select("query_id", F.lit(0).alias("collection"), (F.col("vec_id") + 1).alias("rank"), "vec_id")

    yes = flow.by_column(lambda *_: F.lit(True), native=True)
    grade = flow.by_column(lambda *_: F.struct(F.lit(True).alias("passed"), F.lit("").alias("missing_info")), native=True)
    embed = lambda q: q.select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("query_vector"))
    m = flow.Models(flow.vector_retrieval(search, chunks, embed), flow.table_search(chunks.select(F.col("vec_id").alias("id"))), yes, flow.hinted_question(), flow.question_alone(),
                    flow.by_column(lambda *_: F.lit("g"), native=True), grade, yes)
    write = flow.Tables.write

    def noting(self, df, name):
        out = write(self, df, name)
        lists.extend([out.count()] if name == "documents" else [])
        return out

    flow.Tables.write = noting
    try:
        out = flow.run_batch(spark.createDataFrame([(i, f"q{i}", [], False, True) for i in range(40)], QUESTION), m).collect()
    finally:
        flow.Tables.write = write
    assert asked == [1] and lists == [1, 1] and {tuple(d["text"] for d in r["documents"]) for r in out} == {tuple(f"text {i}" for i in range(4))} and len(out) == 40
