"""The question workflow over a table of questions.

Rows are dealt by the stage that they wait for. A stage takes its own rows only, so a model is called once
per row and stage, and the earliest stage that any row waits for runs first: rows that were sent on wait
until the others have come up, and each stage sees as many rows at once as it can. What a stage does not
touch is not written again: the state of a row (counters, the answer, where next) lies in the table of the
stage that it left last. Its documents are a list that it names by key: a list is written once, by the search
that found the last of its documents, however many rows have it, and only where it holds something new.

Retrieval, search and models are functions on tables: they take ``id`` and their inputs and give ``id`` and
``answer`` (or documents), with ``error`` where they can fail. A row with an error is done, and keeps it.
``by_column`` makes one of a column function, :meth:`ledger.Ledger.ask` one of a paid call.

Ids are unique; null ids are not asked. Null questions count as empty."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions import routing as rt, text as tx
from ..operators import context as ctx
from ..operators.tables import Tables, once

#: A document of a question: its key tells copies apart; what a web search found is not trusted.
DOC = "struct<text:string,source:string,document_type:string,key:string,trusted:boolean>"
#: Most characters of a query for what is missing, and of a web query.
MISSING_CHARS, SEARCH_CHARS = 150, 200
#: Sites that count as trusted in a web search.
TRUSTED_SITES = ("iaea.org", "retsinformation.dk", "sst.dk")
#: In the order in which waiting rows are taken.
STAGES = ("retrieve", "grade_documents", "retrieve_missing", "web_search", "generate", "grade_generation", "verify", "verify_wider")
NO_CONTEXT = "None."

Model = Callable[[DataFrame], DataFrame]


def by_column(expression: Callable[..., Column], *, native: bool = False) -> Model:
    """A model of a function on its inputs' columns, in the order that :class:`Models` names. Where it is
    ``native``, an answer may be computed again where it is used; else its rows are written."""

    def model(asked: DataFrame) -> DataFrame:
        return asked.select("id", expression(*[F.col(c) for c in asked.columns if c != "id"]).alias("answer"))

    model.native = native
    return model


@dataclass
class Models:
    """What the workflow asks. Inputs besides id:

    ``retrieve``, ``search``: query, giving id, ord, text, source, document_type; ``sufficient``: question,
    context, giving a boolean; ``missing_query``: question, context, hint; ``search_query``: question,
    context; ``generate``: question, context, history, retries; ``grade``: question, context, generation,
    giving a struct of passed and missing_info; ``grounded``: context, generation, giving a boolean."""

    retrieve: Model
    search: Model
    sufficient: Model
    missing_query: Model
    search_query: Model
    generate: Model
    grade: Model
    grounded: Model


def question_alone() -> Model:
    """The question as the query, for want of a model."""
    return by_column(lambda question, *_: tx.strip(question), native=True)


def hinted_question() -> Model:
    """The query for what is missing, for want of a model: the question, and the hint of the last grading
    where it says more than 'retry'."""

    def query(question: Column, context: Column, hint: Column) -> Column:
        useful = F.when(~F.lower(tx.strip(hint)).isin("", "retry"), tx.strip(hint))
        return F.coalesce(F.concat(tx.strip(question), F.lit(" "), useful), tx.strip(question))

    return by_column(query, native=True)


def _none() -> Column:
    return F.array().cast(f"array<{DOC}>")


def _texts(docs: Column, trusted: bool = False) -> Column:
    return F.transform(F.filter(docs, lambda d: d["trusted"]) if trusted else docs, lambda d: F.coalesce(d["text"], F.lit("")))


def within(texts: Column, per: int, total: int) -> Column:
    """Texts within a budget, as operators.context.budgeted has it; here within one row."""
    parts = F.filter(F.transform(texts, lambda t: F.left(t, F.lit(per))), lambda x: x != "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("spent"), F.lit(False).alias("done"))

    def step(s, x):
        left = F.lit(total) - s["spent"] - 20
        fits = s["spent"] + F.length(x) + 2 <= total
        part = F.when(fits, x).when(left > 0, F.concat(F.left(x, left), F.lit("...")))
        out = F.when(s["done"] | part.isNull(), s["out"]).otherwise(F.concat(s["out"], F.when(s["spent"] > 0, F.lit("\n\n")).otherwise(F.lit("")), part))
        spent = F.when(s["done"] | ~fits, s["spent"]).otherwise(s["spent"] + F.length(x) + 2)
        return F.struct(out.alias("out"), spent.cast("int").alias("spent"), (s["done"] | ~fits).alias("done"))

    return F.aggregate(parts, start, step, lambda s: s["out"])


def _merged(have: Column, new: Column) -> Column:
    """``have`` and those of ``new``, in order, whose key no document before has."""
    fresh = lambda kept, d: F.when(F.exists(kept, lambda x: x["key"] == d["key"]), kept).otherwise(F.concat(kept, F.array(d)))
    return F.aggregate(F.coalesce(new, _none()), have, fresh)


def _history(c: str = "history") -> Column:
    return F.coalesce(c, F.array().cast("array<struct<q:string,a:string>>"))


def _sure(answer: str = "answer") -> Column:
    return F.coalesce(F.col(answer).cast("boolean"), F.lit(False))


class _Run:
    def __init__(self, questions: DataFrame, models: Models, *, ready: bool, trusted_only: bool):
        self.tables, self.m, self.trusted_only, self.ready = Tables(questions.sparkSession), models, trusted_only, ready
        self.parts: list[DataFrame] = []
        self.searches: list[Model] = []
        self.waiting: dict[str, list[DataFrame]] = {s: [] for s in STAGES}
        self.done: list[DataFrame] = []
        none = lambda kind: F.lit(None).cast(kind)
        first = questions.where("id IS NOT NULL").select(
            "id", F.coalesce("question", F.lit("")).alias("question"), "history", F.coalesce("private", F.lit(False)).alias("private"), F.coalesce("web_enabled", F.lit(False)).alias("web_enabled"),
            F.lit("").alias("docs"), F.lit(0).alias("n_docs"), F.lit(0).alias("n_trusted"), F.lit(0).alias("retrievals"), F.lit(0).alias("retries"), F.lit(False).alias("attempted"), F.lit(0).alias("generations"), none("string").alias("generation"),
            F.lit("").alias("hint"), F.lit(False).alias("verified"), none("string").alias("warning"), none("string").alias("outcome"), none("string").alias("error"), F.lit("retrieve").alias("next"))
        self.state = first.columns
        self.deal(first)

    # Rows and documents

    def deal(self, rows: DataFrame) -> None:
        """Writes rows that leave a stage and puts them where they wait next, finished ones too."""
        seen = Observation()
        counts = [F.count_if(F.col("next") == stage).alias(stage) for stage in (*STAGES, "done")]
        left = self.tables.write(rows.select(*self.state).observe(seen, *counts), "questions")
        for stage, n in seen.get.items():
            if n:
                (self.done if stage == "done" else self.waiting[stage]).append(left.where(F.col("next") == stage))

    def take(self) -> tuple[str, DataFrame] | None:
        for stage in STAGES:
            if self.waiting[stage]:
                rows = reduce(DataFrame.unionByName, self.waiting[stage])
                self.waiting[stage] = []
                return stage, rows
        return None

    def with_documents(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their documents: a row names its list."""
        if not self.parts:
            return rows.withColumn("documents", _none())
        return rows.join(self.lists(), "docs", "left").withColumn("documents", F.coalesce("documents", _none()))

    def lists(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [p.select("docs", "documents") for p in self.parts])

    def add(self, rows: DataFrame, queries: DataFrame, search: Model, *, trusted: bool) -> DataFrame:
        """``rows`` with the lists that they have after what ``search`` finds for ``queries``. A ``shared``
        search names the findings, so that rows with one list and one finding share the list that follows. What
        a ``table`` search finds is the same each time, so it is gathered only for lists that it is no part of."""
        key = tx.dedupe_key(F.col("text"), F.col("source"), F.col("document_type"))
        doc = F.struct("text", "source", "document_type", key.alias("key"), F.lit(trusted).alias("trusted"))
        if hasattr(search, "shared"):
            names, found = search.shared(queries, self.tables)
        else:
            names, found = queries.select("id", F.col("id").alias("found")), search(queries).withColumn("found", F.col("id"))
        met = self.tables.write(rows.select("id", "docs").join(names, "id"), "met")
        pairs = met.select("docs", "found").distinct()
        if self.parts and hasattr(search, "table"):
            pairs = self.tables.write(self.lacking(pairs, search), "lacking")
            if pairs.isEmpty():
                return rows
            found = found.join(pairs.select("found").distinct(), "found", "left_semi")
        fresh = found.groupBy("found").agg(F.array_sort(F.collect_list(F.struct("ord", doc.alias("doc")))).alias("new"))
        both = pairs.join(fresh, "found")
        both = both.join(reduce(DataFrame.unionByName, self.parts).select("docs", F.col("documents").alias("have"), "findings"), "docs", "left") if self.parts else both.withColumns({"have": _none(), "findings": F.array().cast("array<string>")})
        have = F.coalesce("have", _none())
        findings = F.concat(F.coalesce("findings", F.array().cast("array<string>")), F.array(self.named(search)))
        # Keys of lists differ between searches, and within one by the list before and the finding.
        after = F.md5(F.concat_ws("|", F.lit(str(len(self.parts))), "docs", F.col("found").cast("string")))
        merged = once(both, documents=_merged(have, F.transform("new", lambda x: x["doc"]))).where(F.size("documents") > F.size(have))
        trust = F.size(F.filter("documents", lambda d: d["trusted"]))
        part = self.tables.write(merged.select(F.col("docs").alias("before"), "found", after.alias("docs"), "documents", findings.alias("findings"), F.size("documents").alias("n_docs"), trust.alias("n_trusted")), "documents")
        self.parts.append(part)
        grown = part.select(F.col("before").alias("docs"), "found", F.struct("docs", "n_docs", "n_trusted").alias("grown"))
        moved = met.join(grown, ["docs", "found"]).select("id", "grown")
        now = {c: F.coalesce(F.col(f"grown.{c}"), F.col(c)) for c in ("docs", "n_docs", "n_trusted")}
        return rows.join(moved, "id", "left").withColumns(now).drop("grown")

    def lacking(self, pairs: DataFrame, search: Model) -> DataFrame:
        """The pairs of a list and a finding of a table's rows, but for lists that the finding is part of."""
        met = pairs.join(search.table.select(F.col("id").alias("found")).distinct(), "found", "left_semi")
        met = met.join(reduce(DataFrame.unionByName, [p.select("docs", "findings") for p in self.parts]), "docs", "left")
        return met.where(F.coalesce(~F.array_contains("findings", self.named(search)), F.lit(True))).select("docs", "found")

    def named(self, search: Model) -> Column:
        """A finding's name among those of all searches."""
        if not any(s is search for s in self.searches):
            self.searches.append(search)
        return F.concat(F.lit(f"{next(i for i, s in enumerate(self.searches) if s is search)}:"), F.col("found").cast("string"))

    def queried(self, rows: DataFrame, asked: DataFrame, model: Model, most: int) -> DataFrame:
        """(id, query, error): what a model makes of ``asked``, a written table; the question where it says nothing."""
        query = F.coalesce(tx.falsy(F.left(tx.strip(F.col("answer").cast("string")), F.lit(most))), F.col("question"))
        return self.tables.write(self.answers(rows, asked, model).select("id", query.alias("query"), "error"), "queries")

    def answers(self, rows: DataFrame, asked: DataFrame, model: Model) -> DataFrame:
        """``rows`` with the answer; those that were not asked have none. An error ends a row."""
        got = model(asked)
        if "error" not in got.columns:
            got = got.withColumn("error", F.lit(None).cast("string"))
        return rows.drop("error", "answer").join(got.select("id", "answer", "error"), "id", "left")

    @staticmethod
    def onward(rows: DataFrame, stage: Column) -> DataFrame:
        return rows.withColumn("next", F.when(F.col("error").isNotNull(), "done").otherwise(stage))

    def pass_on(self, rows: DataFrame, stage: str, model: Model) -> None:
        """Sends all rows to one stage; without a write where their answers can be computed again."""
        if getattr(model, "native", False):
            self.waiting[stage].append(rows.withColumn("next", F.lit(stage)).select(*self.state))
        else:
            self.deal(self.onward(rows, F.lit(stage)))

    # Stages: each gives its rows with where they go next, or has passed them on.

    def retrieve(self, rows: DataFrame) -> DataFrame | None:
        rows = rows.withColumn("retrievals", F.lit(1))
        if not self.ready:
            return self.onward(rows.withColumn("warning", F.lit("embeddings_not_built")), F.lit("grade_documents"))
        queries = rows.select("id", tx.follow_up_query(F.col("question"), _history()).alias("query"))
        rows = self.add(rows, queries, self.m.retrieve, trusted=True)
        self.waiting["grade_documents"].append(rows.withColumn("next", F.lit("grade_documents")).select(*self.state))
        return None

    def grade_documents(self, rows: DataFrame) -> DataFrame:
        got = self.answers(rows, self._sufficiency(rows), self.m.sufficient)
        return self.onward(got, rt.after_documents(rt.web_flag(F.col("n_docs") > 0, _sure(), F.col("private")), F.col("web_enabled")))

    def _sufficiency(self, rows: DataFrame) -> DataFrame:
        seen = self.with_documents(rows.where("n_docs > 0"))
        return seen.select("id", "question", within(_texts(F.col("documents")), *ctx.SUFFICIENCY).alias("context"))

    def retrieve_missing(self, rows: DataFrame) -> DataFrame:
        known = F.coalesce(tx.falsy(F.array_join(_texts(F.col("documents")), "\n\n")), F.lit(NO_CONTEXT))
        context = F.concat(tx.exchange_prefix(_history()), F.lit("Document context:\n"), known)
        asked = self.with_documents(rows).select("id", "question", context.alias("context"), "hint")
        said = self.queried(rows, asked, self.m.missing_query, MISSING_CHARS)
        got = self.add(rows, said.where("error IS NULL").select("id", "query"), self.m.retrieve, trusted=True)
        got = got.withColumn("retrievals", F.when(F.col("retries") == 0, F.col("retrievals") + 1).otherwise(F.col("retrievals")))
        got = got.drop("error").join(said.select("id", F.col("error").alias("failed")), "id", "left")
        # After a generation that did not pass, the next one is due whatever there is: nothing is asked.
        got = self.answers(got, self._sufficiency(got.where("failed IS NULL AND retries = 0")), self.m.sufficient).withColumn("error", F.coalesce("failed", "error"))
        return self.onward(got, rt.after_missing(F.col("retries"), _sure(), F.col("retrievals"), F.col("private")))

    def web_search(self, rows: DataFrame) -> None:
        known = F.coalesce(tx.falsy(F.array_join(F.transform(_texts(F.col("documents")), lambda t: F.left(t, F.lit(500))), "\n\n")), F.lit(NO_CONTEXT))
        asked = self.with_documents(rows).select("id", "question", F.concat(tx.exchange_prefix(_history(), 300), known).alias("context"))
        said = self.queried(rows, asked, self.m.search_query, SEARCH_CHARS)
        got = self.add(rows, self._restricted(said, F.lit(self.trusted_only)), self.m.search, trusted=False)
        got = got.drop("error").join(said.select("id", "error"), "id", "left")
        self.pass_on(got.withColumn("attempted", F.lit(True)), "generate", self.m.search_query)

    @staticmethod
    def _restricted(said: DataFrame, restrict: Column) -> DataFrame:
        return said.where("error IS NULL").select("id", tx.search_restriction(F.col("query"), restrict, TRUSTED_SITES).alias("query"))

    @staticmethod
    def rendered(docs: Column) -> Column:
        """What the generator reads: web documents first, each under its source."""
        web = lambda d: F.coalesce(d["document_type"], F.lit("")) == "web"
        ordered = F.concat(F.filter(docs, web), F.filter(docs, lambda d: ~web(d)))
        return F.array_join(F.transform(ordered, lambda d: tx.rendered(d["text"], d["source"], d["document_type"])), tx.CONTEXT_BREAK)

    def generate(self, rows: DataFrame) -> None:
        asked = self.with_documents(rows).select("id", "question", self.rendered(F.col("documents")).alias("context"), tx.history_text(_history()).alias("history"), "retries")
        got = self.answers(rows, asked, self.m.generate)
        got = got.withColumns({"generation": F.col("answer").cast("string"), "generations": F.col("generations") + 1, "hint": F.lit("")})
        self.pass_on(got, "grade_generation", self.m.generate)

    def grade_generation(self, rows: DataFrame) -> DataFrame:
        shown = F.coalesce(tx.falsy(self.rendered(F.col("documents"))), F.lit("No documents"))
        asked = self.with_documents(rows).select("id", "question", shown.alias("context"), "generation")
        got = self.answers(rows, asked, self.m.grade)
        passed = F.coalesce(F.col("answer.passed"), F.lit(False))
        said = F.coalesce(tx.falsy(tx.strip(F.col("answer.missing_info"))), F.lit("retry"))
        grade = rt.after_generation(passed, F.col("web_enabled"), F.col("attempted"), F.col("retries"), F.col("private"))
        got = got.withColumn("grade", grade).withColumn("hint", F.when(passed, "").otherwise(said))
        got = got.withColumn("retries", F.when(F.col("grade") == "retry", F.col("retries") + 1).otherwise(F.col("retries")))
        return self.onward(got, F.when(F.col("grade") == "retry", "retrieve_missing").when(F.col("grade") == "web_search", "web_search").otherwise("verify"))

    def _judged(self, got: DataFrame, has: Column, unsure: Column, otherwise: str) -> DataFrame:
        """Rows with the verdict on their answer: ``unsure`` is where those that are not grounded go on."""
        sound = has & _sure()
        warning = F.when(~has, "no_trusted_sources").when(sound | unsure, F.col("warning")).otherwise(otherwise)
        got = got.withColumns({"sound": sound, "verified": sound, "warning": warning})
        got = got.withColumn("outcome", F.when(F.col("error").isNull(), rt.outcome(F.col("attempted"), F.col("sound"))))
        return self.onward(got, F.when(has & ~F.col("sound") & unsure, "verify_wider").otherwise("done"))

    def verify(self, rows: DataFrame) -> DataFrame:
        seen = self.with_documents(rows.where("n_trusted > 0"))
        asked = seen.select("id", within(_texts(F.col("documents"), True), *ctx.GENERATION).alias("context"), "generation").where("context <> ''")
        got = self.answers(rows, asked, self.m.grounded)
        return self._judged(got, F.col("n_trusted") > 0, F.col("attempted"), "not_verified_trusted_only")

    def verify_wider(self, rows: DataFrame) -> DataFrame:
        """Once more, with what a search of trusted sites alone finds. Found texts count as one document,
        behind the others; without any, nothing is asked."""
        asked = rows.select("id", "question", F.lit(NO_CONTEXT).alias("context"))
        queries = self._restricted(self.queried(rows, asked, self.m.search_query, SEARCH_CHARS), F.lit(True))
        found = ctx.ordered_concat(self.m.search(queries).where("text <> ''"), ["id"], F.col("text"), ["ord"], "\n\n", "extra")
        seen = self.with_documents(rows).join(found, "id")
        texts = F.concat(_texts(F.col("documents"), True), F.array("extra"))
        got = self.answers(rows, seen.select("id", within(texts, *ctx.GENERATION).alias("context"), "generation"), self.m.grounded)
        return self._judged(got, F.lit(True), F.lit(False), "not_verified_after_web")

    def result(self) -> DataFrame:
        while (taken := self.take()) is not None:
            stage, rows = taken
            left = getattr(self, stage)(rows)
            if left is not None:
                self.deal(left)
        rows = reduce(DataFrame.unionByName, self.done) if self.done else self.tables.held[0][0]
        plain = F.transform("documents", lambda d: F.struct(d["text"].alias("text"), d["source"].alias("source"), d["document_type"].alias("document_type")))
        kept = [self.tables.write(rows.drop("next", "hint", "n_docs", "n_trusted"), "answers")]
        if self.parts:
            kept.append(self.tables.write(self.lists().join(kept[0].select("docs").distinct(), "docs", "left_semi").withColumn("documents", plain), "documents"))
        self.tables.drop(*[h[0] for h in self.tables.held if all(h[0] is not k for k in kept)])
        answers = kept[0].join(kept[1], "docs", "left") if self.parts else kept[0].withColumn("documents", F.lit(None))
        none = F.array().cast("array<struct<text:string,source:string,document_type:string>>")
        return answers.withColumn("documents", F.coalesce("documents", none)).drop("docs")


def run_batch(questions: DataFrame, models: Models, *, ready: bool = True, trusted_only: bool = False) -> DataFrame:
    """``questions``: id, question, history (an array of struct<q, a>), private, web_enabled. Returns them
    with documents, generation, counters, verified, warning, outcome and error, from two written tables, of
    answers and of lists of documents; all tables in between are removed. ``ready``: whether the collections can be searched."""
    return _Run(questions, models, ready=ready, trusted_only=trusted_only).result()


def table_search(found: DataFrame) -> Model:
    """A search that finds, whatever the query, what a table (id, ord, text, source, document_type) has for
    an id."""

    def model(queries: DataFrame) -> DataFrame:
        return found.join(queries.select("id"), "id", "left_semi")

    model.table = found
    return model


def vector_retrieval(search: Callable[[DataFrame], DataFrame], chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], *, by: str = "collection", order: Sequence[str] = ()) -> Model:
    """Retrieval from collections of vectors: the best of each, collections in order.

    ``search`` is that of a fitted operators.vector.VectorIndex, or nearest over a table; ``chunks``:
    vec_id, text, source, document_type; ``embed`` takes id, query and gives query_id, query_vector."""

    def model(queries: DataFrame) -> DataFrame:
        return placed(search(embed(queries))).withColumnRenamed("found", "id")

    def placed(near: DataFrame) -> DataFrame:
        place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(by)) if order else F.col(by).cast("long")
        return near.join(chunks, "vec_id").select(F.col("query_id").alias("found"), (place * 1000 + F.col("rank")).alias("ord"), "text", "source", "document_type")

    def shared(queries: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
        """Names of findings by id, and the findings: equal vectors are searched once."""
        asked = embed(queries).where("query_vector IS NOT NULL").withColumn("found", F.md5(F.col("query_vector").cast("string")))
        vectors = tables.write(asked.groupBy("found").agg(F.first("query_vector").alias("query_vector")), "vectors")
        return asked.select(F.col("query_id").alias("id"), "found"), placed(search(vectors.withColumnRenamed("found", "query_id")))

    model.shared = shared
    return model
