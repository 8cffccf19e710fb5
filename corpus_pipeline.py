"""A training-data pipeline over ``documents``: five stages, each a written table.

Every stage takes what its predecessor kept, and all return the columns of documents, other ones
included, if there are more. Null ids, sources, languages and texts are judged as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from groundwork.llm import crf_language, toxicity
from groundwork.llm.decontaminate import decontaminate
from groundwork.llm.jaccard_join import jaccard_components
from groundwork.llm.mixing import mix, repeat_rows
from groundwork.llm.shared import table, written

#: A text stays if its words are of a known language, and half of them or more of one.
MIN_LANGUAGE_SHARE = 0.5
#: The threshold at which the toxicity operator predicts 1.
MAX_TOXICITY = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, null and empty ones too, and texts of which no language holds
    half. Rows with a null language are judged by the others' model; an empty table stays empty."""
    found = crf_language.fit_and_identify(docs, docs)
    ok = (F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE)
    return found.where(ok).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic texts. Rows with a null id are judged like others; texts without words take the
    share of toxic labels as their score; without labels nothing is rejected."""
    scored = toxicity.fit_and_score(docs, docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") < MAX_TOXICITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near copies: that with the smallest id (null last), of an id
    that repeats the row with the smallest hash of all its columns. Texts without words link with
    nothing and stay. Rows that are equal in every column are one document."""
    row = F.xxhash64(*docs.columns, *[F.col(f"`{c}`").isNull() for c in docs.columns])
    tagged = docs.withColumn("__row", row).withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    found = jaccard_components(tagged, carry=("__row",))
    place = F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("__row").alias("row"))
    best = found.where("group_key IS NOT NULL").groupBy("group_key").agg(F.min(place).alias("at"))
    bare = found.where("group_key IS NULL").select(place.alias("at")).distinct()
    kept = best.select("at").union(bare).select("at.id", "at.row")
    # Equal rows first: of each only one leaves its task, and the join needs no further shuffle.
    once = Window.partitionBy("__id", "__row").orderBy("__row")
    single = tagged.withColumn("__nth", F.row_number().over(once)).where("__nth = 1")
    return single.join(kept, (F.col("__id") == F.col("id")) & (F.col("__row") == F.col("row")), "left_semi").select(*docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark passage; null and empty texts hold none, and an empty
    benchmark rejects nothing."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's rate says; null is a source of its own."""
    return repeat_rows(mix(docs), docs.columns)


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", clean_of_benchmark),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned stages have no SQL form; tests/llm/test_corpus_pipeline.py has a brute-force version of run().
ORACLE_SQL = None
