"""The queries that apply the operators to whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import cotrain, crf_language, toxicity, warc
from .decontaminate import decontaminate
from .divergence import divergence
from .jaccard_join import jaccard_components
from .mixing import mix
from .pivot_search import top_k
from .sharding import shard_slots
from .shared import crc_mod, table
from .token_counts import count_tokens
from .url_filter import GIVEN_RULES, METHOD_RULES, judge_urls
from .variants import spelling_variants


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.fresh_archive(spark)
    warc.write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.read_warc(spark, path, payload=False).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2)
    scored = toxicity.fit_and_score(docs, docs, labels)
    return scored.select(
        "doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, GIVEN_RULES + METHOD_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs)
    taken = (F.col("copies") * F.col("size")).cast("long")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), budgets=[1024])
    return counted.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), F.element_at("fits", 1).alias("chars_in_limit")
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = docs.where(crc_mod("doc_id", 5) != 0)
    found = crf_language.fit_and_identify(docs.select("doc_id", "text"), labelled)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose crc32(doc_id as text) mod 4 is 2 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    views = cotrain.fit(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2))
    return cotrain.score(docs, views).select(
        "doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_slots(docs, 8).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_top_k": op4_top_k,
    "op5_url_filter": op5_url_filter,
    "op6_mixing": op6_mixing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_token_counts": op8_token_counts,
    "op9_language": op9_language,
    "op10_quality": op10_quality,
    "op11_spelling": op11_spelling,
    "op12_sharding": op12_sharding,
    "op13_divergence": op13_divergence,
}
