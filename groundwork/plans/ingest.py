"""Ingestion into vector collections: chunk, embed, write; refresh and append."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import dedupe_key
from ..operators.vector import hashed_embedding
from ..sources.chunking import split_documents

#: The two collections and the type of documents that each holds.
COLLECTIONS = {"IAEA": "agency", "Danish law": "law"}


def chunks(documents: DataFrame) -> DataFrame:
    """Documents (source, document_type, text) as chunks with their collection and key."""
    known = F.create_map(*[F.lit(x) for kv in COLLECTIONS.items() for x in kv])
    df = split_documents(documents.select("source", "document_type", "text"), "text").withColumnRenamed("chunk", "text")
    return df.withColumn("collection", F.coalesce(F.element_at(known, F.col("document_type")), F.lit("other"))).withColumn(
        "key", dedupe_key(F.col("text"), F.col("source"), F.col("document_type")))


def embedded(df: DataFrame, embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    return df.withColumn("embedding", embed(F.col("text")))


def refresh(df: DataFrame, path: str, provider: str) -> None:
    """Replaces the provider's collections that ``df`` holds, and no others, in one commit."""
    out = df.withColumn("provider", F.lit(provider))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("provider", "collection").parquet(path)


def append(df: DataFrame, path: str, provider: str) -> int:
    """Adds the chunks whose key the collection does not hold yet; their number."""
    spark = df.sparkSession
    have = spark.read.parquet(path).where(F.col("provider") == provider).select("collection", "key")
    new = df.dropDuplicates(["collection", "key"]).join(have, ["collection", "key"], "left_anti").withColumn("provider", F.lit(provider))
    seen = new.count()
    if seen:
        new.select(*[c for c in new.columns]).write.mode("append").partitionBy("provider", "collection").parquet(path)
    return seen


def ready(spark: SparkSession, path: str, provider: str, n: int = 2) -> DataFrame:
    """(ready, message): all collections are there and hold rows."""
    per = spark.read.parquet(path).where(F.col("provider") == provider).groupBy("collection").count()
    ok = (F.count("*") >= n) & (F.min("count") > 0)
    return per.agg(F.coalesce(ok, F.lit(False)).alias("ready")).withColumn("message", F.when(F.col("ready"), "").otherwise(f"embeddings of {provider} are not built yet"))


def write_report(results: DataFrame, path: str) -> None:
    """Evaluation results as JSON lines and as a table in Markdown."""
    results.write.mode("overwrite").json(f"{path}/json")
    cell = [F.coalesce(F.when(F.lit(t == "double"), F.format_string("%.3f", F.col(c).cast("double"))).otherwise(F.left(F.col(c).cast("string"), F.lit(200))), F.lit("")) for c, t in results.dtypes]
    results.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |")).alias("value")).write.mode("overwrite").text(f"{path}/markdown")
