"""Fixture tables in the roles that the engine's queries give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def centroids(vectors: DataFrame) -> DataFrame:
    """(query_id, query_vector): the mean vector of each label, the stated query set."""
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "v")))
    return means.groupBy(F.col("label").alias("query_id")).agg(F.transform(ordered, lambda p: p["v"]).alias("query_vector"))


def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a version history: a series per customer, with labels and URLs of decrees."""
    o = t(spark, sf_dir, "orders")
    y, m, d = (f("o_orderdate").cast("string") for f in (F.year, F.month, F.dayofmonth))
    label = F.concat(F.lit("BEK nr "), F.col("o_orderkey").cast("string"), F.lit(" af "), d, F.lit("/"), m, F.lit("/"), y)
    url = F.concat(F.lit("https://www.retsinformation.dk/eli/lta/"), y, F.lit("/"), F.col("o_orderkey").cast("string"))
    return o.select(
        F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("nr"), F.to_date("o_orderdate").alias("day"), label.alias("label"), url.alias("url")
    )


#: The same table in DuckDB.
LABELLED = """lo AS (SELECT o_custkey AS series, o_orderkey AS nr, CAST(o_orderdate AS DATE) AS day,
  'BEK nr ' || o_orderkey || ' af ' || day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) AS label,
  'https://www.retsinformation.dk/eli/lta/' || year(o_orderdate) || '/' || o_orderkey AS url FROM orders)"""
CENTROIDS = """q AS (SELECT label AS query_id, list(v ORDER BY i) AS qv FROM (
  SELECT label, i, round(avg(x), 6) AS v FROM (
    SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""
