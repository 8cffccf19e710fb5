"""Queries: retrieval, de-duplication, contexts, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators import context as ctx, dedupe, vector
from ..sources import chunking
from .tables import CENTROIDS, centroids, t


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "embeddings").withColumn("collection", F.col("label") % 2)


def knn_dual_top3(spark, sf_dir):
    v = _collections(spark, sf_dir)
    return vector.nearest(centroids(v), v).select("query_id", "collection", "rank", "vec_id", "score")


def knn_index(spark, sf_dir):
    """Every fiftieth vector as a query, through the index: cells with radius bounds, probed until no other
    one can hold a better vector."""
    v = _collections(spark, sf_dir)
    queries = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vector.VectorIndex.fit(v).search(queries)


def _retrieved(spark, sf_dir) -> DataFrame:
    """Per query the best three of each collection among vectors that have a document."""
    v = _collections(spark, sf_dir)
    d = t(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    with_doc = v.join(d.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    near = vector.nearest(centroids(v), with_doc)
    docs = near.join(d, near["vec_id"] == d["doc_id"]).withColumn("ord", F.col("collection") * 100 + F.col("rank"))
    key = tx.dedupe_key(F.col("text"), F.col("source"), F.col("lang"))
    return dedupe.keep_first(docs.withColumn("key", key), ["query_id", "key"], ["ord"])


def knn_merge_dedupe(spark, sf_dir):
    return _retrieved(spark, sf_dir).select("query_id", "ord", "doc_id", "score")


def rag_context(spark, sf_dir):
    """Retrieve from both collections, merge, and assemble a bounded context per query."""
    return ctx.budgeted(_retrieved(spark, sf_dir), ["query_id"], F.col("text"), ["ord"], *ctx.SUFFICIENCY)


def dedupe_key_count(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    key = tx.dedupe_key(F.col("text"), F.col("source"), F.col("lang"))
    return d.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def dedupe_keep_first(spark, sf_dir):
    d = t(spark, sf_dir, "documents").withColumn("key", tx.dedupe_key(F.col("text"), F.col("source"), F.col("lang")))
    return dedupe.keep_first(d.select("doc_id", "source", "lang", "key"), ["key"], ["doc_id"]).select("doc_id", "source", "lang")


def dedupe_anti_merge(spark, sf_dir):
    """Documents of less than 2,000 characters that no longer one has the key of, once each."""
    d = t(spark, sf_dir, "documents").withColumn("key", tx.dedupe_key(F.col("text"), F.col("source"), F.col("lang"))).select("doc_id", "lang", "key", "n_chars")
    _, added = dedupe.anti_merge(d.where("n_chars >= 2000"), d.where("n_chars < 2000"), "key", ["doc_id"])
    return added.select("doc_id", "lang")


def _requests(spark, sf_dir) -> DataFrame:
    """Documents in requests of eight."""
    return t(spark, sf_dir, "documents").withColumn("request", F.floor(F.col("doc_id") / 8))


def context_budget_small(spark, sf_dir):
    return ctx.budgeted(_requests(spark, sf_dir), ["request"], F.col("text"), ["doc_id"], *ctx.SUFFICIENCY)


def context_budget_large(spark, sf_dir):
    return ctx.budgeted(_requests(spark, sf_dir), ["request"], F.col("text"), ["doc_id"], *ctx.GENERATION)


def context_render_web_first(spark, sf_dir):
    d = _requests(spark, sf_dir).withColumn("later", (F.col("lang") != "fr").cast("int"))
    block = tx.rendered(F.col("text"), F.col("source"), F.col("lang"))
    return ctx.ordered_concat(d, ["request"], block, ["later", "doc_id"], tx.CONTEXT_BREAK)


def context_budget_rendered(spark, sf_dir):
    block = tx.rendered(F.col("text"), F.col("source"), F.col("lang"), 1200)
    return ctx.budgeted(_requests(spark, sf_dir), ["request"], block, ["doc_id"], None, 8000, sep=tx.CONTEXT_BREAK, charge_first=False)


def citations_distinct(spark, sf_dir):
    """Ordered distinct (source, type) pairs per request."""
    d = dedupe.keep_first(_requests(spark, sf_dir).select("request", "source", "lang", "doc_id"), ["request", "source", "lang"], ["doc_id"])
    cite = F.concat_ws("/", "source", "lang")
    return ctx.ordered_concat(d, ["request"], cite, ["doc_id"], ";", "citations")


def chunk_pages(spark, sf_dir):
    """One row per non-blank page with its position from 0."""
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text")).where(F.length(F.trim("text")) > 0)


def chunk_recursive(spark, sf_dir):
    return chunking.split_documents(t(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def chunk_windows(spark, sf_dir):
    """Fixed windows of 2500 characters with 200 shared: the native form of the splitter."""
    d = t(spark, sf_dir, "documents").where(F.length("text") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - 2500) / 2300.0)).cast("int")
    at = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("ord"))
    return at.select("doc_id", "ord", F.substring("text", F.col("ord") * 2300 + 1, F.lit(2500)).alias("chunk"))


def collection_ready(spark, sf_dir):
    per = _collections(spark, sf_dir).groupBy("collection").count()
    return per.agg(F.count("*").alias("collections"), F.min("count").alias("least"), ((F.count("*") == 2) & (F.min("count") > 0)).alias("ready"))


_KEY = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_S = f"""{CENTROIDS},
e AS (SELECT *, label % 2 AS collection FROM embeddings),
s AS (SELECT query_id, collection, vec_id, round(list_inner_product(qv, embedding::DOUBLE[]), 5) AS score FROM e, q {{where}}),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, vec_id)::INT AS rank FROM s),
n AS (SELECT * FROM k WHERE rank <= 3)"""
_M = _S.format(where="WHERE vec_id IN (SELECT doc_id FROM documents)") + f""",
m AS (SELECT query_id, collection * 100 + rank AS ord, doc_id, score, text, source, lang FROM n JOIN documents ON vec_id = doc_id),
u AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id, source, lang, left({_KEY}, 240) ORDER BY ord) = 1)"""


def _budget(source: str, key: str, order: str, per: int, total: int) -> str:
    return f"""b AS (SELECT {key} AS g, {order} AS o, left(text, {per}) AS x FROM {source} WHERE length(text) > 0),
r AS (SELECT *, sum(length(x) + 2) OVER (PARTITION BY g ORDER BY o) AS spent FROM b),
f AS (SELECT *, max((spent > {total})::INT) OVER (PARTITION BY g ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM r),
p AS (SELECT g, o, CASE WHEN spent <= {total} THEN x WHEN {total} - (spent - length(x) - 2) - 20 > 0
  THEN left(x, ({total} - (spent - length(x) - 2) - 20)::INT) || '...' END AS part FROM f WHERE coalesce(done, 0) = 0)
SELECT g AS {{out}}, string_agg(part, chr(10) || chr(10) ORDER BY o) AS context FROM p WHERE part IS NOT NULL GROUP BY 1"""


_REQ = "(SELECT *, doc_id // 8 AS request FROM documents)"
_SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
_BLOCK = "'[Source: ' || source || ' (' || lang || ')]' || chr(10) || "

QUERIES = {f.__name__: f for f in (
    knn_dual_top3, knn_index, knn_merge_dedupe, rag_context, dedupe_key_count, dedupe_keep_first, dedupe_anti_merge, context_budget_small,
    context_budget_large, context_render_web_first, context_budget_rendered, citations_distinct, chunk_pages, chunk_recursive, chunk_windows,
    collection_ready,
)}

ORACLE = {
    "knn_dual_top3": f"WITH {_S.format(where='')} SELECT query_id, collection, rank, vec_id, score FROM n",
    "knn_index": """WITH s AS (SELECT q.vec_id AS query_id, e.label % 2 AS collection, e.vec_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)
SELECT query_id, collection, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 3""",
    "knn_merge_dedupe": f"WITH {_M} SELECT query_id, ord, doc_id, score FROM u",
    "rag_context": f"WITH {_M}, {_budget('u', 'query_id', 'ord', 420, 3600).format(out='query_id')}",
    "dedupe_key_count": f"SELECT source || '|' || lang || '|' || left({_KEY}, 240) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1",
    "dedupe_keep_first": f"SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang, left({_KEY}, 240) ORDER BY doc_id) = 1",
    "dedupe_anti_merge": f"""WITH k AS (SELECT doc_id, lang, n_chars, source || '|' || lang || '|' || left({_KEY}, 240) AS key FROM documents)
SELECT doc_id, lang FROM k WHERE n_chars < 2000 AND key NOT IN (SELECT key FROM k WHERE n_chars >= 2000)
QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1""",
    "context_budget_small": f"WITH {_budget(_REQ, 'request', 'doc_id', 420, 3600).format(out='request')}",
    "context_budget_large": f"WITH {_budget(_REQ, 'request', 'doc_id', 1200, 8000).format(out='request')}",
    "context_render_web_first": f"""SELECT request, string_agg({_BLOCK} text, {_SEP} ORDER BY (lang <> 'fr')::INT, doc_id) AS context FROM {_REQ} GROUP BY 1""",
    "context_budget_rendered": f"""WITH b AS (SELECT request AS g, doc_id AS o, {_BLOCK} CASE WHEN length(text) > 1200 THEN left(text, 1200) || '...' ELSE text END AS x FROM {_REQ}),
c AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY g ORDER BY o) > 1 THEN 7 ELSE 0 END AS fee FROM b),
r AS (SELECT *, sum(length(x) + fee) OVER (PARTITION BY g ORDER BY o) AS spent FROM c),
f AS (SELECT *, 8000 - (spent - length(x) - fee) - fee - 20 AS rest, max((spent > 8000)::INT) OVER (PARTITION BY g ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM r),
p AS (SELECT g, o, CASE WHEN spent <= 8000 THEN x WHEN rest > 0 THEN left(x, rest::INT) || '...' END AS part FROM f WHERE coalesce(done, 0) = 0)
SELECT g AS request, string_agg(part, {_SEP} ORDER BY o) AS context FROM p WHERE part IS NOT NULL GROUP BY 1""",
    "citations_distinct": f"""SELECT request, string_agg(source || '/' || lang, ';' ORDER BY o) AS citations
FROM (SELECT request, source, lang, min(doc_id) AS o FROM {_REQ} GROUP BY 1, 2, 3) GROUP BY 1""",
    "chunk_pages": """SELECT doc_id, (i - 1)::INT AS page, x AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
  generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE length(trim(x)) > 0""",
    "chunk_windows": """SELECT doc_id, i::INT AS ord, substring(text, (i * 2300 + 1)::BIGINT, 2500) AS chunk FROM (
  SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 2500) / 2300.0))::BIGINT + 1)) AS i FROM documents WHERE length(text) > 0)""",
    "collection_ready": """SELECT count(*) AS collections, min(n) AS least, count(*) = 2 AND min(n) > 0 AS ready
FROM (SELECT label % 2 AS c, count(*) AS n FROM embeddings GROUP BY 1)""",
}
