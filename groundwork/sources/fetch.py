"""Fetching as a join: addresses that may be fetched meet a table of fetched bodies.

A crawl leaves a table of (url, body); within a run every address is read once however often it is
asked for. Allowlists and size limits hold before a body is looked at, and what cannot be used comes
back with a reason, never as a failed job. Null addresses have the reason of those not allowed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import web
from ..functions.text import falsy, strip

#: Size limits of pages, PDFs and XML files, and how much of an XML file is searched for a label.
MAX_PAGE, MAX_PDF, MAX_XML, LABEL_CHARS = 2 * 1024 * 1024, 50 * 1024 * 1024, 5 * 1024 * 1024, 2048
#: Fixed value: how many results of a search are taken over.
WEB_RESULTS = 5


def fetched(asked: DataFrame, bodies: DataFrame, allowed: Callable[[Column], Column] = web.allowed_b, limit: int = MAX_PAGE) -> DataFrame:
    """``asked`` (url and more) with text and error. ``bodies``: url, body (binary), one row per url."""
    once = asked.select("url").distinct().withColumn("__ok", F.coalesce(allowed(F.col("url")), F.lit(False)))
    met = once.where("__ok").join(bodies.select("url", "body"), "url", "left")
    size = F.octet_length("body")
    error = F.when(F.col("body").isNull(), "not found").when(size > limit, "too large")
    met = met.select("url", error.alias("error"), F.when(error.isNull(), web.as_text(F.col("body"))).alias("text"), F.lit(True).alias("__met"))
    out = asked.join(met, "url", "left")
    return out.withColumn("error", F.when(F.col("__met").isNull(), "not allowed").otherwise(F.col("error"))).drop("__met")


def files_of(asked: DataFrame, bodies: DataFrame, kind: str, allowed: Callable[[Column], Column] = web.allowed_a) -> DataFrame:
    """``asked`` (url and more) with the content of its PDF or XML file, or null: allowed, within its
    limit and of that kind by its first bytes."""
    good = web.is_pdf(F.col("body"), MAX_PDF) if kind == "pdf" else web.looks_like_xml(F.col("body")) & (F.length("body") <= MAX_XML)
    target = web.pdf_url(F.col("url")) if kind == "pdf" else web.xml_url(F.col("url"))
    df = asked.withColumn("__target", F.when(allowed(F.col("url")), F.coalesce(target, F.when(F.lit(kind == "pdf"), F.col("url")))))
    met = bodies.where(good).select(F.col("url").alias("__target"), F.col("body").alias("content"))
    return df.join(met, "__target", "left").drop("__target")


def node_metadata(asked: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``asked`` (url and more) with the label and JSON of the document's metadata; JSON that is no
    object gives none. ``snapshots``: url, json."""
    target = web.metadata_url(F.col("url"))
    v = F.try_parse_json("json")
    is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    known = snapshots.select(F.col("url").alias("__target"), F.when(is_object, F.col("json")).alias("metadata"), F.when(is_object, web.json_label(v)).alias("label"))
    return asked.withColumn("__target", target).join(known, "__target", "left").drop("__target")


def xml_label(content: Column) -> Column:
    """The decree label among the first characters of an XML file."""
    head = F.left(web.as_text(content), F.lit(LABEL_CHARS))
    return falsy(strip(F.regexp_extract(head, r"(?i)(BEK\s+nr\s+\d+\s+af\s+\d{1,2}/\d{1,2}/\d{4})", 1)))


def encoded_query(query: Column, *, keep_slash: bool = False) -> Column:
    """A query percent-encoded with %20 for blanks; ``url_encode`` writes plus signs, leaves ``*`` and
    encodes ``~``."""
    out = F.replace(F.replace(F.url_encode(query), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    out = F.replace(out, F.lit("%7E"), F.lit("~"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if keep_slash else out


def web_documents(results: Column, limit: int = WEB_RESULTS) -> Column:
    """Search results as documents: what has neither snippet nor title nor link is left out."""
    docs = F.transform(F.slice(results, 1, limit), lambda r: F.struct(
        F.coalesce(falsy(r["snippet"]), r["title"], F.lit("")).alias("text"), F.coalesce(falsy(strip(r["link"])), F.lit("web_search")).alias("source"),
        F.lit("web").alias("document_type"), (strip(F.coalesce(r["link"], F.lit(""))) == "").alias("bare")))
    kept = F.filter(docs, lambda d: (d["text"] != "") | ~d["bare"])
    return F.transform(kept, lambda d: F.struct(d["text"].alias("text"), d["source"].alias("source"), d["document_type"].alias("document_type")))
