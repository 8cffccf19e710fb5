"""Documents as values: their plain metadata, and their form as JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DOCUMENT = "struct<text:string,source:string,document_type:string>"
#: The metadata that a chunk keeps.
PLAIN = ("source", "headings", "num_pages")


def plain_metadata(meta: Column) -> Column:
    """Of a VARIANT of metadata what is plain: source, headings (a list of texts) and the number of pages."""
    return F.struct(
        F.try_variant_get(meta, "$.source", "string").alias("source"), F.try_variant_get(meta, "$.headings", "array<string>").alias("headings"),
        F.try_variant_get(meta, "$.num_pages", "int").alias("num_pages"))


def to_text(docs: Column) -> Column:
    """An array of documents as JSON."""
    return F.to_json(docs)


def from_text(json: Column) -> Column:
    """The documents of :func:`to_text`; text that is none gives no documents."""
    none = F.array().cast(f"array<{DOCUMENT}>")
    return F.coalesce(F.from_json(json, f"array<{DOCUMENT}>"), none)
