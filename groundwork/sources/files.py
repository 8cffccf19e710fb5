"""File sources: PDF and XML bytes, version files, registries, golden items, caches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import falsy, strip
from ..functions.web import is_pdf
from .chunking import xml_text

#: Size limits of fetched files.
MAX_PDF, MAX_XML = 50 * 1024 * 1024, 5 * 1024 * 1024
SOURCE_FIELDS = ("id", "name", "url", "folder", "filename_hint", "version")
VERSION_STATE = "map<string,struct<version:string,updated_at:string,canonical_eli_url:string,accession_id:string,resolver_confidence:string,identity_updated_at:string>>"


def _binary(spark: SparkSession, path: str, glob: str) -> DataFrame:
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return df.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1))


def pdf_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Readable PDFs with their document type; what is too large or no PDF is left out."""
    return _binary(spark, path, "*.pdf").where(is_pdf(F.col("content"), MAX_PDF)).withColumn("document_type", F.lit(kind))


def pdf_pages(files: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """One row per non-blank page, from 0. ``reader`` gives a file's pages; where it fails the
    file has none."""

    def run(batches):
        for batch in batches:
            pages = []
            for v in batch["content"]:
                try:
                    pages.append(list(reader(v.as_py())))
                except Exception:  # noqa: BLE001 - an unreadable file is skipped, as the contract says
                    pages.append([])
            yield pa.RecordBatch.from_arrays([batch["path"], batch["document_type"], pa.array(pages, pa.list_(pa.string()))], ["source", "document_type", "pages"])

    rows = files.select("path", "document_type", "content").mapInArrow(run, "source string, document_type string, pages array<string>")
    return rows.select("source", "document_type", F.posexplode("pages").alias("page", "text")).where(F.length(strip(F.col("text"))) > 0)


def attachments(files: DataFrame) -> DataFrame:
    """Embedded files as files of their own: ``parts`` is array<struct<name, content>>."""
    rows = files.select("path", F.explode("parts").alias("a"))
    return rows.select(
        F.concat("path", F.lit(" (Anhang: "), "a.name", F.lit(")")).alias("path"), F.col("a.content").alias("content"), F.col("path").alias("parent_document")
    ).where("content IS NOT NULL")


def xml_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    df = _binary(spark, path, "*.xml").where(F.length("content") <= MAX_XML)
    return df.select(F.col("path").alias("source"), F.lit(kind).alias("document_type"), xml_text("content").alias("text")).where("text <> ''")


def version_state(spark: SparkSession, path: str) -> DataFrame:
    """One row per id of a JSON object file; a file that cannot be read gives none."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", VERSION_STATE)).alias("id", "v"))
    return rows.select("id", "v.*")


def version_markers(spark: SparkSession, path: str) -> DataFrame:
    """(id, version) from files ``<id>_version.txt``."""
    df = spark.read.option("pathGlobFilter", "*_version.txt").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return df.select(F.regexp_extract("_metadata.file_name", r"^(.*)_version\.txt$", 1).alias("id"), strip(F.col("value")).alias("version")).where("version <> ''")


def disk_versions(sources: DataFrame, markers: DataFrame, files: DataFrame) -> DataFrame:
    """(id, version): the marker, else the date of the hinted file."""
    dated = sources.where("filename_hint <> ''").join(files.select("folder", "name", "modified"), "folder").where(F.contains("name", "filename_hint"))
    dated = dated.groupBy("id").agg(F.date_format(F.min_by("modified", "name"), "yyyy-MM-dd").alias("dated"))
    df = sources.select("id").join(markers, "id", "left").join(dated, "id", "left")
    return df.select("id", F.coalesce(falsy(F.col("version")), "dated").alias("version"))


def registry_rows(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """A parsed registry file as sources: entries need id and name; other fields have defaults."""
    rows = [
        (i, *(str(e.get(f) or ("IAEA" if f == "folder" else "")).strip() if f in ("url", "version") else (e.get(f) or ("IAEA" if f == "folder" else "")) for f in SOURCE_FIELDS))
        for i, e in enumerate(entries) if isinstance(e, dict) and e.get("id") and e.get("name")
    ]
    return spark.createDataFrame(rows, "ord int, " + ", ".join(f"{f} string" for f in SOURCE_FIELDS))


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry in YAML. The file has one entry per source and is read on the driver."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    data = yaml.safe_load(text) or {}
    return registry_rows(spark, data.get("sources", []) if isinstance(data, dict) else data)


def golden_items(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions; items without a question are an error. Items without id get a digest."""
    df = spark.read.schema("id string, question string, expected_answer string, key_facts array<string>").json(path, multiLine=True)
    checked = F.assert_true(F.coalesce(strip(F.col("question")), F.lit("")) != "", F.lit("an item has no question"))
    return df.withColumn("ok", checked).select(F.coalesce("id", F.sha2("question", 256)).alias("id"), "question", "expected_answer", "key_facts", "ok").drop("ok")


def first_items(items: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The first ``n`` items, for a trial run."""
    return items.orderBy(order).limit(n)


def write_cache(results: DataFrame, path: str, golden_path: str, modified: str) -> None:
    """Results with the golden file that they belong to."""
    results.withColumns({"golden_path": F.lit(golden_path), "golden_modified": F.lit(modified)}).write.mode("overwrite").parquet(path)


def with_cache(items: DataFrame, cache: DataFrame) -> DataFrame:
    """``items`` with their cached results, null where an item has none; one entry of each id counts."""
    known = cache.drop("golden_path", "golden_modified").dropDuplicates(["id"])
    return items.join(known, "id", "left")


def in_order(results: DataFrame, asked: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """``results`` in the order in which they were asked for."""
    return asked.select(key, order).join(results, key, "left").orderBy(order)


def trail(rows: DataFrame, path: str) -> None:
    """Appends rows to a trail of JSON lines."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def valid_cache(cache: DataFrame, path: str, modified: str) -> DataFrame:
    """Cached results of this very golden file."""
    return cache.where((F.col("golden_path") == path) & (F.col("golden_modified") == modified))

