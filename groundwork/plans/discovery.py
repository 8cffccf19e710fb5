"""The registry built from what is on disk, and jobs that load, download and register sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as tx, versions as vs
from ..functions.text import falsy
from ..operators import dedupe, registry
from ..operators.tables import written
from ..sources import files
from ..sources.chunking import split_documents, xml_text

#: Fixed value: the folder of laws. All others hold PDFs of agencies.
LAW = "Bekendtgørelse"
FIELDS = ("id", "name", "url", "folder", "filename_hint", "version")


def from_markers(markers: DataFrame) -> DataFrame:
    """Candidate rows of version marker files (id, version), by id; the URL follows from the label."""
    got = vs.label_year_nr(F.col("version"))
    url = F.when(got.isNotNull(), F.format_string("https://www.retsinformation.dk/eli/lta/%d/%d", got["year"], got["nr"]))
    return markers.select("id", tx.default_label(F.col("id")).alias("name"), url.alias("url"), F.lit(LAW).alias("folder"), F.lit(None).cast("string").alias("filename_hint"), "version", F.col("id").alias("path"))


def from_pages(first_pages: DataFrame) -> DataFrame:
    """Candidate rows of PDFs by the texts of their first pages: path, stem, folder, meta_title, page."""
    got = vs.title_and_version(F.col("meta_title"), F.col("page"), F.col("stem"))
    df = first_pages.withColumn("__t", got)
    return df.select(
        tx.slug(F.col("stem")).alias("id"), F.col("__t.title").alias("name"), F.lit(None).cast("string").alias("url"), "folder",
        F.col("stem").alias("filename_hint"), F.col("__t.version").alias("version"), "path")


def build_registry(markers: DataFrame, laws: DataFrame, agency: DataFrame, known: DataFrame | None = None, confirmed: DataFrame | None = None) -> DataFrame:
    """One registry of three discoveries, in this order and each by path. Of laws the first row of an
    id stays; agency rows keep all and take a free suffix. ``known`` (id, name, url, version, ord) fills
    URLs and versions, ``confirmed`` (id, url) replaces URLs."""
    both = markers.withColumn("__turn", F.lit(0)).unionByName(laws.withColumn("__turn", F.lit(1))).where("id <> ''")
    first = dedupe.keep_first(both, ["id"], ["__turn", "path"])
    more = agency.where("id <> ''").withColumn("__turn", F.lit(2))
    every = first.unionByName(more).withColumn("__ord", F.struct("__turn", "path"))
    named = dedupe.suffix_ids(every, "id", ["__turn", "path"]).withColumn("id", F.col("unique_id")).drop("unique_id")
    if known is not None:
        named = registry.merge_discovered(named, known)
        named = named.withColumn("url", F.coalesce(falsy(F.col("known_url")), F.col("url"))).withColumn("version", F.coalesce(falsy(F.col("version")), F.col("known_version")))
    if confirmed is not None:
        named = named.join(confirmed.select("id", F.col("url").alias("__sure")), "id", "left").withColumn("url", F.coalesce("__sure", "url"))
    return named.select(*[F.col(c) for c in FIELDS], F.col("__ord.__turn").alias("turn"), "path")


def disk_registry(spark: SparkSession, root: str, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """:func:`build_registry` over a folder: ``*_version.txt``, laws in a folder of that name, other PDFs."""
    def pages(path: str, kind: str) -> DataFrame:
        df = files.pdf_pages(files.pdf_files(spark, path, kind), reader).where("page = 0")
        return df.select(F.col("source").alias("path"), F.regexp_extract("source", r"([^/]+)\.[^./]*$", 1).alias("stem"), F.col("document_type").alias("folder"), F.lit(None).cast("string").alias("meta_title"), F.col("text").alias("page"))

    found = pages(root, "IAEA")
    law = F.contains("path", F.lit(f"/{LAW}/")) | F.contains("path", F.url_encode(F.lit(LAW)))
    return build_registry(from_markers(files.version_markers(spark, root)), from_pages(found.where(law).withColumn("folder", F.lit(LAW))), from_pages(found.where(~law)))


def write_registry(sources: DataFrame, path: str) -> None:
    """The whole registry as JSON lines (flow mappings, to a YAML parser), in the order of discovery, in one
    commit in place of the old one."""
    order = [c for c in ("turn", "path", "id") if c in sources.columns]
    line = F.to_json(F.struct(*[F.col(c) for c in FIELDS]), {"ignoreNullFields": "false"})
    sources.orderBy(*order).select(line.alias("value")).write.mode("overwrite").text(path)


def loaded(sources: DataFrame, contents: DataFrame, pages_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(chunks of laws, chunks of agencies) of sources with an address: two plans by folder, XML for the
    one and PDF pages for the other. ``contents``: id, content; ``pages_of`` gives (source, document_type, page, text)."""
    s = sources.where(F.coalesce("url", F.lit("")) != "").join(contents, "id")
    law = s.where(F.col("folder") == LAW).select(F.col("name").alias("source"), F.lit("Danish law").alias("document_type"), xml_text("content").alias("text"))
    other = s.where(F.col("folder") != LAW).select(F.col("name").alias("path"), F.lit("IAEA").alias("document_type"), "content")
    return split_documents(law.where("text <> ''"), "text"), pages_of(other)


def all_chunks(local: DataFrame, from_registry: DataFrame) -> DataFrame:
    """Chunks of local files and of the registry together; copies stay, as a bag."""
    return local.unionByName(from_registry, allowMissingColumns=True)


def path_order(df: DataFrame, *, tag: str = "ord") -> DataFrame:
    """The rows of files with their place in the order of paths, null ones first, by running counts within
    ranges. The ranges are drawn once, and written: drawn anew, they would have other borders."""
    ranged = written(df.repartitionByRange("path").withColumn("__range", F.spark_partition_id()), "ranges")
    upto = F.sum("count").over(Window.orderBy("__range"))  # one row for each range
    before = ranged.groupBy("__range").count().select("__range", (upto - F.col("count")).alias("__before"))
    n = F.row_number().over(Window.partitionBy("__range").orderBy("path"))
    return ranged.withColumn("__n", n).join(F.broadcast(before), "__range").withColumn(tag, F.col("__before") + F.col("__n") - 1).drop("__range", "__n", "__before")


def updated_files(status: DataFrame, fresh: DataFrame, existing: DataFrame, stamp: Column, keep: int = 2) -> tuple[DataFrame, DataFrame]:
    """(files to write, backups to keep) of a download: sources with an update and a fetched file
    replace it, and what was there becomes a backup. ``fresh``: id, content; ``existing``: id, path,
    content, is_backup, modified; the newest ``keep`` backups of a source stay."""
    changed = status.where("update_available").select("id", "remote_version").join(fresh, "id")
    now = existing.where("NOT is_backup").join(changed.select("id"), "id", "left_semi")
    moved = now.select("id", F.concat("path", F.lit(".bak-"), F.date_format(stamp, "yyyyMMddHHmmss")).alias("path"), "content", F.lit(True).alias("is_backup"), stamp.alias("modified"))
    kept = dedupe.newest(existing.where("is_backup").unionByName(moved), ["id"], [F.col("modified").desc(), F.col("path").desc()], keep)
    target = now.select("id", "path")
    return changed.join(target, "id", "left").select("id", F.coalesce("path", F.col("id")).alias("path"), "content", F.col("remote_version").alias("version")), kept
