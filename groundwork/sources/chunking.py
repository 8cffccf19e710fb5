"""Chunkers: the recursive splitter and XML text, inside Arrow tasks over one document each."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType

#: Separators of the splitter by priority, chunk size and overlap in characters.
SEPARATORS = ("\n\n", "§ ", "\n", ". ", " ", "")
SIZE, OVERLAP = 2500, 200
#: Characters of chunks that a task holds before it passes them on.
PART_CHARS = 2_000_000


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters: cut at the first separator that occurs, joined again
    up to the size, with up to ``overlap`` characters carried over; longer parts are cut further."""
    sep = next((s for s in separators if s == "" or s in text), "")
    deeper = separators[list(separators).index(sep) + 1 :] if sep in separators else ()
    if sep:
        head, *tail = text.split(sep)
        parts = [p for p in (head, *(sep + x for x in tail)) if p]
    else:
        parts = list(text)
    chunks: list[str] = []
    held: list[str] = []

    def emit() -> None:
        joined = "".join(held).strip()
        if joined:
            chunks.append(joined)

    total = 0
    for part in parts:
        if len(part) > size:
            emit()
            held, total = [], 0
            chunks += split_text(part, size, overlap, deeper or ("",))
            continue
        if held and total + len(part) > size:
            emit()
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.pop(0))
        held.append(part)
        total += len(part)
    emit()
    return chunks


def split_documents(df: DataFrame, text_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row per chunk: the other columns, ord and chunk. Null and blank texts give none."""
    names = [c for c in df.columns if c != text_col]

    def built(batch: pa.RecordBatch, rows: list[int], ords: list[int], chunks: list[str]) -> pa.RecordBatch:
        kept = batch.select(names).take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array(ords, pa.int32()), pa.array(chunks, pa.string())], [*names, "ord", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ords, chunks, held = [], [], [], 0
            for i, value in enumerate(batch[text_col]):
                for n, c in enumerate(split_text(value.as_py() or "", size, overlap)):
                    rows.append(i)
                    ords.append(n)
                    chunks.append(c)
                    held += len(c)
                    if held >= PART_CHARS:
                        yield built(batch, rows, ords, chunks)
                        rows, ords, chunks, held = [], [], [], 0
            if rows:
                yield built(batch, rows, ords, chunks)

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in names)
    return df.mapInArrow(run, f"{fields}ord int, chunk string")


@F.pandas_udf(StringType())
def xml_text(content: pd.Series) -> pd.Series:
    """Each element's text and then its tail, in pre-order, white space collapsed; unreadable XML
    gives an empty text."""

    def one(raw) -> str:
        try:
            root = ElementTree.fromstring(raw)
        except (ElementTree.ParseError, TypeError, ValueError):
            return ""
        return " ".join(" ".join(x for e in root.iter() for x in (e.text, e.tail) if x).split())

    return content.map(one)


def xml_text_in_order(c):
    """All text nodes in document order, natively."""
    return F.trim(F.regexp_replace(F.array_join(F.xpath(c, F.lit("//text()")), " "), r"(?U)\s+", " "))


#: Fixed value: the most tokens (words) of a structured chunk.
MAX_TOKENS = 512


def html_blocks(html):
    """Headings and paragraphs of HTML in order: array of struct(level, text), level 0 for paragraphs."""
    tag = r"(?is)<(h[1-6]|p|li)(?:\s[^>]*)?>([^<]+)"
    found = F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda x: F.struct(
        F.coalesce(F.nullif(F.regexp_extract(x, r"(?i)^<h([1-6])", 1), F.lit("")).cast("int"), F.lit(0)).alias("level"),
        F.trim(F.regexp_replace(F.regexp_extract(x, tag, 2), r"(?U)\s+", " ")).alias("text")))
    return F.filter(found, lambda b: b["text"] != "")


def structured_chunks(blocks: DataFrame, key: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Chunks of at most ``max_tokens`` words that do not cross a heading, with that heading.
    ``blocks``: key, pos, level (0: text), text. Longer texts are cut into pieces of half that size, so
    that pieces whose running counts begin in one half make up a chunk."""
    half = max_tokens // 2
    own = Window.partitionBy(key).orderBy("pos")
    section = F.sum((F.col("level") > 0).cast("int")).over(own)
    heading = F.last(F.when(F.col("level") > 0, F.col("text")), ignorenulls=True).over(own)
    text = blocks.withColumns({"section": section, "heading": heading}).where("level = 0")
    words = F.split("text", " ")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / half).cast("int")), lambda i: F.slice(words, i * half + 1, F.lit(half)))
    text = text.select(key, "section", "heading", "pos", F.posexplode(pieces).alias("nth", "w"))
    order = Window.partitionBy(key, "section").orderBy("pos", "nth")
    before = F.sum(F.size("w")).over(order) - F.size("w")
    text = text.withColumn("part", F.floor(before / half).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "nth", F.array_join("w", " ").alias("t"))))
    out = text.groupBy(key, "section", "part").agg(F.first("heading").alias("heading"), F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("chunk"), F.sum(F.size("w")).alias("tokens"))
    return out.select(key, F.col("section").cast("int").alias("section"), "part", "heading", "chunk", "tokens")
