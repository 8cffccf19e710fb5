"""How far the sources of a language are apart in their words.

Texts that are identical within a language are one row with a list of (source, copies): each task folds
what it reads before the shuffle, which deals by a digest of language and text, so a text that a third of
the rows repeat travels once per task. Each distinct text is tokenised once, and its counts are added for
every source times its copies; so are document frequencies. Terms in at least ``min_docs`` documents of
the language are kept. With count the occurrences in a group, N their sum over the V kept terms of the
language and p = 1 + floor(scale * (count + 2) / (N + 2 * V)), two groups diverge in a term by
floor((p - q)^2 / (p + q)), in integers throughout.

Pairs of sources are summed in blocks of terms and of sources. Only terms that one of both sources holds
are evaluated: a term that one holds alone by the distinct values of p, a term of both by itself, and the
rest, where both counts are 0, in one product. Blocks bound memory at any number of sources and terms.

Null text, language and source are ''. Texts without terms make their group known and add nothing; a
language without kept terms has pairs of value 0. Ties are ranked by the UTF-8 bytes of the item. Repeated
rows count as documents of their own. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import bytetext as bt
from .shared import Scratch

#: Bytes of distinct texts, and entries, that a task holds before it sends them on.
FOLD_BYTES, FOLD_ENTRIES = 16 << 20, 50_000
#: Bytes of text tokenised at a time, and (text, source, term) counts added at a time.
SLICE_BYTES, SLICE_COUNTS = 8 << 20, 4_000_000
#: Terms and sources of a block, on average.
BLOCK_TERMS, BLOCK_SOURCES = 4096, 256

FOLDED = "lang string, digest binary, text string, sources array<string>, copies array<bigint>"
COUNTS = "lang string, source string, term string, n bigint, df bigint"
PAIRED = "lang string, a string, b string, value bigint, terms bigint"


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to one row for each language and text, with copies per source."""
    held: dict[tuple[str, str], dict[str, int]] = {}
    size = entries = 0

    def out() -> pa.RecordBatch:
        digests = [hashlib.blake2b(f"{len(lang)}:{lang}{text}".encode(), digest_size=32).digest() for lang, text in held]
        columns = [[k[0] for k in held], digests, [k[1] for k in held], [list(v) for v in held.values()], [list(v.values()) for v in held.values()]]
        kinds = [pa.string(), pa.binary(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "digest", "text", "sources", "copies"])

    for batch in batches:
        for lang, source, text in zip(*[batch.column(c) for c in ("lang", "source", "text")]):
            key, source = (lang.as_py(), text.as_py()), source.as_py()
            found = held.get(key)
            if found is None:
                found = held[key] = {}
                size += len(key[1])
            entries += source not in found
            found[source] = found.get(source, 0) + 1
            if size > FOLD_BYTES or entries > FOLD_ENTRIES:
                yield out()
                held, size, entries = {}, 0, 0
    if held:
        yield out()


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions first[i], ..., first[i] + count[i] - 1 of all i, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - first, count)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each value column."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[at], *[np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]


def term_table(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of some texts, and per text its (term, occurrences), with a border for each text."""
    data, offsets = bt.column_bytes(texts)
    w = bt.words(data, offsets, bt.byte_class("letters"))
    size = w.end - w.start
    body = w.data[_spread(w.start, size)] if len(size) else w.data[:0]
    ends = np.r_[0, np.cumsum(size)].astype(np.int64)
    tokens = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body)))
    coded = tokens.dictionary_encode()
    k = max(1, len(coded.dictionary))
    owner = np.repeat(np.arange(len(texts)), np.diff(w.first))
    key, n = np.unique(owner * k + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return coded.dictionary.cast(pa.string()), key % k, n.astype(np.int64), np.searchsorted(key, np.arange(len(texts) + 1) * k)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded rows in order of (lang, digest) to counts per (lang, source, term); a row of each group
    with a null term makes the group known."""
    last: tuple | None = None
    for batch in batches:
        _, offsets = bt.column_bytes(batch.column("text"))
        for lo, hi in bt.pieces(offsets, SLICE_BYTES):
            part = batch.slice(lo, hi - lo)
            marks = list(zip(part.column("lang").to_pylist(), part.column("digest").to_pylist()))
            new = np.array([i == 0 or m != marks[i - 1] for i, m in enumerate(marks)])
            if last is not None and marks[0] == last[0]:  # the text before goes on: it is not tokenised again
                new[0] = False
            own = term_table(part.column("text").filter(pa.array(new)))
            text_of = np.cumsum(new) - 1
            if text_of[0] < 0:
                lead = int(np.sum(text_of < 0))
                yield from _added(part.slice(0, lead), np.zeros(lead, np.int64), *last[1])
                part, text_of = part.slice(lead), text_of[lead:]
            if len(part):
                yield from _added(part, text_of, *own)
                a, b = own[3][-2:]
                used = own[1][a:b]
                last = (marks[-1], (own[0].take(pa.array(used)), np.arange(b - a), own[2][a:b], np.array([0, b - a])))


def _added(part: pa.RecordBatch, text_of: np.ndarray, terms: pa.Array, code: np.ndarray, n: np.ndarray, border: np.ndarray) -> Iterator[pa.RecordBatch]:
    lists = part.column("sources")
    row = np.repeat(np.arange(len(part)), pc.list_value_length(lists).to_numpy())
    group = pa.table({"l": part.column("lang").take(pa.array(row)), "s": lists.flatten()})
    copies = part.column("copies").flatten().to_numpy()
    coded = [group.column(c).combine_chunks().dictionary_encode() for c in ("l", "s")]
    coded = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in coded]
    many = len(coded[1].dictionary)
    both, group_of = np.unique(coded[0].indices.to_numpy().astype(np.int64) * many + coded[1].indices.to_numpy(), return_inverse=True)
    langs, sources = coded[0].dictionary.take(pa.array(both // many)), coded[1].dictionary.take(pa.array(both % many))
    zero = pa.array(np.zeros(len(both), np.int64))
    yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(both), pa.string()), zero, zero], ["lang", "source", "term", "n", "df"])
    text = text_of[row]
    each = np.diff(border)[text]
    k = max(1, len(terms))
    for lo, hi in bt.pieces(np.r_[0, np.cumsum(each)], SLICE_COUNTS):
        at = _spread(border[text[lo:hi]], each[lo:hi])
        if not len(at):
            continue
        weight = np.repeat(copies[lo:hi], each[lo:hi])
        keys, total, docs = _summed(np.repeat(group_of[lo:hi], each[lo:hi]) * k + code[at], n[at] * weight, weight)
        g, t = pa.array(keys // k), pa.array(keys % k)
        yield pa.RecordBatch.from_arrays([langs.take(g), sources.take(g), terms.take(t), pa.array(total), pa.array(docs)], ["lang", "source", "term", "n", "df"])


def source_counts(docs: DataFrame, tmp: Scratch, *, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Occurrences and document frequencies per (lang, source, term), a written table."""
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    folded = docs.select(*known).mapInArrow(fold, FOLDED).repartition("lang", "digest").sortWithinPartitions("lang", "digest")
    counted = folded.mapInArrow(count_terms, COUNTS).groupBy("lang", "source", "term")
    return tmp.write(counted.agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "source-terms")


def share(n: Column, total: Column, v: Column, scale: int) -> Column:
    """1 + floor(scale * (n + 2) / (total + 2 * v)); decimals of 38 digits hold the product."""
    top = F.lit(scale).cast("decimal(20,0)") * (n + F.lit(2)).cast("decimal(18,0)")
    return F.call_function("div", top, (total + F.lit(2) * v).cast("decimal(20,0)")) + F.lit(1)


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def pair_block(keys: tuple, rows: pa.Table) -> pa.Table:
    """Sums of one block: rows of source blocks ``x`` and ``y`` and one block of terms. A row without
    a term gives a source's p at count 0."""
    lang, _, x, y = [k.as_py() for k in keys]
    df = rows.select(["source", "term", "p", "own"]).to_pandas()
    bare = df[df.term.isna()].sort_values("source")
    names, zero, own = bare.source.to_numpy(), bare.p.to_numpy(), bare.own.to_numpy()
    df = df[df.term.notna()]
    src = pd.Index(names).get_indexer(df.source)
    term = pd.factorize(df.term)[0]
    p, many = df.p.to_numpy(), int(term.max()) + 1 if len(term) else 0
    order = np.argsort(src, kind="stable")
    src, term, p = src[order], term[order], p[order]
    border = np.searchsorted(src, np.arange(len(names) + 1))
    right = np.flatnonzero(own == y)
    there = np.isin(src, right)
    r_src, r_term, r_p = src[there], term[there], p[there]
    place = np.full(len(names), -1)
    place[right] = np.arange(len(right))
    r_at, size = place[r_src], np.diff(border)
    out: list[list] = [[], [], [], []]
    for s in np.flatnonzero(own == x).tolist():
        mine, mine_p = term[border[s] : border[s + 1]], p[border[s] : border[s + 1]]
        dense, present = np.full(many, zero[s]), np.zeros(many, bool)
        dense[mine], present[mine] = mine_p, True
        both = present[r_term]
        value = _gap(dense[r_term], r_p)
        value[both] -= _gap(dense[r_term[both]], zero[r_src[both]])
        sums, joint = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
        np.add.at(sums, r_at, value)
        np.add.at(joint, r_at[both], 1)
        for u, h in zip(*np.unique(mine_p, return_counts=True)):
            sums += h * _gap(u, zero[right])
        later = np.flatnonzero((right > s) | (x != y))
        for column, v in zip(out, ([names[s]] * len(later), names[right[later]], sums[later], (size[s] + size[right] - joint)[later])):
            column.extend(v)
    return pa.table([pa.array([lang] * len(out[0]), pa.string()), pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["lang", "a", "b", "value", "terms"])


def source_pairs(shares: DataFrame, groups: DataFrame, *, block_terms: int, block_sources: int) -> DataFrame:
    """(lang, a, b, value) for every two sources a < b of a language. ``shares``: lang, source, term, p
    of counts above 0; ``groups``: lang, source, v, zero (p at count 0), sources (of the language)."""
    t_parts = F.greatest(F.ceil(F.col("v") / block_terms), F.lit(1)).cast("int")
    s_parts = F.ceil(F.col("sources") / block_sources).cast("int")
    known = groups.select("lang", "source", "zero", t_parts.alias("t_parts"), s_parts.alias("s_parts"))
    known = known.withColumn("own", F.pmod(F.xxhash64("source"), "s_parts").cast("int"))
    bare = known.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"), "own", "s_parts", F.explode(F.sequence(F.lit(0), F.col("t_parts") - 1)).alias("block"))
    full = shares.join(known, ["lang", "source"]).select("lang", "source", "term", "p", "own", "s_parts", F.pmod(F.xxhash64("term"), "t_parts").cast("int").alias("block"))
    rows = full.unionByName(bare).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s_parts") - 1)))
    rows = rows.select("lang", "block", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "source", "term", "p", "own")
    parts = rows.groupBy("lang", "block", "x", "y").applyInArrow(pair_block, PAIRED)
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    for c in ("a", "b"):
        sums = sums.join(groups.select("lang", F.col("source").alias(c), F.col("zero").alias(f"zero_{c}"), "v"), ["lang", c]).withColumnRenamed("v", f"v_{c}")
    rest = (F.col("v_a") - F.col("terms")) * gap(F.col("zero_a"), F.col("zero_b"))
    return sums.select("lang", "a", "b", (F.col("value") + rest).alias("value"))


def divergence(
    docs: DataFrame, *, min_docs: int = 10, top: int = 10, scale: int = 1_000_000_000,
    block_terms: int = BLOCK_TERMS, block_sources: int = BLOCK_SOURCES,
    text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank: each source's divergence from each
    other one of its language, and its ``top`` terms by divergence from the language as a whole."""
    tmp = Scratch(docs.sparkSession)
    counts = source_counts(docs, tmp, text_col=text_col, lang_col=lang_col, source_col=source_col)
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("docs")).where(F.col("docs") >= min_docs)
    kept = tmp.write(counts.where("term IS NOT NULL").join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = counts.select("lang", "source").distinct()
    groups = known.join(totals, ["lang", "source"], "left").join(langs, ["lang"], "left").join(known.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")), ["lang"])
    nothing = F.lit(0).cast("long")
    groups = groups.select("lang", "source", "sources", *[F.coalesce(c, nothing).alias(c) for c in ("total", "v", "lang_total")])
    zero = F.when(F.col("v") > 0, share(nothing, F.col("total"), F.col("v"), scale)).otherwise(F.lit(1).cast("long"))
    groups = tmp.write(groups.withColumn("zero", zero), "source-groups")
    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v"), scale).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("v"), scale).alias("q"),
    )
    pairs = source_pairs(shares.select("lang", "source", "term", "p"), groups, block_terms=block_terms, block_sources=block_sources)
    sides = [pairs.select("lang", F.col(s).alias("source"), F.col(o).alias("item"), "value") for s, o in ("ab", "ba")]
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    ranked = sides[0].union(sides[1]).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    leaning = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    leaning = leaning.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return tmp.result(ranked.unionByName(leaning), "divergence")
