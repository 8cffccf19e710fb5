"""Languages by profiles of three-letter sequences, learned from labelled rows.

A profile holds the ``top`` most frequent sequences of a language, the first one with the most points. A text
has the points of all its sequences, and the language with the most; of equal ones the first by name. Texts
without a sequence that a profile holds take the default, null ones too. Everything is sums of whole numbers.
A task counts the sequences of its rows in parts of bounded size, so that what leaves it are counts and not one
row per character; profiles have ``top`` rows for a language and go to every task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

TOP = 300
#: More profile rows than this (languages times ``top``) are joined by shuffle.
MAX_BROADCAST = 100_000
#: Sequences that a task counts at once, and cells of its table of texts by languages.
PART = 1_000_000


def letters(text: Column) -> Column:
    """Lower case, with one blank for whatever is no letter and at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def sequences(text: Column) -> Column:
    """All runs of three characters, overlapping ones too."""
    return F.regexp_extract_all(letters(text), F.lit("(?s)(?=(...))"), F.lit(1))


def _parts(texts: Iterator[str | None], most: int = PART, rows: int = PART) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Texts in parts of ``most`` sequences or ``rows`` texts, with the row of each; longer ones are cut, with
    the two characters after the cut in either piece."""
    of, held, size = [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text or "") - 2, most):
            of.append(row)
            held.append(text[at : at + most + 2])
            size += len(held[-1])
            if size >= most or len(held) >= rows:
                yield np.array(of), held
                of, held, size = [], [], 0
    if held:
        yield np.array(of), held


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sequences of texts, each as the number of its three code points, and the text that it is of."""
    x = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    within = of[2:] == of[:-2]
    return (x[:-2] << 42 | x[1:-1] << 21 | x[2:])[within], of[2:][within]


def _grams(codes: np.ndarray) -> np.ndarray:
    """The sequences again as strings."""
    points = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], axis=1).astype("<u4")
    return np.ascontiguousarray(points).view("<U3").ravel()


def profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", *, top: int = TOP) -> DataFrame:
    """(lang, gram, points) from rows with a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch["lang"].dictionary_encode()
            of_row = langs.indices.to_numpy()
            for rows, texts in _parts(x.as_py() for x in batch["text"]):
                codes, of = _codes(texts)
                n = pa.table({"lang": of_row[rows][of], "code": codes}).group_by(["lang", "code"], use_threads=False).aggregate([([], "count_all")])
                grams = pa.array(_grams(n["code"].to_numpy()), pa.string())
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(n["lang"].combine_chunks()), grams, n["count_all"].combine_chunks()], ["lang", "gram", "n"])

    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), letters(F.col(text)).alias("text"))
    counted = rows.mapInArrow(run, f"lang {dict(rows.dtypes)['lang']}, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("count"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("count").desc(), "gram"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "gram", (F.lit(top + 1) - F.col("rank")).alias("points"))


def _scored(rows: DataFrame, known: list) -> DataFrame:
    """(id, lang, n): the points of each row's ``text``, as :func:`letters` gives it, in the languages that have any."""
    langs = sorted({r["lang"] for r in known})
    code = lambda gram: _codes([gram])[0][0]
    held = sorted((code(r["gram"]), langs.index(r["lang"]), r["points"]) for r in known)
    gram, lang, points = (np.array([h[i] for h in held], np.int64) for i in range(3))
    gram, first, times = np.unique(gram, return_index=True, return_counts=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(langs)
        for batch in batches:
            for rows, texts in _parts((x.as_py() for x in batch["text"]), rows=max(1, PART // len(langs))):
                codes, of = _codes(texts)
                at = np.minimum(np.searchsorted(gram, codes), len(gram) - 1)
                hit = gram[at] == codes
                at, of = at[hit], of[hit]
                # Each hit once for every profile that holds it.
                n = times[at]
                entry = np.arange(n.sum()) + np.repeat(first[at] - (np.cumsum(n) - n), n)
                sums = np.bincount(np.repeat(of, n) * len(langs) + lang[entry], points[entry]).astype(np.int64)
                cell = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(rows[cell // len(langs)])), names.take(pa.array(cell % len(langs))), pa.array(sums[cell])], ["id", "lang", "n"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, lang string, n long")


def detected(docs: DataFrame, known: DataFrame, id_col: str, text: str = "text", *, default: str = "en") -> DataFrame:
    """(id, lang): ``known`` as :func:`profiles` gives it. Rows of one id are judged together."""
    small = known.limit(MAX_BROADCAST + 1).collect()
    if 0 < len(small) <= MAX_BROADCAST:
        points = _scored(docs.select(F.col(id_col).alias("id"), letters(F.col(text)).alias("text")), small)
    else:
        points = docs.select(F.col(id_col).alias("id"), F.explode(sequences(F.col(text))).alias("gram")).join(known, "gram").withColumnRenamed("points", "n")
    best = points.groupBy("id", "lang").agg(F.sum("n").alias("n")).groupBy("id").agg(F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("lang"))
    ids = docs.select(F.col(id_col).alias("id")).distinct()
    return ids.join(best, ids["id"].eqNullSafe(best["id"]), "left").select(ids["id"].alias(id_col), F.coalesce("lang", F.lit(default)).alias("lang"))
