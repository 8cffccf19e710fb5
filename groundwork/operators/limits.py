"""Request counters and rate limits over request tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .tables import written

#: A key with more rows is read in spans of about this many.
SPAN_ROWS = 1_000_000


def aligned_limit(df: DataFrame, key: str, micros: Column, order: str, window_s: int, limit: int) -> DataFrame:
    """Counts within windows that start at multiples of ``window_s``. A busy key's rows are spread
    over its windows."""
    slot = F.floor(micros / F.lit(window_s * 1_000_000))
    df = df.withColumn("slot", slot).withColumn("__m", micros)
    n = F.row_number().over(Window.partitionBy(key, "slot").orderBy("__m", order))
    retry = (F.lit(window_s) - F.pmod(F.floor(F.col("__m") / 1_000_000), F.lit(window_s))).cast("int")
    df = df.withColumn("n_in_window", n).withColumn("status", F.when(F.col("n_in_window") > limit, 429).otherwise(200))
    return df.withColumn("retry_after", F.when(F.col("status") == 429, retry)).drop("__m")


def _runs(batch: pa.RecordBatch, names: Sequence[str]) -> list[tuple[int, int]]:
    """Where rows of equal ``names`` begin and end."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for c in names if n > 1 else ():
        x, y = batch[c].slice(1), batch[c].slice(0, n - 1)
        void = pc.or_(pc.is_null(x), pc.is_null(y))
        differ = pc.if_else(void, pc.xor(pc.is_null(x), pc.is_null(y)), pc.not_equal(x, y))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new).tolist()
    return list(zip(first, [*first[1:], n], strict=True))


def _exits(key: str, width: int):
    """What a span does to the end of the window that reaches into it: pieces (upto, exit) say that
    a window ending by ``upto``, and after the piece before, leads to a last window ending at
    ``exit``. Rows come by key, span and time. A span of one window's width is not held."""

    def pieces(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        m = np.unique(np.concatenate(held))
        last, own = np.searchsorted(m, m + width), np.arange(len(m))
        last = np.where(last < len(m), last, own)
        while (last[last] != last).any():
            last = last[last]
        out = m[last] + width
        # A window that reaches in ends within the first width, or starts anew at the next row.
        n = min(int(np.searchsorted(m, m[0] + width)) + 1, len(m))
        m, out = m[:n], out[:n]
        keep = np.r_[out[1:] != out[:-1], True]
        return m[keep], out[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, owner, held = None, None, []

        def rows(at, upto, out):
            k, s = at
            n = len(upto)
            return pa.RecordBatch.from_arrays([pa.repeat(k, n), pa.array(np.full(n, s)), pa.array(upto), pa.array(out)], [key, "span", "upto", "exit"])

        for batch in batches:
            m, alone = batch["m"].to_numpy(), batch["alone"].to_numpy(zero_copy_only=False)
            for a, b in _runs(batch, [key, "span"]):
                k, s = batch[key][a], batch["span"][a].as_py()
                if (k.as_py(), s) != who:
                    if held:
                        yield rows(owner, *pieces(held))
                    who, owner, held = (k.as_py(), s), (k, s), []
                if alone[a]:
                    own = np.unique(m[a:b])
                    yield rows(owner, own, own + width)
                else:
                    held.append(np.unique(m[a:b]))
        if held:
            yield rows(owner, *pieces(held))

    return run


def _entries(key: str):
    """The end of the window that reaches into each span, from the pieces of a key in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, who, end, found = None, None, None, True
        for batch in batches:
            rows, ends = [], []
            upto, out = batch["upto"].to_numpy(), batch["exit"].to_numpy()
            for a, b in _runs(batch, [key, "span"]):
                k, s = batch[key][a].as_py(), batch["span"][a].as_py()
                if at is None or at[0] != k:
                    at, end = (k,), None
                if (k, s) != who:
                    who, found = (k, s), False
                    rows.append(a)
                    ends.append(end)
                i = a if end is None else a + int(np.searchsorted(upto[a:b], end))
                if not found and i < b:
                    end, found = int(out[i]), True
            picked = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([picked[key], picked["span"], pa.array(ends, pa.int64())], [key, "span", "end"])

    return run


def _starts(key: str, width: int):
    """The window start of each row. Rows come by key, span and time; what is kept is the end of
    the present window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, end = None, None
        for batch in batches:
            m = batch["m"].to_numpy()
            start = np.zeros(len(m), np.int64)
            for a, b in _runs(batch, [key, "span"]):
                now = (batch[key][a].as_py(), batch["span"][a].as_py())
                if now != who:
                    who, end = now, batch["end"][a].as_py()
                while a < b:
                    if end is None or m[a] >= end:
                        end = int(m[a]) + width
                    n = a + int(np.searchsorted(m[a:b], end))
                    start[a:n], a = end - width, n
            cols = [c for c in batch.schema.names if c not in ("span", "end")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in cols), pa.array(start)], [*cols, "start"])

    return run


def _spans(rows: DataFrame, key: str, width: int, span_rows: int) -> DataFrame:
    """(key, bucket, span, alone) of keys with more than ``span_rows`` rows: neighbouring buckets of
    one window's width together hold about so many; a bucket with more is a span of its own."""
    big = rows.groupBy(key).count().where(F.col("count") > span_rows).select(F.col(key).alias("__k"))
    hot = rows.join(big, F.col(key).eqNullSafe(F.col("__k")), "left_semi")
    per = hot.groupBy(key, F.floor(F.col("m") / width).alias("bucket")).count()
    w = Window.partitionBy(key).orderBy("bucket")
    upto, alone = F.sum("count").over(w), F.col("count") > span_rows
    full = F.floor(upto / span_rows) != F.floor((upto - F.col("count")) / span_rows)
    cut = per.withColumn("alone", alone).withColumn("cut", F.col("alone") | F.coalesce(F.lag("alone").over(w), F.lit(False)) | full)
    return cut.select(key, "bucket", F.sum(F.col("cut").cast("long")).over(w).alias("span"), "alone")


def _dealt(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def anchored_limit(
    df: DataFrame, key: str, micros: Column, order: str, window_s: int, limit: int, *, state: DataFrame | None = None, span_rows: int = SPAN_ROWS
) -> DataFrame:
    """Counts within windows that start with a key's first request after the last one ended.

    Rows are read by key and time and only the end of the present window is kept. The history of a
    key with more than ``span_rows`` rows is cut into spans at multiples of the window: a pass over
    the spans says where each window that reaches into one leads, one task follows these pieces
    per key, and the spans are then read side by side. Rows are counted per window, so no key is
    one task's; a single window is. Requests over the limit count too. Rows without a time are
    counted apart. ``state`` (key, start, n): windows that earlier rows left open."""
    width = window_s * 1_000_000
    rows = df.select(F.col(key), F.col(order), micros.cast("long").alias("m"))
    kind, went = {f.name: f for f in rows.schema}, None
    if state is not None:
        old = state.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("n").alias("__n"))
        rows = rows.join(old, F.col(key).eqNullSafe(F.col("__k")), "left")
        within = F.col("m") < F.col("__s") + width
        went = rows.where(within).select(key, order, "m", F.col("__s").alias("start"), "__n")
        rows = rows.where(~F.coalesce(within, F.lit(False))).select(key, order, "m")
    timed = rows.where("m IS NOT NULL")
    spans = _spans(timed, key, width, span_rows)
    if spans.isEmpty():
        cut = timed.withColumns({"span": F.lit(0).cast("long"), "end": F.lit(None).cast("long")})
    else:
        spans = written(spans, "spans")
        s = spans.select(F.col(key).alias("__k"), "bucket", "span", "alone")
        same = F.col(key).eqNullSafe(F.col("__k")) & (F.floor(F.col("m") / width) == F.col("bucket"))
        cut = timed.join(s, same, "left").drop("__k", "bucket")
        cut = written(cut.withColumn("span", F.coalesce("span", F.lit(-1).cast("long"))), "cut")
        field = lambda name: T.StructField(name, T.LongType())
        hot = _dealt(cut.where("span >= 0").select(key, "span", "m", "alone"), [key, "span"], "m")
        pieces = hot.mapInArrow(_exits(key, width), T.StructType([kind[key], field("span"), field("upto"), field("exit")]))
        ends = pieces.repartition(key).sortWithinPartitions(key, "span", "upto").mapInArrow(_entries(key), T.StructType([kind[key], field("span"), field("end")]))
        ends = ends.select(F.col(key).alias("__k"), F.col("span").alias("__span"), "end")
        cut = cut.join(ends, F.col(key).eqNullSafe(F.col("__k")) & (F.col("span") == F.col("__span")), "left").select(key, order, "m", "span", "end")
    began = _dealt(cut, [key, "span"], "m").mapInArrow(_starts(key, width), T.StructType([kind[key], kind[order], kind["m"], T.StructField("start", T.LongType())]))
    began = began.unionByName(rows.where("m IS NULL").withColumn("start", F.lit(None).cast("long"))).withColumn("__n", F.lit(0))
    if went is not None:
        began = began.unionByName(went)
    n = F.row_number().over(Window.partitionBy(key, "start").orderBy("m", order)) + F.col("__n")
    left, over = F.lit(width) - (F.col("m") - F.col("start")), F.col("n_in_window") > limit
    return began.withColumn("n_in_window", n.cast("int")).select(
        key, order, "n_in_window", F.when(over, 429).otherwise(200).alias("status"),
        F.when(over, F.greatest(F.lit(1), F.floor(left / 1_000_000).cast("int"))).alias("retry_after"), "start",
    )


def exposition(counters: DataFrame, metric: str, label: str, value: str) -> DataFrame:
    """Text lines of a counter family, by label; see :func:`metrics_page` for their order."""
    from ..functions.text import escape_label

    text = F.concat(F.lit(f'{metric}{{{label}="'), escape_label(F.col(label)), F.lit('"} '), F.col(value).cast("string"))
    return counters.select(label, text.alias("line"))


def metrics_page(families: Sequence[tuple[str, str, str, DataFrame, str | None]]) -> DataFrame:
    """(ord, line): metric families in order, each with its help and type and then its samples, sorted
    by label. A family: name, kind, help, its rows (value and maybe a label column), the label's name."""
    from ..functions.text import escape_label

    spark, parts = families[0][3].sparkSession, []
    for i, (name, kind, about, rows, label) in enumerate(families):
        shown = F.col(label) if label else F.lit("")
        at = F.concat(F.lit(f'{name}{{{label}="'), escape_label(shown), F.lit('"} ')) if label else F.lit(f"{name} ")
        parts.append(rows.select(F.lit(i).alias("f"), F.lit(2).alias("part"), shown.alias("label"), F.concat(at, F.col("value").cast("string")).alias("line")))
        parts.append(spark.createDataFrame([(i, 0, "", f"# HELP {name} {about}"), (i, 1, "", f"# TYPE {name} {kind}")], "f int, part int, label string, line string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # One row for each label value: few, whatever the number of requests.
    order = Window.orderBy("f", "part", "label")
    return out.select((F.row_number().over(order) - 1).alias("ord"), "line").orderBy("ord")
