"""Mixing sources to target weights.

Words are counted per document and summed per source. Sources, in code point order with null
last, weigh ``weights`` in turn and share ``budget`` times all words; a target stops at
``max_rate`` times its source's size and the excess is shared anew by weight until none is above.
A document is emitted floor(rate) times, and once more where a hash of its id and ``seed`` falls
below the fraction: the coin depends on nothing else, so reruns and lost executors change nothing.

Null text has size 0. A null id takes its coin from the text. Repeated rows of one id share their
coin. Sources that hold no words get target 0 and rate 0. An empty table gives no rows.
The tables per source have one row each: the window over them sees sources, never documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: More sources than this are joined by shuffle, not broadcast (a row takes about 100 bytes).
MAX_BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Runs of anything but white space: places where one begins, so no word is built."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, budget: float, max_rate: float, weights: Sequence[float]) -> DataFrame:
    """Per source: source_size and target. ``sizes``: source, size per document."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_rate)))
    # Sources reach their cap in order of cap / weight: with the first k capped, the rest share
    # what is left, and the first source whose cap lies above its share ends the capped ones.
    by = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * F.lit(float(budget))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level)
    open_level = F.max(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))).over(whole)
    per = per.withColumn("open_level", open_level)
    target = F.when(F.col("open_level").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("open_level") * F.col("weight"))
    )
    return per.select("source", "source_size", target.alias("target"))


def coin(id_col: Column, fallback: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 48 bits of a digest of id and seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), fallback, F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(
    docs: DataFrame, *, budget: float = 1.5, max_rate: float = 2.0, weights: Sequence[float] = (5, 2, 1),
    seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``docs`` with size, source_size, target and copies (how often the mix holds the row).
    Columns of these names are replaced."""
    added = ("size", "source_size", "target", "copies")
    keep = [c for c in docs.columns if c not in added]
    sizes = docs.select(F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    targets = source_targets(sizes, budget=budget, max_rate=max_rate, weights=weights)
    names = {"source": "__source", "source_size": "source_size", "target": "target"}
    small = targets.select(*[F.col(k).alias(v) for k, v in names.items()])
    if docs.select(source_col).distinct().limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        small = F.broadcast(small)
    df = docs.select(*[F.col(f"`{c}`") for c in keep], n_words(F.col(text_col)).alias("size"))
    df = df.join(small, F.col(source_col).eqNullSafe(F.col("__source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (coin(F.col(id_col), F.col(text_col), seed) < rate - whole).cast("int")
    return df.select(
        *[F.col(f"`{c}`") for c in keep], "size", "source_size", "target", (whole + extra).cast("int").alias("copies")
    )


def repeat_rows(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row ``copies`` times."""
    times = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mixed.where(F.col("copies") > 0).select(*columns, times.alias("__copy")).drop("__copy")
