"""Order-preserving de-duplication and merging of document lists."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

_SUFFIX = re.compile("[1-9][0-9]*")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key. Ranking by ``min_by`` aggregates before the shuffle, so a hot key
    sends one row per task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("__first")).select(*keys, *[F.col(f"__first.`{c}`").alias(c) for c in rest])


def anti_merge(existing: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(merged, added): rows of ``new`` whose key neither ``existing`` nor an earlier row holds."""
    fresh = new.join(existing.select(key).distinct(), key, "left_anti")
    added = keep_first(fresh, [key], order).select(*new.columns)
    return existing.unionByName(added, allowMissingColumns=True), added


def _free_ids(key: str):
    """Ids in the order of the rows, which come by root. The state is one number per base of the
    root: its last suffix. A base that was met is taken, and so are all its suffixes up to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, {}
        for batch in batches:
            out = []
            for root, base in zip(batch["__root"].to_pylist(), batch[key].to_pylist(), strict=True):
                if root != at:
                    at, last = root, {}
                if base is None:
                    out.append(None)
                    continue
                n = last.get(base)
                if n is None:
                    n = 0
                    parent, _, k = base.rpartition("-")
                    if not (_SUFFIX.fullmatch(k) and last.get(parent, 0) >= int(k)):
                        last[base] = 0
                        out.append(base)
                        continue
                n += 1
                while f"{base}-{n}" in last:
                    n += 1
                last[base] = n
                out.append(f"{base}-{n}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "__out"])

    return run


def suffix_ids(df: DataFrame, key: str, order: Sequence[str], out: str = "unique_id") -> DataFrame:
    """Each row in order takes its id, or the id with the smallest of -1, -2, ... that no row before
    it has. Names that can meet share a root, the name without its numbers at the end; the rows of
    a root are read in order by one task."""
    df = df.withColumn("__root", F.regexp_replace(key, r"(-[0-9]+)+\z", ""))
    dealt = df.repartition("__root").sortWithinPartitions("__root", *order)
    done = dealt.mapInArrow(_free_ids(key), T.StructType([*dealt.schema.fields, T.StructField("__out", T.StringType())]))
    return done.withColumn(out, F.col("__out")).drop("__root", "__out")


def next_free_id(base: Column, used: Column) -> Column:
    """``base``, or with the smallest suffix that ``used`` (an array) does not hold: one of as many
    suffixes as it has entries, and one more, is free."""
    tried = F.transform(F.sequence(F.lit(1), F.size(used) + 1), lambda i: F.concat_ws("-", base, i.cast("string")))
    free = F.element_at(F.filter(tried, lambda t: ~F.array_contains(used, t)), 1)
    return F.when(F.array_contains(used, base), free).otherwise(base)


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key in the given order; Spark limits groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)
