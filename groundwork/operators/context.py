"""Size-bounded contexts from ordered document lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Characters per document and in all, for the two graders.
SUFFICIENCY, GENERATION = (420, 3600), (1200, 8000)


def ordered_concat(df: DataFrame, keys: Sequence[str], text: Column, order: Sequence[str], sep: str, out: str = "context") -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], text.alias("__t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["__t"]), sep).alias(out))


def budgeted(
    df: DataFrame, keys: Sequence[str], text: Column, order: Sequence[str], per_doc: int | None, total: int, *, sep: str = "\n\n",
    charge_first: bool = True, out: str = "context",
) -> DataFrame:
    """Documents in order until ``total`` characters are spent.

    A document costs its length and that of ``sep`` (the first one only with ``charge_first``).
    The first that does not fit gives what is left less 20 characters and three dots, if any, and
    ends the list. Empty documents are passed over."""
    t = F.coalesce(text, F.lit(""))
    t = t if per_doc is None else F.left(t, F.lit(per_doc))
    order_cols = [F.col(c) for c in order]
    w = Window.partitionBy(*keys).orderBy(*order_cols)
    df = df.withColumn("__t", t).where(F.length("__t") > 0)
    fee = F.lit(len(sep)) if charge_first else F.when(F.row_number().over(w) > 1, len(sep)).otherwise(0)
    df = df.withColumn("__fee", fee).withColumn("__cost", F.length("__t") + F.col("__fee"))
    spent = F.sum("__cost").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("__spent", spent)
    left = F.lit(total) - (F.col("__spent") - F.col("__cost")) - 20 - (F.lit(0) if charge_first else F.col("__fee"))
    fits = F.col("__spent") <= total
    cut = F.when(fits, F.col("__t")).when(left > 0, F.concat(F.left("__t", left.cast("int")), F.lit("...")))
    over_before = F.max((~fits).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__part", cut).withColumn("__over", F.coalesce(over_before, F.lit(0)))
    df = df.where((F.col("__over") == 0) & F.col("__part").isNotNull())
    return ordered_concat(df, keys, F.col("__part"), order, sep, out)
