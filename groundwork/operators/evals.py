"""Evaluation metrics over golden questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def precision_at(verdicts: Column, ks: tuple[int, ...] = (1, 3, 5), limit: int = 10) -> Column:
    """The mean of precision at each k that the list reaches; 0 for none."""
    v = F.slice(verdicts, 1, limit)
    at = [F.when(F.size(v) >= k, F.aggregate(F.slice(v, 1, k), F.lit(0.0), lambda s, x: s + x) / k) for k in ks]
    got = F.array_compact(F.array(*at))
    mean = F.aggregate(got, F.lit(0.0), lambda s, x: s + x) / F.size(got)
    return F.when(F.size(got) > 0, mean).otherwise(0.0)


def fit_verdicts(numbers: Column, n: Column) -> Column:
    """A verdict list padded with 0 or cut to ``n``."""
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0), F.greatest(n - F.size(numbers), F.lit(0)))), F.lit(1), n)


def fact_recall(context: Column, facts: Column) -> Column:
    """The share of facts found in the context, case aside; 0 for an empty list."""
    low = F.lower(context)
    return F.when(F.size(facts) > 0, F.size(F.filter(facts, lambda f: F.contains(low, F.lower(f)))) / F.size(facts)).otherwise(0.0)


def passes(metrics: Column, rule: str = "all", least: float = 0.5) -> Column:
    """``metrics``: map of name to value."""
    v = F.map_values(metrics)
    if rule == "all":
        return F.forall(v, lambda x: x >= least)
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v) >= least


def summary(results: DataFrame, metrics: list[str]) -> DataFrame:
    means = [F.coalesce(F.avg(m), F.lit(0.0)).alias(f"mean_{m}") for m in metrics]
    return results.agg(*means, F.coalesce(F.avg(F.col("pass").cast("double")), F.lit(0.0)).alias("pass_rate"), F.count("*").alias("n"))
