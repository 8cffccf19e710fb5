"""The source registry: priorities, upserts, discovery merge, file resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import falsy


def with_current(sources: DataFrame, versions: DataFrame, disk: DataFrame | None = None) -> DataFrame:
    """``sources`` with current_version: the version state, else the registry, else the disk."""
    v = versions.select("id", F.col("version").alias("__state"))
    df = sources.join(v, "id", "left")
    cols = [falsy(F.col("__state")), falsy(F.col("version"))]
    if disk is not None:
        df = df.join(disk.select("id", F.col("version").alias("__disk")), "id", "left")
        cols.append(falsy(F.col("__disk")))
    return df.withColumn("current_version", F.coalesce(*cols)).drop("__state", "__disk")


def upsert(state: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row per key of both; of equal times the change holds."""
    both = state.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    cols = [c for c in state.columns if c != key]
    last = F.max_by(F.struct(*cols), F.struct(order, "__new"))
    return both.groupBy(key).agg(last.alias("__r")).select(key, *[F.col(f"__r.`{c}`").alias(c) for c in cols])


def partial_upsert(state: DataFrame, changes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Only filled fields of ``changes`` replace those of ``state``."""
    s, c = state.alias("s"), changes.alias("c")
    pick = [F.coalesce(falsy(F.col(f"c.`{f}`").cast("string")), F.col(f"s.`{f}`").cast("string")).alias(f) for f in fields]
    return s.join(c, F.col(f"s.{key}") == F.col(f"c.{key}"), "full_outer").select(F.coalesce(F.col(f"s.{key}"), F.col(f"c.{key}")).alias(key), *pick)


def merge_discovered(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` (id, name, ...) with the first known row of equal id or trimmed name.

    Two equi-joins instead of one disjunctive join, each on a known side of one row per key; the
    earlier row in registry order (``ord``) holds."""
    k = known.select(F.col("id").alias("k_id"), F.trim("name").alias("k_name"), F.col("url").alias("k_url"), F.col("version").alias("k_version"), "ord")
    row = F.struct("ord", "k_id", "k_url", "k_version")
    by_id = k.groupBy("k_id").agg(F.min(row).alias("i"))
    by_name = k.where(F.col("k_name") != "").groupBy("k_name").agg(F.min(row).alias("n"))
    df = found.join(by_id, found["id"] == by_id["k_id"], "left").join(by_name, F.trim(found["name"]) == by_name["k_name"], "left")
    hit = F.when(F.coalesce(F.col("i.ord") <= F.col("n.ord"), F.col("n.ord").isNull()), F.col("i")).otherwise(F.col("n"))
    return df.withColumn("__hit", hit).select(
        *[F.col(c) if c in ("id", "name") else F.col(c) for c in found.columns], F.col("__hit.k_id").alias("known_id"),
        F.coalesce(falsy(F.col("__hit.k_url")), F.lit("")).alias("known_url"), F.col("__hit.k_version").alias("known_version"),
    )


def local_file(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path): the first path whose name contains the hint; without a hint the only file of
    the folder. Files meet each hint of their folder once, however many sources have it."""
    wanted = sources.select("id", "folder", F.coalesce("filename_hint", F.lit("")).alias("hint"))
    met = wanted.select("folder", "hint").distinct().join(files.select("folder", "name", "path"), "folder")
    per = met.groupBy("folder", "hint").agg(
        F.min(F.when((F.col("hint") != "") & F.contains("name", "hint"), F.col("path"))).alias("hinted"), F.count("path").alias("n"), F.min("path").alias("first"))
    only = F.when((F.max("hint") == "") & (F.sum("n") == 1), F.min("first"))
    return wanted.join(per, ["folder", "hint"], "left").groupBy("id").agg(F.coalesce(F.min("hinted"), only).alias("path"))


def set_field(sources: DataFrame, id_: str, field: str, value: Column) -> DataFrame:
    """``field`` of the first row (by ``ord``) with this id."""
    first = sources.where(F.col("id") == id_).agg(F.min("ord").alias("__ord"))
    df = sources.join(F.broadcast(first), sources["ord"] == first["__ord"], "left")
    return df.withColumn(field, F.when(F.col("__ord").isNotNull(), value).otherwise(F.col(field))).drop("__ord")
