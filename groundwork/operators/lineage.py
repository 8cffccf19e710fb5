"""Traversal of citation edges and the choice of the latest edition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .tables import Tables


def reachable(starts: DataFrame, edges: DataFrame, max_depth: int = 12) -> DataFrame:
    """(start, node, depth): every node within ``max_depth`` steps, at its smallest depth.

    ``starts``: start; ``edges``: src, dst; edges without an end lead nowhere. Rounds end early when none is
    new. Starts and edges are written once. Two ways to a node part at a node with several edges into it, so
    only such nodes are held against those that were met; at any other, all that can come again is the start.
    What a round finds is a written table, and so is the result, when those of the rounds are removed."""
    tables = Tables(starts.sparkSession)
    plain = tables.write(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst"), "edges")
    joints = tables.write(plain.groupBy("dst").count().where("count > 1").select("dst"), "joints")
    many = not joints.isEmpty()
    flagged = plain.withColumn("many", F.lit(False))
    if many:
        flagged = tables.write(plain.join(joints.withColumn("many", F.lit(True)), "dst", "left").select("src", "dst", F.coalesce("many", F.lit(False)).alias("many")), "edges")
    first = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.lit(False).alias("many")).distinct()
    fronts = [tables.write(first, "starts")]
    for depth in range(1, max_depth + 1):
        last = fronts[-1]
        step = last.select("start", "node").join(flagged, F.col("node") == F.col("src")).where("dst <> start")
        step = step.select("start", F.col("dst").alias("node"), F.lit(depth).alias("depth"), "many")
        if many:
            met = reduce(DataFrame.unionByName, fronts).where("many").select("start", "node")
            again = step.where("many").distinct().join(met, ["start", "node"], "left_anti")
            step = step.where("NOT many").unionByName(again.select(*step.columns))
        front = tables.write(step, "front")
        if front.isEmpty():
            break
        fronts.append(front)
    return tables.result(reduce(DataFrame.unionByName, fronts).drop("many"), "reached")


def best_node(visited: DataFrame, nodes: DataFrame) -> DataFrame:
    """(start, chosen): dated before undated, then the latest (date, year, nr), then the first met.

    ``nodes``: node, issue_date, year, nr."""
    df = visited.join(nodes, "node", "left")
    rank = F.struct(
        F.col("issue_date").isNotNull(), F.coalesce("issue_date", F.lit("0001-01-01").cast("date")), F.coalesce("year", F.lit(0)),
        F.coalesce("nr", F.lit(0)), -F.col("depth"), -F.col("node"),
    )
    return df.groupBy("start").agg(F.max_by(F.struct("node", "issue_date"), rank).alias("b")).select(
        "start", F.col("b.node").alias("chosen"), F.col("b.issue_date").alias("issue_date")
    )
