"""Written tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new name in ``spark.checkpoint.dir``. Where that is unset, in the session's checkpoint folder
    or, in local mode alone, in a new one that becomes it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table, so that it is computed once."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once per row, however often they are used. The optimiser copies
    a projected expression into each of its uses; it does not copy one into a generator, here of one row."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder from whichever file system holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Written tables of one job, removed once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = folder(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for out, path in [h for h in self.held if any(h[0] is t for t in tables)]:
            removed(self.spark, path)
            self.held = [h for h in self.held if h[0] is not out]

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a written table; all others go."""
        out = self.write(df, name)
        self.drop(*[h[0] for h in self.held if h[0] is not out])
        return out


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of Spark's default file system, if it has none of its own."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
