"""What the operators of this subpackage share: the shared folder, written tables, samples."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, as in tests, the session's
    checkpoint folder or, in local mode alone, a new one that becomes it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        path = sc.getCheckpointDir()
        if not path:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="spark-shared-")
            sc.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/groundwork-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here, and a lost executor costs
    nothing that was computed before."""
    return Scratch(df.sparkSession).write(df, name)


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a folder from whichever file system holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables in the shared folder that one operator writes, and removes once they are used."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for out, path in [h for h in self.held if any(h[0] is t for t in tables)]:
            delete_path(self.spark, path)
            self.held = [h for h in self.held if h[0] is not out]

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as the operator's table; all others go."""
        out = self.write(df, name)
        self.clear(out)
        return out

    def clear(self, *but: DataFrame) -> None:
        self.drop(*[h[0] for h in self.held if not any(h[0] is b for b in but)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(n)


def ascii_lower(col: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())


def hash_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """About ``n`` rows of ``df``, 2 * ``n`` at most: those whose key hashes low enough.

    A share of the hash range is chosen by the row count, so no rows are sorted and none but the
    sample leaves its task. The same rows come on every run; fewer than ``n`` rows come whole."""
    total = df.count()
    if total <= n:
        return df
    steps = 1 << 40
    return df.where(F.pmod(F.xxhash64(key), F.lit(steps)) < F.lit(int(n / total * steps))).limit(2 * n)


def fitted(rows: DataFrame, fit: Callable[[pd.DataFrame], object]) -> object:
    """What ``fit`` makes of ``rows``, a bounded sample, in one task: the driver gets the model alone. A lost
    executor costs the training, not the result; ``fit`` orders its rows itself."""

    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        whole = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=names)
        yield pd.DataFrame({"model": [pickle.dumps(fit(whole))]})

    made = rows.repartition(1).mapInPandas(run, "model binary").first()
    # Where the plan shows that there are no rows, no task runs.
    return fit(pd.DataFrame(columns=names)) if made is None else pickle.loads(made[0])


def stretch_of(text: Column, key: Column, size: int) -> Column:
    """The text or, of a longer one, ``size`` characters from a place that a hash of ``key`` picks."""
    at = F.pmod(F.xxhash64(key, F.length(text)), F.length(text) - size + 1).cast("int") + 1
    return F.when(F.length(text) <= size, text).otherwise(F.substring(text, at, F.lit(size)))
