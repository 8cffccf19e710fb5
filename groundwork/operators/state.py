"""A keyed table that is merged bucket by bucket, with a log of commits.

Rows lie in ``buckets`` by a hash of the key. A merge reads and writes the buckets that its changes touch,
under a new version; the others stay where they are. Then one entry of the log, which names the version of
every bucket, is written under a temporary name and renamed: that is the commit. What was written without
one is not part of the table, and the next merge writes over it. An entry also keeps the number of the last
batch, so that a batch that comes again changes nothing. Readers follow the newest entry; ``vacuum`` removes
what the last entries do not name.

One writer at a time: of two that commit the same version one gets an error. A null key is a key."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

Apply = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class StateTable:
    spark: SparkSession
    path: str
    schema: T.StructType
    key: str
    buckets: int = 64

    def _fs(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(folder)
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("log") if n.endswith(".json"))

    def entry(self, version: int | None = None) -> dict:
        """The log's entry of a version, the newest by default: version, batch, and the version of each bucket."""
        found = self.versions()
        if not found:
            return {"version": 0, "batch": None, "buckets": {}}
        fs, at = self._fs(f"log/{found[-1] if version is None else version}.json")
        stream = fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, entry: dict) -> None:
        fs, temporary = self._fs(f"log/.{entry['version']}.part")
        stream = fs.create(temporary, True)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        _, final = self._fs(f"log/{entry['version']}.json")
        if fs.exists(final) or not fs.rename(temporary, final):
            raise RuntimeError(f"another writer has committed version {entry['version']}")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        at = self.entry(version)["buckets"]
        paths = [f"{self.path}/data/v{v}/bucket={b}" for b, v in sorted(at.items()) if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, changes: DataFrame, apply: Apply, batch: int | None = None) -> bool:
        """``apply(rows of the touched buckets, changes)`` replaces these rows. False where ``batch`` is done."""
        now = self.entry()
        if batch is not None and now["batch"] is not None and batch <= now["batch"]:
            return False
        touched = [r[0] for r in changes.select(self.bucket().alias("b")).distinct().collect()]  # at most ``buckets``
        version, held = now["version"] + 1, dict(now["buckets"])
        if touched:
            rows = apply(self.read(touched), changes).select(*self.schema.names).withColumn("bucket", self.bucket())
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v{version}")
            there = {n.removeprefix("bucket=") for n in self._names(f"data/v{version}") if n.startswith("bucket=")}
            held = {b: v for b, v in held.items() if int(b) not in touched} | {b: version for b in there}
        self._commit({"version": version, "batch": now["batch"] if batch is None else batch, "buckets": held})
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Removes entries before the last ``keep``, and data that those do not name."""
        found = self.versions()
        named = {(v, b) for version in found[-keep:] for b, v in self.entry(version)["buckets"].items()}
        for version in found[:-keep]:
            fs, at = self._fs(f"log/{version}.json")
            fs.delete(at, False)
        for name in self._names("data"):
            v = int(name.removeprefix("v"))
            for bucket in self._names(f"data/{name}"):
                if bucket.startswith("bucket=") and (v, bucket.removeprefix("bucket=")) not in named:
                    fs, at = self._fs(f"data/{name}/{bucket}")
                    fs.delete(at, True)
