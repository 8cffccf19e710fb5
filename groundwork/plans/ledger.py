"""Calls that cost something, made once per input.

A model or a search behind a service is called from tasks. Its answers are kept in a ledger: a table per
stage, keyed by a digest of the stage and the inputs. What the ledger holds is never asked again, in this
run or a later one. What it lacks is asked once per distinct input, and each answer is a file of its own
before the next call is made, so a task that is lost and started again goes on after its last answer. When
the stage is done the files become rows of its table and are removed.

Calls that fail are tried again after waits; what fails to the end gives a row with an error, not a failed
job, and is asked anew by the next run. Speculative execution would run one task twice at a time and is
refused. Null inputs are inputs like others; repeated inputs share one call."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import errors
from ..operators.tables import qualified, removed

ANSWERS = "key string, answer string"
#: Buckets of keys: a task lists the open answers of the buckets that it meets.
BUCKETS = 256


def digest(stage: str, inputs: Sequence[str]) -> Column:
    """The key of a call: the stage and its inputs, nulls apart from empty texts."""
    return F.sha2(F.to_json(F.array(F.lit(stage), *[F.col(c).cast("string") for c in inputs])), 256)


class _Answers:
    """The answers of one bucket that are files already, whichever file system holds them."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(root.replace("file:/", "file:///", 1) if root.startswith("file:/") and "://" not in root else root)
        self.kind = fs.FileType
        self.select = fs.FileSelector

    def known(self, bucket: int) -> dict[str, str]:
        at = f"{self.root}/{bucket}"
        if self.fs.get_file_info(at).type == self.kind.NotFound:
            return {}
        found = {}
        for info in self.fs.get_file_info(self.select(at)):
            if info.base_name.endswith(".json"):
                with self.fs.open_input_stream(info.path) as f:
                    found[info.base_name.removesuffix(".json")] = json.loads(f.read())
        return found

    def keep(self, bucket: int, key: str, answer: str) -> None:
        """Under a temporary name first: a file that is there is whole."""
        self.fs.create_dir(f"{self.root}/{bucket}", recursive=True)
        at = f"{self.root}/{bucket}/{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(at) as f:
            f.write(json.dumps(answer).encode())
        self.fs.move(at, f"{self.root}/{bucket}/{key}.json")


@dataclass
class Ledger:
    """A ledger in the folder ``path``, which all executors share."""

    spark: SparkSession
    path: str
    #: Seconds between a failed call and the next try, and between any two calls of a task.
    waits: Sequence[float] = errors.RATE_WAITS
    interval: float = 0.0
    retry: Callable[[Exception], bool] = errors.rate_limited

    def __post_init__(self) -> None:
        if self.spark.conf.get("spark.speculation", "false").lower() == "true":
            raise ValueError("calls are paid for once: turn spark.speculation off")
        self.path = qualified(self.spark, self.path).rstrip("/")

    def answers(self, stage: str) -> DataFrame:
        """What has been asked at ``stage``: key, answer."""
        at = f"{self.path}/{stage}/done"
        self.spark.createDataFrame([], ANSWERS).write.mode("ignore").parquet(at)
        return self.spark.read.schema(ANSWERS).parquet(at)

    def ask(self, asked: DataFrame, stage: str, call: Callable[[dict], str]) -> DataFrame:
        """(id, answer, error) of ``asked`` (id and inputs). ``call`` takes the inputs by name, and gives a
        text; an error stands where it failed to the end."""
        inputs = [c for c in asked.columns if c != "id"]
        keyed = asked.withColumn("key", digest(stage, inputs))
        open_at = f"{self.path}/{stage}/open"
        new = keyed.join(self.answers(stage).select("key"), "key", "left_anti").dropDuplicates(["key"]).drop("id")
        new = new.withColumn("bucket", F.pmod(F.crc32("key"), F.lit(BUCKETS)).cast("int")).repartition("bucket")
        made_at = f"{self.path}/{stage}/made-{uuid.uuid4().hex}"
        new.mapInPandas(_asker(call, inputs, open_at, self.waits, self.interval, self.retry), f"{ANSWERS}, error string").write.parquet(made_at)
        made = self.spark.read.schema(f"{ANSWERS}, error string").parquet(made_at)
        made.where("error IS NULL").select("key", "answer").write.mode("append").parquet(f"{self.path}/{stage}/done")
        removed(self.spark, open_at)
        failed = made.where("error IS NOT NULL").select("key", "error")
        found = self.answers(stage).dropDuplicates(["key"])
        return keyed.select("id", "key").join(found, "key", "left").join(failed, "key", "left").select("id", "answer", "error")


def _asker(call: Callable, inputs: list[str], open_at: str, waits: Sequence[float], interval: float, retry: Callable) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, known = _Answers(open_at), {}
        pace = errors.Throttle(interval)

        def paced(row: dict) -> str:
            pace.wait()
            return call(row)

        tried = errors.retried(paced, waits, retry)
        for batch in batches:
            out = []
            for key, bucket, *values in batch[["key", "bucket", *inputs]].itertuples(index=False):
                if bucket not in known:
                    known[bucket] = files.known(bucket)
                answer, error = known[bucket].get(key), None
                if answer is None:
                    try:
                        answer = str(tried(dict(zip(inputs, values))))
                        files.keep(bucket, key, answer)
                    except Exception as e:  # noqa: BLE001 - one question's failure is a row, not a failed job
                        answer, error = None, f"{type(e).__name__}: {e}"
                out.append((key, answer, error))
            yield pd.DataFrame(out, columns=["key", "answer", "error"])

    return run
