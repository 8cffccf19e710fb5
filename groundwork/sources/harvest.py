"""The change feed as a data source, as a batch and as a stream.

Items come from a folder of ``YYYY-MM-DD.json`` files, a partition for each day, or over HTTP from an
address with ``{date}``. The provider wants calls apart, so all days of a run are then one partition, read
one after another by one task: there is one slot for calls, whatever the size of the cluster. With the
option ``slot`` (a file that all executors share) the time of the last call outlives task, batch and
process. The stream's offset is the last day that is done; Spark commits it only when a batch has
succeeded, so after an error its days are read again. Days older than the look-back are out of reach."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.errors import Throttle
from ..operators.tables import qualified

LOOK_BACK = 10
#: Fixed value: seconds between calls that the provider asks for.
RATE_S = 10
SCHEMA = "day string, item string"
#: Keys under which a payload holds its list.
LIST_KEYS = ("documents", "items", "data")


@dataclass
class Days(InputPartition):
    days: list[str]


def items_of(payload: object) -> list[dict]:
    if isinstance(payload, dict):
        payload = next((payload[k] for k in LIST_KEYS if isinstance(payload.get(k), list)), [])
    return [x for x in payload if isinstance(x, dict)] if isinstance(payload, list) else []


def window(last: str | None, today: date) -> list[str]:
    """The days after ``last`` up to today, within the look-back."""
    try:
        start = date.fromisoformat(last or "") + timedelta(days=1)
    except ValueError:
        start = today - timedelta(days=1)
    start = max(start, today - timedelta(days=LOOK_BACK))
    return [(start + timedelta(days=i)).isoformat() for i in range((today - start).days + 1)]


def _file(path: str):
    """(file system, path) of a path with or without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and "://" not in path else path)


class _Slot:
    """When the last call was made, in a file that outlives the task."""

    def __init__(self, path: str | None):
        self.path = path

    def last(self) -> float | None:
        if not self.path:
            return None
        files, at = _file(self.path)
        try:
            with files.open_input_stream(at) as f:
                return float(f.read())
        except (OSError, ValueError):
            return None

    def taken(self, when: float) -> None:
        if self.path:
            files, at = _file(self.path)
            with files.open_output_stream(at) as f:
                f.write(repr(when).encode())


class _Fetch:
    def __init__(self, options):
        self.base = options["path"]
        self.today = date.fromisoformat(options["today"]) if options.get("today") else date.today()
        self.last = options.get("last")
        self.interval = float(options.get("interval", RATE_S))
        self.slot = options.get("slot")

    def parts(self, days: list[str]) -> list[Days]:
        if "{date}" in self.base:
            return [Days(days)]
        return [Days([d]) for d in days] or [Days([])]

    def read(self, partition: Days) -> Iterator[tuple[str, str]]:
        pace, slot = Throttle(self.interval, time.time), _Slot(self.slot)
        pace.last = slot.last()
        for day in partition.days:
            for item in items_of(self._payload(day, pace, slot)):
                yield day, json.dumps(item, ensure_ascii=False)

    def _payload(self, day: str, pace: Throttle, slot: _Slot) -> object:
        if "{date}" in self.base:
            from urllib.request import urlopen

            pace.wait()
            slot.taken(pace.last)
            with urlopen(self.base.replace("{date}", day), timeout=15) as r:
                return json.load(r)
        files, root = _file(self.base)
        path = f"{root}/{day}.json"
        if files.get_file_info(path).type.name == "NotFound":
            return None
        with files.open_input_stream(path) as f:
            return json.loads(f.read())


class _Batch(_Fetch, DataSourceReader):
    def partitions(self):
        return self.parts(window(self.last, self.today))


class _Stream(_Fetch, DataSourceStreamReader):
    def initialOffset(self):
        first = window(self.last, self.today)
        return {"done": (date.fromisoformat(first[0]) - timedelta(days=1)).isoformat() if first else self.today.isoformat()}

    def latestOffset(self):
        return {"done": self.today.isoformat()}

    def partitions(self, start, end):
        return self.parts(window(start["done"], date.fromisoformat(end["done"])))

    def commit(self, end):
        pass


class HarvestSource(DataSource):
    @classmethod
    def name(cls):
        return "harvest"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def harvest(spark: SparkSession, path: str, *, last: str | None, today: str, interval: float = RATE_S, slot: str | None = None) -> DataFrame:
    """Change events of the days to do."""
    from ..functions.web import change_event

    spark.dataSource.register(HarvestSource)
    path = path if "{date}" in path else qualified(spark, path)
    r = spark.read.format("harvest").option("path", path).option("today", today).option("interval", interval)
    r = r.option("last", last) if last else r
    df = (r.option("slot", qualified(spark, slot)) if slot else r).load()
    return df.select("day", change_event(F.col("item")).alias("c")).where("c IS NOT NULL").select("day", "c.*")


def atom_events(xml: Column) -> Column:
    """Entries of an Atom feed as structs; without id and link none."""
    x = lambda q: F.xpath(xml, F.lit(f"//*[local-name()='entry']/{q}"))
    entries = F.arrays_zip(x("*[local-name()='id']/text()").alias("id"), x("*[local-name()='updated']/text()").alias("updated"), x("*[local-name()='link']/@href").alias("href"))
    events = F.transform(entries, lambda e: F.struct(
        F.lit("eli_atom_feed").alias("source"), F.coalesce(e["id"], e["href"]).alias("identifier"), F.coalesce(e["href"], e["id"]).alias("url"), e["updated"].alias("changed_at")))
    return F.filter(events, lambda e: e["identifier"].isNotNull())
