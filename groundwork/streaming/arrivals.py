"""Rate limits for requests as they arrive, one state per key.

A key's window begins with its first request; its state is the start and the count, and a timer at the
window's end removes it once the watermark is past (in processing time the state's own time to live does),
so what is kept are the keys of open windows alone. Requests count in the order in which they come; within
what comes together, in the order of time. Requests over the limit count too. A request that comes late
counts into the window that is open.

A limit never refuses for want of its state: requests without a time, and all of a key whose state cannot
be read or written, go through uncounted (``n_in_window`` is null)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.tables import folder

ANSWER = "user_id long, event_id long, time timestamp, start long, n_in_window int, status int, retry_after int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Arrivals(StatefulProcessor):
    def __init__(self, window_s: int, limit: int, event_time: bool = True):
        self.width, self.limit, self.event_time = window_s * 1_000_000, limit, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, n int", None if self.event_time else self.width // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch.sort_values(["time", "event_id"])
            micros = batch.time.astype("datetime64[us]").to_numpy().astype("int64")
            timed = batch.time.notna().to_numpy()
            try:
                start, n = self._counted(micros, timed)
            except Exception:  # noqa: BLE001 - the requests of this key go through
                start, n = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            over = n > self.limit
            left = np.maximum(1, (self.width - (micros - start)) // 1_000_000)
            yield pd.DataFrame({
                "user_id": batch.user_id.to_numpy(), "event_id": batch.event_id.to_numpy(), "time": batch.time.to_numpy(), "start": pd.Series([int(s) if x else None for s, x in zip(start, n)], dtype="Int64"),
                "n_in_window": pd.Series([int(x) or None for x in n], dtype="Int32"), "status": np.where(over, 429, 200), "retry_after": pd.Series([int(x) if o else None for x, o in zip(left, over)], dtype="Int32")})

    def _counted(self, micros: np.ndarray, timed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of the window and place in it of each request; the state follows."""
        starts, places = np.zeros(len(micros), np.int64), np.zeros(len(micros), np.int64)
        held = self.window.get() if self.window.exists() else None
        start, n = (int(held[0]), int(held[1])) if held else (None, 0)
        before = start
        for i in np.flatnonzero(timed).tolist():
            if start is None or micros[i] - start >= self.width:
                start, n = int(micros[i]), 0
            n += 1
            starts[i], places[i] = start, n
        if start is not None:
            self.window.update((start, n))
            if self.event_time and start != before:
                if before is not None:
                    self.handle.deleteTimer((before + self.width) // 1000)
                self.handle.registerTimer((start + self.width) // 1000)
        return starts, places

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


def arrivals(requests: DataFrame, window_s: int, limit: int, *, delay: str | None = None) -> DataFrame:
    """``requests`` (user_id, event_id, time), a stream, with their answers. In processing time, the default,
    state ends by the clock and every request is answered. With ``delay`` it ends by the watermark, for
    replays: requests that come later than that are none of the stream's any more."""
    timed = requests.select("user_id", "event_id", "time")
    timed = timed if delay is None else timed.withWatermark("time", delay)
    mode = "ProcessingTime" if delay is None else "EventTime"
    return timed.groupBy("user_id").transformWithStateInPandas(Arrivals(window_s, limit, delay is not None), ANSWER, "Append", mode)


def run_arrivals(requests: DataFrame, window_s: int, limit: int, *, path: str | None = None, delay: str | None = None):
    """Everything that is there now, as a table in ``path``, from where a later call goes on; and the query."""
    spark: SparkSession = requests.sparkSession
    name, old = path or folder(spark, "stream"), spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        q = arrivals(requests, window_s, limit, delay=delay).writeStream.format("parquet").option("checkpointLocation", f"{name}/state").outputMode("append").trigger(availableNow=True).start(f"{name}/out")
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, old)
    return spark.read.schema(ANSWER).parquet(f"{name}/out"), q
