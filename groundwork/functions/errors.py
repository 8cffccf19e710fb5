"""Error messages by kind, and calls that are tried again."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

#: What a message of a rate limit holds.
RATE_WORDS = ("429", "rate limit", "resource_exhausted", "quota")
#: Seconds before a call is tried again, for local writes and for rate limits.
LOCAL_WAITS, RATE_WAITS = (1.0, 3.0), (30.0, 60.0, 120.0)


def is_rate_limit(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    hit = F.lit(False)
    for w in RATE_WORDS:
        hit = hit | F.contains(low, F.lit(w))
    return hit


def local_runtime_message(kind: Column, message: Column, model: str, embedding: str, program: str) -> Column:
    """What a user can do about a failure of the local model runtime. ``kind``: the error's type."""
    low = F.lower(message)
    lost = F.contains(low, F.lit("not found")) | F.contains(low, F.lit("404"))
    down = F.contains(F.lower(kind), F.lit("connect")) | F.contains(low, F.lit("connection refused"))
    told = lambda what, name: F.lit(f"{what} '{name}' is not installed. Run: {program} pull {name}")
    return (
        F.when(lost & F.contains(low, F.lit(embedding.lower())), told("Embedding model", embedding)).when(lost, told("Model", model))
        .when(down, F.lit(f"The local runtime is not running. Start it with: {program} serve")).otherwise(F.concat(F.lit("Local runtime error: "), message))
    )


def retried(call: Callable, waits: Sequence[float] = LOCAL_WAITS, only: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call``, tried once more after each wait; errors that ``only`` leaves out, and the last one, are
    raised. For use inside tasks: Spark's own retries of a task come on top."""

    def run(*args):
        for wait in waits:
            try:
                return call(*args)
            except Exception as e:  # noqa: BLE001 - raised below where it is not to be tried again
                if not only(e):
                    raise
                sleep(wait)
        return call(*args)

    return run


def rate_limited(e: Exception) -> bool:
    return any(w in str(e).lower() for w in RATE_WORDS)


class Throttle:
    """At least ``least`` seconds between calls of one reader."""

    def __init__(self, least: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.least, self.clock, self.sleep, self.last = least, clock, sleep, None

    def wait(self) -> None:
        if self.last is not None and (left := self.least - (self.clock() - self.last)) > 0:
            self.sleep(left)
        self.last = self.clock()
