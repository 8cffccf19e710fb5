"""Structured Streaming forms of counters, limits and feed de-duplication."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators import limits
from ..operators.state import StateTable
from ..operators.tables import folder

LATE = "10 days"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return df.withColumn("time", F.col("ts").cast("timestamp"))


def counters(df: DataFrame) -> DataFrame:
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def windowed(df: DataFrame, width: str = "6 hours") -> DataFrame:
    per = df.withWatermark("time", LATE).groupBy(F.window("time", width), "event_type").agg(F.count("*").alias("n"))
    return per.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def deduped(df: DataFrame) -> DataFrame:
    """Change events once per identifier and day, within the look-back of the feed."""
    e = df.withWatermark("time", LATE).select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("identifier"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "time")
    return e.dropDuplicatesWithinWatermark(["identifier", "day"])


def run_anchored(df: DataFrame, window_s: int, limit: int, *, path: str | None = None, delay_s: int = 0) -> DataFrame:
    """Limits by windows that start with a key's first request, as a table in ``path``, from where a later
    call goes on (by default a new folder).

    A micro-batch goes through the batch operator with the windows that earlier ones left open:
    start and count per key, a written table per batch. Nothing holds a key's rows at once, so one
    batch may be the whole input. Files are not split over batches by a limit of their own: rows
    count in the order of time within a batch, and only if files come in that order do more
    batches give the same counts. A window is kept until requests are seen that are ``delay_s`` later than
    its end; what comes later still begins a new one. For requests as they arrive see ``arrivals``."""
    spark, name = df.sparkSession, path or folder(df.sparkSession, "stream")
    kept, out = "user_id long, start long, n int", "user_id long, start long, event_id long, n_in_window int, status int"
    width = (window_s + delay_s) * 1_000_000

    def step(batch: DataFrame, i: int) -> None:
        s = batch.sparkSession
        old = s.read.schema(kept).parquet(f"{name}/open/{i - 1}") if i else None
        got = limits.anchored_limit(batch, "user_id", F.unix_micros("time"), "event_id", window_s, limit, state=old)
        got.select("user_id", "start", "event_id", "n_in_window", "status").write.mode("overwrite").parquet(f"{name}/out/batch={i}")
        ends = s.read.schema(f"{kept.replace('n int', 'n_in_window int')}").parquet(f"{name}/out/batch={i}").where("start IS NOT NULL")
        ends = ends.select("user_id", "start", F.col("n_in_window").alias("n"))
        ends = ends if old is None else ends.unionByName(old)
        last = ends.groupBy("user_id").agg(F.max(F.struct("start", "n")).alias("x")).select("user_id", "x.start", "x.n")
        latest = batch.agg(F.max(F.unix_micros("time"))).first()[0]
        (last if latest is None else last.where(F.col("start") + width > latest)).write.mode("overwrite").parquet(f"{name}/open/{i}")

    spark.createDataFrame([], out).write.mode("overwrite").parquet(f"{name}/out/batch=-1")
    df.writeStream.foreachBatch(step).option("checkpointLocation", f"{name}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out).parquet(f"{name}/out")


def run_available(df: DataFrame, keys: Sequence[str] = (), *, path: str | None = None) -> DataFrame:
    """Everything that is there now, through the stream, as a table in ``path``, from where a later call
    goes on (by default a new folder). With ``keys`` the rows are aggregates in update mode: a batch writes
    those that it changed, and the last row of each key holds; a watermark drops their state."""
    spark, name = df.sparkSession, path or folder(df.sparkSession, "stream")
    if not keys:
        q = df.writeStream.format("parquet").option("checkpointLocation", f"{name}/state").outputMode("append").trigger(availableNow=True).start(f"{name}/out")
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{name}/out")

    def keep(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{name}/out/batch={i}")

    df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{name}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{name}/out")
    last = F.max_by(F.struct(*df.columns), "batch")
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(last.alias("x")).select("x.*")


def aligned(df: DataFrame, window_s: int) -> DataFrame:
    """Requests per key and aligned window, as a stream: state is kept for a window and its delay."""
    per = df.withWatermark("time", LATE).groupBy(F.window("time", f"{window_s} seconds"), "user_id").agg(F.count("*").alias("requests"))
    return per.select("user_id", F.unix_micros("window.start").alias("start"), "requests")


def limited(counts: DataFrame, limit: int) -> DataFrame:
    """How many requests of each key and window went through and how many were turned away."""
    passed = F.least(F.col("requests"), F.lit(limit).cast("long"))
    return counts.select("user_id", "start", passed.alias("passed"), (F.col("requests") - passed).alias("refused"))


def run_limited(df: DataFrame, window_s: int, limit: int) -> DataFrame:
    """Limits by aligned windows. Where the shared counters cannot be kept, the limits of each key's own
    windows hold instead: requests are never refused for want of a counter."""
    try:
        return limited(run_available(aligned(df, window_s), ("user_id", "start")), limit)
    except StreamingQueryException:
        per = run_anchored(df, window_s, limit).groupBy("user_id", "start")
        return per.agg(F.count_if(F.col("status") == 200).alias("passed"), F.count_if(F.col("status") != 200).alias("refused"))


def reconciled(feed: DataFrame, atom: DataFrame) -> DataFrame:
    """Change events of both sources, each under its name; both may be streams."""
    cols = ("source", "identifier", "url", "changed_at")
    return feed.select(*cols).unionByName(atom.select(*cols))


def run_sync(changes: DataFrame, state_path: str, apply: Callable[[DataFrame, DataFrame], DataFrame], first: DataFrame, *, key: str = "id", buckets: int = 64) -> DataFrame:
    """Applies every micro-batch of changes to the state, a table of buckets with a log of commits: see
    operators.state. A batch that comes again is known by its number. Returns the state as it is now, also
    where nothing was new; the two last versions are kept. ``first`` is the state before any change."""
    table = StateTable(changes.sparkSession, state_path, first.schema, key, buckets)
    if not table.versions():
        table.merge(first, lambda _, rows: rows, -1)

    def step(batch: DataFrame, i: int) -> None:
        table.merge(batch, apply, i)
        table.vacuum()

    changes.writeStream.foreachBatch(step).option("checkpointLocation", f"{state_path}/progress").trigger(availableNow=True).start().awaitTermination()
    return table.read()
