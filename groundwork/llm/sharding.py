"""Sharding by jump consistent hashing: stable keys go to shards without a ring table.

From shard b a key jumps to the next shard that it would move to if shards were appended one by one:
with r uniform in (0, 1], a hash of key and b, the next is floor((b + 1) / r). The key's shard among n
is the last one below n on this way. So the id and the number of shards decide alone, shares are equal,
and when shards are appended a key stays or goes to an appended one. (The law is ``key``: rows with
equal texts but different ids may be parted.)

A null id is a key of its own. Null text has no bytes and crc32 0; sizes are bytes plus one, so empty
texts have size 1. Repeated rows of one id share a shard and take different slots. Which of rows that
are equal in id, size and crc32 takes which slot makes no difference to the result. Slots follow a digest
of these three, so they are the same on every run. An empty table gives no rows; other columns, of
whatever name, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A way of more jumps than this ends in an error: for n <= 2^31 its probability is below 2^-300.
MAX_JUMPS = 256
#: Groups in which slots are counted, over all shards together; their table is broadcast.
SLOT_GROUPS = 32_768
#: Copies of one row are told apart in runs of this length.
RUN = 10_000


def jump_shard(key: Column, n: int) -> Column:
    """The shard, from 0, of a text key among ``n``. Integer arithmetic alone: r is (x + 1) / 2^32 for x
    the first 32 bits of the md5 of ``<key>:<b>``."""
    if not 1 <= n < 1 << 30:
        raise ValueError("n is from 1 to 2^30")

    def bits(b: Column) -> Column:
        text = F.concat(key, F.lit(":"), b.cast("string"))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")

    def jump(at: Column, _: Column) -> Column:
        b = at["next"]
        step = F.call_function("div", (b + F.lit(1)) * F.lit(1 << 32), bits(b) + F.lit(1))
        return F.when(b < F.lit(n), F.struct(b.alias("shard"), step.alias("next"))).otherwise(at)

    start = F.struct(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(min(n, MAX_JUMPS))), start, jump)
    ended = F.when(done["next"] >= F.lit(n), done["shard"]) if n > MAX_JUMPS else done["shard"]
    return (ended.otherwise(F.raise_error("too many jumps")) if n > MAX_JUMPS else ended).cast("int")


def id_text(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def with_shard(docs: DataFrame, n_shards: int, *, id_col: str = "doc_id") -> DataFrame:
    """Whole rows with their ``shard``; a column of this name is replaced. One pass, no shuffle."""
    return docs.withColumn("shard", jump_shard(id_text(id_col), n_shards))


def write_shards(docs: DataFrame, path: str, n_shards: int, *, id_col: str = "doc_id", max_rows: int = 1_000_000) -> None:
    """Rows as Parquet below ``path/shard=<n>``. Each task writes to each shard itself, so no shard meets
    in one task; files end at ``max_rows``. An older result is replaced as the job commits."""
    out = with_shard(docs, n_shards, id_col=id_col).write.mode("overwrite").option("maxRecordsPerFile", max_rows)
    out.partitionBy("shard").parquet(path)


def shard_slots(docs: DataFrame, n_shards: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, shard, slot (gapless from 0 within the shard) and grown_shard (the
    shard if there were one more). Equal rows are counted before the shuffle and told apart after it;
    slots are counted within groups that a hash makes, and groups follow one another."""
    groups = max(1, SLOT_GROUPS // n_shards)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    rows = rows.select("id", "size", "crc", jump_shard(id_text("id"), n_shards).alias("shard"))
    mark = F.md5(F.concat_ws(":", id_text("id"), F.col("size"), F.col("crc")).cast("binary"))
    rows = rows.withColumn("part", (F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") % groups).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    single = rows.groupBy("id", "size", "crc", "shard", "part").agg(F.count(F.lit(1)).alias("n"))
    single = single.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = single.join(F.broadcast(starts), ["shard", "part"])
    last = F.col("n") - 1
    runs = placed.select("*", F.explode(F.sequence(F.lit(0), F.call_function("div", last, F.lit(RUN)))).alias("run"))
    here = F.sequence(F.col("run") * RUN, F.least(last, F.col("run") * RUN + (RUN - 1)))
    each = runs.select("*", F.explode(here).alias("nth"))
    return each.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("start") + F.col("first") + F.col("nth")).alias("slot"), jump_shard(id_text("id"), n_shards + 1).alias("grown_shard"),
    )
