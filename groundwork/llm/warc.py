"""WARC archives: a deterministic sharded writer and a reader, as a Spark data source ``warc``.

Records are in order of key and digest, and cut into shards of ``shard_bytes`` payload bytes by exact
running sums over the narrow columns: the borders follow from the records alone, wherever keys lie and
however the input is partitioned, and a shard holds more only where one key and payload repeat. A
shard is one task, which streams its sorted records and rolls its file when ``file_bytes`` compressed
bytes are reached. Every header is made anew: lengths, SHA-1 digests, ids derived from key and
payload; gzip members carry no time. Tasks write under temporary names. Once all have ended the
driver renames the files that the successful attempts report and writes a manifest, itself under
a temporary name first; the reader reads what the manifest lists. Files of lost attempts are never
listed. An archive that has a manifest is not written again: that raises FileExistsError.

Of records with equal payloads of at least ``dedupe_bytes`` bytes that with the largest key is a
response and the others revisit it. Null payloads are empty; null keys come first in order, are
never referred to, and stay null; a null URL has no target header, and control characters in one
are percent-encoded. Rows that repeat key and payload refer to their first. An empty table gives an
archive without files. Other columns are not written. Paths without a scheme are of Spark's default
file system.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .shared import Scratch, fresh_path

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "manifest.json"
#: Record dates are a parameter of the archive, so that equal input gives equal bytes.
DEFAULT_DATE = "1970-01-01T00:00:00Z"
#: About what the headers of a record take.
RECORD_BYTES = 500
READ_SCHEMA = "key long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
WRITE_SCHEMA = "shard int, key long, digest string, kind int, refers_to long, url string, payload string"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of Spark's default file system, if it has none of its own."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def filesystem(uri: str):
    """(file system, path within it) for a qualified folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def clean_url(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}:{digest}')}>"


def make_record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member of its own."""
    sha = hashlib.sha1(payload)
    b32 = base64.b32encode(sha.digest()).decode()
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    lines = [
        VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key, sha.hexdigest())}",
        f"WARC-Date: {date}", *([f"WARC-Target-URI: {clean_url(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{b32}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Payload-Length: {len(payload)}",
        *([f"X-Record-Key: {key}"] if key is not None else []),
    ]
    if revisit:
        lines += [
            f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha.hexdigest())}", f"X-Refers-To-Key: {refers_to}",
        ]
    return gzip_member("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_records(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record; memory holds one record and one chunk."""
    z, out, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(chunk)
        rest = b""
        if not data:
            if out:
                raise ValueError("the archive ends within a record")
            return
        out.append(z.decompress(data))
        if z.eof:
            rest = z.unused_data
            head, _, block = b"".join(out).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if lines[0] != VERSION or not block.endswith(b"\r\n\r\n"):
                raise ValueError(f"not a record: {lines[0]!r}")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            block = block[:-4]
            if len(block) != int(headers["Content-Length"]):
                raise ValueError(f"length of {headers['WARC-Record-ID']} differs")
            yield headers, block
            z, out = zlib.decompressobj(31), []


@dataclass
class _Files(WriterCommitMessage):
    files: list


@dataclass
class _File(InputPartition):
    name: str


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.date = options["path"], options.get("date", DEFAULT_DATE)
        self.file_bytes = int(options.get("fileBytes", 1 << 30))

    def write(self, rows) -> _Files:
        fs, base = filesystem(self.path)
        attempt, files = uuid.uuid4().hex, []
        out, shard, seq, known, leader = None, None, 0, None, None

        def close():
            if out is not None:
                out.close()
                files[-1]["bytes"] = size

        size = 0
        for r in rows:
            if r.kind == 0:  # what the records of this key and payload refer to
                known, leader = (r.key, r.digest), r.refers_to
                continue
            if out is None or r.shard != shard or size >= self.file_bytes:
                close()
                seq = seq + 1 if r.shard == shard else 0
                shard, size = r.shard, 0
                name = f"part-{shard:06d}-{seq:05d}.warc.gz"
                files.append({"name": name, "temporary": f".{name}.{attempt}", "records": 0, "bytes": 0})
                out = fs.open_output_stream(f"{base}/{files[-1]['temporary']}")
                info = f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, name)}\r\nWARC-Date: {self.date}\r\n"
                body = f"software: groundwork\r\nformat: {VERSION}\r\n".encode()
                size += out.write(gzip_member(f"{info}WARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"))
            mine = known == (r.key, r.digest)
            size += out.write(make_record(r.key, r.url, (r.payload or "").encode(), leader if mine else None, self.date))
            if not mine:  # a row that repeats this one refers to it
                repeat = r.key is not None and len((r.payload or "").encode()) >= 1
                known, leader = ((r.key, r.digest), r.key) if repeat and r.refers_to is not None else (known, leader)
            files[-1]["records"] += 1
        close()
        return _Files(files)

    def commit(self, messages) -> None:
        fs, base = filesystem(self.path)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"])
        for f in files:
            fs.move(f"{base}/{f['temporary']}", f"{base}/{f['name']}")
        listed = [{k: f[k] for k in ("name", "records", "bytes")} for f in files]
        with fs.open_output_stream(f"{base}/.{MANIFEST}") as out:
            out.write(json.dumps({"files": listed}, indent=1).encode())
        fs.move(f"{base}/.{MANIFEST}", f"{base}/{MANIFEST}")

    def abort(self, messages) -> None:
        fs, base = filesystem(self.path)
        for f in (f for m in messages if m for f in m.files):
            try:
                fs.delete_file(f"{base}/{f['temporary']}")
            except FileNotFoundError:
                pass


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.with_payload = options["path"], options.get("payload", "true") == "true"

    def partitions(self):
        fs, base = filesystem(self.path)
        with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
            return [_File(x["name"]) for x in json.loads(f.read())["files"]] or [_File("")]

    def read(self, partition):
        if not partition.name:
            return
        fs, base = filesystem(self.path)
        with fs.open_input_stream(f"{base}/{partition.name}", compression=None) as stream:
            for h, block in parse_records(stream):
                if h["WARC-Type"] == "warcinfo":
                    continue
                digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                payload = block.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
                if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"digest of {h['WARC-Record-ID']} differs")
                whole = lambda k: int(h[k]) if k in h else None  # noqa: E731, B023
                yield (
                    whole("X-Record-Key"), h.get("WARC-Target-URI"), h["WARC-Type"], digest, int(h["X-Payload-Length"]),
                    whole("X-Refers-To-Key"), payload if self.with_payload else None,
                )


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)`` and the write behind ``write_warc``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def _order(key: int | None, digest: str) -> tuple[bool, int, str]:
    return (key is not None, key or 0, digest)


def _borders(narrow: DataFrame, shard_bytes: int, max_shards: int, tmp: Scratch) -> list[tuple[bool, int, str]]:
    """The first (key, digest) of every shard. Groups of records are dealt by range, wherever the
    ranges happen to end, summed within ranges and moved by what lies in the ranges before."""
    spark = narrow.sparkSession
    groups = narrow.groupBy("key", "digest").agg(F.sum(F.col("n") + RECORD_BYTES).alias("bytes"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = tmp.write(groups.repartitionByRange(n, "key", "digest").withColumn("range", F.spark_partition_id()), "ranges")
    totals = {r["range"]: r["bytes"] for r in ranged.groupBy("range").agg(F.sum("bytes").alias("bytes")).collect()}
    if not totals:
        return []
    before, rows = 0, []
    for k in sorted(totals):
        rows.append((k, before))
        before += totals[k]
    width = max(shard_bytes, -(-before // max_shards))
    moved = ranged.join(F.broadcast(spark.createDataFrame(rows, "range int, before long")), "range")
    upto = F.sum("bytes").over(Window.partitionBy("range").orderBy("key", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shard = F.floor((F.col("before") + upto - F.col("bytes")) / F.lit(width))
    first = moved.withColumn("shard", shard).groupBy("shard").agg(F.min(F.struct("key", "digest")).alias("first"))
    return sorted(_order(r["first"]["key"], r["first"]["digest"]) for r in first.collect())


def write_warc(
    pages: DataFrame, path: str, *, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    dedupe_bytes: int = 1000, shard_bytes: int = 32 << 20, file_bytes: int = 4 << 20, max_shards: int = 20_000,
    date: str = DEFAULT_DATE,
) -> None:
    """Writes every row of ``pages`` as a record under ``path``, a folder that executors share. With
    more than ``max_shards`` times ``shard_bytes`` bytes shards are longer: they are streamed, so that
    costs time in a task and no memory."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    tmp, path = Scratch(spark), qualified(spark, path)
    fs, base = filesystem(path)
    fs.create_dir(base, recursive=True)
    if fs.get_file_info(f"{base}/{MANIFEST}").is_file:
        raise FileExistsError(f"{path} holds an archive already")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    narrow = tmp.write(rows.select("key", "digest", F.octet_length("payload").cast("long").alias("n")), "digests")
    sent = spark.sparkContext.broadcast(_borders(narrow, shard_bytes, max_shards, tmp))
    shards = max(1, len(sent.value))

    @F.pandas_udf("int")
    def shard_of(key: pd.Series, digest: pd.Series) -> pd.Series:
        whole = key.astype("Int64").astype(object).where(key.notna(), None)
        return pd.Series([bisect.bisect_right(sent.value, _order(k, d)) - 1 for k, d in zip(whole, digest, strict=True)], dtype="int32")

    shard = shard_of("key", "digest")
    long = narrow.where(F.col("n") >= dedupe_bytes)
    lead = long.groupBy("digest").agg(F.max("key").alias("lead"), F.count("*").alias("copies")).where("copies > 1 AND lead IS NOT NULL")
    both = long.join(lead, "digest").where("key IS NULL OR key < lead").select("key", "digest", "lead").distinct()
    notes = both.select(
        shard.alias("shard"), "key", "digest", F.lit(0).alias("kind"), F.col("lead").alias("refers_to"),
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"),
    )
    # On records refers_to says only whether the payload is long enough to be referred to.
    able = F.when(F.octet_length("payload") >= dedupe_bytes, F.col("key"))
    records = rows.select(shard.alias("shard"), "key", "digest", F.lit(1).alias("kind"), able.alias("refers_to"), "url", "payload")
    out = notes.union(records).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key", "digest", "kind", "url")
    out.write.format("warc").mode("append").option("date", date).option("fileBytes", file_bytes).option("path", path).save()
    tmp.clear()


def read_warc(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """Every record of an archive, digests checked: see READ_SCHEMA."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", qualified(spark, path)).option("payload", str(payload).lower()).load()


def fresh_archive(spark: SparkSession) -> str:
    return fresh_path(spark, "warc")
