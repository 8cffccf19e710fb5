import gzip
import hashlib
import json
from pathlib import Path

from groundwork.llm import warc

SCHEMA = "page_id long, url string, html string, key string"


def expected(rows):
    out, groups = [], {}
    for i, _, h, _ in rows:
        p = (h or "").encode()
        if len(p) >= 1000:
            groups.setdefault(p, []).append(i)
    lead = {p: max((i for i in ids if i is not None), default=None) for p, ids in groups.items() if len(ids) > 1}
    said = set()
    for i, _, h, _ in rows:
        p = (h or "").encode()
        to = lead.get(p)
        if to is not None and i == to and (i, p) not in said:
            said.add((i, p))
            to = None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def pages():
    big = "é" * 600
    rows = [(i, f"http://a/{i}", f"<p>{i}</p>" * (i % 40), "x") for i in range(60)]
    rows += [(100, "http://a/ b\nc", big, "x"), (101, None, big, "x"), (102, "u", big, "x"), (102, "u", big, "x"), (103, "u", None, "x"), (104, "u", "", "x")]
    return rows + [(None, "u", big, "x"), (None, "u", "short", "x"), (105, "u", "s", "x"), (105, "u", "s", "x"), (106, "u", "z" * 3_000_000, "x")]


def write(spark, rows, path, **kw):
    warc.write_warc(spark.createDataFrame(rows, SCHEMA).repartition(3), str(path), **kw)


def test_round_trip(spark, tmp_path):
    rows = pages()
    write(spark, rows, tmp_path / "a", shard_bytes=500_000, file_bytes=1000)
    got = warc.read_warc(spark, str(tmp_path / "a")).collect()
    assert sorted(((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(rows)
    text = {(r["key"], r["payload"].decode()) for r in got if r["record_type"] == "response"}
    assert {(i, h or "") for i, _, h, _ in rows if len((h or "").encode()) < 1000} <= text
    listed = {f["name"] for f in json.loads((tmp_path / "a" / warc.MANIFEST).read_text())["files"]}
    assert {p.name for p in (tmp_path / "a").glob("*.warc.gz")} == listed and len(listed) > 3
    assert not [p for p in (tmp_path / "a").iterdir() if p.name.startswith(".part") and not p.name.endswith(".crc")]


def test_equal_input_gives_equal_bytes(spark, tmp_path):
    rows = pages()
    write(spark, rows, tmp_path / "a", shard_bytes=500_000)
    write(spark, rows[::-1], tmp_path / "b", shard_bytes=500_000)
    files = lambda d: {p.name: p.read_bytes() for p in Path(d).glob("*.gz")}
    assert files(tmp_path / "a") == files(tmp_path / "b")
    assert gzip.decompress(next(iter(files(tmp_path / "a").values()))).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_empty_table(spark, tmp_path):
    write(spark, [], tmp_path / "e")
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_an_outlying_key_costs_no_balance_and_files_roll(spark, tmp_path):
    rows = [(i, "u", f"{i} " * 300, "x") for i in range(400)] + [(1 << 60, "u", "far", "x")]
    write(spark, rows, tmp_path / "a", shard_bytes=100_000, file_bytes=2000)
    files = json.loads((tmp_path / "a" / warc.MANIFEST).read_text())["files"]
    per = {}
    for f in files:
        per[f["name"][5:11]] = per.get(f["name"][5:11], 0) + f["records"]
    assert sum(per.values()) == 401 and len(per) >= 5 and max(per.values()) < 120
    assert len(files) > 2 * len(per)
    got = warc.read_warc(spark, str(tmp_path / "a"))
    assert got.count() == 401 and {r["key"] for r in got.select("key").collect()} == {r[0] for r in rows}
    import pytest

    with pytest.raises(FileExistsError):
        write(spark, rows[:3], tmp_path / "a")
    assert warc.read_warc(spark, str(tmp_path / "a")).count() == 401
