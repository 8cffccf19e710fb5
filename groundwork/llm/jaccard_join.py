"""Exact Jaccard join of documents by word shingles, with set relations used to skip work.

Two sets link when ``den * intersection >= num * union``. The steps, each a Spark job over all
documents with its result in the shared folder:

1. Equal sets are one class, found by fingerprint: copies cost no pairs.
2. A count of shingles per hash slot (``SLOT_BITS``, fixed size) gives the order in which every
   set lists its shingles: rare slots first, then by hash. Any order is exact; this one keeps
   frequent passages out of the prefixes.
3. Index lists: every pair that links shares a shingle of its prefixes. A posting is a shingle, a
   set, its size and the shingle's position in the set. Lists of one set go at once.
4. Blocks: a set's home is its longest list within a size band, and a home is cut by hash into
   blocks of bounded sets and shingles (:func:`_parts`). A list is thereby cut into blocks too.
5. Skipping by position: a shingle at position i of one set and j of another bounds what the two can
   share by n - (i - j) or m - (j - i). A set skips a whole block of a list if no position in it can
   reach the needed overlap, and within a block it reads only the postings at positions that can.
6. First round: every set meets its own block, and a few sets of a home meet all its blocks, so
   that a large group of near copies soon is one component.
7. Second round: blocks are dealt anew by component, and sets meet blocks (of all homes) of which
   not everything is of their own component: of a pair that is, the answer is known. Sets that
   ask one block are split into parts, each with the block's members, so no task holds a hot one.
8. Answers: in a block, a set's intersections with all members are read off an index. A set that is
   highly similar to one whose answer is computed takes that answer, less the lists of the
   shingles that it lacks, plus those of the shingles that it has besides (:class:`_Block`).

Frequent shingles are not gathered in a task: their lists stay rows. Lists hold as many leading
bytes of a hash as the corpus needs. Shingles are 64-bit hashes and classes 64-bit fingerprints.
Null texts and texts without words have the empty set and link with nothing. Null ids are judged
by their texts and report the id of a set they link to, or null. Repeated ids are judged by their
own texts, repeated rows are one class and a row each. An empty table gives no rows. Of other
columns those in ``carry`` are returned as they are, but for names of the result; ties have no part,
as every link counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import bytetext as bt
from .components import components
from .shared import Scratch

SLOT_BITS, CHUNK_BITS = 22, 16
FLUSH_TOKENS = 8_000_000
BUCKET_POSTINGS = 1_000_000
HEAVY_CLASS = 6
BATCH_POSTINGS = 300_000
#: A block holds at most about so many shingles, and so many sets or, for a home of more, as many
#: as keep the number of blocks to a share of the root of its sets.
BLOCK_SHINGLES, BLOCK_SETS = 2_000_000, 256
#: Sets of a home that meet all its blocks.
HUBS = 8
#: The largest bit table that picks texts is 2**27 bits, 16 MB, whatever the number of sets.
MAX_PICK_BITS = 27
#: So many rows of 40 bytes at most (8 MB) are broadcast.
MAX_BROADCAST_ROWS = 200_000
#: Answers kept in a block, and the similarity from which one is derived from another.
ANSWERS, DERIVE = 32, 0.6


def fingerprint(s: np.ndarray) -> int:
    """A signed 64-bit key of a sorted set."""
    if not len(s):
        return 0
    x = bt.mix(s + np.uint64(0x51ED270B)).sum(dtype=np.uint64)
    return int(bt.mix(np.array([x + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    """(batch, first row, the rows' sets) for pieces of each batch's column ``text``."""
    nonspace = bt.byte_class("nonspace")
    for batch in batches:
        data, offsets = bt.column_bytes(batch["text"])
        for i, j in bt.pieces(offsets):
            flat, borders = bt.shingle_sets(bt.words(data, offsets[i : j + 1], nonspace), size)
            yield batch, i, [flat[borders[k] : borders[k + 1]] for k in range(j - i)]


def _describe(size: int, carry: list[str]):
    """Rows of sets (kind 0), with the carried columns, and of slot counts (kind 1)."""
    names = ["kind", "id", "n", "key", "blob", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count, empty = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            slots = np.concatenate(held) if held else np.empty(0, np.uint32)
            dense = np.minimum(np.bincount(slots, minlength=1 << SLOT_BITS), 65535).astype(np.uint16)
            held.clear()
            parts = dense.reshape(-1, 1 << CHUNK_BITS)
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([1] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(range(n), pa.int64()), pa.nulls(n, pa.int64()),
                 pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary()), *[pa.nulls(n, t) for t in empty]],
                names,
            )

        for batch, i, sets in _sets(batches, size):
            n, empty = len(sets), [batch[c].type for c in carry]
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * n, pa.int32()), batch["id"].slice(i, n), pa.array(map(len, sets), pa.int64()),
                 pa.array(map(fingerprint, sets), pa.int64()), pa.nulls(n, pa.binary()), *[batch[c].slice(i, n) for c in carry]],
                names,
            )
            for s in sets:
                held.append((s >> np.uint64(64 - SLOT_BITS)).astype(np.uint32))
                count += len(s)
            if count >= FLUSH_TOKENS:
                yield from flush()
                count = 0
        if count:
            yield from flush()

    return run


def _level(tokens: int) -> float:
    """Twice the mean count of a slot."""
    return max(1.0, 2.0 * tokens / (1 << SLOT_BITS))


def _slot_classes(described: DataFrame, tokens: int) -> np.ndarray:
    """Per slot the power of two by which its count exceeds the level; 2**SLOT_BITS bytes."""
    level = _level(tokens)

    def total(key, pdf):
        import pandas as pd

        counts = sum(np.frombuffer(zlib.decompress(b), np.uint16).astype(np.int64) for b in pdf["blob"])
        cls = np.floor(np.log2(np.maximum(1, counts / level))).astype(np.uint8)
        return pd.DataFrame({"n": [key[0]], "blob": [cls.tobytes()]})

    rows = described.where("kind = 1").select("n", "blob").groupBy("n").applyInPandas(total, "n long, blob binary").collect()
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    for r in rows:
        at = r["n"] << CHUNK_BITS
        out[at : at + (1 << CHUNK_BITS)] = np.frombuffer(r["blob"], np.uint8)
    return out


def _token_bytes(tokens: int) -> int:
    """Leading bytes of a hash that lists hold: enough that of 256 shingles of the corpus hardly
    one shares them with another. Those that do only add candidates; whole sets decide."""
    return min(8, max(5, -(-(tokens.bit_length() + 8) // 8)))


def _narrow(token: np.ndarray, width: int) -> bytes:
    """The ``width`` leading bytes of each hash."""
    return token.view(np.uint8).reshape(-1, 8)[:, 8 - width :].tobytes()


def _widen(blob, width: int) -> np.ndarray:
    """The hashes of :func:`_narrow`, with zeros for what it left out."""
    part = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, 8 - width :] = part
    return out.view(np.uint64).ravel()


def _slot(key: np.ndarray, ident: np.ndarray, bits: int) -> np.ndarray:
    x = key.view(np.uint64) ^ (ident.view(np.uint64) << np.uint64(44)) ^ (ident.view(np.uint64) << np.uint64(37))
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _picked(wanted: DataFrame) -> tuple[int, np.ndarray]:
    """A bit table over hashes of (key, low), made by Spark; its size is bounded."""
    bits = min(MAX_PICK_BITS, max(18, int(wanted.count()).bit_length() + 4))
    low = F.coalesce("low", F.lit(0).cast("long"))
    mixed = F.col("key").bitwiseXOR(F.shiftleft(low, 44)).bitwiseXOR(F.shiftleft(low, 37))
    slot = F.shiftrightunsigned(mixed, 64 - bits)
    rows = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("chunk")).agg(
        F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767)).alias("bitmap")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        out[r["chunk"] * 4096 : r["chunk"] * 4096 + len(r["bitmap"])] = np.frombuffer(r["bitmap"], np.uint8)
    return bits, out


def _chosen(batches: Iterator[pa.RecordBatch], size: int, picked) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(keys, sets) of the classes in a bit table, each from the document with its lowest id. Some
    come that were not asked for, or twice."""
    bits, table = picked.value
    seen: set[int] = set()
    for batch, first, sets in _sets(batches, size):
        owners = batch["id"].slice(first, len(sets)).fill_null(0).to_numpy()
        keys = np.array([fingerprint(s) for s in sets], np.int64)
        slot = _slot(keys, owners, bits)
        out = []
        for i in np.flatnonzero((table[slot >> 3] >> (slot & 7)) & 1).tolist():
            key = int(keys[i])
            if len(sets[i]) and key not in seen:
                if len(seen) < 1_000_000:
                    seen.add(key)
                out.append(i)
        yield keys[out], [sets[i] for i in out]


def _postings(size: int, num: int, den: int, classes, picked, buckets: int, width: int):
    """Prefixes as postings (token, key, position), packed by bucket of tokens. Frequent tokens go to
    negative buckets by set, since their lists are known to be long and need no gathering."""

    def packed(keys: list[np.ndarray], prefixes: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(x) for x in prefixes])
        token, key = np.concatenate(prefixes), np.repeat(np.concatenate(keys), n)
        # Positions that two bytes do not hold are cut, which brings them nearer: nothing is skipped for it.
        pos = np.minimum(np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n), 65535).astype(np.uint16)
        heavy = _class_of(token, classes.value) >= HEAVY_CLASS
        bucket = (bt.mix(token) % np.uint64(buckets)).astype(np.int64)
        bucket[heavy] = -1 - (bt.mix(key[heavy].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        token, key, pos, bucket = token[order], key[order], pos[order], bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        blobs = [key[i:j].tobytes() + pos[i:j].tobytes() + _narrow(token[i:j], width) for i, j in zip(cut.tolist(), np.append(cut[1:], len(bucket)).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        count = 0
        for keys, sets in _chosen(batches, size, picked):
            if not sets:
                continue
            held[0].append(keys)
            for x in sets:
                prefix = _in_order(x, classes.value)[: len(x) - -(-num * len(x) // den) + 1]
                held[1].append(prefix)
                count += len(prefix)
            if count >= BATCH_POSTINGS:
                yield packed(*held)
                held, count = ([], []), 0
        if count:
            yield packed(*held)

    return run


def _class_of(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return classes[(s >> np.uint64(65 - len(classes).bit_length())).astype(np.int64)]


def _in_order(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A sorted set in the order of lists: rare slots first."""
    c = _class_of(s, classes)
    return s[np.argsort(c, kind="stable")] if c.any() else s


def _lists(width: int, classes, level: float):
    """(token, key, pos, m) of lists of two sets or more; m is the length of the list or, where it is
    not gathered, what the slot count says of it."""

    def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = len(blob) // (10 + width)
        return _widen(blob[10 * m :], width), np.frombuffer(blob, np.int64, m), np.frombuffer(blob, np.uint16, m, 8 * m)

    def rows(token: np.ndarray, key: np.ndarray, pos: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(token.view(np.int64)), pa.array(key), pa.array(pos.astype(np.int32)), pa.array(m, pa.int64())], ["token", "key", "pos", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            for b, blob in zip(batch["bucket"].to_pylist(), batch["blob"].to_pylist(), strict=True):
                if b < 0:
                    token, key, pos = unpacked(blob)
                    yield rows(token, key, pos, (np.exp2(_class_of(token, classes.value).astype(np.float64)) * level).astype(np.int64))
                else:
                    held.setdefault(b, []).append(unpacked(blob))
        for b in list(held):
            token, key, pos = (np.concatenate(x) for x in zip(*held.pop(b), strict=True))
            order = np.lexsort((key, token))
            token, key, pos = token[order], key[order], pos[order]
            new = np.r_[True, (token[1:] != token[:-1]) | (key[1:] != key[:-1])]
            token, key, pos = token[new], key[new], pos[new]
            cut = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            m = np.diff(np.append(cut, len(token)))
            m = np.repeat(m, m)
            if (several := m > 1).any():
                yield rows(token[several], key[several], pos[several], m[several])

    return run


BAND = 1.1


def _low(block: Column) -> Column:
    """The least size in a block: the last eight bits of its number are its size band."""
    return F.floor(F.pow(F.lit(BAND), block.bitwiseAND(255)))


def _high(block: Column) -> Column:
    return F.ceil(F.pow(F.lit(BAND), block.bitwiseAND(255) + 1))


def _least_shared(n: Column, low: Column, high: Column, num: int, den: int) -> Column:
    """Prefix shingles that a set of ``n`` must share with one of ``low`` to ``high`` to reach the
    threshold. Beyond the prefix that ends first at most ceil(t * size) - 1 of its set are left;
    the overlap needed grows with the other's size, what is left of the other grows faster."""
    t, u = num / den, num / (num + den)
    low, high = F.greatest(low, F.floor(n * t)), F.least(high, F.ceil(n / t))
    own, other = F.floor((n + low) * u) - F.ceil(n * t), F.floor((n + high) * u) - F.ceil(high * t)
    return F.greatest(F.lit(1), F.least(own, other))


def _reachable(n: Column, pos: Column, block: Column, first: Column, last: Column, num: int, den: int) -> Column:
    """Whether a set of ``n`` with a shingle at ``pos`` can link with one of the block that has it
    at positions ``first`` to ``last``; one shingle of slack covers rounding."""
    u = num / (num + den)
    least = F.greatest(_low(block), F.floor(n * (num / den)))
    most = F.least(_high(block), F.ceil(n * (den / num)))
    return (pos - last <= n - (n + least) * u + 1) & (first - pos <= most - (n + most) * u + 1)


def _parts(sets: Column, shingles: Column) -> Column:
    """Into how many blocks a group of sets is cut."""
    by_sets = F.least(sets / F.lit(float(BLOCK_SETS)), F.greatest(F.lit(1.0), F.sqrt(sets.cast("double")) / 4))
    return F.ceil(F.greatest(by_sets, shingles / F.lit(float(BLOCK_SHINGLES))))


def _number(band: Column, *of: Column, large: Column | None = None) -> Column:
    """A block's number: a hash, with the size band in the last eight bits and, in the bit before,
    whether one component has the block for itself."""
    flag = F.lit(0) if large is None else F.when(large, 256).otherwise(0)
    return F.shiftleft(F.shiftright(F.xxhash64(*of), 9), 9).bitwiseOR(band).bitwiseOR(flag.cast("long"))


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(BAND))).cast("long")


def _homes(lists: DataFrame, lows: DataFrame, tmp: Scratch) -> DataFrame:
    """(key, n, listed, home, band): each set's listed shingles with positions, and its longest list."""
    found = lists.groupBy("key").agg(F.max_by("token", F.struct("m", "token")).alias("home"), F.collect_list(F.struct("token", "pos")).alias("listed"))
    found = found.join(lows.select("key", "n"), "key").withColumn("band", _band(F.col("n")))
    return tmp.write(found.select("key", F.col("n").cast("int").alias("n"), "listed", "home", "band"), "homes")


def _small(df: DataFrame, name: str, tmp: Scratch) -> DataFrame:
    """A table of few narrow rows: written, and broadcast to joins where it has no more than the bound."""
    out = tmp.write(df, name)
    return F.broadcast(out) if out.count() <= MAX_BROADCAST_ROWS else out


def _cut(sets: DataFrame, groups: list[str], parts: str, tmp: Scratch) -> DataFrame:
    """``sets`` with the number of blocks that their group is cut into; few groups are cut at all."""
    large = _small(sets.groupBy(*groups).agg(_parts(F.count("*"), F.sum("n")).alias(parts)).where(F.col(parts) > 1), "cut", tmp)
    return sets.join(large, groups, "left").withColumn(parts, F.coalesce(parts, F.lit(1).cast("long")))


def _own_blocks(homes: DataFrame, tmp: Scratch) -> DataFrame:
    """Rows of the first round: every set in its own block, and the hubs of each home that has
    several blocks in all of them."""
    homes = _cut(homes, ["home", "band"], "parts", tmp)
    number = lambda part: _number(F.col("band"), F.col("home"), F.col("band"), part)
    own = homes.select(number(F.pmod(F.xxhash64("key"), F.col("parts"))).alias("block"), F.lit(-1).alias("role"), "key", "n", "listed")
    hub = F.min_by(F.struct("key", "n", "listed", "parts"), F.xxhash64("key", F.lit(1))).alias("hub")
    hubs = homes.where("parts > 1").groupBy("home", "band", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(HUBS)).alias("k")).agg(hub)
    hubs = hubs.select("home", "band", "hub.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hub.parts") - 1)).alias("part"))
    hubs = hubs.select(number(F.col("part")).alias("block"), F.lit(1).alias("role"), "key", "n", "listed")
    return own.unionByName(hubs).withColumn("part", F.lit(0)).withColumn("comp", F.col("key"))


def _blocks_by_component(homes: DataFrame, comp: DataFrame, tmp: Scratch) -> DataFrame:
    """(key, n, listed, comp, whole, block): a component that fills a block has blocks of its own,
    ``whole`` being one number for all of them; the others of a home share blocks."""
    slim = homes.select("key", "n", "home", "band")
    slim = slim.join(comp, slim["key"] == comp["node"], "left").select(slim["*"], F.coalesce("label", "key").alias("comp"))
    slim = tmp.write(slim, "components")
    slim = _cut(_cut(slim, ["home", "band", "comp"], "subs", tmp), ["home", "band"], "parts", tmp)
    large = F.col("subs") > 1
    among = F.when(large, F.col("comp")).otherwise(F.pmod(F.xxhash64("comp"), F.col("parts")))
    slim = slim.withColumn("whole", _number(F.col("band"), F.col("home"), F.col("band"), large, among, large=large))
    block = _number(F.col("band"), F.col("whole"), F.pmod(F.xxhash64("key"), F.col("subs")))
    slim = slim.select("key", "comp", "whole", block.alias("block"))
    return tmp.write(homes.select("key", "n", "listed").join(slim, "key"), "blocks")


def _apart(blocks: DataFrame, num: int, den: int, tmp: Scratch) -> DataFrame:
    """Rows of the second round: the sets that share enough listed shingles with a block of another
    component, each pair of blocks from one side, and the members of the blocks that are asked."""
    listed = blocks.select(F.explode("listed").alias("x"), "key", "n", "comp", "whole").select("x.token", "x.pos", "key", "n", "comp", F.col("whole").alias("own"))
    listed = listed.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "token")  # once, for both sides
    held = listed.groupBy("token", F.col("own").alias("whole")).agg(
        F.count("*").alias("m"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    whole, own = F.col("whole"), F.col("own")
    # Others ask the blocks of a large component, not its many sets them. Of two equal blocks a bit of
    # both numbers says which one asks, so that neither asks all others.
    large, mine = whole.bitwiseAND(256), own.bitwiseAND(256)
    asks = F.when(large != mine, large > mine).otherwise((own < whole) == (F.shiftright(own.bitwiseXOR(whole), 9).bitwiseAND(1) == 1))
    met = listed.join(held, "token").where(
        ((F.col("least") != F.col("comp")) | (F.col("most") != F.col("comp")))
        & (((own != whole) & asks) | ((own == whole) & (F.col("m") > 1)))
        & (_low(whole) * num <= F.col("n") * den) & (F.col("n") * num <= _high(whole) * den)
        & _reachable(F.col("n"), F.col("pos"), whole, F.col("first"), F.col("last"), num, den))
    met = met.groupBy("key", "n", "whole").agg(F.count("*").alias("shared"))
    met = met.where(F.col("shared") >= _least_shared(F.col("n"), _low(whole), _high(whole), num, den)).select("key", "whole")
    met = tmp.write(met.join(_small(blocks.select("whole", "block").distinct(), "wholes", tmp), "whole").select("key", "block"), "met")
    return _with_parts(met, blocks, blocks.select("key", "n", "listed", "comp"), tmp)


def _with_parts(probes: DataFrame, members: DataFrame, sets: DataFrame, tmp: Scratch) -> DataFrame:
    """Askers (role 1) split into parts of a block's size or BLOCK_SETS, and the block's members
    (role 0) once for each part; ``sets`` has what else is known of a key."""
    size = members.groupBy("block").agg(F.count("*").alias("held"))
    load = probes.groupBy("block").agg(F.count("*").alias("asking")).join(size, "block")
    load = _small(load.select("block", F.ceil(F.col("asking") / F.greatest(F.lit(BLOCK_SETS), F.col("held"))).alias("parts")), "load", tmp)
    asking = probes.join(load, "block").select("key", "block", F.pmod(F.xxhash64("key", F.lit(3)), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    each = F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part")
    there = members.select("key", "block").join(load, "block").select("key", "block", each, F.lit(0).alias("role"))
    return tmp.write(asking.unionByName(there).join(sets, "key"), "asked")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by block and part, members before askers, askers of one component together."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "block", "part").sortWithinPartitions("block", "part", F.col("role") > 0, "comp", "key")


class _Index:
    """Sets by token, each list in order of positions where they are given."""

    def __init__(self, sets: list[np.ndarray], positions: list[np.ndarray] | None = None):
        self.n = len(sets)
        flat = np.concatenate(sets)
        pos = np.concatenate(positions) if positions else np.zeros(len(flat), np.int64)
        order = np.lexsort((pos, flat)) if positions else np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
        flat = flat[order]
        new = np.r_[True, flat[1:] != flat[:-1]]
        cut = np.flatnonzero(new)
        self.token, self.first = flat[cut], np.r_[cut, len(flat)]
        # Number of the list, then position: ascending, so a stretch of positions is found at once.
        self.place = ((np.cumsum(new) - 1) << 32) | pos[order].astype(np.int64) if positions else None
        self.read = self.skipped = 0

    def _owners(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        count = b - a
        places = np.repeat(a - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.bincount(self.owner[places], minlength=self.n)

    def lists(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``s`` have a list, the lists)."""
        at = np.minimum(np.searchsorted(self.token, s), len(self.token) - 1)
        ok = np.flatnonzero(self.token[at] == s)
        return ok, at[ok]

    def counts(self, s: np.ndarray) -> np.ndarray:
        """Per set how many tokens of ``s`` it holds."""
        _, at = self.lists(s)
        return self._owners(self.first[at], self.first[at + 1])

    def near(self, s: np.ndarray, pos: np.ndarray, before: int, after: int) -> np.ndarray:
        """The same, over postings at positions from ``pos - before`` to ``pos + after``."""
        ok, at = self.lists(s)
        lo = np.maximum(pos[ok] - before, 0)
        a = np.searchsorted(self.place, (at << 32) | lo)
        b = np.maximum(a, np.searchsorted(self.place, (at << 32) | np.maximum(pos[ok] + after, 0), "right"))
        read = int((b - a).sum())
        self.read += read
        self.skipped += int((self.first[at + 1] - self.first[at]).sum()) - read
        return self._owners(a, b)


def _least(n, m, num: int, den: int):
    """The overlap that sets of ``n`` and ``m`` need."""
    return -(-(n + m) * num // (num + den))


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    """(block, part, role, key, the values of ``columns``), as they come; a row that repeats the
    one before is left out."""
    last = None
    for batch in batches:
        names = ("block", "part", "role", "key")
        for i, row in enumerate(zip(*(batch[c].to_pylist() for c in names), strict=True)):
            if row != last:
                yield (*row, *(batch[c][i] for c in columns))
            last = row


def _sent(batches: Iterator, names: list[str], types: list, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in batches:
        held.append(row)
        if len(held) >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held.clear()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


class _Listed:
    """The listed shingles of a block's members, and who may link with a set."""

    def __init__(self, members: list[tuple], num: int, den: int):
        self.keys, self.size, self.comp = (np.array([m[i] for m in members], np.int64) for i in range(3))
        self.index = _Index([m[3] for m in members], [m[4] for m in members])
        self.low, self.high = int(self.size.min()), int(self.size.max())
        self.hit, self.num, self.den = np.zeros(len(members), bool), num, den

    def candidates(self, key: int, n: int, comp: int, s: np.ndarray, pos: np.ndarray) -> bool:
        num, den = self.num, self.den
        able = (self.comp != comp) & (self.keys != key) & (den * np.minimum(self.size, n) >= num * np.maximum(self.size, n))
        if not able.any():
            return False
        low, high = max(self.low, -(-n * num // den)), min(self.high, n * den // num)
        shared = self.index.near(s, pos, n - _least(n, low, num, den), high - _least(n, high, num, den))
        least = _least(self.size, n, num, den)
        need = np.minimum(least + (-n * num // den), least + (-self.size * num // den)) + 1
        ok = able & (shared >= np.maximum(need, 1))
        self.hit |= ok
        return bool(ok.any())


def _count(num: int, den: int):
    """(key, block, role) of sets and members that may link, by their listed shingles."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int]]:
        at, held, listed = None, [], None

        def built() -> Iterator[tuple[int, int, int]]:
            nonlocal listed
            if listed is None and held:
                listed = _Listed(held, num, den)
                for key, n, comp, s, pos, asks in held:
                    if asks and listed.candidates(key, n, comp, s, pos):
                        yield key, at[0], -1

        def ended() -> Iterator[tuple[int, int, int]]:
            yield from built()
            if listed is not None:
                for m in np.flatnonzero(listed.hit).tolist():
                    yield held[m][0], at[0], 0

        for block, part, role, key, n, comp, own in _groups(batches, ("n", "comp", "listed")):
            if (block, part) != at:
                yield from ended()
                at, held, listed = (block, part), [], None
            fields = own.values
            s, pos = fields.field(0).to_numpy().view(np.uint64), fields.field(1).to_numpy().astype(np.int64)
            me = (key, n.as_py(), comp.as_py(), s, pos)
            if role <= 0:
                held.append((*me, role < 0))
                continue
            yield from built()
            if listed is not None and listed.candidates(*me):
                yield key, block, 1
        yield from ended()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(found(batches), ["key", "block", "role"], [pa.int64(), pa.int64(), pa.int32()])

    return run


def _sets_of(base: DataFrame, wanted: DataFrame, size: int, tmp: Scratch) -> DataFrame:
    """(key, s): the shingles of the sets in ``wanted`` (key, low), built again from their texts. Those
    that were not asked for go with the join on the key, repeated ones where sets meet."""
    picked = base.sparkSession.sparkContext.broadcast(_picked(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets in _chosen(batches, size, picked):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "s"])

    return tmp.write(base.select("id", "text").mapInArrow(run, "key long, s binary"), "sets")


def _with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` joined with the sets by key; few of them are sent to the sets, many are shuffled."""
    return sets.join(F.broadcast(rows) if rows.count() <= MAX_BROADCAST_ROWS else rows, "key")


class _Block:
    """The whole sets of a block, which of them are of one component by now, and computed answers.

    An answer is a set's intersection sizes with all members. It also says which members are highly
    similar to the set: when one of these is asked about, its answer is derived from the set's by
    the shingles in which the two differ. So is that of an asker that is similar to the last one."""

    def __init__(self, keys: list[int], sets: list[np.ndarray], comps: list[int]):
        self.keys, self.comp, self.sets, self.index = keys, np.array(comps, np.int64), sets, _Index(sets)
        self.size = np.array([len(s) for s in sets])
        self.same: dict[int, int] = {}
        self.answers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.best, self.source = np.zeros(len(sets)), np.full(len(sets), -1)
        self.computed = self.derived = 0

    def now(self, comp: int) -> int:
        while comp in self.same:
            comp = self.same[comp]
        return comp

    def answer(self, s: np.ndarray, member: int | None) -> np.ndarray:
        near = int(self.source[member]) if member is not None and self.best[member] >= DERIVE else self.computed - 1
        if near in self.answers:
            base, counts = self.answers[near]
            at = np.minimum(np.searchsorted(base, s), len(base) - 1)
            both = base[at] == s
            common = int(both.sum())
            if common >= DERIVE * (len(s) + len(base) - common):
                lost = np.ones(len(base), bool)
                lost[at[both]] = False
                self.derived += 1
                return counts + self.index.counts(s[~both]) - self.index.counts(base[lost])
        counts = self.index.counts(s)
        self.answers[self.computed] = (s, counts)
        self.answers.pop(self.computed - ANSWERS, None)
        alike = counts / (self.size + len(s) - counts)
        closer = alike > self.best
        self.best[closer], self.source[closer] = alike[closer], self.computed
        self.computed += 1
        return counts

    def links(self, s: np.ndarray, comp: int, num: int, den: int, member: int | None = None) -> np.ndarray:
        """One linked member of each other component."""
        able = (self.comp != self.now(comp)) & (den * np.minimum(self.size, len(s)) >= num * np.maximum(self.size, len(s)))
        if not able.any():
            return np.empty(0, np.int64)
        both = self.answer(s, member)
        hit = np.flatnonzero(able & (den * both >= num * (self.size + len(s) - both)))
        return hit[np.unique(self.comp[hit], return_index=True)[1]]

    def join(self, a: int, b: int) -> None:
        """What links to a linked set is of its component: no further look is needed."""
        a, b = self.now(a), self.now(b)
        if a != b:
            self.same[a] = b
            self.comp[self.comp == a] = b


def _meet(num: int, den: int):
    """Links between sets and blocks. Rows come by block, its members (role 0) before the sets
    that meet it (role 1); members that meet their own block (role -1) do both. A task holds one
    block at a time."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        at, members, ask, block = None, ([], [], []), [], None

        def meet(key: int, s: np.ndarray, comp: int, member: int | None = None) -> Iterator[tuple[int, int]]:
            for j in block.links(s, comp, num, den, member).tolist():
                yield key, block.keys[j]
                block.join(int(block.comp[j]), comp)

        def ready() -> Iterator[tuple[int, int]]:
            nonlocal block
            if block is None and members[0]:
                block = _Block(*members)
                for m in ask:
                    yield from meet(members[0][m], members[1][m], members[2][m], m)

        for blk, part, role, key, comp, own in _groups(batches, ("comp", "s")):
            s, comp = np.frombuffer(own.as_buffer(), np.uint64).copy(), comp.as_py()
            if (blk, part) != at:
                yield from ready()
                at, members, ask, block = (blk, part), ([], [], []), [], None
            if role <= 0:
                if role < 0:
                    ask.append(len(members[0]))
                for held, x in zip(members, (key, s, comp), strict=True):
                    held.append(x)
                continue
            yield from ready()
            if block is not None:
                yield from meet(key, s, comp)
        yield from ready()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(links(batches), ["a", "b"], [pa.int64(), pa.int64()])

    return run


def _links(rows: DataFrame, num: int, den: int, tmp: Scratch) -> DataFrame:
    """``rows`` (block, part, role, key, comp, s) met."""
    return tmp.write(_dealt(rows).select("block", "part", "role", "key", "comp", "s").mapInArrow(_meet(num, den), "a long, b long"), "links")


def _candidates(rows: DataFrame, num: int, den: int, tmp: Scratch) -> DataFrame:
    """(key, block, role) of the sets of ``rows`` that may link there."""
    counted = _dealt(rows).select("block", "part", "role", "key", "n", "comp", "listed").mapInArrow(_count(num, den), "key long, block long, role int")
    return tmp.write(counted.groupBy("key", "block", F.col("role") > 0).agg(F.min("role").alias("role")).select("key", "block", "role"), "candidates")


def jaccard_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 75, den: int = 100, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, class_key, group_key (one value per component,
    null without words), component_id (the smallest id that links lead to) and the ``carry`` columns."""
    spark = docs.sparkSession
    tmp = Scratch(spark)
    carry = tuple(c for c in carry if c not in (id_col, "n_shingles", "class_key", "group_key", "component_id"))
    n_shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)]
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), *kept)
    extra = [f for f in base.schema if f.name.startswith("carry_")]
    names = [f.name for f in extra]
    types = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in extra)
    described = tmp.write(base.mapInArrow(_describe(size, names), f"kind int, id long, n long, key long, blob binary{types}"), "described")
    rows = described.where("kind = 0").select("id", "n", "key", *names)
    tokens = rows.agg(F.sum("n")).first()[0] or 0
    lows = tmp.write(rows.where("n > 0").groupBy("key").agg(F.min("id").alias("low"), F.first("n").alias("n")), "lows")
    classes, picked = spark.sparkContext.broadcast(_slot_classes(described, tokens)), spark.sparkContext.broadcast(_picked(lows))
    buckets = max(n_shuffle, -(-tokens * (den - num) // den // BUCKET_POSTINGS))
    width = _token_bytes(tokens)
    posted = base.select("id", "text").mapInArrow(_postings(size, num, den, classes, picked, buckets, width), "bucket long, blob binary")
    lists = posted.repartition(buckets, "bucket").mapInArrow(_lists(width, classes, _level(tokens)), "token long, key long, pos int, m long")
    homes = _homes(lists, lows, tmp)
    # First round: own blocks.
    found = _candidates(_own_blocks(homes, tmp), num, den, tmp)
    sets = _sets_of(base, tmp.write(lows.join(found.select("key").distinct(), "key", "left_semi"), "used"), size, tmp)
    # A hub is a member of its own block: one row does for both.
    inside = found.groupBy("key", "block").agg(F.min("role").alias("role")).withColumn("part", F.lit(0)).withColumn("comp", F.col("key"))
    links = _links(_with_sets(inside, sets), num, den, tmp)
    comp = components(links, tmp)
    # Second round: blocks of other components.
    blocks = _blocks_by_component(homes, comp, tmp)
    tmp.drop(homes)
    asked = _apart(blocks, num, den, tmp)
    found = _candidates(asked, num, den, tmp)
    tmp.drop(asked)
    more = lows.join(found.select("key").distinct(), "key", "left_semi").join(sets.select("key").distinct(), "key", "left_anti")
    both = sets.unionByName(_sets_of(base, tmp.write(more, "more"), size, tmp))
    of = blocks.select("key", "comp").join(found.select("key").distinct(), "key", "left_semi")
    asked = _with_parts(found.where("role = 1").select("key", "block"), found.where("role = 0").select("key", "block"), of, tmp)
    links = links.unionByName(_links(_with_sets(asked, both), num, den, tmp))
    comp = components(links, tmp)
    # From classes to documents: the smallest id of a component, over all its classes' copies.
    ids = lows.join(comp, lows["key"] == comp["node"], "left").select("key", "low", F.coalesce("label", "key").alias("comp"))
    ids = tmp.write(ids, "classes")
    lowest = ids.groupBy("comp").agg(F.min("low").alias("component_id"))
    ids = ids.join(lowest, "comp").select("key", F.col("comp").alias("group_key"), "component_id")
    out = rows.join(ids, "key", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("key").alias("class_key"), "group_key",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        *[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)])
    return tmp.result(out, "jaccard")
