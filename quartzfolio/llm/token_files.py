"""Token ids in binary files, with access by document key.

A store is a folder of shard files, one for each range of keys, in ascending
order. A shard file is

* a header of seven little-endian 64-bit numbers: the magic number, bytes an id
  (2 or 4), rows, rows without a key (they come first), distinct keys, levels of
  the hash index, ids;
* the rows' keys and the ends of their ids, 64-bit numbers in row order;
* the index: the sizes of its levels, their bits, and by slot a 32-bit
  fingerprint and the first row with that key (64 bits);
* the ids, raw, one document after another; a line feed ends the file.

The index is a minimal perfect hash: in each level a key has one bit, set if no
other key left has the same; keys that met go to the next level. A key's slot is
the number of bits set before its own, so that n keys have the slots 0 to n - 1
and an expected two probes each. The slot's fingerprint turns unknown keys away
but for one in 2^32; the key of the row it points to turns away the rest.

Spark's writers write the files, so that lost tasks leave nothing behind and any
file system will do. Rows, ids and the least and greatest key of a shard stand
in the folder names: a listing is the manifest.

Defined results. Null texts are empty: the end id alone. Rows with equal keys are
documents of their own, in the order of a hash of their texts; they may go on in
the next shards, and a look-up finds all of them. Rows without a key come first;
they are in no index, and scans read them. Very long texts are encoded whole; a
shard's ids must fit in a row (2 GB). An empty table has no files. Further
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfolio.llm.common import GOLDEN, kept_by_worker, mix64, shared_path
from quartzfolio.llm.tokens import TokenIds, ended

MAGIC = int.from_bytes(b"ids-mph1", "little")
HEADER = np.dtype([(c, "<i8") for c in ("magic", "width", "rows", "keyless", "keys", "levels", "ids")])
SLOT = np.dtype([("fingerprint", "<u4"), ("row", "<i8")])
#: Bits a key in each level, and levels before the keys left are just listed by rank.
SPACE, LEVELS = 2, 64
#: Bytes of text in a shard, unless the session has more shuffle partitions.
SHARD_BYTES = 64 << 20
BATCH = 500
#: Requests up to which those of a look-up are broadcast.
FEW_REQUESTS = 100_000


def level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix64(keys.astype(np.int64).view(np.uint64) + np.array([level + 1], np.uint64) * GOLDEN)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (level_hash(keys, LEVELS + 7) >> np.uint64(32)).astype(np.uint32)


@dataclass
class PerfectHash:
    """Bits of each level, packed."""

    levels: list[np.ndarray]
    sizes: np.ndarray  # bits of each level
    before: np.ndarray | None = None  # bits set before each byte, over all levels

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """For distinct keys."""
        levels, sizes = [], []
        while len(keys):
            if len(levels) == LEVELS:
                raise ValueError("keys must be distinct")
            size = max(8, -(-SPACE * len(keys) // 8) * 8)
            at = (level_hash(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            levels.append(np.packbits(hits == 1, bitorder="little"))
            sizes.append(size)
            keys = keys[hits[at] > 1]
        return cls(levels, np.array(sizes, np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key, -1 for some of those that are not in the index."""
        packed = np.concatenate(self.levels) if self.levels else np.zeros(0, np.uint8)
        if self.before is None:
            self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])
        out, todo = np.full(len(keys), -1), np.arange(len(keys))
        first = 0
        for level, size in enumerate(self.sizes.tolist()):
            at = (level_hash(keys[todo], level) % np.uint64(size)).astype(np.int64)
            byte, bit = first + (at >> 3), (at & 7).astype(np.uint8)
            there = (packed[byte] >> bit) & 1 == 1
            below = np.bitwise_count(packed[byte] & ((np.uint8(1) << bit) - np.uint8(1)))
            out[todo[there]] = (self.before[byte] + below)[there]
            todo = todo[~there]
            first += size // 8
        return out


def shard_bytes(keys: np.ndarray, keyless: int, sizes: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """A shard file, of rows in order, the ``keyless`` ones first."""
    own = keys[keyless:]
    fresh = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]]))
    index = PerfectHash.of(own[fresh])
    slots = np.zeros(len(fresh), SLOT)
    at = index.slots(own[fresh])
    slots["fingerprint"][at], slots["row"][at] = fingerprints(own[fresh]), fresh + keyless
    head = np.array([(MAGIC, width, len(keys), keyless, len(fresh), len(index.levels), len(ids))], HEADER)
    parts = [head, keys.astype("<i8"), np.cumsum(sizes).astype("<i8"), index.sizes.astype("<i8"), *index.levels, slots, ids.astype(f"<u{width}")]
    return b"".join(x.tobytes() for x in parts)


class Shard:
    """A shard file's parts, without copies of its bytes."""

    def __init__(self, content: memoryview | bytes) -> None:
        at = HEADER.itemsize
        head = np.frombuffer(content, HEADER, 1)[0]
        if head["magic"] != MAGIC:
            raise ValueError("this is no shard of token ids")

        def take(kind: str | np.dtype, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += out.nbytes
            return out

        rows, n_keys = int(head["rows"]), int(head["keys"])
        self.keyless = int(head["keyless"])
        self.keys, self.ends = take("<i8", rows), take("<i8", rows)
        sizes = take("<i8", int(head["levels"]))
        self.index = PerfectHash([take(np.uint8, n // 8) for n in sizes.tolist()], sizes)
        self.slots = take(SLOT, n_keys)
        self.ids = take(f"<u{head['width']}", int(head["ids"]))

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, -1 if it isn't there: slot, fingerprint, and
        the key that the row has."""
        at = self.index.slots(keys)
        out = np.full(len(keys), -1)
        may = np.flatnonzero(at >= 0)
        may = may[self.slots["fingerprint"][at[may]] == fingerprints(keys[may])]
        row = self.slots["row"][at[may]]
        right = self.keys[row] == keys[may]
        out[may[right]] = row[right]
        return out

    def offsets(self, rows: np.ndarray) -> np.ndarray:
        """Ids before each row."""
        return np.where(rows > 0, self.ends[rows - 1], 0) if len(rows) else rows


def write(docs: DataFrame, spec: str, path: str, end_id: int = 2, shards: int | None = None) -> None:
    """Encode rows ``doc_id, text`` and write them as a store at ``path``. Rows are
    shuffled once, as texts, by ranges of key and a hash, so that a key with very
    many rows is spread over shards; each task encodes and writes a shard."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if shards is None:
        amount = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // SHARD_BYTES))
    shipped = spark.sparkContext.broadcast(spec)  # a tokenizer file, of fixed size
    digest = hashlib.sha256(spec.encode()).hexdigest()
    fields = [("shard", pa.int64()), ("n_rows", pa.int64()), ("n_ids", pa.int64()), ("least", pa.int64()), ("greatest", pa.int64()), ("content", pa.binary())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_by_worker("tokens", digest, lambda: TokenIds(shipped.value))
        width = 2 if max(encoder.largest, end_id) < 1 << 16 else 4
        keys, sizes, ids, keyless, shard = [], [], [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                got, n = ended(*encoder.flat(part.column("text").to_pylist()), end_id)
                keyless += part.column("doc_id").null_count
                keys.append(part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
                sizes.append(n)
                ids.append(got.astype(f"<u{width}"))
                shard = part.column("shard")[0].as_py()
        if keys:
            key, size, flat = np.concatenate(keys), np.concatenate(sizes), np.concatenate(ids)
            ids.clear()
            own = key[keyless:]
            row = (shard, len(key), len(flat), *((int(own[0]), int(own[-1])) if len(own) else (None, None)), shard_bytes(key, keyless, size, flat, width))
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    dealt = texts.withColumn("spread", F.xxhash64("text", F.monotonically_increasing_id())).repartitionByRange(shards, "doc_id", "spread")
    rows = dealt.sortWithinPartitions("doc_id", "spread").select("doc_id", "text", F.spark_partition_id().alias("shard"))
    files = rows.mapInArrow(run, "shard long, n_rows long, n_ids long, least long, greatest long, content binary")
    files.withColumn("content", F.col("content").cast("string")).write.partitionBy("shard", "n_rows", "n_ids", "least", "greatest").text(path)


#: The manifest's columns, in the folder names.
NAMED = "shard long, n_rows long, n_ids long, least long, greatest long"


def files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each shard: the manifest's columns, and the ids of all shards
    before; from a listing, no content is read."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("path"), *(F.col(c.split()[0]).cast("long") for c in NAMED.split(", ")))
    return listed.selectExpr("*", "coalesce(sum(n_ids) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")


def empty(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not any(x.isDirectory() for x in system.listStatus(folder))


OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
OUT_DDL = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def rows_out(shard: Shard, rows: np.ndarray, before: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a shard with their place, the CRC-32 of their ids as little-endian
    32-bit numbers, and those ids."""
    for at in range(0, len(rows), BATCH):
        part = rows[at : at + BATCH]
        first, last = shard.offsets(part), shard.ends[part]
        each = [shard.ids[a:b].astype("<u4") for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        keys = pa.array(shard.keys[part], mask=part < shard.keyless)
        crc = pa.array([zlib.crc32(x) for x in each], pa.int64())
        raw = pa.array([x.tobytes() for x in each] if with_ids else [None] * len(each), pa.binary())
        yield pa.record_batch([keys, pa.array(first + before), pa.array(last - first), crc, raw], schema=OUT)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Every document of a store, by its key: each shard's keys are looked up in its
    index, and their ids taken from where it says. Rows that share a key follow
    its first; those without a key come from the scan. No content is shuffled."""
    if empty(spark, path):
        return spark.createDataFrame([], OUT_DDL)
    before = files(spark, path).select("shard", "before").toPandas()  # one row a shard
    shipped = spark.sparkContext.broadcast(dict(zip(before["shard"].tolist(), before["before"].tolist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, content in zip(b.column("shard").to_pylist(), b.column("content"), strict=True):
                shard = Shard(memoryview(content.as_buffer()))
                distinct, first, repeats = np.unique(shard.keys[shard.keyless :], return_index=True, return_counts=True)
                found = shard.rows_of(distinct)
                if not np.array_equal(found, first + shard.keyless):
                    raise ValueError(f"the index of shard {number} does not fit its rows")
                rows = np.repeat(found - (np.cumsum(repeats) - repeats), repeats) + np.arange(repeats.sum())
                yield from rows_out(shard, np.concatenate([np.arange(shard.keyless), rows]), shipped.value[number], with_ids)

    scan = spark.read.format("binaryFile").load(path).select(F.col("shard").cast("long").alias("shard"), "content")
    return scan.mapInArrow(run, OUT_DDL)


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The documents of a store whose key is in column ``doc_id``, with their ids.
    Requests go to the shards whose ranges hold them; only such are read, and a
    shard is shuffled only if there are too many requests to broadcast."""
    if empty(spark, path):
        return spark.createDataFrame([], OUT_DDL)
    listed = files(spark, path).where("least IS NOT NULL").orderBy("shard").toPandas()  # one row a shard
    least, greatest, number, before = (listed[c].to_numpy() for c in ("least", "greatest", "shard", "before"))

    @F.arrow_udf("array<long>")
    def shards_of(key: pa.Array) -> pa.Array:
        k = key.to_numpy(zero_copy_only=False)
        return pa.array([number[a:b].tolist() for a, b in zip(np.searchsorted(greatest, k, "left"), np.searchsorted(least, k, "right"), strict=True)], pa.list_(pa.int64()))

    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    by_shard = wanted.select(F.explode(shards_of("doc_id")).alias("shard"), "doc_id").groupBy("shard").agg(F.collect_list("doc_id").alias("keys"))
    few = wanted.limit(FEW_REQUESTS + 1).count() <= FEW_REQUESTS
    shipped = spark.sparkContext.broadcast(dict(zip(number.tolist(), before.tolist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, requests, content in zip(b.column("shard").to_pylist(), b.column("keys"), b.column("content"), strict=True):
                shard = Shard(memoryview(content.as_buffer()))
                rows = shard.rows_of(requests.values.to_numpy())
                rows = rows[rows >= 0]
                more = rows
                while len(more):  # further rows of the same key
                    more = more[more + 1 < len(shard.keys)]
                    more = more[shard.keys[more + 1] == shard.keys[more]] + 1
                    rows = np.concatenate([rows, more])
                yield from rows_out(shard, rows, shipped.value[at], True)

    scan = spark.read.format("binaryFile").load(path).select(F.col("shard").cast("long").alias("shard"), "content")
    return scan.join(F.broadcast(by_shard) if few else by_shard, "shard").select("shard", "keys", "content").mapInArrow(run, OUT_DDL)


def round_trip(docs: DataFrame, spec: str, end_id: int = 2) -> DataFrame:
    """Write a store in the shared folder and read every document back from it."""
    path = shared_path(docs.sparkSession, "token-files")
    write(docs, spec, path, end_id)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", "ids_crc32")
