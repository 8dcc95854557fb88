"""Exact deduplication through cuckoo-filter indexes sharded by digest.

Texts are equal when identical after lower-casing A-Z. Each shard keeps a `CuckooIndex`: a cuckoo filter of
16-bit fingerprints answers "surely new" without a look at stored content; a hit is verified against the
content records of the digest's bucket (the whole SHA-256 of the normalised text, so texts themselves never
cross a shuffle). A full filter is doubled and refilled from the stored keys.

Every map task first indexes its own rows, so that a group of copies that holds a third of all rows
reaches the shard of its digest as one row per task.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, id_and_text, if_small, materialize, table

_UPPER_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Distinct digests that a map task holds before it hands them on, and rows that a shard indexes.
LOCAL_LIMIT = SHARD_ROWS = 500_000
#: Copies from which a group is joined with its rows apart from all others, without a shuffle.
HOT = 10_000
#: Stands for a null doc_id, below all others.
_NO_ID = -(1 << 63)


class CuckooIndex:
    """Live digests with a record each: insert, delete and look up, four slots a bucket."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 1024):
        self._lay_out(buckets)
        self.size = self.resizes = 0

    def _lay_out(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.fingers = array("H", bytes(2 * self.SLOTS * buckets))
        self.content: list[list | None] = [None] * buckets

    @staticmethod
    def _hash(digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[:6], "little"), (digest[6] | digest[7] << 8) or 1

    def _other(self, bucket: int, finger: int) -> int:
        return (bucket ^ (finger * 0x5BD1E995)) & self.mask

    def _slot(self, bucket: int, finger: int) -> int:
        """Place of a fingerprint in the bucket, -1 if it is not there."""
        fingers, at = self.fingers, bucket * 4
        for k in (at, at + 1, at + 2, at + 3):
            if fingers[k] == finger:
                return k
        return -1

    def find(self, digest: bytes) -> list | None:
        """The live record of a digest: filter first, then the bucket's content."""
        h, finger = self._hash(digest)
        bucket = h & self.mask
        if self._slot(bucket, finger) < 0 and self._slot(self._other(bucket, finger), finger) < 0:
            return None
        for record in self.content[bucket] or ():
            if record[0] == digest:
                return record
        return None

    def insert(self, record: list) -> None:
        """record: [digest, ...]; the digest must not be live."""
        h, finger = self._hash(record[0])
        bucket = h & self.mask
        if self.content[bucket] is None:
            self.content[bucket] = []
        self.content[bucket].append(record)
        self.size += 1
        if not self._place(bucket, finger):
            self._grow()

    def _place(self, bucket: int, finger: int) -> bool:
        for b in (bucket, self._other(bucket, finger)):
            if (k := self._slot(b, 0)) >= 0:
                self.fingers[k] = finger
                return True
        for turn in range(self.KICKS):
            k = bucket * 4 + (turn * 7 + finger) % 4
            finger, self.fingers[k] = self.fingers[k], finger
            bucket = self._other(bucket, finger)
            if (k := self._slot(bucket, 0)) >= 0:
                self.fingers[k] = finger
                return True
        return False

    def _grow(self) -> None:
        """Overflow: twice the buckets, filled anew from the stored keys."""
        kept, buckets = list(self.records()), 2 * (self.mask + 1)
        while True:
            self._lay_out(buckets)
            self.resizes += 1
            for record in kept:
                h, finger = self._hash(record[0])
                bucket = h & self.mask
                if self.content[bucket] is None:
                    self.content[bucket] = []
                self.content[bucket].append(record)
                if not self._place(bucket, finger):
                    break
            else:
                return
            buckets *= 2

    def delete(self, digest: bytes) -> bool:
        """Forget a live digest; False if it was not live (verified, so no other key's fingerprint goes)."""
        record = self.find(digest)
        if record is None:
            return False
        h, finger = self._hash(digest)
        bucket = h & self.mask
        k = self._slot(bucket, finger)
        self.fingers[k if k >= 0 else self._slot(self._other(bucket, finger), finger)] = 0
        self.content[bucket].remove(record)
        self.size -= 1
        return True

    def records(self) -> Iterator[list]:
        for bucket in self.content:
            yield from bucket or ()


_DIGESTS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary())])
_GROUPS = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
_GROUP_DDL = "digest binary, keep_id long, keep_row long, group_size long"


def digest_of(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode().translate(_UPPER_TO_LOWER)).digest()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        found = [hashlib.sha256(x.as_py().translate(_UPPER_TO_LOWER)).digest() for x in texts]
        yield pa.record_batch([batch.column("row"), batch.column("doc_id"), pa.array(found, pa.binary())], schema=_DIGESTS)


def _emit(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    records = list(index.records())
    for k in range(0, len(records), 50_000):
        digest, keep, row, size = zip(*records[k : k + 50_000], strict=True)
        yield pa.record_batch([pa.array(digest, pa.binary()), pa.array([None if x == _NO_ID else x for x in keep], pa.int64()), pa.array(row, pa.int64()), pa.array(size, pa.int64())], schema=_GROUPS)


def _index(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[pa.RecordBatch]:
    """Groups of the task's rows (digest, id, row, size). With a limit, partial groups leave early."""
    index = CuckooIndex()
    for batch in batches:
        for digest, keep, row, size in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            keep = _NO_ID if keep is None else keep
            record = index.find(digest)
            if record is None:
                index.insert([digest, keep, row, size])
            else:
                record[3] += size
                if (keep, row) > (record[1], record[2]):
                    record[1], record[2] = keep, row
        if limit and index.size > limit:
            yield from _emit(index)
            index = CuckooIndex()
    yield from _emit(index)


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, digest) of every row, written once; `row` tells repeated rows apart."""
    found = id_and_text(docs).withColumn("row", F.monotonically_increasing_id())
    return materialize(found.mapInArrow(_digest, "row long, doc_id long, digest binary"))


def _shards(spark, rows: int) -> int:
    """Shards grow with the rows, so that no index does."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHARD_ROWS))


def groups(digested: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, group_size), one row per distinct text."""
    own = digested.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    local = own.mapInArrow(lambda it: _index(it, LOCAL_LIMIT), _GROUP_DDL)
    return local.repartition(_shards(digested.sparkSession, digested.count()), "digest").mapInArrow(lambda it: _index(it, None), _GROUP_DDL)


def _with_group(digested: DataFrame, found: DataFrame) -> DataFrame:
    """digested with its group; rows of very large groups do not meet in one task."""
    hot = found.where(F.col("group_size") >= HOT)
    n = hot.count()
    if not 0 < n <= BROADCAST_ROWS:
        return digested.join(found, "digest")
    hot = F.broadcast(hot)  # counted: at most BROADCAST_ROWS
    rest = digested.join(hot, "digest", "left_anti").join(found.where(F.col("group_size") < HOT), "digest")
    return digested.join(hot, "digest").unionByName(rest)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays (null ids rank below all others; of repeated rows
    with that id exactly one stays). Null text counts as empty; texts of any length are digested whole. An empty table
    gives no rows. Further columns of any name are not looked at.
    """
    digested = digests(docs)
    joined = _with_group(digested, materialize(groups(digested)))
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs, all columns, without all but one row of each group of equal texts (which: see exact_groups).

    All null and empty texts are one group; an empty table gives no rows; columns of any name go through unchanged.
    """
    mark = "_digest"
    while mark in docs.columns:
        mark = "_" + mark
    columns = docs.columns
    at = columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([hashlib.sha256((x.as_py() or b"").translate(_UPPER_TO_LOWER)).digest() for x in batch.column(at).cast(pa.binary())], pa.binary())
            yield pa.record_batch([*batch.columns, found], names=[*columns, mark])

    digested = digests(docs)
    stay = materialize(groups(digested))
    marked = docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(mark, T.BinaryType())]))
    same_id = lambda other: marked["doc_id"].cast("long").eqNullSafe(other)
    repeated = digested.groupBy("digest", "doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if repeated.isEmpty():  # (digest, doc_id) tells rows apart: those that go are fewer than those that stay
        gone = _with_group(digested, stay).where("row != keep_row").select(F.col("digest").alias("_gone"), F.col("doc_id").alias("_id"))
        gone = if_small(materialize(gone))
        return marked.join(gone, (marked[mark] == gone["_gone"]) & same_id(gone["_id"]), "left_anti").drop(mark)
    stay = stay.select(F.col("digest").alias("_stay"), F.col("keep_id").alias("_keep"))
    kept = marked.join(stay, (marked[mark] == stay["_stay"]) & same_id(stay["_keep"]), "left_semi")
    return kept.dropDuplicates([mark, "doc_id"]).drop(mark)


def apply_changes(changes: DataFrame) -> DataFrame:
    """Live digests after a log of insertions and deletions: (digest, doc_ids live under it).

    changes: seq long (the order), op string (insert or delete), doc_id long, text string. A deletion takes
    its doc_id out; a digest leaves the filter with its last document. Unknown deletions change nothing.
    """

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([digest_of(x) for x in batch.column("text").to_pylist()], pa.binary())
            yield pa.record_batch([batch.column("seq"), batch.column("op"), batch.column("doc_id"), found], names=["seq", "op", "doc_id", "digest"])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for op, doc, digest in zip(*(batch.column(c).to_pylist() for c in ("op", "doc_id", "digest")), strict=True):
                record = index.find(digest)
                if op == "insert":
                    if record is None:
                        index.insert([digest, {doc}])
                    else:
                        record[1].add(doc)
                elif op == "delete" and record is not None:
                    record[1].discard(doc)
                    if not record[1]:
                        index.delete(digest)
        live = list(index.records())
        yield pa.record_batch([pa.array([r[0] for r in live], pa.binary()), pa.array([sorted(r[1]) for r in live], pa.list_(pa.int64()))], names=["digest", "doc_ids"])

    log = changes.select(F.col("seq").cast("long"), F.col("op").cast("string"), F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    shards = _shards(changes.sparkSession, changes.count())
    dealt = log.mapInArrow(digested, "seq long, op string, doc_id long, digest binary").repartition(shards, "digest").sortWithinPartitions("seq")
    return dealt.mapInArrow(replay, "digest binary, doc_ids array<long>")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
