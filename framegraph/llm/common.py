"""Shared helpers of the training-data operators: tables, shared scratch tables, byte-level words."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; a folder of this machine only where that is unset and the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="framegraph-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = "file://" + own
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors.

    Every row is computed once, by tasks whose output is committed, so values that depend on how rows
    were dealt to tasks stay fixed for all readers. `drop_scratch` or the end of the process removes it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/framegraph/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch() -> None:
    """Remove every table that `materialize` wrote in this process."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may be gone; the folder's owner clears what is left
            return


atexit.register(drop_scratch)


#: Rows of texts that go to Python at a time, at most, and rows of keys that a join may broadcast (under 200 bytes each).
BATCH_ROWS, BROADCAST_ROWS = 1000, 500_000


def small_batches(spark: SparkSession) -> None:
    """Sessions of this subpackage hand texts to Python in batches of BATCH_ROWS at most: memory follows their length."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def if_small(keys: DataFrame) -> DataFrame:
    """keys, marked for broadcast where they are counted to be at most BROADCAST_ROWS; else left to a shuffled join."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone (null text: empty), so that further columns of any name cannot clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_marks(text: Column) -> tuple[Column, Column]:
    """A 128-bit name of a text (null: empty): with doc_id it tells rows apart whose ids are repeated or null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def without(docs: DataFrame, gone: DataFrame, once: bool) -> DataFrame:
    """docs, all columns, without the rows whose doc_id and text marks are in gone (doc_id, m1, m2); with `once` of
    rows equal in all three exactly one stays."""
    m1, m2 = "_m1", "_m2"
    while m1 in docs.columns or m2 in docs.columns:
        m1, m2 = "_" + m1, "_" + m2
    first, second = text_marks(F.col("text"))
    marked = docs.withColumn(m1, first).withColumn(m2, second)
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("m1").alias("_gone1"), F.col("m2").alias("_gone2")).distinct()
    gone = if_small(materialize(gone))
    same = marked["doc_id"].cast("long").eqNullSafe(gone["_gone"]) & (marked[m1] == gone["_gone1"]) & (marked[m2] == gone["_gone2"])
    kept = marked.join(gone, same, "left_anti")
    return (kept.dropDuplicates(["doc_id", m1, m2]) if once else kept).drop(m1, m2)


def in_fold(doc_id, modulus: int, remainder: int):
    """crc32(doc_id as text) mod modulus == remainder, false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `most` bytes of text (one longer text makes a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.array(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


def pooled(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, small batches put together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, column, most):
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


WHITE = np.ones(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text whose A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of a block that belong to a word of which 0 to 8 are left.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Starts of the two independent hashes of a word, and bytes from which a word goes through BLAKE2.
SEEDS, LONG = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)), 512


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of many texts, found and hashed at once: `first[i]:first[i + 1]` are text i's words.

    `hash` holds a 64-bit hash of each word's bytes, the same on every machine, `second` another, independent one.
    Words of the same length up to eight bytes never collide; longer ones are mixed block by block.
    """

    def __init__(self, texts: pa.Array, is_word: np.ndarray, lower: bool):
        texts = texts.cast(pa.binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        n = len(data)
        self._padded = np.zeros(n + 8, np.uint8)
        self._padded[:n] = LOWER[data] if lower else data
        self.data, self.texts = self._padded[:n], len(texts)
        inside = np.zeros(n + 1, bool)
        inside[:n] = is_word[self.data]
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:n]
        before[offsets] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(n + 1, bool)
        after[:n] = inside[1:]
        inner = offsets[1:]
        after[inner[inner > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hash = self.span(self.starts, self.ends)

    def blocks(self) -> np.ndarray:
        """The eight bytes from each place on, as one number."""
        return np.ndarray(len(self.data) + 1, "<u8", self._padded, strides=(1,))

    @cached_property
    def second(self) -> np.ndarray:
        return self.span(self.starts, self.ends, 1)

    def span(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """Hash of the bytes from each start to its end."""
        blocks, length, seed = self.blocks(), ends - starts, SEEDS[which]
        h = mix(mix(length.astype(np.uint64) + seed) ^ (blocks[starts] & _MASKS[np.minimum(length, 8)]))
        for k in np.flatnonzero(length > LONG).tolist():
            h[k] = int.from_bytes(hashlib.blake2b(self.data[starts[k] : ends[k]], digest_size=8, key=seed.tobytes()).digest(), "little")
        live, at = np.flatnonzero((length > 8) & (length <= LONG)), 8
        while len(live):
            block = blocks[starts[live] + at] & _MASKS[np.minimum(length[live] - at, 8)]
            h[live] = mix(h[live] * np.uint64(0xD1342543DE82EF95) + block)
            at += 8
            live = live[length[live] > at]
        return h

    def same(self, mine: np.ndarray, other: Words, theirs: np.ndarray) -> np.ndarray:
        """Whether words `mine` have the bytes of the other's words `theirs`, one by one."""
        length = self.ends[mine] - self.starts[mine]
        equal = length == other.ends[theirs] - other.starts[theirs]
        a, b, live, at = self.blocks(), other.blocks(), np.flatnonzero(equal), 0
        while len(live):
            differs = (a[self.starts[mine[live]] + at] ^ b[other.starts[theirs[live]] + at]) & _MASKS[np.minimum(length[live] - at, 8)]
            equal[live[differs != 0]] = False
            at += 8
            live = live[(differs == 0) & (length[live] > at)]
        return equal

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), self.counts())


def runs(hashes: np.ndarray, owner: np.ndarray, k: int, step: int = 0xD1342543DE82EF95) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k consecutive words that one text holds, and the place where the run starts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = hashes[:n].copy()
    for j in range(1, k):
        total *= np.uint64(step)
        total += hashes[j : j + n]
    where = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return mix(total[where]), where
