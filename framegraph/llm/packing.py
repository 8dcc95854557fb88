"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Only a document longer than a sequence is cut, so every item of the bin-packing instance has an integer size of
at most 2048, and the whole instance is a histogram with 2048 counters, however many documents there are. The
reduction and the best fit run on that histogram (runs of equal bins at once) and give *slots*: for each size,
ranges of ranks with the sequence and offset they go to. Spark tokenises, ranks the pieces within their size
and joins them with their slots.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_and_text, materialize, slices, table

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: the published split pattern of this byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Tokens:
    """Ids of texts as little-endian uint32 bytes, by the vocabulary and merges of a tokenizer's file.

    A byte-level file whose merges stand in the order of their ids (checked) is handed to tiktoken, whose encoder
    gives the same ids in a quarter of the time; any other goes through the tokenizers library itself.
    """

    def __init__(self, path: str):
        self.path, self.library, self.fast = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        vocabulary = model.get("vocab", {})
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model.get("merges", [])]
        special = {x["content"] for x in spec.get("added_tokens", [])}
        ordered = model.get("type") == "BPE" and all(vocabulary.get(x + y) == 256 + k for k, (x, y) in enumerate(merges))
        if ordered and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer"):
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            shown = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
            ranks = {bytes(shown[c] for c in token): k for token, k in vocabulary.items() if token not in special}
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        else:
            self.library = self._slow

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch(texts, add_special_tokens=False)]
        return [self._fast_ids(x) for x in texts]

    def _fast_ids(self, text: str) -> bytes:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), "<u4").tobytes()
        except ValueError:  # its pattern gives up on white space of about a million characters
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @cached_property
    def _slow(self):
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(self.path)
        slow.encode_special_tokens = True
        return slow


_workers: dict[str, _Tokens] = {}


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers:
            _workers[path] = _Tokens(path)
        block, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, most=1 << 20):
            out = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), _workers[path].ids(batch.column("text").to_pylist()), strict=True):
                ids += b"\0\0\0\0"
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n - start - 1) % capacity + 1 if start == 0 else capacity
                    out.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), block, int(seen[length])))
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

    return run


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, nth long"


class _Sizes:
    """Counts of items by size; sizes that are left, ascending."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.left = sorted(self.n)

    def take(self, size: int, times: int) -> None:
        self.n[size] -= times
        if not self.n[size]:
            del self.n[size]
            self.left.pop(bisect_left(self.left, size))

    def largest(self, most: int, less: tuple[int, ...] = ()) -> int | None:
        """Largest size of at most `most` of which an item is left besides those in `less`."""
        k = bisect_left(self.left, most + 1) - 1
        while k >= 0 and self.n[self.left[k]] <= less.count(self.left[k]):
            k -= 1
        return self.left[k] if k >= 0 else None

    def smallest(self, how_many: int, above: int = 0, less: tuple[int, ...] = ()) -> list[int]:
        out: list[int] = []
        k = bisect_left(self.left, above + 1)
        while k < len(self.left) and len(out) < how_many:
            s = self.left[k]
            out += [s] * min(self.n[s] - less.count(s), how_many - len(out))
            k += 1
        return out


def reduce_by_dominance(sizes: _Sizes, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello-Toth reduction: fix sets that dominate every other feasible set with their largest item.

    With j the largest item left and as many others as can go beside it: none, the set is {j}; one, it is {j, a}
    with a the largest that fits, as also when j + a fills the sequence; two, {j, a} if no pair beside j is larger
    than a alone, {j, a, b} with b the largest beside j and a if no pair has both items above b. Where nothing is
    proven, j is left for the best fit. Equal sets are fixed together.
    """
    fixed = []
    for j in sorted(sizes.n, reverse=True):
        while sizes.n.get(j):
            room = capacity - j
            small = sizes.smallest(3, less=(j,))
            fit = next((k for k in range(len(small), -1, -1) if sum(small[:k]) <= room), 0)
            a = sizes.largest(room, less=(j,))
            found: tuple[int, ...] | None = None
            if fit == 0 or a is None:
                found = (j,)
            elif fit == 1 or a == room:
                found = (j, a)
            elif fit == 2:
                b = sizes.largest(room - a, less=(j, a))
                above = sizes.smallest(2, above=b, less=(j,)) if b is not None else []
                best = max((x + (sizes.largest(min(room - x, x), less=(j, x)) or -x) for x in sizes.left if x <= room), default=0)
                if best <= a:
                    found = (j, a)
                elif b is not None and (len(above) < 2 or sum(above) > room):
                    found = (j, a, b)
            if found is None:
                break
            times = min(sizes.n[s] // found.count(s) for s in found)
            fixed.append((found, times))
            for s in found:
                sizes.take(s, times)
    return fixed


def best_fit(sizes: _Sizes, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of the items in decreasing order, equal sequences at once."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []
    done = []

    def put(room: int, held: tuple[int, ...], times: int) -> None:
        if not room:
            done.append((held, times))
            return
        if room not in open_:
            open_[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_[room].append((held, times))

    for s in reversed(sizes.left[:]):
        n = sizes.n[s]
        while n:
            k = bisect_left(rooms, s)
            if k == len(rooms):
                # as many of one size as fit go into each new sequence
                per = min(capacity // s, n)
                put(capacity - per * s, (s,) * per, n // per)
                n -= per * (n // per)
                continue
            room = rooms[k]
            held, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
            use = min(n, times)
            if use < times:
                put(room, held, times - use)
            put(room - s, (*held, s), use)
            n -= use
    return done + [x for group in open_.values() for x in group]


def slots(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Where ranks of each size go: rows (size, first rank, sequence of that rank, offset, ranks), and the sequences."""
    sizes = _Sizes(counts)
    packed = reduce_by_dominance(sizes, capacity)
    packed += best_fit(sizes, capacity)
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for held, times in packed:
        offset = 0
        for s in held:
            rows.append((s, used.get(s, 0), sequence, offset, times))
            used[s] = used.get(s, 0) + times
            offset += s
        sequence += times
    out = np.array(rows or [(0, 0, 0, 0, 0)], np.int64)
    return out[np.lexsort((out[:, 1], out[:, 0]))], sequence


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document ends with id 0, so null and empty texts make a piece of one id. Only a document longer than a sequence
    is cut, into as many pieces as it takes. Repeated rows, also of one or no doc_id, are packed each; pieces of equal
    size are interchangeable. An empty table gives no rows. Further columns of any name are not looked at.
    """
    spark = docs.sparkSession
    pieces = materialize(id_and_text(docs).mapInArrow(_pieces(tokenizer, capacity), _PIECES))
    by_block = pieces.groupBy("block", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    where, _ = slots(counts, capacity)
    # a bound on the slots that data cannot raise: sets fixed or fitted, times the items in each
    shared = spark.sparkContext.broadcast((where, np.searchsorted(where[:, 0], np.arange(capacity + 2))))
    before = by_block.select(F.col("block").alias("_block"), F.col("length").alias("_length"), (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, (pieces["block"] == before["_block"]) & (pieces["length"] == before["_length"]))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, first = shared.value
        # one ascending key over (size, rank) for a single search
        key = runs[:, 0] * (1 << 48) + runs[:, 1]
        for pdf in batches:
            size, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            k = np.searchsorted(key, size * (1 << 48) + rank, "right") - 1
            yield pdf.drop(columns="rank").assign(sequence_id=runs[k, 2] + rank - runs[k, 1], offset=runs[k, 3])

    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    return rows.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
