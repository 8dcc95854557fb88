"""Removal of repeated passages: a count-min prefilter, then exact grouping of what it lets through.

Pass 1 sketches. Documents are dealt into blocks; each block marks the counters of its windows in a count-min
sketch (saturating at two). A sketch that fits all windows does not fit one machine, so it is cut into ranges of
counters, and a block sends to each range only the counters that it touched. Each range merges the blocks'
partial sketches and answers every block: which of your counters reached two.
Pass 2 groups. A window whose counters all reached two may repeat (the sketch never underestimates, so none is
lost); just these windows, one row per block and window, are grouped exactly, to find where each starts first. A window
goes by two independent 64-bit hashes of its words, each made of hashes of the words' bytes.
Pass 3 removes words covered by windows that start earlier elsewhere.

No stage sends a row per occurrence: a passage found in a third of all documents costs one entry per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, Words, id_and_text, mix, runs, slices, table

WINDOW = 20
#: Text that a block is to hold, and the fewest blocks.
BLOCK_BYTES, LEAST_BLOCKS = 8 << 20, 48
#: Rows of the sketch, counters per window in each, and counters in a range.
DEPTH, PER_WINDOW, RANGE_BITS = 2, 4, 22
#: Stands for a null doc_id, before all others.
NO_ID = -(1 << 63)


class _Block:
    """Windows of a block's documents, in the order of (doc_id, tie)."""

    def __init__(self, pdf: pd.DataFrame, size: int):
        pdf = pdf.sort_values(["doc_id", "tie"])
        self.doc_id, self.text = pdf["doc_id"].to_numpy(np.int64), pdf["text"].tolist()
        self.tie, self.times = pdf["tie"].to_numpy(np.int64), pdf["times"].to_numpy(np.int64)
        hashes, second, counts = [], [], []
        for part in slices(iter([pa.record_batch([pa.array(self.text, pa.string())], names=["text"])])):
            w = Words(part.column(0), WHITE, lower=False)
            hashes.append(w.hash)
            second.append(w.second)
            counts.append(w.counts())
        words, others = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (hashes, second))
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.a, self.at = runs(words, owner, size)
        self.b = runs(others, owner, size, 0xA0761D6478BD642F)[0]
        self.owner = owner[self.at] if len(owner) else owner

    def counters(self, depth: int, width: int) -> np.ndarray:
        """Counter of each window in one row of the sketch."""
        return mix(self.a + np.uint64(0x9E3779B97F4A7C15 * (depth + 1) & (2**64 - 1))) & np.uint64(width - 1)


def _sketch(width: int, size: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, out = _Block(pdf, size), []
        for depth in range(DEPTH):
            cells, n = np.unique(block.counters(depth, width), return_counts=True)
            part = (cells >> np.uint64(RANGE_BITS)).astype(np.int64)
            low = (cells & np.uint64((1 << RANGE_BITS) - 1)).astype(np.uint32) << np.uint32(1) | (n > 1).astype(np.uint32)
            out += [(depth, p, key[0], _steps(low[s:e])) for p, s, e in _cuts(part)]
        return pd.DataFrame(out, columns=["depth", "part", "block", "cells"])

    return run


def _cuts(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of each run of equal values in a sorted array."""
    if not len(part):
        return []
    at = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    return [(int(part[s]), s, e) for s, e in zip(at, [*at[1:], len(part)], strict=True)]


def _steps(cells: np.ndarray) -> bytes:
    """Ascending counters as steps, two bytes each where all steps fit."""
    steps = np.diff(cells, prepend=np.uint32(0))
    return b"\2" + steps.astype(np.uint16).tobytes() if steps.max(initial=0) < 1 << 16 else b"\4" + steps.tobytes()


def _cells(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint16 if data[0] == 2 else np.uint32, offset=1), dtype=np.uint32)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block's counters of this range, one bit: it reached two over all blocks."""
    total = np.zeros(1 << RANGE_BITS, np.uint8)
    for x in pdf["cells"]:
        cells = _cells(x)
        k = cells >> 1
        total[k] = np.minimum(total[k] + 1 + (cells & 1).astype(np.uint8), 2)
    bits = [np.packbits(total[_cells(x) >> 1] > 1).tobytes() for x in pdf["cells"]]
    return pd.DataFrame({"block": pdf["block"], "depth": pdf["depth"], "part": pdf["part"], "bits": bits})


def _repeated(block: _Block, answers: pd.DataFrame, width: int) -> np.ndarray:
    """Places in block.a of windows that the merged sketch counts twice or more."""
    maybe = np.ones(len(block.a), bool)
    for depth in range(DEPTH):
        cells, inverse = np.unique(block.counters(depth, width), return_inverse=True)
        part = (cells >> np.uint64(RANGE_BITS)).astype(np.int64)
        flags = np.zeros(len(cells), bool)
        mine = answers[answers["depth"] == depth]
        for p, bits in zip(mine["part"], mine["bits"], strict=True):
            s, e = np.searchsorted(part, p, "left"), np.searchsorted(part, p, "right")
            flags[s:e] = np.unpackbits(np.frombuffer(bits, np.uint8), count=e - s).astype(bool)
        maybe &= flags[inverse]
    return np.flatnonzero(maybe)


def _distinct(block: _Block, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct window among `maybe` (by a, b), and for each of maybe the number of its window."""
    order = np.lexsort((maybe, block.b[maybe], block.a[maybe]))
    a, b = block.a[maybe][order], block.b[maybe][order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    number = np.empty(len(maybe), np.int64)
    number[order] = np.cumsum(new) - 1
    return maybe[order[new]], number


def _packed(*columns: np.ndarray) -> bytes:
    return pa.compress(b"".join(x.tobytes() for x in columns), codec="zstd", asbytes=True)


def _unpacked(n: int, data: bytes, *kinds: str) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    raw = pa.decompress(data, n * sum(widths), codec="zstd", asbytes=True)
    return [np.frombuffer(raw, k, n, n * sum(widths[:i])) for i, k in enumerate(kinds)]


def _candidates(width: int, size: int, parts: int, shared: bool):
    def run(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block = _Block(docs, size)
        maybe = _repeated(block, answers, width)
        firsts, number = _distinct(block, maybe)
        a, b, owner = block.a[firsts], block.b[firsts], block.owner[firsts]
        places = [block.doc_id[owner], block.tie[owner]] if shared else [block.doc_id[owner]]
        more = (np.bincount(number, minlength=len(firsts)) > 1).astype(np.uint8)
        part = (a % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        out = [(p, key[0], e - s, _packed(a[o], b[o], more[o], *(x[o] for x in places))) for p, s, e in _cuts(part[order]) for o in [order[s:e]]]
        return pd.DataFrame(out, columns=["part", "block", "n", "records"])

    return run


def _decide(shared: bool):
    """Exact groups of one range of windows: per block those that do repeat, and whether the first start is its own.

    Rows of one doc_id share a block, so between blocks the smallest doc_id alone decides; where doc_ids are shared,
    rows of one doc_id and text do, and doc_id and tie decide.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _decided(pdf, shared)

    return run


def _decided(pdf: pd.DataFrame, shared: bool) -> pd.DataFrame:
    columns = [_unpacked(n, x, "<u8", "<u8", "u1", "<i8", *(["<i8"] if shared else [])) for n, x in zip(pdf["n"], pdf["records"], strict=True)]
    a, b, more, *places = (np.concatenate(x) for x in zip(*columns, strict=True))
    source = np.repeat(np.arange(len(columns)), pdf["n"])
    order = np.lexsort((*reversed(places), b, a))
    a, b, more, source = a[order], b[order], more[order], source[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    repeats = ((np.bincount(group) > 1) | (np.bincount(group, weights=more) > 0))[group]
    a, new, source = a[repeats], new[repeats], source[repeats]
    back = np.argsort(source, kind="stable")
    a, new = a[back], new[back]
    out = [(int(pdf["block"].iloc[k]), e - s, _packed(a[s:e], new[s:e].astype(np.uint8))) for k, s, e in _cuts(source[back])]
    return pd.DataFrame(out, columns=["block", "n", "windows"])


def _remove(size: int):
    def run(key: tuple, docs: pd.DataFrame, decided: pd.DataFrame) -> pd.DataFrame:
        block = _Block(docs, size)
        parts = [_unpacked(n, x, "<u8", "u1") for n, x in zip(decided["n"], decided["windows"], strict=True)]
        a = np.concatenate([x[0] for x in parts] or [np.zeros(0, np.uint64)])
        owns = np.concatenate([x[1] for x in parts] or [np.zeros(0, np.uint8)]).astype(bool)
        order = np.argsort(a)
        a, owns = a[order], owns[order]
        repeated = np.flatnonzero(np.isin(block.a, a))
        firsts, _ = _distinct(block, repeated)
        spared = firsts[owns[np.searchsorted(a, block.a[firsts])]] if len(a) else firsts
        dies = np.zeros(len(block.a), bool)
        dies[repeated] = True
        dies[spared] = False
        start = block.at[dies]
        edge = np.zeros(block.first[-1] + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + size, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[block.first])
        kept = []
        for k, text in enumerate(block.text):
            words = text.encode().split()
            if removed[k]:
                words = compress(words, (~gone[block.first[k] : block.first[k + 1]]).tolist())
            kept.append(b" ".join(words).decode())
        out = pd.DataFrame({"doc_id": block.doc_id, "n_words": block.counts, "n_removed": removed, "kept_text": kept, "times": 1})
        # of rows equal in doc_id and text, all but the first lose every window
        again = np.flatnonzero(block.times > 1)
        if not len(again):
            return out
        long = block.counts[again] >= size
        whole = ["" if x else b" ".join(block.text[k].encode().split()).decode() for k, x in zip(again.tolist(), long, strict=True)]
        rest = pd.DataFrame({"doc_id": block.doc_id[again], "n_words": block.counts[again], "n_removed": np.where(long, block.counts[again], 0), "kept_text": whole, "times": block.times[again] - 1})
        return pd.concat([out, rest])

    return run


def without_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (words left, joined by one space).

    A word goes if a window of `size` words covers it whose words also start earlier (smaller doc_id, or earlier
    in the same document; null ids come first, repeated ids in a fixed order, and of rows equal in doc_id and text all
    but one lose every window). Null or empty texts have no words; texts of any length are read whole; an empty table
    gives no rows; further columns of any name are not looked at.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs)
    about = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(LEAST_BLOCKS, -(-about["bytes"] // BLOCK_BYTES))
    windows = max(about["bytes"] // 6, 1)
    width = 1 << max(RANGE_BITS, int(np.ceil(np.log2(windows * PER_WINDOW))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-windows // 4_000_000))
    rows = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    # rows of one doc_id fall into one block, which orders them; where doc_ids are shared, rows equal in doc_id and text
    # are counted first and the others spread, so that rows without an id are not one block
    shared = not rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if shared:
        rows = rows.groupBy("doc_id", "tie", "text").agg(F.count("*").alias("times"))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "tie", F.lit(5)), F.lit(n_blocks)))
    else:
        rows = rows.withColumn("times", F.lit(1).cast("long")).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(n_blocks)))
    blocks = rows.groupBy("block")
    sketched = blocks.applyInPandas(_sketch(width, size), "depth int, part long, block long, cells binary")
    answers = sketched.groupBy("depth", "part").applyInPandas(_merge, "block long, depth int, part long, bits binary")
    candidates = blocks.cogroup(answers.groupBy("block")).applyInPandas(_candidates(width, size, parts, shared), "part long, block long, n long, records binary")
    decided = candidates.groupBy("part").applyInPandas(_decide(shared), "block long, n long, windows binary")
    kept = blocks.cogroup(decided.groupBy("block")).applyInPandas(_remove(size), "doc_id long, n_words long, n_removed long, kept_text string, times long")
    out = kept.select(F.expr(f"nullif(doc_id, {NO_ID}L)").alias("doc_id"), "n_words", "n_removed", "kept_text", "times")
    return out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times") if shared else out.drop("times")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS s FROM d, unnest(generate_series(1, len(w) - 19)) AS g(i) WHERE len(w) >= 20),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM later, unnest(generate_series(i, i + 19)) AS g(p) GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n, coalesce(len(ps), 0) AS r,
                CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_select(w, list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p))), ' ') END AS t
         FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(t) AS kept_sha256 FROM kept
"""
