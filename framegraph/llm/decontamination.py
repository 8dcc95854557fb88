"""Benchmark decontamination as a prefix-filtered set join with exact verification.

A window of a benchmark item (10 consecutive words, or a whole shorter item) is a record whose tokens are its
words. A document span can only contain the window if it contains every token, so the necessary prefix of the
window is its one rarest word; rarity is counted over all documents. Documents meet windows on that word alone.
A meeting proposes one place (position of the document's word less the word's place in the window), must leave
room for the window's length on both sides, and is then verified word by word on the bytes of the words.

The benchmark is joined block by block: a block has at most BLOCK_WINDOWS windows, which bounds what is broadcast;
a larger benchmark takes more passes over the documents (written once, so that all passes number rows alike), whose
hits are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Words, id_and_text, materialize, slices, table, text_marks, without

SIZE = 10
#: Windows in a block, at most about 160 bytes each when broadcast.
BLOCK_WINDOWS = 200_000

_ITEM_WINDOWS = "item_id long, words string"


def _windows(size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Words(batch.column("text"), ALNUM, lower=True)
            items, owners, found = batch.column("doc_id").to_pylist(), [], []
            for k, item in enumerate(items):
                lo, hi = w.first[k], w.first[k + 1]
                words = [w.data[a:b].tobytes().decode() for a, b in zip(w.starts[lo:hi], w.ends[lo:hi], strict=True)]
                mine = [" ".join(words[at : at + size]) for at in range(max(1, len(words) - size + 1))] if words else []
                found += mine
                owners += [item] * len(mine)
            yield pa.record_batch([pa.array(owners, pa.int64()), pa.array(found, pa.string())], names=["item_id", "words"])

    return cut


class _Block:
    """Distinct windows with the items that hold each, found by their rarest word."""

    def __init__(self, rows: list):
        items: dict[str, set] = {}
        for item, words in rows:
            items.setdefault(words, set()).add(item)
        self.items = [sorted(x, key=lambda i: -(1 << 63) if i is None else i) for x in items.values()]
        self.words = Words(pa.array(list(items), pa.string()), ALNUM, lower=False)
        self.first, self.length = self.words.first[:-1], np.diff(self.words.first)

    def order_by(self, frequency: dict[int, int]) -> None:
        """Each window goes by its rarest word, the earliest of equally rare ones."""
        hashes = self.words.hash.view(np.int64)
        known, number = np.unique(hashes, return_inverse=True)
        times = np.array([frequency.get(x, 0) for x in known.tolist()], np.int64)[number] if len(known) else known
        owner = self.words.owner()
        rarest = np.lexsort((np.arange(len(owner)), times, owner))[self.first] if len(owner) else self.first
        self.place = rarest - self.first
        self.of = np.argsort(hashes[rarest], kind="stable")
        self.prefix = hashes[rarest][self.of]

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(window, word place) of each verified containment."""
        words, owner = w.hash.view(np.int64), w.owner()
        lo, hi = np.searchsorted(self.prefix, words, "left"), np.searchsorted(self.prefix, words, "right")
        met = np.flatnonzero(hi > lo)
        n = (hi - lo)[met]
        at = np.repeat(met, n)
        window = self.of[np.repeat(lo[met] - np.cumsum(n) + n, n) + np.arange(len(at))]
        start = at - self.place[window]
        # positional and length bounds: the window lies within the document that holds the word
        doc = owner[at]
        fits = (start >= w.first[doc]) & (start + self.length[window] <= w.first[doc + 1])
        window, start = window[fits], start[fits]
        for j in range(int(self.length.max(initial=0))):
            longer = np.flatnonzero(self.length[window] > j)
            there, mine = start[longer] + j, self.first[window[longer]] + j
            maybe = w.hash[there] == self.words.hash[mine]
            maybe[maybe] = w.same(there[maybe], self.words, mine[maybe])
            keep = np.ones(len(window), bool)
            keep[longer[~maybe]] = False
            window, start = window[keep], start[keep]
        return window, start


def _frequencies(docs: DataFrame, vocabulary) -> DataFrame:
    """How often each benchmark word occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        total = np.zeros(len(words), np.int64)
        for batch in slices(batches):
            h = Words(batch.column("text"), ALNUM, lower=True).hash.view(np.int64)
            k = np.searchsorted(words, h)
            k[k == len(words)] = 0
            total += np.bincount(k[words[k] == h], minlength=len(words)) if len(h) else 0
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(words[met]), pa.array(total[met])], names=["word", "n"])

    return docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _matched(docs: DataFrame, block) -> DataFrame:
    """Per document: its columns but text, its number of words, the disjoint hit spans [from, to) and the items met."""
    keys = [c for c in docs.columns if c != "text"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in slices(batches):
            w = Words(batch.column("text"), ALNUM, lower=True)
            window, start = b.hits(w)
            edge = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + b.length[window], -1)
            hit = np.cumsum(edge[:-1]) > 0
            owner = w.owner()
            items: dict[int, set] = {}
            for k, doc in zip(*np.unique(np.stack([window, owner[start]]), axis=1), strict=True) if len(window) else ():
                items.setdefault(int(doc), set()).update(b.items[k])
            spans: list[list] = [[] for _ in range(w.texts)]
            for doc in items:
                own = np.flatnonzero(np.diff(hit[w.first[doc] : w.first[doc + 1]].astype(np.int8), prepend=0, append=0))
                spans[doc] = own.reshape(-1, 2).tolist()
            yield pa.record_batch(
                [*(batch.column(c) for c in keys), pa.array(w.counts()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([list(items.get(k, ())) for k in range(w.texts)], pa.list_(pa.int64()))],
                names=[*keys, "n_words", "spans", "items"],
            )

    return docs.mapInArrow(match, "".join(f"{c} long, " for c in keys) + "n_words long, spans array<array<long>>, items array<long>")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, spans (hit words [from, to)), items (item ids met, sorted as strings).

    Null or empty texts have no words and no hits; an empty benchmark hits nothing; an empty table gives no rows; texts of
    any length are read whole; repeated documents give repeated rows, repeated items count once. Items of fewer than `size`
    words, but at least one, are one window. Further columns of any name are not looked at.
    """
    found = _found(id_and_text(docs), benchmark, size, block_windows)
    return found.select("doc_id", "n_words", "spans", F.expr("array_sort(transform(items, x -> cast(x as string)))").alias("items"))


def _found(docs: DataFrame, benchmark: DataFrame, size: int, block_windows: int) -> DataFrame:
    """docs (text and columns of type long) without text, with n_words, spans and items of each row."""
    spark = docs.sparkSession
    cut = id_and_text(benchmark, "item_id").mapInArrow(_windows(size), _ITEM_WINDOWS).distinct()
    n = cut.count()
    blocks = -(-n // block_windows)
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows) if blocks > 1 else rows
    found = None
    for k in range(max(blocks, 1)):
        block = _Block([(r.item_id, r.words) for r in (cut.where(F.pmod(F.hash("words"), F.lit(blocks)) == k) if blocks > 1 else cut).toLocalIterator()])
        frequency = {r.word: r.n for r in _frequencies(rows, spark.sparkContext.broadcast(np.unique(block.words.hash.view(np.int64)))).collect()} if block.items else {}
        block.order_by(frequency)
        part = _matched(rows, spark.sparkContext.broadcast(block))
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        both = found.groupBy(*(c for c in rows.columns if c != "text")).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        # spans of several blocks may overlap: sorted, each is put together with the last one or set after it
        found = both.withColumn(
            "spans",
            F.expr(
                "aggregate(spans, cast(array() as array<array<bigint>>), (done, s) -> if(size(done) > 0 and s[0] <= element_at(done, -1)[1],"
                " concat(slice(done, 1, size(done) - 1), array(array(element_at(done, -1)[0], greatest(element_at(done, -1)[1], s[1])))), concat(done, array(s))))"
            ),
        )
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.0) -> DataFrame:
    """docs, all columns, without documents of which more than `share` of the words is hit.

    Each row is judged by its own text, whatever other rows have its doc_id; repeated rows go or stay together. Null and
    empty texts stay, as does all where the benchmark is empty.
    """
    m1, m2 = text_marks(F.col("text"))
    hit = _found(id_and_text(docs).withColumn("m1", m1).withColumn("m2", m2), benchmark, SIZE, BLOCK_WINDOWS)
    hit = hit.withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s[1] - s[0])"))
    return without(docs, hit.where((F.col("n_hit") > 0) & (F.col("n_hit") > F.lit(share) * F.col("n_words"))), once=False)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s[1] - s[0])")
    return hit.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP8_SQL = r"""
WITH low AS (SELECT translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, doc_id FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
       FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
       FROM d, ks, unnest(generate_series(1, len(w) - k + 1)) AS g(i) WHERE len(w) >= k),
hit AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
words AS (SELECT DISTINCT doc_id, p FROM (SELECT DISTINCT doc_id, i, k FROM hit), unnest(generate_series(i, i + k - 1)) AS g(p)),
nw AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nw USING (doc_id) LEFT JOIN it USING (doc_id)
"""
