"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A document is the set of its runs of five words (lower-cased, letters and digits), each of weight 1
however often it occurs, so that what is banded is what a link is defined by: the Jaccard similarity of the sets.
Every shingle sends arrivals of a Poisson process, whose rate is its weight, to random registers; a register
keeps the shingle that arrives first, so two documents agree in a register with the probability Jaccard of their
weighted sets. A shingle stops once its next arrival comes after the latest of the document's registers.

Documents with equal shingle sets make one class at once. Classes that agree in a whole band of registers are
candidates. The members of a bucket are verified against one leader, the one that shares most buckets with others;
where some have no link with it, all are verified against a few leaders of those. Only members that are still not in one
component meet the bucket's others in tiles of bounded size, each of which gives a spanning forest of the links it
finds, never all pairs. A link is a Jaccard similarity of the shingle sets of at
least 0.8, computed on the sets of 64-bit shingles themselves; classes are the connected components of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Words, id_and_text, if_small, materialize, mix, runs, slices, table, text_marks, without
from .graph import components

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 a pair misses all bands with probability (1 - 0.8^4)^16, about 2 in 10,000.
BANDS, ROWS = 16, 4
#: Documents, and bytes of shingles, on either side of a tile.
TILE, TILE_BYTES = 512, 16 << 20
#: Leaders of a bucket that one leader leaves open, before tiles.
LEADERS = 4


class Shingles:
    """Distinct shingles of each text: 64-bit ids, ascending within `first[i]:first[i + 1]`.

    A text of fewer words than a shingle has, but not none, is one shingle; a text without words has none.
    """

    def __init__(self, texts: pa.Array):
        w = Words(texts, ALNUM, lower=True)
        owner = w.owner()
        ids, at = runs(w.hash, owner, SHINGLE)
        own = owner[at]
        short = np.flatnonzero((w.counts() > 0) & (w.counts() < SHINGLE))
        whole = [mix(np.bitwise_xor.reduce(mix(w.hash[w.first[k] : w.first[k + 1]] + np.arange(w.first[k + 1] - w.first[k], dtype=np.uint64)), keepdims=True)) for k in short]
        where = np.searchsorted(own, short)
        ids, own = np.insert(ids, where, np.concatenate(whole) if whole else ids[:0]), np.insert(own, where, short)
        for s, e in zip(*(x.tolist() for x in _ranges(own, w.texts)), strict=True):
            ids[s:e].sort()
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (own[1:] != own[:-1])
        self.ids, self.owner, self.texts = ids[new], own[new], w.texts
        self.first = np.searchsorted(self.owner, np.arange(w.texts + 1))

    def names(self) -> list[np.ndarray]:
        """A 128-bit name of each text's set of shingles, in two halves."""
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.ids + np.uint64(seed)))]) for seed in (0x1234567, 0x89ABCDE)]
        return [(x[self.first[1:]] - x[self.first[:-1]]).view(np.int64) for x in sums]


def _ranges(owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.searchsorted(owner, np.arange(texts + 1))
    return first[:-1], first[1:]


def prob_min_hash(ids: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """Per text and register the shingle that arrives first (0 in texts without shingles)."""
    time = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    live, arrived, turn = np.arange(len(ids)), np.zeros(len(ids)), 0
    while len(live):
        turn += 1
        draw = mix(ids[live] + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        arrived[live] -= np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weights[live]
        cell = owner[live] * registers + (mix(draw ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
        x = arrived[live]
        np.minimum.at(time, cell, x)
        first = x == time[cell]
        winner[cell[first]] = ids[live[first]]
        docs = np.unique(owner[live])
        latest = np.full(texts, -1.0)
        latest[docs] = time.reshape(texts, registers)[docs].max(1)
        live = live[x < latest[owner[live]]]
    return winner.reshape(texts, registers)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        s = Shingles(batch.column("text"))
        won = prob_min_hash(s.ids, np.ones(len(s.ids)), s.owner, s.texts, BANDS * ROWS).reshape(s.texts, BANDS, ROWS)
        band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (s.texts, BANDS))
        for k in range(ROWS):
            band = mix(band * np.uint64(0x9E3779B97F4A7C15) + won[:, :, k])
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, s.texts * BANDS + 1, BANDS), pa.int32()), pa.array(np.ascontiguousarray(band).view(np.int64).ravel()))
        keys = ["row", "doc_id", "m1", "m2"]
        yield pa.record_batch([*(batch.column(c) for c in keys), pa.array(np.diff(s.first)), *(pa.array(x) for x in s.names()), bands], names=[*keys, "n", "k1", "k2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        s = Shingles(batch.column("text"))
        sets = pa.array([s.ids[a:b].tobytes() for a, b in zip(s.first[:-1], s.first[1:], strict=True)], pa.binary())
        yield pa.record_batch([*(pa.array(x) for x in s.names()), sets], names=["k1", "k2", "shingles"])


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if not len(large) or len(small) < SIMILARITY * len(large):
        return 0.0
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    same = int((large[at] == small).sum())
    return same / (len(a) + len(b) - same)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
        keep = [_jaccard(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) >= SIMILARITY for p, q in zip(x, y, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links of members on the left with members on the right: at most one link fewer than
    there are components among them. Components known before are joined from the start."""
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    names, place = np.unique(np.concatenate([left["component"], right["component"]]).astype(np.int64), return_inverse=True)
    root = np.arange(len(names))  # of every component, kept flat

    sets = [np.frombuffer(x, np.uint64) for x in right["shingles"]]
    sizes = np.array([len(x) for x in sets], np.int64)
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    ids, mine, theirs = right["rep"].to_numpy(np.int64), place[: len(left)], place[len(left) :]
    out = []
    for rep, comp, data in zip(left["rep"], mine, left["shingles"], strict=True):
        own = np.frombuffer(data, np.uint64)
        lo, hi = np.searchsorted(elements, own, "left"), np.searchsorted(elements, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        same = np.bincount(owner[at], minlength=len(sets))
        linked = np.flatnonzero((same >= SIMILARITY * (len(own) + sizes - same)) & (sizes > 0))
        others, first = np.unique(root[theirs[linked]], return_index=True)
        for other, k in zip(others, first, strict=True):
            if root[comp] != other:
                out.append((rep, int(ids[linked[k]])))
                root[root == other] = root[comp]
    return pd.DataFrame(out, columns=["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are similar enough."""
    with_b = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    with_both = with_b.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
    return materialize(with_both.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"))


def _led(members: DataFrame, candidate: Column, count: int) -> DataFrame:
    """(key, lead): up to `count` leaders of each bucket among the candidates: the one that shares most buckets with
    others, and further ones by hash."""
    one = F.struct("rep", "n")
    by_hash = [F.max_by(F.when(candidate, one), F.when(candidate, F.xxhash64("rep", F.lit(k)))) for k in range(1, count)]
    first = F.max_by(F.when(candidate, one), F.when(candidate, F.struct("weight", F.negative("rep"))))
    leads = F.array_distinct(F.array(first, *by_hash))
    return materialize(members.groupBy("key").agg(leads.alias("leads")).select("key", F.explode("leads").alias("lead")).where("lead is not null"))


def _compared(members: DataFrame, leaders: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of members with the leaders of their buckets: rows as members, times leaders of a bucket."""
    met = members.join(leaders, "key").where(F.col("rep") != F.col("lead.rep"))
    near = met.where((F.col("n") >= SIMILARITY * F.col("lead.n")) & (F.col("lead.n") >= SIMILARITY * F.col("n")))
    return _verified(near.select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b")).distinct(), sets)


def linked_sets(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(v, component) of all sets that have a link with another one of their bucket.

    members: key (of the bucket), rep (of the set), n (its size), in buckets of two or more. sets: rep, shingles.

    All pairs of a bucket are decided: verified, or in one component through others. First all members meet one leader;
    in buckets where some have no link with it, all meet LEADERS of those. Leaders are done then, and so are buckets
    whose other members are all in one component. Tiles compare what is still open: a row is copied once per TILE rows
    of the other side, and tiles give fewer links than they hold members.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    weight = members.join(sizes, "key").groupBy("rep").agg(F.sum("size").alias("weight"))
    members = materialize(members.join(weight, "rep").select("key", "rep", "n", "weight"))
    leaders = _led(members, F.lit(True), 1)
    links = _compared(members, leaders, sets)
    rest = members.join(leaders, "key").where(F.col("rep") != F.col("lead.rep")).withColumn("a", F.least("rep", "lead.rep")).withColumn("b", F.greatest("rep", "lead.rep"))
    rest = materialize(rest.join(links.withColumn("linked", F.lit(True)), ["a", "b"], "left").select("key", "rep", "n", "weight", F.col("linked").isNull().alias("outside")))
    open_ = rest.groupBy("key").agg(F.count_if("outside").alias("outside"), F.count("*").alias("size")).where("outside > 0 and size > 1").select("key")
    rest = materialize(rest.join(open_, "key"))
    if rest.isEmpty():
        return components(links)
    more = _led(rest, F.col("outside"), LEADERS)
    links = links.unionByName(_compared(rest.drop("outside"), more, sets))
    found = components(links)
    # leaders have met all of their bucket and go; what is in one component needs no comparison
    rest = rest.join(more.select("key", F.col("lead.rep").alias("rep")), ["key", "rep"], "left_anti")
    rest = rest.join(found.select(F.col("v").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rest = materialize(rest.select("key", "rep", "n", "weight", "component"))
    main = F.max_by("component", F.struct("weight", "rep"))
    open_ = rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), main.alias("main")).where("lo != hi").select("key", "main")
    left = materialize(rest.join(open_, "key").withColumn("outside", F.col("component") != F.col("main")).drop("main", "weight"))
    if left.isEmpty():
        return found
    totals = left.groupBy("key").agg(*(F.ceil(F.greatest(F.count_if(c) / TILE, F.sum(F.when(c, F.col("n"))) * 8 / TILE_BYTES)).cast("int").alias(k) for k, c in (("i_parts", F.col("outside")), ("j_parts", F.lit(True)))))
    dealt = left.join(materialize(totals.where("i_parts > 0")), "key")
    chunk = lambda parts: F.pmod(F.xxhash64("rep"), F.col(parts)).cast("int")
    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    rows = dealt.where("outside").select("key", chunk("i_parts").alias("i"), spread("j_parts").alias("j"), F.lit(0).alias("side"), "rep", "component")
    columns = dealt.select("key", spread("i_parts").alias("i"), chunk("j_parts").alias("j"), F.lit(1).alias("side"), "rep", "component")
    tiles = rows.unionByName(columns).join(sets, "rep")
    return components(links.unionByName(materialize(tiles.groupBy("key", "i", "j").applyInPandas(_tile, "a long, b long"))))


def _classed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, m1, m2, component, class_id) of every row of docs, doc_id and text marks as in `without`.

    Rows are told apart by `row`, written once with what is read from the text; sets of shingles go by the first row
    that has them, and component is the first row of a class (null for rows without words).
    """
    m1, m2 = text_marks(F.col("text"))
    rows = id_and_text(docs).withColumn("m1", m1).withColumn("m2", m2)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    signed = materialize(numbered.mapInArrow(_sign, "row long, doc_id long, m1 long, m2 long, n long, k1 long, k2 long, bands array<long>"))
    worded = signed.where("n > 0")
    # written, so that both sides of the joins below are dealt anew and a hot key can be split
    classes = materialize(worded.groupBy("k1", "k2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"), F.bool_or(F.col("doc_id").isNull()).alias("no_id")))
    reps = worded.join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    cells = reps.select(F.col("row").alias("rep"), "n", F.explode("bands").alias("key"))
    buckets = materialize(cells.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    members = materialize(cells.join(buckets.select("key"), "key"))
    wanted = members.select(F.col("rep").alias("row")).distinct()
    wanted = materialize(worded.select("row", "doc_id", "m1", "m2", "k1", "k2").join(wanted, "row"))
    # the wanted rows and those equal to them in doc_id and text, whose sets are the same
    keys = if_small(wanted.select(F.col("doc_id").alias("w_id"), F.col("m1").alias("w1"), F.col("m2").alias("w2")))
    texts = rows.join(keys, rows["doc_id"].eqNullSafe(keys["w_id"]) & (rows["m1"] == keys["w1"]) & (rows["m2"] == keys["w2"]), "left_semi")
    texts = texts.select("text").mapInArrow(_sets, "k1 long, k2 long, shingles binary").dropDuplicates(["k1", "k2"])
    sets = materialize(texts.join(wanted.select("k1", "k2", "row"), ["k1", "k2"]).select(F.col("row").alias("rep"), "shingles"))
    found = linked_sets(members, sets)
    # the smallest doc_id of each component, a null one before all others
    found = found.withColumnRenamed("v", "rep")
    joined = found.join(classes, "rep").groupBy("component").agg(F.min("least").alias("c_least"), F.bool_or("no_id").alias("c_no_id"))
    named = classes.join(found.join(materialize(joined), "component"), "rep", "left").select(
        "k1",
        "k2",
        F.coalesce("component", "rep").alias("component"),
        F.when(~F.coalesce("c_no_id", "no_id"), F.coalesce("c_least", "least")).alias("class_id"),
    )
    out = worded.select("row", "doc_id", "m1", "m2", "k1", "k2").join(materialize(named), ["k1", "k2"]).drop("k1", "k2")
    return out.unionByName(signed.where("n = 0").select("row", "doc_id", "m1", "m2", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("class_id")))


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and class_id, the smallest doc_id of its class of near duplicates.

    Documents without words (null or empty text too) are alone in their class, as are all that have no link.
    Repeated rows share a class; different texts under one doc_id, or with a null one, are different documents,
    though their classes may go by the same id. A null doc_id counts as the smallest. Texts of any length are read whole,
    a similarity of exactly 0.8 is a link, an empty table gives no rows; further columns of any name are not looked at.
    """
    return _classed(docs).select("doc_id", "class_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one document (the smallest doc_id) of each class of near duplicates.

    Texts that are not near duplicates all stay, whatever their doc_ids. Of rows equal in doc_id and text one stays. Null
    and empty texts have no words and no copies, but as rows equal in doc_id and text. An empty table gives no rows.
    """
    classed = materialize(_classed(docs))
    head = F.col("doc_id").eqNullSafe(F.col("class_id"))
    gone = classed.where(~head)
    # classes in which several rows have the smallest doc_id: the first row's text stays
    heads = classed.where(head & F.col("component").isNotNull())
    several = materialize(heads.groupBy("component").agg(F.min("row").alias("stay"), F.count("*").alias("n")).where("n > 1"))
    if not several.isEmpty():
        heads = heads.join(several, "component")
        stay = heads.where("row = stay").select("component", F.col("m1").alias("s1"), F.col("m2").alias("s2"))
        gone = gone.unionByName(heads.join(stay, "component").where("m1 != s1 or m2 != s2").select(gone.columns))
    repeated = not classed.groupBy("doc_id", "m1", "m2").count().where("count > 1").limit(1).isEmpty()
    return without(docs, gone, once=repeated)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
