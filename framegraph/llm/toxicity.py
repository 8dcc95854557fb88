"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

Labelled documents get a severity grade: 0 where they are labelled clean, else 1 to 3 by how densely (in thirds of
the toxic documents) they hold features that the labels bind to toxicity. One weight vector is shared by the three
thresholds: P(grade >= k) = sigmoid(w.x - theta_k) with rising theta. The result is the expected severity, the sum of
the three probabilities; a document is rejected where P(grade >= 1) reaches the cut found on the training rows.

Features are words (letters of any script, lower-cased) and their beginnings, hashed; a fixed-size sample of labelled
rows selects those that differ between the labels, so noise words carry no weight however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTERS, Words, id_and_text, materialize, mix, slices, small_batches, table

#: Labelled rows to learn from, at most: those with the smallest hashes of their doc_id.
SAMPLE = 12_000
BITS, PREFIXES = 22, (4, 5, 6, 7, 8)
#: A feature that a text holds so often counts as another feature too.
OFTEN = (2, 3, 5)
GRADES = 3
#: Features that are kept, at most, and how far from chance their label counts must be (in standard deviations).
SELECTED, APART = 4096, 4.0


class Features:
    """Distinct hashed features of each text: `ids[first[i]:first[i + 1]]`, and how often each occurs."""

    def __init__(self, texts: pa.Array):
        w = Words(texts, LETTERS, lower=True)
        length, owner = w.ends - w.starts, w.owner()
        parts, owners = [w.hash], [owner]
        for k in PREFIXES:
            longer = np.flatnonzero(length > k)
            parts.append(mix(w.span(w.starts[longer], w.starts[longer] + k) ^ np.uint64(k)))
            owners.append(owner[longer])
        ids = (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)
        key, times = np.unique(np.concatenate(owners) << BITS | ids, return_counts=True)
        low = (1 << BITS) - 1
        more = [(np.flatnonzero(times >= k), k) for k in OFTEN]
        again = [key[at] & ~low | (mix((key[at] & low).astype(np.uint64) * np.uint64(64) + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64) for at, k in more]
        key, times = np.concatenate([key, *again]), np.concatenate([times, *(np.zeros(len(at), times.dtype) for at, _ in more)])
        order = np.argsort(key, kind="stable")
        key, self.times = key[order], times[order]
        self.ids = (key & low).astype(np.int32)
        self.owner = key >> BITS
        self.first = np.searchsorted(self.owner, np.arange(w.texts + 1))
        self.words = w.counts()


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, y) of the sampled labelled rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).dropna()
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return id_and_text(docs).join(F.broadcast(known), "doc_id")  # at most `sample` rows of 12 bytes


class Model:
    """Selected features with shared weights, and the thresholds."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, theta: np.ndarray, cut: float):
        self.ids, self.weights, self.theta, self.cut = ids, weights, theta, cut

    def at_least(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1.., one row per text."""
        f = Features(texts)
        at = np.searchsorted(self.ids, f.ids)
        at[at == len(self.ids)] = 0
        hit = np.flatnonzero(self.ids[at] == f.ids) if len(self.ids) else np.zeros(0, int)
        x = np.bincount(f.owner[hit], weights=self.weights[at[hit]], minlength=len(f.words))
        return 1 / (1 + np.exp(np.clip(self.theta - x[:, None], -50, 50)))


def _fit_ordinal(rows: list[np.ndarray], grade: np.ndarray, n: int, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the mean negative log-likelihood of the cumulative-link model with a small L2 penalty."""
    at, lens = np.concatenate(rows) if rows else np.zeros(0, int), np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), lens)
    p = np.concatenate([np.zeros(n), [1.0], np.zeros(GRADES - 1)])  # weights, first threshold, log steps to the next
    m, s = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        steps_up = np.exp(p[n + 1 :])
        theta = p[n] + np.concatenate([[0.0], np.cumsum(steps_up)])
        x = np.bincount(owner, weights=p[at], minlength=len(rows))
        q = 1 / (1 + np.exp(np.clip(theta - x[:, None], -50, 50)))  # P(grade >= k + 1)
        full = np.concatenate([np.ones((len(rows), 1)), q, np.zeros((len(rows), 1))], 1)
        i = np.arange(len(rows))
        own = np.maximum(full[i, grade] - full[i, grade + 1], 1e-9)
        slope = full * (1 - full)
        d_hi, d_lo = -slope[i, grade] / own, slope[i, grade + 1] / own  # d loss / d (x - theta) of both bounds
        dx = d_hi + d_lo
        g = np.zeros_like(p)
        g[:n] = np.bincount(at, weights=dx[owner], minlength=n)[:n] / len(rows) + 1e-4 * p[:n]
        dtheta = np.zeros(GRADES + 2)
        np.add.at(dtheta, grade, -d_hi)
        np.add.at(dtheta, grade + 1, -d_lo)
        dtheta = dtheta[1:-1] / len(rows)
        g[n] = dtheta.sum()
        g[n + 1 :] = np.cumsum(dtheta[::-1])[::-1][1:] * steps_up
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        p -= 0.1 * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    return p[:n], p[n] + np.concatenate([[0.0], np.cumsum(np.exp(p[n + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from at most `sample` labelled rows; without rows of both labels, one that rejects nothing.

    Rows without a label or an id are left out; of a doc_id's labels the largest counts. Equal probabilities are never
    parted by the cut.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            f = Features(batch.column("text"))
            got = [f.ids[s:e].tobytes() for s, e in zip(f.first[:-1], f.first[1:], strict=True)]
            times = [f.times[s:e].astype(np.int32).tobytes() for s, e in zip(f.first[:-1], f.first[1:], strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(f.words), pa.array(got, pa.binary()), pa.array(times, pa.binary())], names=["doc_id", "y", "words", "ids", "times"])

    gathered = _labelled(docs, labels, sample).mapInArrow(gather, "doc_id long, y int, words long, ids binary, times binary")

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for y, ids in zip(batch.column("y").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                both[int(y > 0)][np.frombuffer(ids, np.int32)] += 1
        met = np.flatnonzero(both.sum(0))
        yield pa.record_batch([pa.array(met), pa.array(both[0][met].astype(np.int64)), pa.array(both[1][met].astype(np.int64))], names=["id", "clean", "toxic"])

    gathered = materialize(gathered)
    sizes = {r["y"]: r["n"] for r in gathered.groupBy(F.least("y", F.lit(1)).alias("y")).agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.arange(1.0, GRADES + 1) * 50, 0.5)
    rate = toxic / (clean + toxic)
    n = F.col("clean") + F.col("toxic")
    apart = (F.col("toxic") - F.lit(rate) * n) / F.sqrt(F.lit(rate * (1 - rate)) * n)
    chosen = gathered.mapInArrow(unroll, "id long, clean long, toxic long").groupBy("id").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    chosen = chosen.where(n >= 3).withColumn("apart", apart).where(F.abs("apart") >= APART).orderBy(F.abs("apart").desc(), "id").limit(SELECTED).collect()
    ids = np.array(sorted(r["id"] for r in chosen), np.int64)
    strong = np.array(sorted(r["id"] for r in chosen if r["apart"] > 0), np.int64)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dense = [], []
            for words, a, b in zip(*(batch.column(c).to_pylist() for c in ("words", "ids", "times")), strict=True):
                a, b = np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)
                out.append(np.searchsorted(ids, a[np.isin(a, ids)]).astype(np.int32))
                dense.append(float(b[np.isin(a, strong)].sum() / max(words, 1)))
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(out, pa.list_(pa.int32())), pa.array(dense)], names=["doc_id", "y", "x", "dense"])

    rows = gathered.mapInArrow(select, "doc_id long, y int, x array<int>, dense double").orderBy("doc_id").collect()
    y, dense = np.array([r["y"] > 0 for r in rows]), np.array([r["dense"] for r in rows])
    bounds = np.quantile(dense[y], [1 / 3, 2 / 3])
    grade = np.where(y, 1 + np.searchsorted(bounds, dense, "left"), 0)
    x = [np.array(r["x"], np.int64) for r in rows]
    weights, theta = _fit_ordinal(x, grade, max(len(ids), 1))
    weights = weights[: len(ids)]
    model = Model(ids, weights, theta, 0.5)
    p = 1 / (1 + np.exp(np.clip(theta[0] - np.array([weights[k].sum() for k in x]), -50, 50)))
    # the cut with the best F1 on the training rows, midway between neighbouring probabilities
    order = np.argsort(-p)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = 0
    k = int(f1.argmax())
    model.cut = float((p[order][k] + (p[order][k + 1] if k + 1 < len(p) else 0)) / 2)
    return model


_SCORES = "p_toxic double, severity double, toxic boolean"


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id with p_toxic = P(grade >= 1), severity (expected grade, 0 to 3) and toxic (p_toxic at the cut or above).

    Null and empty texts have no features: the severity that the thresholds alone give. Texts of any length are read whole,
    each feature counts once however often it occurs; repeated rows are scored each; an empty table gives no rows. Further
    columns of any name are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = shared.value.at_least(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(p[:, 0]), pa.array(p.sum(1)), pa.array(p[:, 0] >= shared.value.cut)], names=["doc_id", "p_toxic", "severity", "toxic"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, " + _SCORES)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the documents that the model calls toxic.

    Rows are judged by their own text, whatever their other columns hold or are called; null and empty texts are judged by
    the thresholds alone. Without labels of both kinds, or for an empty table, nothing is rejected.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at).fill_null("")
            for part in slices(iter([pa.record_batch([text, pa.array(range(batch.num_rows))], names=["text", "k"])])):
                keep = shared.value.at_least(part.column("text"))[:, 0] < shared.value.cut
                yield batch.slice(part.column("k")[0].as_py(), part.num_rows).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity(docs, fit(docs, table(spark, sf_dir, "labels")))
