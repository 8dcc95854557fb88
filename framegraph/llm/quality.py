"""Quality scores by a convolutional network over bytes, in numpy.

A text is cut into overlapping chunks of bytes that cover all of it. Learned filters, eight bytes wide and four
apart, run over the bytes' embeddings; each filter's largest response in a chunk goes into a small dense layer
that rates the chunk; the document's probability combines the mean and the largest and smallest chunk ratings.
Only bytes of the text enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, in_fold, slices, table

CHUNK, HOP = 512, 448
EMBED, FILTERS, DENSE, WIDTH = 8, 32, 24, 4
#: Labelled rows to learn from, at most (half of them of each label where there are enough); their texts are used whole.
SAMPLE = 3000
#: Gradient steps, texts of a step, and chunks that go through the network at a time.
STEPS, BATCH, PART = 500, 24, 512


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts (rows of CHUNK bytes, zeros after the end) and the text each belongs to."""
    rows, owner = [], []
    for k, text in enumerate(texts):
        n = max(1, -(-(len(text) - (CHUNK - HOP)) // HOP))
        for s in range(0, n * HOP, HOP):
            part = text[s : s + CHUNK]
            rows.append(part if len(part) == CHUNK else part.ljust(CHUNK, b"\0"))
            owner.append(k)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, CHUNK), np.array(owner)


def initial() -> dict[str, np.ndarray]:
    rng, f = np.random.default_rng(3), np.float32
    fan = 2 * WIDTH * EMBED
    return {
        "E": rng.normal(0, 0.5, (256, EMBED)).astype(f), "W0": rng.normal(0, fan**-0.5, (WIDTH * EMBED, FILTERS)).astype(f), "W1": rng.normal(0, fan**-0.5, (WIDTH * EMBED, FILTERS)).astype(f),
        "b": np.zeros(FILTERS, f), "D": rng.normal(0, FILTERS**-0.5, (FILTERS, DENSE)).astype(f), "d": np.zeros(DENSE, f),
        "o": rng.normal(0, DENSE**-0.5, (DENSE, 1)).astype(f), "v": np.array([1.0, 0.3, 0.3, 0.0], f),
    }


def _rate(w: dict, data: np.ndarray):
    """What the network makes of chunks on the way to their ratings, ratings last."""
    x = w["E"][data].reshape(len(data), CHUNK // WIDTH, WIDTH * EMBED)
    a = x @ w["W0"]
    a[:, :-1] += (x @ w["W1"])[:, 1:]
    top = a.argmax(1)
    pooled = np.take_along_axis(a, top[:, None], 1)[:, 0] + w["b"]
    hidden = np.maximum(pooled @ w["D"] + w["d"], 0)
    return x, top, pooled, hidden, (hidden @ w["o"])[:, 0]


def _logits(w: dict, rating: np.ndarray, owner: np.ndarray, texts: int):
    """Logit of each text from its chunks' ratings: their mean, largest and smallest."""
    first, n = np.searchsorted(owner, np.arange(texts)), np.bincount(owner, minlength=texts)
    mean, high, low = np.add.reduceat(rating, first) / n, np.maximum.reduceat(rating, first), np.minimum.reduceat(rating, first)
    return n, mean, high, low, w["v"][0] * mean + w["v"][1] * high + w["v"][2] * low + w["v"][3]


def _ratings(w: dict, data: np.ndarray) -> np.ndarray:
    return np.concatenate([_rate(w, data[s : s + PART])[-1] for s in range(0, len(data), PART)])


def probability(w: dict, texts: list[bytes]) -> np.ndarray:
    out, k = np.empty(len(texts)), 0
    while k < len(texts):  # about 1 MB at once; one longer text makes a turn of its own, in parts
        e, size = k, 0
        while e < len(texts) and (e == k or size + len(texts[e]) < 1 << 20):
            size += len(texts[e])
            e += 1
        data, owner = chunks(texts[k:e])
        logit = _logits(w, _ratings(w, data), owner, e - k)[-1]
        out[k:e] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        k = e
    return out


def loss(w: dict, data: np.ndarray, owner: np.ndarray, y: np.ndarray) -> float:
    z = _logits(w, _ratings(w, data), owner, len(y))[-1]
    return float((np.log1p(np.exp(z)) - y * z).mean())


def _gradients(w: dict, data: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Gradients of the weighted mean loss over all chunks: ratings first, then back through the network, both in parts."""
    rating = _ratings(w, data)
    n, mean, high, low, logit = _logits(w, rating, owner, len(y))
    dl = ((1 / (1 + np.exp(-logit)) - y) * weight / weight.sum()).astype(w["v"].dtype)
    dr = w["v"][0] * (dl / n)[owner]
    for v, best in ((w["v"][1], high), (w["v"][2], low)):
        at = rating == best[owner]
        dr = dr + np.where(at, v * dl[owner] / np.bincount(owner, weights=at)[owner], 0)
    g = {k: np.zeros_like(a) for k, a in w.items()}
    g["v"][:] = dl @ mean, dl @ high, dl @ low, dl.sum()
    for s in range(0, len(data), PART):
        _back(w, data[s : s + PART], dr[s : s + PART, None].astype(dl.dtype), g)
    return g


def _back(w: dict, data: np.ndarray, dr: np.ndarray, g: dict) -> None:
    """Adds the gradients that the ratings of these chunks bring."""
    x, top, pooled, hidden, _ = _rate(w, data)
    g["o"] += hidden.T @ dr
    dh = (dr @ w["o"].T) * (hidden > 0)
    g["D"] += pooled.T @ dh
    g["d"] += dh.sum(0)
    dp = dh @ w["D"].T
    g["b"] += dp.sum(0)
    rows = np.arange(len(data))[:, None]
    left = x[rows, top]  # (chunks, filters, WIDTH * EMBED)
    last = top == x.shape[1] - 1
    right = np.where(last[..., None], 0, x[rows, np.minimum(top + 1, x.shape[1] - 1)])
    g["W0"] += np.einsum("cfk,cf->kf", left, dp, optimize=True)
    g["W1"] += np.einsum("cfk,cf->kf", right, dp, optimize=True)
    for part, kernel, live in ((0, w["W0"], np.ones_like(last)), (1, w["W1"], ~last)):
        dx = (dp * live)[..., None] * kernel.T[None]
        at = (np.minimum(top + part, x.shape[1] - 1) * WIDTH)[..., None] + np.arange(WIDTH)
        np.add.at(g["E"], data[rows[..., None], at].ravel(), dx.reshape(-1, EMBED))


def fit(texts: list[bytes], y: np.ndarray, steps: int = STEPS) -> dict:
    """Adam on the logistic loss, both labels with equal weight in all."""
    w, rng = initial(), np.random.default_rng(11)
    m, s = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    both = [np.flatnonzero(y == k) for k in (0, 1)]
    if not len(both[0]) or not len(both[1]):
        w["v"][:] = [0, 0, 0, 2.0 if len(both[1]) else -2.0 if len(both[0]) else 0.0]
        return w
    mean = {k: a.astype(np.float64) for k, a in w.items()}
    for t in range(1, steps + 1):
        pick, times = np.unique(np.concatenate([rng.choice(k, BATCH // 2) for k in both]), return_counts=True)
        g = _gradients(w, *chunks([texts[k] for k in pick]), y[pick].astype(np.float32), times.astype(np.float32))
        for k, grad in g.items():
            m[k] += 0.1 * (grad - m[k])
            s[k] += 0.01 * (grad * grad - s[k])
            w[k] -= (0.006 * (1 - 0.9 * t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
            mean[k] += 0.05 * (w[k] - mean[k])
    return {k: a.astype(np.float32) for k, a in mean.items()}


def train(docs: DataFrame, labels: DataFrame, usable, sample: int = SAMPLE, steps: int = STEPS) -> dict:
    """The network from at most `sample` labelled rows (smallest hashes of doc_id of each label) where `usable` holds.

    Their texts are used whole, so that learning and scoring combine the same chunks. Without rows of both labels the
    network gives one probability to all texts. Rows without a label or an id are left out; of a doc_id's labels the
    largest counts, and each row that has the doc_id is learned from.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).dropna().where(usable)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    each = [known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for k in (0, 1)]
    rows = id_and_text(docs).join(F.broadcast(each[0].unionByName(each[1])), "doc_id")  # at most `sample` rows of 12 bytes
    found = rows.select("doc_id", "text", "y").orderBy("doc_id", "text").limit(sample).collect()  # `sample` texts
    return fit([r["text"].encode() for r in found], np.array([r["y"] for r in found], np.int64), steps)


def score(docs: DataFrame, weights: dict) -> DataFrame:
    """(doc_id, score): the probability of label 1 from the whole text, however long.

    Null and empty texts are one chunk of zeros. Repeated rows are scored each, an empty table gives no rows; further
    columns of any name are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = probability(shared.value, batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.record_batch([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), in_fold(F.col("doc_id"), 3, 1)
    scored = score(docs, train(docs, table(spark, sf_dir, "labels"), ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
