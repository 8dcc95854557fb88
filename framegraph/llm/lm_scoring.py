"""Scoring of documents by a gated recurrent language model with a class-factored output.

Every training token is counted; the counts give the base score, the open vocabulary and the units of the model.
A unit is one of the most frequent words, the end of a text, a repetition of the word before, or a bucket of
rarer words with the same ending. With h the state of a gated recurrent unit after the tokens so far,

    P(word | h) = P(class | h) * P(unit | class, h) * P(word | unit)

where classes cut the units by frequency and P(word | unit) is 1 for a frequent word and the add-one estimate
from counts inside a bucket, which holds a share for words never seen. So all words have a probability and the
sum over all is at most one.

Texts are tokenised twice: to count, and to write each document's units, from which both training and scoring read.
Training is data-parallel and goes once through every token of every training document: documents are cut into
consecutive spans, spans are dealt by a hash of document and place to shards of a fixed number of tokens, and a task
runs truncated backpropagation over a shard (gradients stop at each window, the state goes on to the end of the span).
Shards of the first half of the spans start from the initial weights, those of the second half from the first half's
mean; means are weighted by tokens and taken in levels, so that no one gathers all of them. Neither shards nor their
order depend on how rows were dealt to tasks. Scoring carries the state from window to window through each whole document.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, Words, id_and_text, in_fold, materialize, mix, pooled, slices, table

#: Units that are single words, buckets of rarer words by ending, classes of units.
HEAD, BUCKETS, CLASSES = 1500, 256, 40
#: Words whose counts every task holds (16 bytes each): a bound on what is broadcast.
KNOWN = 400_000
EMBED, HIDDEN = 24, 32
#: Tokens of a gradient window and of a training span at most, spans side by side at most, and tokens of a shard.
BPTT, SPAN, LANES, SHARD_TOKENS = 24, 1024, 512, 2_000_000
#: Tasks that shards are dealt to, at most.
TASKS = 10_000
#: Learning rates of the turns, each of which takes its share of the spans; models that are averaged at a time.
RATES, FAN_IN = (0.01, 0.004), 64
#: Fewest gradient steps of a shard: a small table has fewer lanes, or is gone through again.
LEAST_STEPS = 160
#: Bits of a hash that find a known word at once.
SLOT_BITS = 21
#: Texts' bytes whose units are found, and bytes of units that are scored, side by side.
POOL = 8 << 20, 6 << 20
END_HASH = np.uint64(0x6A09E667F3BCC909)
END, REPEAT = 0, 1


class Tokens:
    """Tokens of texts: lower-cased words (not white space) and an end each, as hashes; buckets by the last bytes."""

    @staticmethod
    def of_batch(batch: pa.RecordBatch) -> Tokens:
        """Of a large batch, found slice by slice."""
        parts = [Tokens(x.column("text")) for x in slices(iter([batch]))]
        out = Tokens.__new__(Tokens)
        out.hash, out.bucket, out.counts = (np.concatenate([getattr(x, k) for x in parts]) for k in ("hash", "bucket", "counts"))
        out.first = np.concatenate([[0], np.cumsum(out.counts)])
        return out

    def __init__(self, texts: pa.Array):
        w = Words(texts, WHITE, lower=True)
        n = w.counts()
        self.counts = n + 1
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        place = np.arange(len(w.hash)) + w.owner()
        self.hash = np.full(self.first[-1], END_HASH, np.uint64)
        self.hash[place] = w.hash
        self.bucket = np.zeros(self.first[-1], np.int32)
        self.bucket[place] = (w.span(np.maximum(w.starts, w.ends - 3), w.ends) % np.uint64(BUCKETS)).astype(np.int32)


class Vocabulary:
    """The most frequent words with their counts (sorted by hash), units and what the buckets hold."""

    def __init__(self, known: np.ndarray, counts: np.ndarray, total: int, distinct: int, in_bucket: np.ndarray, of_bucket: np.ndarray):
        """known/counts: by falling count; in_bucket, of_bucket: tokens and distinct words of each bucket, units left out."""
        self.total, self.distinct = total, distinct
        order = np.argsort(known)
        self.hash, self.count = known[order], counts[order]
        unit = np.full(len(known), -1, np.int32)
        rank = np.flatnonzero(known != END_HASH)[:HEAD]
        unit[rank] = 2 + BUCKETS + np.arange(len(rank))
        unit[known == END_HASH] = END
        self.unit = unit[order]
        self.units = 2 + BUCKETS + HEAD
        self.in_bucket, self.of_bucket = in_bucket, of_bucket
        # units by falling frequency, cut into classes of about equal sums of roots of frequencies
        weight = np.ones(self.units)
        weight[2 : 2 + BUCKETS] += in_bucket
        weight[self.unit[self.unit >= 0]] += self.count[self.unit >= 0]
        weight[REPEAT] += total // 100
        by = np.argsort(-weight, kind="stable")
        share = np.cumsum(np.sqrt(weight[by]))
        cls = np.minimum((share / share[-1] * CLASSES).astype(int), CLASSES - 1)
        _, cls = np.unique(cls, return_inverse=True)
        self.order = by  # units grouped by class
        self.first = np.searchsorted(cls, np.arange(CLASSES + 1))
        self.cls = np.empty(self.units, np.int32)
        self.cls[by] = cls
        self.place = np.empty(self.units, np.int64)
        self.place[by] = np.arange(self.units)
        self.log_weight = np.log(weight / weight.sum())

    @cached_property
    def _slots(self) -> tuple[np.ndarray, np.ndarray]:
        """For the low bits of a hash, the most frequent word with these bits, and whether there are more such words."""
        low = (self.hash & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
        slots = np.full(1 << SLOT_BITS, -1, np.int32)
        order = np.argsort(self.count, kind="stable")
        slots[low[order]] = order
        return slots, np.bincount(low, minlength=1 << SLOT_BITS) > 1

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes among the known words, -1 for others."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        slots, crowded = self._slots
        low = (hashes & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
        at = slots[low]
        at[self.hash[at] != hashes] = -1
        rest = np.flatnonzero((at < 0) & crowded[low])
        k = np.searchsorted(self.hash, hashes[rest])
        k[k == len(self.hash)] = 0
        at[rest] = np.where(self.hash[k] == hashes[rest], k, -1)
        return at

    def look_up(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, known index or -1, log10 P(word | unit) as far as counts are at hand)."""
        at = self.index(tokens.hash)
        hit = at >= 0
        unit = np.where(hit, self.unit[at], -1) if len(self.hash) else np.full(len(at), -1)
        unit = np.where(unit < 0, 2 + tokens.bucket, unit).astype(np.int32)
        again = np.zeros(len(unit), bool)
        again[1:] = tokens.hash[1:] == tokens.hash[:-1]
        again[tokens.first[:-1]] = False
        inside = np.where((unit >= 2) & (unit < 2 + BUCKETS), -np.log10(self.in_bucket + self.of_bucket + 1.0)[np.clip(unit - 2, 0, BUCKETS - 1)], 0.0)
        inside += np.where(hit & (unit >= 2) & (unit < 2 + BUCKETS), np.log10((self.count[at] if len(self.hash) else 0) + 1.0), 0.0)
        inside[again] = 0.0
        unit[again] = REPEAT
        return unit, np.where(hit, at, -1), inside


def initial(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    u, f = vocabulary.units, np.float32
    bias = vocabulary.log_weight[vocabulary.order]
    cls = np.zeros(CLASSES, f)
    for c in range(CLASSES):
        s, e = vocabulary.first[c], vocabulary.first[c + 1]
        cls[c] = np.log(np.exp(bias[s:e]).sum() + 1e-12)
    return {
        "E": rng.normal(0, 0.3, (u, EMBED)).astype(f), "W": rng.normal(0, EMBED**-0.5, (EMBED, 3 * HIDDEN)).astype(f),
        "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)).astype(f), "b": np.zeros(3 * HIDDEN, f),
        "C": np.zeros((HIDDEN, CLASSES), f), "cb": cls, "D": np.zeros((HIDDEN, u), f), "db": bias.astype(f),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _step(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """One gated step; x holds the input's share of the gates. Returns the new state, z, r, candidate, h @ u of it."""
    n = HIDDEN
    g = h @ u
    zr = _sigmoid(x[:, : 2 * n] + g[:, : 2 * n])
    z, r = zr[:, :n], zr[:, n:]
    c = r * g[:, 2 * n :]
    c += x[:, 2 * n :]
    np.tanh(c, out=c)
    new = h - c
    new *= z
    new += c
    return new, z, r, c, g[:, 2 * n :]


def _bounds(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far from zero the inputs of a softmax can be, by output. States lie in [-1, 1]."""
    return np.abs(w).sum(0) + np.abs(b)


def _softmax(h: np.ndarray, w: np.ndarray, b: np.ndarray, own: np.ndarray, bound: float, all_: bool) -> tuple[np.ndarray, np.ndarray]:
    """(log P of `own` in each row, P of all if wanted) of a softmax layer. The bound tells whether exp may get too much."""
    p = h @ w
    p += b
    if bound > 80:
        p -= p.max(1, keepdims=True)
    logp = p[np.arange(len(own)), own]
    np.exp(p, out=p)
    total = p @ np.ones(p.shape[1], np.float32)
    if all_:
        p *= (1 / total)[:, None]
    return logp - np.log(total), p


def _outputs(w: dict, v: Vocabulary, hs: np.ndarray, units: np.ndarray, gradients: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log P(class) + log P(unit | class) at each state; with gradients, adds to them and returns d/d state."""
    n, learn = len(units), gradients is not None
    cls = v.cls[units]
    # states in the order of their classes: each class is a slice
    order = np.argsort(cls.astype(np.int8), kind="stable")
    hs, cls, place = hs[order], cls[order], v.place[units[order]]
    cut = np.searchsorted(cls, np.arange(CLASSES + 1))
    logp, p = _softmax(hs, w["C"], w["cb"], cls, float(_bounds(w["C"], w["cb"]).max()), learn)
    dh = None
    if learn:
        p[np.arange(n), cls] -= 1
        gradients["C"] += hs.T @ p
        gradients["cb"] += np.ones(n, np.float32) @ p
        dh = p @ w["C"].T
    bounds = _bounds(w["D"], w["db"])
    for c in np.flatnonzero(np.diff(cut)):
        k, s, e = slice(cut[c], cut[c + 1]), v.first[c], v.first[c + 1]
        if e - s == 1:
            continue
        h, own = hs[k], place[k] - s
        inner, p = _softmax(h, w["D"][:, s:e], w["db"][s:e], own, float(bounds[s:e].max()), learn)
        logp[k] += inner
        if learn:
            p[np.arange(len(own)), own] -= 1
            gradients["D"][:, s:e] += h.T @ p
            gradients["db"][s:e] += np.ones(len(own), np.float32) @ p
            dh[k] += p @ w["D"][:, s:e].T
    out = np.empty_like(logp)
    out[order] = logp
    if learn:
        back = np.empty_like(dh)
        back[order] = dh
        dh = back
    return out, dh


def _train_window(w: dict, v: Vocabulary, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None) -> tuple[dict, np.ndarray, float]:
    """Gradients of one window (time, lane); the state that enters counts as given. live: tokens that exist; fresh:
    where a span starts, from the empty state."""
    time, lanes = inputs.shape
    x_of = w["E"] @ w["W"] + w["b"]
    trace, states = [], np.empty((time, lanes, HIDDEN), np.float32)
    h = h.copy()
    for t in range(time):
        if fresh is not None:
            h[fresh[t]] = 0
        before = h
        h, z, r, c, gc = _step(np.take(x_of, inputs[t], 0), before, w["U"])
        trace.append((before, z, r, c, gc))
        states[t] = h
    g = {k: np.zeros_like(a) for k, a in w.items()}
    if live.all():
        logp, dh_out = _outputs(w, v, states.reshape(-1, HIDDEN), targets.ravel(), g)
    else:
        where = np.flatnonzero(live.ravel())
        logp, dstate = _outputs(w, v, states.reshape(-1, HIDDEN)[where], targets.ravel()[where], g)
        dh_out = np.zeros((time * lanes, HIDDEN), np.float32)
        dh_out[where] = dstate
    dh_out = dh_out.reshape(time, lanes, HIDDEN)
    n, back_u = HIDDEN, np.ascontiguousarray(w["U"].T)
    dx, dg = np.empty((time, lanes, 3 * HIDDEN), np.float32), np.empty((lanes, 3 * HIDDEN), np.float32)
    carry = np.zeros((lanes, HIDDEN), np.float32)
    for t in reversed(range(time)):
        before, z, r, c, gc = trace[t]
        d = dh_out[t]
        d += carry
        keep = 1 - z
        dc = d * keep
        dc *= 1 - c * c
        dz = before - c
        dz *= d
        dz *= z
        np.multiply(dz, keep, out=dg[:, :n])
        dr = dc * gc
        dr *= r
        np.multiply(dr, 1 - r, out=dg[:, n : 2 * n])
        dx[t, :, : 2 * n] = dg[:, : 2 * n]
        dx[t, :, 2 * n :] = dc
        np.multiply(dc, r, out=dg[:, 2 * n :])
        g["U"] += before.T @ dg
        carry = d
        carry *= z
        carry += dg @ back_u
        if fresh is not None:
            carry[fresh[t]] = 0
    # summed by unit first: all that follows is per unit, not per token
    ids = inputs.ravel().astype(np.int16)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.diff(ids, prepend=np.int16(-1)))
    sums, own = np.add.reduceat(np.take(dx.reshape(-1, 3 * HIDDEN), order, 0), starts), ids[starts]
    g["b"] += sums.sum(0)
    g["W"] += w["E"][own].T @ sums
    g["E"][own] = sums @ w["W"].T
    return g, h, float(logp.sum())


class _Lanes:
    """Spans (units, the one before the first in front) laid end to end in lanes of about equal length."""

    def __init__(self, spans: list[np.ndarray]):
        counts = np.array([len(x) - 1 for x in spans], np.int64)
        self.tokens = int(counts.sum())
        n = int(np.clip(self.tokens // (BPTT * LEAST_STEPS), 8, LANES))
        lanes = _dealt(counts, n)
        time = max(sum(int(counts[k]) for k in lane) for lane in lanes)
        time = -(-time // BPTT) * BPTT
        self.inputs, self.targets = np.zeros((time, n), np.int32), np.zeros((time, n), np.int32)
        self.live, self.fresh = np.zeros((time, n), bool), np.zeros((time, n), bool)
        for k, lane in enumerate(lanes):
            at = 0
            for i in lane:
                end = at + counts[i]
                self.inputs[at:end, k], self.targets[at:end, k] = spans[i][:-1], spans[i][1:]
                self.live[at:end, k], self.fresh[at, k] = True, True
                at = end


def _train(weights: dict, v: Vocabulary, lanes: _Lanes, rate: float) -> None:
    """Adam over all windows of a shard, in place."""
    m = {k: np.zeros_like(a) for k, a in weights.items()}
    s = {k: np.zeros_like(a) for k, a in weights.items()}
    windows = len(lanes.live) // BPTT
    steps = windows * max(1, -(-LEAST_STEPS // windows))
    h = np.zeros((lanes.live.shape[1], HIDDEN), np.float32)
    for done in range(1, steps + 1):
        start = (done - 1) % windows * BPTT
        at = slice(start, start + BPTT)
        open_ = np.flatnonzero(lanes.live[at].any(0))
        part = lambda x: x[at, open_]  # noqa: E731, B023
        g, h[open_], _ = _train_window(weights, v, part(lanes.inputs), part(lanes.targets), part(lanes.live), h[open_], part(lanes.fresh))
        scale, step = 1 / lanes.live[at].sum(), rate * (1 - 0.9 * (done - 1) / steps)
        for name, grad in g.items():
            grad *= scale
            m[name] += 0.1 * (grad - m[name])
            s[name] += 0.002 * (grad * grad - s[name])
            weights[name] -= step * (m[name] / (1 - 0.9**done)) / (np.sqrt(s[name] / (1 - 0.998**done)) + 1e-7)


def _pack(weights: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **weights)
    return out.getvalue()


def _unpack(data: bytes) -> dict:
    return {k: a.copy() for k, a in np.load(io.BytesIO(data)).items()}


def _average(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("shard")
    total = pdf["tokens"].sum()
    mean: dict = {}
    for data, n in zip(pdf["weights"], pdf["tokens"], strict=True):
        for k, a in _unpack(data).items():
            mean[k] = mean.get(k, 0) + a.astype(np.float64) * (n / total)
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0] // FAN_IN], "tokens": [total], "weights": [_pack({k: a.astype(np.float32) for k, a in mean.items()})]})


def token_counts(rows: DataFrame) -> DataFrame:
    """(hash, bucket, n): every token of rows and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged() -> tuple:
            h, b, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return u, b[first], np.bincount(inverse, weights=n).astype(np.int64)

        for batch in slices(batches):
            t = Tokens(batch.column("text"))
            u, first, n = np.unique(t.hash, return_index=True, return_counts=True)
            held.append((u, t.bucket[first], n))
            if len(held) >= 16:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield pa.record_batch([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1]), pa.array(held[0][2])], names=["hash", "bucket", "n"])
                    held = []
        if held:
            u, b, n = merged()
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(b), pa.array(n)], names=["hash", "bucket", "n"])

    return rows.mapInArrow(count, "hash long, bucket int, n long").groupBy("hash").agg(F.first("bucket").alias("bucket"), F.sum("n").alias("n"))


def vocabulary_of(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The vocabulary, and the least count of the words it holds."""
    high = 1 << 16
    hist = counts.groupBy(F.least("n", F.lit(high)).alias("c")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()
    total, distinct = sum(r["tokens"] for r in hist), sum(r["words"] for r in hist)
    least, held = high, 0
    for r in sorted(hist, key=lambda r: -r["c"]):
        held += r["words"]
        if held > KNOWN:
            break
        least = r["c"]
    if held > KNOWN and least == high:  # at most KNOWN words can have a share of 1 / KNOWN each
        least = max(high, -(-total // KNOWN))
    known = counts.where(F.col("n") >= least).select("hash", "bucket", "n").toPandas().sort_values(["n", "hash"], ascending=[False, True])
    in_bucket, of_bucket = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        in_bucket[r["bucket"]], of_bucket[r["bucket"]] = r["n"], r["words"]
    hashes = known["hash"].to_numpy(np.int64).view(np.uint64)
    units = known[hashes != END_HASH].head(HEAD)
    units = pd.concat([units, known[hashes == END_HASH]])
    np.subtract.at(in_bucket, units["bucket"], units["n"])
    np.subtract.at(of_bucket, units["bucket"], 1)
    return Vocabulary(hashes, known["n"].to_numpy(np.int64), total, distinct, in_bucket, of_bucket), least


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive spans of each document's units, the unit before the first (an end, at the start) in front."""
    for batch in batches:
        keys, spans = [], []
        for key, data in zip(np.array(batch.column("mark"), np.int64).tolist(), batch.column("units").to_pylist(), strict=True):
            units = np.concatenate([[END], np.frombuffer(data, np.int16)]).astype(np.int16)
            cut = [units[k : k + SPAN + 1].tobytes() for k in range(0, len(units) - 1, SPAN)]
            keys += mix(np.uint64(key & (1 << 64) - 1) + np.arange(len(cut), dtype=np.uint64)).view(np.int64).tolist()
            spans += cut
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(spans, pa.binary())], names=["key", "span"])


def _learn(shared, start, rate: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = _unpack(start.value)
        lanes = _Lanes([np.frombuffer(x, np.int16) for x in pdf.sort_values(["key", "span"])["span"]])
        _train(own, shared.value, lanes, rate)
        return pd.DataFrame({"shard": [key[0]], "tokens": [lanes.tokens], "weights": [_pack(own)]})

    return run


def train(encoded: DataFrame, v: Vocabulary, tokens: int) -> dict:
    """Weights of the recurrent model after one pass over all units of encoded (mark long, units binary)."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(v)
    shards = max(1, -(-tokens // (SHARD_TOKENS * len(RATES))))
    spans = encoded.select("mark", "units").mapInArrow(_spans, "key long, span binary")
    spans = spans.withColumn("turn", F.pmod("key", F.lit(len(RATES)))).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    weights = initial(v)
    for turn, rate in enumerate(RATES):
        schema, learn = "shard long, tokens long, weights binary", _learn(shared, spark.sparkContext.broadcast(_pack(weights)), rate)
        # a shard is few bytes and much work: dealt to tasks of its own, which adaptive execution does not put together
        dealt = spans.where(F.col("turn") == turn).repartition(min(2 * shards, TASKS), "shard")
        means, left = dealt.groupBy("shard").applyInPandas(learn, schema), shards
        while left > FAN_IN:
            means, left = means.groupBy(F.expr(f"shard div {FAN_IN}")).applyInPandas(_average, schema), -(-left // FAN_IN)
        means = means.toPandas()  # at most FAN_IN models
        if len(means):
            weights = _unpack(_average((), means)["weights"][0])
    return weights


def _dealt(counts: np.ndarray, n: int) -> list[list[int]]:
    """Texts dealt to n lanes of about equal length, longest first."""
    lanes: list[list[int]] = [[] for _ in range(n)]
    heap = [(0, k) for k in range(n)]
    for k in np.argsort(-counts, kind="stable").tolist():
        load, lane = heap[0]
        lanes[lane].append(k)
        heapq.heapreplace(heap, (load + int(counts[k]), lane))
    return lanes


def _unit_scores(w: dict, v: Vocabulary, units: np.ndarray, first: np.ndarray, window: int = 160) -> np.ndarray:
    """Natural log of P(class) P(unit | class) at every token; each text starts from the empty state after an end."""
    counts = np.diff(first)
    lanes = _dealt(counts, int(np.clip(counts.sum() // max(int(counts.max(initial=1)), 1), 1, 256)))
    place = np.full((int(max(counts[lane].sum() for lane in lanes)), len(lanes)), -1, np.int32)
    for k, lane in enumerate(lanes):
        at = np.concatenate([np.arange(first[i], first[i + 1]) for i in lane] or [np.zeros(0, np.int64)])
        place[: len(at), k] = at
    live = place >= 0
    starts = np.zeros(len(units) + 1, bool)
    starts[first[:-1]] = True
    before = np.empty(len(units), np.int32)
    before[1:], before[first[:-1][first[:-1] < len(units)]] = units[:-1], END
    fresh = starts[place] & live
    restarts = fresh.any(1).tolist()
    inputs, out = np.where(live, before[place], END), np.zeros(len(units), np.float64)
    x_of = w["E"] @ w["W"] + w["b"]
    h = np.zeros((len(lanes), HIDDEN), np.float32)
    for s in range(0, len(place), window):
        e = min(s + window, len(place))
        states = np.empty((e - s, len(lanes), HIDDEN), np.float32)
        for t in range(s, e):
            if restarts[t]:
                h[fresh[t]] = 0
            h = _step(np.take(x_of, inputs[t], 0), h, w["U"])[0]
            states[t - s] = h
        where = live[s:e].ravel()
        at = place[s:e].ravel()[where]
        out[at] = _outputs(w, v, states.reshape(-1, HIDDEN)[where], units[at])[0]
    return out


_ENCODED = "row long, doc_id long, mark long, learn boolean, n_tokens long, n_known long, base_sum double, inside_sum double, rare binary, units binary"
_KEYS = ["row", "doc_id", "mark", "learn"]


def _encode(v):
    """Per document its units and what is known of the sums; rare: hashes, counts and non-repeats of words not at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = v.value
        for batch in pooled(batches, POOL[0]):
            t = Tokens.of_batch(batch)
            unit, known, inside = voc.look_up(t)
            count = np.where(known >= 0, voc.count[known] if len(voc.count) else 0, 0)
            owner = np.repeat(np.arange(len(t.counts)), t.counts)
            miss = np.flatnonzero(known < 0)
            order = miss[np.lexsort((t.hash[miss], owner[miss]))]
            h, o, rest = t.hash[order], owner[order], (unit[order] != REPEAT).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])) if len(h) else np.zeros(0, int)
            tf = np.diff(np.append(new, len(h)))
            own = np.add.reduceat(rest, new) if len(h) else rest
            record = np.zeros(len(new), _RARE)
            record["hash"], record["tf"], record["own"] = h[new], tf, own
            cut = np.searchsorted(o[new], np.arange(len(t.counts) + 1))
            sums = [np.bincount(owner, weights=x, minlength=len(t.counts)) for x in ((known >= 0).astype(float), np.log10(count + 1.0), inside)]
            rare = [record[cut[k] : cut[k + 1]].tobytes() for k in range(len(t.counts))]
            units = [x.tobytes() for x in np.split(unit.astype(np.int16), t.first[1:-1])]
            columns = [pa.array(t.counts), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.array(rare, pa.binary()), pa.array(units, pa.binary())]
            yield pa.record_batch([*(batch.column(k) for k in _KEYS), *columns], names=[*_KEYS, "n_tokens", "n_known", "base_sum", "inside_sum", "rare", "units"])

    return run


def _scores(v, weights):
    """Per document log10 P of its tokens by the model, as far as it is known without the counts of rare words."""
    keep = ["row", "doc_id", "n_tokens", "n_known", "base_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, w = v.value, _unpack(weights.value)
        for batch in pooled(batches, POOL[1], "units"):
            counts = np.array(batch.column("n_tokens"), np.int64)
            first = np.concatenate([[0], np.cumsum(counts)])
            units = np.frombuffer(b"".join(batch.column("units").to_pylist()), np.int16).astype(np.int32)
            logp = np.add.reduceat(_unit_scores(w, voc, units, first), first[:-1]) / np.log(10)
            yield pa.record_batch([*(batch.column(k) for k in keep), pa.array(logp + np.array(batch.column("inside_sum")))], names=[*keep, "model_sum"])

    return run


_RARE = np.dtype([("hash", "<i8"), ("tf", "<i4"), ("own", "<i4")])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = batch.column("rare").to_pylist()
        n = np.array([len(x) // _RARE.itemsize for x in data], np.int64)
        r = np.frombuffer(b"".join(data), _RARE)
        rows = np.repeat(np.array(batch.column("row"), np.int64), n)
        yield pa.record_batch([pa.array(rows), pa.array(r["hash"]), pa.array(r["tf"]), pa.array(r["own"])], names=["row", "hash", "tf", "own"])


def score(docs: DataFrame, training) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    training: Column over doc_id, true for documents to learn from. Null text counts as empty: one token, the end.
    Texts of any length are counted, learned from and scored whole; repeated rows each count and are scored each. An
    empty table gives no rows; with no training documents every word is unknown and scores stay finite. Further columns
    of any name are not looked at.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs)
    counts = materialize(token_counts(rows.where(training)))
    v, least = vocabulary_of(counts)
    shared = spark.sparkContext.broadcast(v)
    marked = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("mark", F.xxhash64("doc_id", "text")).withColumn("learn", F.coalesce(training, F.lit(False)))
    encoded = materialize(marked.mapInArrow(_encode(shared), _ENCODED))
    weights = train(encoded.where("learn"), v, v.total)
    packed = spark.sparkContext.broadcast(_pack(weights))
    scored = encoded.select("row", "doc_id", "n_tokens", "n_known", "base_sum", "inside_sum", "units").mapInArrow(_scores(shared, packed), "row long, doc_id long, n_tokens long, n_known long, base_sum double, model_sum double")
    rare = encoded.where(F.length("rare") > 0).select("row", "rare").mapInArrow(_spread, "row long, hash long, tf int, own int")
    lower = counts.where(F.col("n") < least).select("hash", F.col("n").alias("c"))
    more = rare.join(lower, "hash").groupBy("row").agg(F.sum("tf").alias("k"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("base"), F.sum(F.col("own") * F.log10(F.col("c") + 1.0)).alias("model"))
    base_size = F.log10(F.lit(float(v.total + v.distinct + 1)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base_sum") + zero("base") - F.col("n_tokens") * base_size).alias("base_score"), (F.col("model_sum") + zero("model")).alias("score"),
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = in_fold(F.col("doc_id"), 7, 2)
    out = score(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
