"""Resampling of sample streams, conversion between formats, and envelopes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.audio import TAPS, convert_channels, sinc_kernel
from ..functions.timing import whole
from .running import running_sum
from .samples import format_sessions, rechunk

#: Samples of a chunk from which frames take what lies before them.
CHUNK = 512


def resample(frames: DataFrame, source_rate: int, target_rate: int, quality: str = "medium", channels: int = 1) -> DataFrame:
    """Each frame (stream, seq, timestamp_ns, interleaved samples) at the other rate: what the filter can give once it
    has come, from the stream's samples so far, silence before the first.

    The last half filter of a stream, which no later sample completes, is not given. An output depends on samples around
    its place alone, so there is no state: frames get their place by running sums, and take the samples that they need
    from chunks of the stream by an equi-join; a hot stream is spread like any other.
    """
    half = TAPS[quality]
    rows = frames.select("stream", "seq", "timestamp_ns", F.col("samples").cast("array<double>").alias("samples"))
    if source_rate == target_rate:
        return rows
    size = whole(F.size("samples").cast("long"), channels)
    placed = running_sum(rows, "stream", size, out="_a", inclusive=False).withColumn("_b", F.col("_a") + size)
    # outputs before sample number x is there: those whose place is before x - half
    given = lambda x: F.greatest(whole((x - half) * target_rate + (source_rate - 1), source_rate), F.lit(0).cast("long"))
    asked = placed.select("stream", "seq", "timestamp_ns", given(F.col("_a")).alias("_from"), given(F.col("_b")).alias("_to"), F.greatest(F.col("_a") - 2 * half, F.lit(0)).alias("_lo"), F.col("_b").alias("_hi"))
    silent = asked.where("_from >= _to").select("stream", "seq", "timestamp_ns", F.array().cast("array<double>").alias("samples"))
    asked = asked.where("_from < _to")
    chunks = rechunk(rows, CHUNK * channels, keep_tail=True).select("stream", "chunk", F.col("samples").alias("_held"))
    parts = asked.withColumn("chunk", F.explode(F.sequence(whole(F.col("_lo"), CHUNK), whole(F.col("_hi") - 1, CHUNK)))).join(chunks, ["stream", "chunk"])
    first = F.greatest(F.col("_lo") - F.col("chunk") * CHUNK, F.lit(0))
    last = F.least(F.col("_hi") - F.col("chunk") * CHUNK, F.lit(CHUNK).cast("long"))
    part = F.slice("_held", (first * channels + 1).cast("int"), ((last - first) * channels).cast("int"))
    keys = ["stream", "seq", "timestamp_ns", "_from", "_to", "_lo"]
    gathered = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk", part.alias("part")))).alias("_x"))  # a frame and 2 * half samples
    windows = gathered.select("stream", "seq", "timestamp_ns", "_from", "_to", "_lo", F.flatten("_x.part").alias("_window"))
    kernel, step, taps = np.array(sinc_kernel(source_rate, target_rate, half)), math.gcd(source_rate, target_rate), np.arange(1 - half, half + 1)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples = []
            for first, end, start, held in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), batch.column(6), strict=True):
                window = np.concatenate([np.zeros((1, channels)), held.values.to_numpy(zero_copy_only=False).reshape(-1, channels)])
                at = np.arange(first, end) * source_rate
                k = (at // target_rate)[:, None] + taps - start
                near = window[np.where((k >= 0) & (k < len(window) - 1), k + 1, 0)]
                samples.append(np.einsum("jmc,jm->jc", near, kernel[at % target_rate // step]).ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(samples, pa.list_(pa.float64()))], names=["stream", "seq", "timestamp_ns", "samples"])

    return windows.mapInArrow(weigh, silent.schema).unionByName(silent)


def convert(frames: DataFrame, formats: list[tuple[int, int]], channels: int, rate: int, size: int | None = None) -> DataFrame:
    """Streams in one format: channels first, then the rate, then chunks of `size` samples a channel.

    frames: stream, seq, timestamp_ns, samples, rate, channels; formats: the (rate, channels) that occur. A stream that
    changes its format starts anew: session counts the changes, and each session is resampled and chunked by itself.
    Gives stream, session, seq (or chunk), timestamp_ns, samples.
    """
    split = format_sessions(frames, "rate", "channels").withColumn("stream", F.struct("stream", "session"))
    parts = []
    for r, c in formats:
        own = split.where((F.col("rate") == r) & (F.col("channels") == c)).withColumn("samples", convert_channels(F.col("samples"), c, channels))
        parts.append(resample(own, r, rate, channels=channels))
    out = reduce(DataFrame.unionByName, parts)
    out = out if size is None else rechunk(out, size * channels)
    rest = [x for x in out.columns if x != "stream"]
    return out.select(F.col("stream.stream").alias("stream"), F.col("stream.session").alias("session"), *rest)


def envelope(gates: DataFrame, attack_s: float = 600.0, decay_s: float = 1200.0, sustain: float = 0.6, release_s: float = 1800.0) -> DataFrame:
    """level at each row of a stream (stream, t_us, on): on true triggers, false releases, null only samples.

    Attack rises from zero, decay falls to the sustain level, release falls from that to zero. A stage ends at the first
    sample at or after its time, where the next one starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, stage, since = None, "idle", 0
        for batch in batches:
            out = []
            for s, t, on in zip(*(batch.column(c).to_pylist() for c in ("stream", "t_us", "on")), strict=True):
                if s != stream:
                    stream, stage = s, "idle"
                if on:
                    stage, since = "attack", t
                elif on is False and stage != "idle":
                    stage, since = "release", t
                share = (t - since) / 1e6 / {"attack": attack_s, "decay": decay_s, "release": release_s}.get(stage, 1.0)
                over = share >= 1
                if stage == "attack":
                    level = 1.0 if over else share
                elif stage == "decay":
                    level = sustain if over else 1 - (1 - sustain) * share
                elif stage == "release":
                    level = 0.0 if over else sustain * (1 - share)
                else:
                    level = sustain if stage == "sustain" else 0.0
                following = {"attack": "decay", "decay": "sustain", "release": "idle"}.get(stage)
                if over and following:
                    stage, since = following, t
                out.append(level)
            yield pa.record_batch([batch.column("stream"), batch.column("t_us"), pa.array(out, pa.float64())], names=["stream", "t_us", "level"])

    rows = gates.select(F.col("stream").cast("long").alias("stream"), F.col("t_us").cast("long").alias("t_us"), "on")
    return rows.repartition("stream").sortWithinPartitions("stream", "t_us", "on").mapInArrow(run, "stream long, t_us long, level double")
