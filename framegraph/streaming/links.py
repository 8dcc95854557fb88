"""Links under Structured Streaming: profiles, taps, zip, rechunk and triggers.

Keyed state lives in Spark's state store; a frame's channel (or stream) is the key, so state grows with the number of
channels and the depth of their queues, not with the frames. rechunk_batches keeps its state, less than a chunk per
stream, as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import samples
from ..operators.delivery import DEPTH

FRAME = "channel string, seq long, timestamp_ns long, payload string"


def trigger(writer, execution: str, interval_ms: int = 0):
    """reactive: as soon as data is there; continuous: at least the interval apart; manual: what is there now, then stop."""
    if execution == "continuous":
        return writer.trigger(processingTime=f"{max(interval_ms, 0)} milliseconds")
    return writer.trigger(availableNow=True) if execution == "manual" else writer


def latest_per_tick(frames: DataFrame, tick: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """The newest frame of each (channel, tick), given once the tick is over: a windowed aggregate with a watermark."""
    stamped = frames.withColumn("at", F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000).cast("long"))).withWatermark("at", late)
    best = F.max_by(F.struct("seq", "timestamp_ns", "payload"), "seq")
    return stamped.groupBy("channel", F.window("at", tick)).agg(best.alias("x"), F.count("*").alias("arrived")).select("channel", F.col("window.start").alias("tick"), "x.*", "arrived")


def every_sample(frames: DataFrame, depth: int = DEPTH["every_sample"]) -> DataFrame:
    """The newest `depth` of what a micro-batch brings a channel, in order, with how many it dropped so far."""

    def read(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dropped = state.get[0] if state.exists else 0
        queue = pd.DataFrame()
        for pdf in batches:  # a queue never holds more than its depth
            queue = pd.concat([queue, pdf]).sort_values("seq")
            dropped += max(len(queue) - depth, 0)
            queue = queue.tail(depth)
        state.update((dropped,))
        yield queue.assign(dropped=dropped)[["channel", "seq", "timestamp_ns", "payload", "dropped"]]

    return frames.groupBy("channel").applyInPandasWithState(read, FRAME + ", dropped long", "dropped long", "append", GroupStateTimeout.NoTimeout)


def zip_ports(left: DataFrame, right: DataFrame) -> DataFrame:
    """The k-th frame of one port with the k-th of the other, per key; what has no partner yet waits in state.

    left, right: key long, seq long, timestamp_ns long, value double.
    """
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [list(x) for x in state.get] if state.exists else [[], [], [], []]
        seqs, stamps = [held[0], held[2]], [held[1], held[3]]
        # a key's frames of a micro-batch come in several parts, in no order: put together and sorted once
        for side, seq, t in pd.concat([pdf[["side", "seq", "timestamp_ns"]] for pdf in batches]).sort_values("seq").itertuples(index=False):
            seqs[side].append(int(seq))
            stamps[side].append(int(t))
        n = min(len(seqs[0]), len(seqs[1]))
        out = [(key[0], a, b, max(s, t)) for a, b, s, t in zip(seqs[0][:n], seqs[1][:n], stamps[0][:n], stamps[1][:n], strict=True)]
        for k in (0, 1):
            del seqs[k][:n], stamps[k][:n]
        state.update((seqs[0], stamps[0], seqs[1], stamps[1]))
        yield pd.DataFrame(out, columns=["key", "l_seq", "r_seq", "timestamp_ns"])

    held = "l_seq array<long>, l_ts array<long>, r_seq array<long>, r_ts array<long>"
    return both.groupBy("key").applyInPandasWithState(pair, "key long, l_seq long, r_seq long, timestamp_ns long", held, "append", GroupStateTimeout.NoTimeout)


def rechunk(frames: DataFrame, size: int) -> DataFrame:
    """Chunks of `size` samples per stream (stream long, seq long, timestamp_ns long, samples array<double>); the rest waits in state.

    Frames of one micro-batch are put in order of seq, micro-batches follow each other as they come; a task holds what a
    micro-batch brings a stream. For large micro-batches see rechunk_batches.
    """

    def cut(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, chunk = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out = []
        for t, samples in pd.concat([pdf[["seq", "timestamp_ns", "samples"]] for pdf in batches]).sort_values("seq")[["timestamp_ns", "samples"]].itertuples(index=False):
            held += [float(x) for x in samples]
            while len(held) >= size:
                out.append((key[0], chunk, int(t), held[:size]))
                held, chunk = held[size:], chunk + 1
        state.update((held, chunk))
        yield pd.DataFrame(out, columns=["stream", "chunk", "timestamp_ns", "samples"])

    return frames.groupBy("stream").applyInPandasWithState(cut, "stream long, chunk long, timestamp_ns long, samples array<double>", "held array<double>, chunk long", "append", GroupStateTimeout.NoTimeout)


#: What is left of a stream after a micro-batch: samples of the incomplete chunk, and how many chunks were given.
REST = "stream long, held array<double>, given long"
CHUNK = "stream long, chunk long, timestamp_ns long, samples array<double>"


def rechunk_batches(frames: DataFrame, size: int, path: str):
    """A writer that gives the chunks of `rechunk` in the folder path (see rechunked), each micro-batch as one batch job.

    Frames of one micro-batch are put in order of seq by running sums, so no task holds a stream, whatever the number and
    order of the files they come from. What is left of the streams is a table per micro-batch, which the next one
    reads; a micro-batch that is run again writes the same anew.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rest = spark.read.schema(REST).parquet(f"{path}/rest/{epoch - 1}") if epoch else spark.createDataFrame([], REST)
        here = batch.groupBy("stream").agg(F.min("seq").alias("_first")).withColumnRenamed("stream", "_stream")
        own = F.col("stream").eqNullSafe(F.col("_stream"))
        # the samples left before are a frame in front of the first; it completes no chunk, so it needs no time
        held = rest.join(here, own).select("stream", (F.col("_first") - 1).alias("seq"), F.lit(None).cast("long").alias("timestamp_ns"), F.col("held").alias("samples"))
        cut = samples.rechunk(batch.select(*held.columns).unionByName(held), size, keep_tail=True)
        given = rest.select(F.col("stream").alias("_stream"), "given")
        cut = cut.join(given, own, "left").withColumn("chunk", F.col("chunk") + F.coalesce("given", F.lit(0)))
        cut.select("stream", "chunk", "timestamp_ns", "samples").write.mode("overwrite").parquet(f"{path}/chunks/batch={epoch}")
        full = F.size("samples") == size
        done = spark.read.schema(CHUNK).parquet(f"{path}/chunks/batch={epoch}").groupBy(F.col("stream").alias("_stream")).agg(
            F.coalesce(F.first(F.when(~full, F.col("samples")), ignorenulls=True), F.array().cast("array<double>")).alias("_held"), (F.max(F.when(full, F.col("chunk"))) + 1).alias("_given"),
        )
        left = rest.join(done, own, "full").select(
            F.when(F.col("_held").isNull(), F.col("stream")).otherwise(F.col("_stream")).alias("stream"),
            F.coalesce("_held", "held").alias("held"), F.coalesce("_given", "given", F.lit(0)).alias("given"),
        )
        left.write.mode("overwrite").parquet(f"{path}/rest/{epoch}")

    return frames.writeStream.foreachBatch(each)


def rechunked(spark, size: int, path: str) -> DataFrame:
    """The whole chunks that rechunk_batches gave so far; incomplete ones, which a later micro-batch completes, are left out."""
    return spark.read.schema(CHUNK).parquet(f"{path}/chunks/batch=*").where(F.size("samples") == size)


def fan_out(frames: DataFrame, *sinks: Callable[[DataFrame, int], None]):
    """A writer that hands each micro-batch to every sink, computed once."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, epoch)
        finally:
            batch.unpersist()

    return frames.writeStream.foreachBatch(each)


def state_of(query) -> str:
    """Running, Stopped or Error of a streaming query."""
    if query.exception() is not None:
        return "Error"
    return "Running" if query.isActive else "Stopped"


def wait_all(queries: list, timeout_s: float) -> None:
    """Until all have started, one deadline for all; else an error that names every state."""
    import time

    deadline = time.monotonic() + timeout_s
    while not all(q.isActive for q in queries):
        if time.monotonic() > deadline:
            raise TimeoutError(", ".join(f"{q.name or q.id}: {state_of(q)}" for q in queries))
        time.sleep(0.05)


def test_frames(spark, rate: int = 30) -> DataFrame:
    """A paced stream of synthetic frames: seq, timestamp_ns and the colour bar of the pixel with that number."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    return rows.select(F.col("value").alias("seq"), (F.unix_micros("timestamp") * 1000).alias("timestamp_ns"), F.least(F.floor((F.col("value") % 64) * 8 / 64), F.lit(7)).alias("bar"))
