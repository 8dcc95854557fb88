"""How a link delivers frames: newest only, a bounded queue, or everything; taps, admission and retention.

Arrivals between two reads are the rows of one channel in one tick, ordered by seq, which makes every profile a pure
function of the table. All operators group by (channel, tick) or a given key; none sorts a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timing import whole
from .running import numbered, running_last, running_max

HEADER = 76
CEILING = 64 << 20
DEPTH = {"latest": 4, "every_sample": 16, "lossless": 16}


def latest(frames: DataFrame, *keys: str) -> DataFrame:
    """The newest frame of each (channel, tick): an aggregate with map-side combine, no window."""
    keys = keys or ("channel", "tick")
    rest = [c for c in frames.columns if c not in keys]
    best = frames.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_x"), F.count("*").alias("arrived"))
    return best.select(*keys, *(F.col("_x")[c].alias(c) for c in rest), "arrived")


def every_sample(frames: DataFrame, depth: int = DEPTH["every_sample"], *keys: str) -> DataFrame:
    """The newest `depth` of each (channel, tick), oldest dropped; dropped counts those lost before the reading."""
    keys = keys or ("channel", "tick")
    w = Window.partitionBy(*keys)
    ranked = frames.withColumn("_r", F.row_number().over(w.orderBy(F.desc("seq")))).withColumn("dropped", F.greatest(F.count("*").over(w) - depth, F.lit(0)))
    return ranked.where(F.col("_r") <= depth).drop("_r")


def lossless(frames: DataFrame) -> DataFrame:
    """Every frame, with its place in its channel's tick."""
    return frames.withColumn("place", F.row_number().over(Window.partitionBy("channel", "tick").orderBy("seq")))


def apply_profile(frames: DataFrame, profile: str) -> DataFrame:
    if profile == "latest":
        return latest(frames).drop("arrived")
    if profile == "every_sample":
        return every_sample(frames).drop("dropped")
    if profile == "lossless":
        return frames
    raise ValueError(f"unknown delivery profile {profile!r}")


def tap(frames: DataFrame, depth: int = DEPTH["every_sample"]) -> DataFrame:
    """What a non-blocking observer sees: the first `depth` of each (channel, tick); newest dropped."""
    w = Window.partitionBy("channel", "tick").orderBy("seq")
    return frames.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= depth).drop("_r")


def bounded_sample(frames: DataFrame, count: int | None = None, default: int = 8) -> DataFrame:
    """The first frames in order; the count is clamped to 1 up to 1024."""
    return frames.orderBy("timestamp_ns", "seq").limit(max(1, min(default if count is None else count, 1024)))


def sample_window(frames: DataFrame, count: int, window_ns: int = 500_000_000) -> DataFrame:
    """Up to count frames that arrive within the window from the first one."""
    start = frames.agg(F.min("timestamp_ns").alias("_t0"))
    return bounded_sample(frames.join(F.broadcast(start), F.col("timestamp_ns") < F.col("_t0") + window_ns).drop("_t0"), count)  # one row


def admission(frames: DataFrame, ceiling: int = CEILING, first_capacity: int = 128) -> DataFrame:
    """admitted (len fits the ceiling), capacity (grown to the next power of two) and crossed (first beyond a quarter).

    frames' len includes the header.
    """
    fits = F.col("len") <= ceiling
    rows = running_max(frames.withColumn("admitted", fits), "channel", F.when(fits, F.col("len")), out="_top")
    rows = running_max(rows, "channel", F.when(fits, F.col("len")), out="_before", inclusive=False)

    def capacity(most):
        # the next power of two by the length of its binary digits; nothing grows while frames fit what there is
        grown = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(most - 1)))
        return F.when(most > first_capacity, grown).otherwise(F.lit(first_capacity).cast("long"))

    beyond = lambda most: capacity(F.col(most)) > ceiling // 4
    return rows.withColumn("capacity", capacity(F.col("_top"))).withColumn("crossed", beyond("_top") & ~beyond("_before")).drop("_top", "_before")


def every_nth(frames: DataFrame, n: int = 30) -> DataFrame:
    """Frames whose running number in the channel is divisible by n."""
    return numbered(frames, "channel", out="_r").where((F.col("_r") + 1) % n == 0).drop("_r")


#: Intervals of a segment, which one task walks at a time.
SEGMENT = 64


def _groups(batches, at: list[int]):
    """Runs of rows that are equal in the columns `at`, each put together from sorted batches."""
    import pyarrow as pa

    held, last = [], None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in at), strict=True))
        start = 0
        for k in range(1, len(keys) + 1):
            if k < len(keys) and keys[k] == keys[start]:
                continue
            if held and keys[start] != last:
                yield last, pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(start, k - start))
            last, start = keys[start], k
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


def every_interval(frames: DataFrame, interval_ns: int) -> DataFrame:
    """Frames at least the interval after the last one kept of their channel; the first is kept.

    What is kept depends on what was kept before. A channel is cut into segments of SEGMENT intervals, which tasks walk
    side by side for every frame that may be the first one kept of a segment (those of its first interval, and the next);
    a fold over only these settles which it is, and the segments are walked once more from there. So a channel with a
    third of all frames is not one task, and a task holds one segment.
    """
    import numpy as np
    import pyarrow as pa

    rows = frames.withColumn("_seg", whole(F.col("timestamp_ns"), interval_ns * SEGMENT))
    columns = rows.columns
    at, time, seq = [columns.index("channel"), columns.index("_seg")], columns.index("timestamp_ns"), columns.index("seq")
    channel = dict(frames.dtypes)["channel"]

    def starts(batches):
        for (name, seg), group in _groups(batches, at):
            t = group.column(time).to_numpy()
            following = np.searchsorted(t, t + interval_ns)
            n = min(len(t), int(np.searchsorted(t, seg * interval_ns * SEGMENT + interval_ns)) + 1)
            last = np.arange(n)
            while len(ahead := np.flatnonzero(following[last] < len(t))):
                last[ahead] = following[last[ahead]]
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, group.schema.field(at[0]).type), pa.array([seg] * n, pa.int64()), pa.array(t[:n]), group.column(seq)[:n].combine_chunks(), pa.array(t[last])], names=["channel", "_seg", "_t", "_seq", "_last"])

    def settle(batches):
        name, free, started = None, 0, False
        for batch in batches:
            keep = []
            for c, t, last in zip(*(batch.column(k).to_pylist() for k in ("channel", "_t", "_last")), strict=True):
                if not started or c != name:
                    name, free, started = c, t, True
                keep.append(t >= free)
                if keep[-1]:
                    free = last + interval_ns
            yield batch.select(["channel", "_seg", "_t"]).filter(pa.array(keep, pa.bool_()))

    def walk(batches):
        for _, group in _groups(batches, at):
            t, first = group.column(time).to_numpy(), group.column(len(columns))[0].as_py()
            keep, k = np.zeros(len(t), bool), int(np.searchsorted(t, first))
            while k < len(t):
                keep[k] = True
                k = int(np.searchsorted(t, t[k] + interval_ns))
            yield from group.filter(pa.array(keep)).drop_columns(["_seg", "_from"]).to_batches()

    dealt = lambda df: df.repartition("channel", "_seg").sortWithinPartitions("channel", "_seg", "timestamp_ns", "seq")
    may = dealt(rows).mapInArrow(starts, f"channel {channel}, _seg long, _t long, _seq {dict(frames.dtypes)['seq']}, _last long")
    firsts = may.repartition("channel").sortWithinPartitions("channel", "_t", "_seq").mapInArrow(settle, f"channel {channel}, _seg long, _t long")
    firsts = firsts.select(F.col("channel").alias("_c"), F.col("_seg").alias("_s"), F.col("_t").alias("_from"))
    led = rows.join(firsts, rows["channel"].eqNullSafe(firsts["_c"]) & (rows["_seg"] == firsts["_s"])).select(*columns, "_from")
    return dealt(led).mapInArrow(walk, frames.schema)


def drop_busy(frames: DataFrame, service_ns: int) -> DataFrame:
    """Frames that find the one worker of their channel idle; each taken keeps it busy for the service time."""
    return every_interval(frames, service_ns)


def keep_last(frames: DataFrame, k: int = 8) -> DataFrame:
    w = Window.partitionBy("channel").orderBy(F.desc("seq"))
    return frames.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def evict(files: DataFrame, max_files: int, max_bytes: int, key: str = "dir") -> DataFrame:
    """kept: the newest files of each directory that fit both caps together (no older one stays once one goes)."""
    w = Window.partitionBy(key).orderBy(F.desc("mtime"), F.desc("path"))
    rows = files.withColumn("_n", F.row_number().over(w)).withColumn("_b", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("kept", (F.col("_n") <= max_files) & (F.col("_b") <= max_bytes)).drop("_n", "_b")


def frame_index(frames: DataFrame) -> DataFrame:
    """frame_index: the running number of a frame in its channel from 0, as text."""
    return numbered(frames, "channel", out="frame_index").withColumn("frame_index", F.col("frame_index").cast("string"))


def hold_last(frames: DataFrame, column: str) -> DataFrame:
    """held: the last value that was there, up to and including the row's own."""
    return running_last(frames, "channel", column, out="held")


def outside_pauses(frames: DataFrame, pauses: DataFrame) -> DataFrame:
    """Frames whose tick lies in no pause [from_tick, to_tick) of their channel."""
    spans = pauses.select(F.col("channel").alias("_c"), "from_tick", "to_tick")
    inside = (F.col("channel") == F.col("_c")) & (F.col("tick") >= F.col("from_tick")) & (F.col("tick") < F.col("to_tick"))
    return frames.join(spans, inside, "left_anti")


def topic(events: DataFrame, wanted: str, column: str = "channel") -> DataFrame:
    """Events of one topic; `*` takes all."""
    return events if wanted == "*" else events.where(F.col(column) == wanted)


def within_size(events: DataFrame, encoded: Column, most: int = 8192) -> DataFrame:
    return events.where(F.octet_length(encoded) <= most)


def dropped_reports(counters: DataFrame, every_ns: int = 1_000_000_000, at_least: int = 1000) -> DataFrame:
    """Rows at which drops are reported: some new ones since the last report, and that (or the source's first row) the
    interval ago or at_least of them.

    counters: source, timestamp_ns, dropped (cumulative). What is reported depends on the last report, so each source is
    an ordered fold, fed batch by batch.
    """
    columns = ["source", "timestamp_ns", "dropped"]

    def fold(batches):
        import pyarrow as pa

        source, seen, last, started = None, 0, 0, False
        for batch in batches:
            new = []
            for s, t, dropped in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if not started or s != source:
                    source, seen, last, started = s, 0, t, True
                drops = dropped - seen
                report = drops > 0 and (t - last >= every_ns or drops >= at_least)
                new.append(drops if report else None)
                if report:
                    seen, last = dropped, t
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.int64())], names=[*columns, "new_drops"])

    source = dict(counters.dtypes)["source"]
    rows = counters.select("source", F.col("timestamp_ns").cast("long").alias("timestamp_ns"), F.col("dropped").cast("long").alias("dropped"))
    told = rows.repartition("source").sortWithinPartitions("source", "timestamp_ns", "dropped").mapInArrow(fold, f"source {source}, timestamp_ns long, dropped long, new_drops long")
    return told.where("new_drops is not null")


def two_level(frames: DataFrame, depth: int, reads: int) -> DataFrame:
    """Frames that get read, with read_tick: a ring and a mailbox of `depth` each stand between a channel and its reader.

    In each tick that brings frames the ring keeps the newest `depth` of them, what it holds goes into the mailbox, which
    drops its oldest beyond `depth`, and `reads` frames are taken from there in order. Frames that the ring lets through
    are numbered, so the mailbox is a range of numbers; only its head is folded, over one row a channel and tick.
    """
    w = Window.partitionBy("channel", "tick")
    ringed = frames.withColumn("_back", F.row_number().over(w.orderBy(F.desc("seq")))).where(F.col("_back") <= depth).drop("_back")
    ticks = ringed.groupBy("channel", "tick").agg(F.count("*").alias("came"))
    channel = dict(frames.dtypes)["channel"]

    def fold(batches):
        import pyarrow as pa

        name, came, head, started = None, 0, 0, False
        for batch in batches:
            first, end, before = [], [], []
            for c, n in zip(batch.column("channel").to_pylist(), batch.column("came").to_pylist(), strict=True):
                if not started or c != name:
                    name, came, head, started = c, 0, 0, True
                before.append(came)
                came += n
                head = max(head, came - depth)
                first.append(head)
                head = min(came, head + reads)
                end.append(head)
            yield pa.RecordBatch.from_arrays([batch.column("channel"), batch.column("tick"), *(pa.array(x, pa.int64()) for x in (before, first, end))], names=["channel", "tick", "before", "first", "end"])

    spans = ticks.repartition("channel").sortWithinPartitions("channel", "tick").mapInArrow(fold, f"channel {channel}, tick long, before long, first long, end long")
    taken = spans.where("first < end").select("channel", F.col("tick").alias("read_tick"), F.explode(F.sequence("first", F.col("end") - 1)).alias("_e"))
    entered = ringed.withColumn("_place", F.row_number().over(w.orderBy("seq")) - 1).join(spans.select("channel", "tick", "before"), ["channel", "tick"]).withColumn("_e", F.col("before") + F.col("_place"))
    return entered.join(taken, ["channel", "_e"]).drop("_e", "_place", "before")
