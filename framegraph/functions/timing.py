"""Timestamps (nanoseconds), synchronisation and clocks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE_MS = 16.6


def whole(x: Column, width: int) -> Column:
    """floor(x / width) of whole numbers, never by way of doubles: nanoseconds since 1970 do not fit these."""
    w = F.lit(width).cast("long")
    return F.call_function("div", x - F.pmod(x, w), w)


def delta_ms(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.lit(1e6)


def is_synced(a: Column, b: Column, tolerance_ms: float = TOLERANCE_MS) -> Column:
    return delta_ms(a, b) <= tolerance_ms


def sync_action(video: Column, audio: Column, tolerance_ms: float = TOLERANCE_MS) -> Column:
    """none within the tolerance, drop where video is ahead, duplicate where it is behind."""
    return F.when(is_synced(video, audio, tolerance_ms), "none").when(video > audio, "drop").otherwise("duplicate")


def tick(timestamp_ns: Column, tick_ns: int) -> Column:
    return whole(timestamp_ns, tick_ns)


def tick_duration_s(buffer: Column, rate: Column) -> Column:
    return buffer / rate


def latency_budget_ms(priority: Column) -> Column:
    """10 for realtime, 33 for high, null for normal."""
    return F.when(priority == "realtime", 10.0).when(priority == "high", 33.0)


def expirations(now: Column, start: Column, interval: int) -> Column:
    """How often a monotonic timer has fired by `now`."""
    return F.greatest(whole(now - start, interval), F.lit(0).cast("long"))
