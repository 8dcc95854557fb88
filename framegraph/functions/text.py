"""Names, addresses and text renderings as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .timing import whole

LEVELS = ("trace", "debug", "info", "warn", "error")


def level_rank(level: Column) -> Column:
    """0 for trace up to 4; a missing level counts as trace, an unknown one is null."""
    out = F.when(level.isNull(), 0)
    for k, name in enumerate(LEVELS):
        out = out.when(level == name, k)
    return out


def format_size(n: Column) -> Column:
    out = None
    for unit, scale in (("GiB", 1 << 30), ("MiB", 1 << 20), ("KiB", 1 << 10)):
        out = (F if out is None else out).when(n >= scale, F.format_string(f"%.1f {unit}", n / float(scale)))
    return out.otherwise(F.concat(n.cast("string"), F.lit(" B")))


def format_started(millis: Column) -> Column:
    """ISO stamp (UTC session) of epoch milliseconds; beyond year 9999 the digits themselves."""
    fits = (millis >= -62135596800000) & (millis < 253402300800000)
    return F.when(fits, F.date_format(F.timestamp_millis(F.when(fits, millis)), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(millis.cast("string"))


def wall_clock(ns: Column) -> Column:
    """HH:MM:SS.mmm of the day, truncated."""
    part = lambda width, most, digits: F.lpad(F.pmod(whole(ns, width), F.lit(most)).cast("string"), digits, "0")
    return F.concat(part(3_600_000_000_000, 24, 2), F.lit(":"), part(60_000_000_000, 60, 2), F.lit(":"), part(1_000_000_000, 60, 2), F.lit("."), part(1_000_000, 1000, 3))


def log_pretty(r: dict[str, Column]) -> Column:
    """`time [LEVEL] [runtime/source] target — message k=v ...`; attrs: map of rendered values, in key order."""
    optional = [F.when(r[k].isNotNull(), F.concat(F.lit(f" {k}="), r[k])) for k in ("pipeline_id", "processor_id", "rhi_op") if k in r]
    attrs = F.concat_ws("", F.transform(F.array_sort(F.map_entries(r["attrs"])), lambda e: F.concat(F.lit(" "), e["key"], F.lit("="), e["value"]))) if "attrs" in r else F.lit("")
    head = F.concat(wall_clock(r["host_ts"]), F.lit(" ["), F.lpad(F.upper(F.coalesce(r["level"], F.lit("info"))), 5, " "), F.lit("] ["), r["runtime_id"], F.lit("/"), r["source"], F.lit("] "), r["target"], F.lit(" — "), r["message"])
    return F.concat(head, *(F.coalesce(x, F.lit("")) for x in optional), attrs)


def port_ref(ref: Column) -> tuple[Column, Column]:
    """(alias, port) at the first dot; null alias and port where there is none (the caller reports these)."""
    dot = F.instr(ref, ".")
    return F.when(dot > 0, F.substring_index(ref, ".", 1)), F.when(dot > 0, F.substr(ref, dot + 1))


def link_address(ref: Column) -> tuple[Column, Column]:
    """(processor, port), the port empty where there is no dot."""
    alias, port = port_ref(ref)
    return F.coalesce(alias, ref), F.coalesce(port, F.lit(""))


@F.pandas_udf(StringType())
def _fnv1a_64(data: pd.Series) -> pd.Series:
    """All byte strings of an Arrow batch side by side, byte by byte; 64-bit products wrap as they should."""
    raw = sorted(((x, k) for k, x in data.dropna().items()), key=lambda p: -len(p[0]))
    sizes = np.array([len(x) for x, _ in raw], np.int64)
    flat, first = np.frombuffer(b"".join(x for x, _ in raw), np.uint8), np.cumsum(sizes) - sizes
    h = np.full(len(raw), 14695981039346656037, np.uint64)
    alive = np.searchsorted(-sizes, -np.arange(sizes.max(initial=0)))  # strings longer than each place
    for place, n in enumerate(alive.tolist()):
        h[:n] = (h[:n] ^ flat[first[:n] + place]) * np.uint64(1099511628211)
    return pd.Series([f"{x:016x}" for x in h.tolist()], [k for _, k in raw], dtype=object).reindex(data.index)


def fnv1a_64(data: Column) -> Column:
    """FNV-1a of a string's bytes as 16 lower-case hex digits; in Arrow batches, as products of SQL do not wrap at 64 bits."""
    return _fnv1a_64(data.cast("binary"))


def channel_name(source: Column, port: Column, most: int = 63) -> Column:
    """lower(source)/port in at most `most` bytes; a source too long is cut at the last character that fits whole and
    closed with the last 12 hex digits of its FNV-1a; no room: an error."""
    room = most - 1 - F.octet_length(port)
    low = F.lower(source)
    # a byte that starts a character is not 10xxxxxx: the cut goes back to one
    bytes_, fits = low.cast("binary"), F.greatest(room - 13, F.lit(0))
    inner = lambda n: F.hex(F.substring(bytes_, n + 1, F.lit(1))).rlike("^[89AB]")
    end = F.coalesce(F.array_max(F.filter(F.sequence(F.greatest(fits - 3, F.lit(0)), fits), lambda n: ~F.coalesce(inner(n), F.lit(False)))), F.lit(0))
    cut = F.concat(F.substring(bytes_, F.lit(1), end).cast("string"), F.lit("-"), F.right(fnv1a_64(F.when(F.octet_length(low) > room, low)), F.lit(12)))
    return F.when(F.octet_length(low) <= room, F.concat(low, F.lit("/"), port)).when(room >= 13, F.concat(cut, F.lit("/"), port)).otherwise(F.raise_error(F.concat(F.lit("no room for the source in channel of port "), port)))


def track_name(processor: Column, port: Column) -> Column:
    return F.concat(processor, F.lit("/"), port)


def camel(name: Column) -> Column:
    return F.concat(F.lower(F.substr(name, F.lit(1), F.lit(1))), F.substr(name, F.lit(2)))


def log_file(name: Column) -> tuple[Column, Column]:
    """(runtime, started millis) of `<runtime>-<millis>.jsonl`, split at the last dash; nulls where it does not parse."""
    pattern = r"^(.+)-([0-9]+)\.jsonl$"
    ok = name.rlike(pattern)
    return F.when(ok, F.regexp_extract(name, pattern, 1)), F.when(ok, F.regexp_extract(name, pattern, 2).cast("long"))


def preview(data: Column, most: int = 4096) -> tuple[Column, Column, Column]:
    """(lower-case hex of the first bytes, length, truncated)."""
    n = F.octet_length(data)
    return F.lower(F.hex(F.substring(data, 1, most))), n, n > most


def config_checksum(config: Column) -> Column:
    return F.xxhash64(config)


#: Delivery profiles: (drain order, on a full queue, depth).
PROFILES = {"latest": ("skip_to_latest", "drop_oldest", 4), "every_sample": ("fifo", "drop_oldest", 16), "lossless": ("fifo", "block", 16)}


def profile(name: Column, strict: bool = False) -> Column:
    """struct(order, overflow, depth) of a delivery profile; an unknown name is null, or an error where strict."""
    out = None
    for k, (order, overflow, depth) in PROFILES.items():
        out = (F if out is None else out).when(name == k, F.struct(F.lit(order).alias("drain_order"), F.lit(overflow).alias("overflow"), F.lit(depth).alias("depth")))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown delivery profile "), name))) if strict else out
