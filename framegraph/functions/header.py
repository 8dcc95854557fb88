"""The 76-byte frame header: one length byte, 63 bytes of port, timestamp (int64) and length (uint32), little-endian."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PORT, SIZE = 63, 76


def _little(x: Column, n: int) -> Column:
    big = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substr(big, F.lit(17 - 2 * k), F.lit(2)) for k in range(1, n + 1))))


def _number(data: Column, at: int, n: int) -> Column:
    """n little-endian bytes as a whole number; eight of them in two's complement."""
    part = lambda k: F.conv(F.hex(F.substring(data, at + k, 1)), 16, 10).cast("long")
    out = part(0)
    for k in range(1, n):
        out = out.bitwiseOR(F.shiftleft(part(k), 8 * k))
    return out


def pack(port: Column, timestamp_ns: Column, length: Column) -> Column:
    """The header; a port of more than 63 bytes is an error."""
    raw = F.when(F.octet_length(port) <= PORT, port.cast("binary")).otherwise(F.raise_error(F.lit("port name too long")))
    return F.concat(_little(F.octet_length(port), 1), F.rpad(raw, F.lit(PORT), F.lit(b"\0")), _little(timestamp_ns, 8), _little(length, 4))


def unpack(data: Column) -> tuple[Column, Column, Column]:
    n = _number(data, 1, 1)
    return F.substring(data, F.lit(2), n.cast("int")).cast("string"), _number(data, 2 + PORT, 8), _number(data, 10 + PORT, 4)
