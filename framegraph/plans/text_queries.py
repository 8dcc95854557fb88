"""Queries over names, addresses and renderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.timing import whole
from ..sources.tables import FR, P, frames, processors, with_
from .catalog import query

WP = with_(P)


@query("sc_profile_resolve", "SELECT * FROM (VALUES ('latest', 'skip_to_latest', 'drop_oldest', 4), ('every_sample', 'fifo', 'drop_oldest', 16), ('lossless', 'fifo', 'block', 16), ('other', NULL, NULL, NULL)) v(name, drain_order, overflow, depth)")
def sc_profile_resolve(spark, sf):
    rows = spark.createDataFrame([("latest",), ("every_sample",), ("lossless",), ("other",)], "name string")
    return rows.select("name", t.profile(F.col("name")).alias("p")).select("name", "p.drain_order", "p.overflow", "p.depth")


@query("sc_execution_default", "SELECT * FROM (VALUES (1, NULL, 0, 'reactive'), (0, 'manual', 0, 'manual'), (0, NULL, 0, 'error: a processor without inputs must name its execution'), (0, 'continuous', 33, 'continuous'), (0, 'continuous', -1, 'error: the interval of a continuous processor is negative')) v(inputs, execution, interval_ms, result)")
def sc_execution_default(spark, sf):
    from .registry import execution_of

    rows = []
    for inputs, execution, interval in (({"a": "latest"}, None, 0), ({}, "manual", 0), ({}, None, 0), ({}, "continuous", 33), ({}, "continuous", -1)):
        try:
            rows.append((len(inputs), execution, interval, execution_of(inputs, execution, interval)))
        except ValueError as e:
            rows.append((len(inputs), execution, interval, f"error: {e}"))
    return spark.createDataFrame(rows, "inputs int, execution string, interval_ms int, result string")


@query("sc_port_ref", WP + ", r AS (SELECT id, CASE WHEN ord % 3 = 0 THEN type ELSE type || '.out.' || ord END AS ref FROM p) SELECT id, CASE WHEN contains(ref, '.') THEN split_part(ref, '.', 1) END AS alias, CASE WHEN contains(ref, '.') THEN ref[instr(ref, '.') + 1:] END AS port FROM r")
def sc_port_ref(spark, sf):
    rows = processors(spark, sf).select("id", F.when(F.col("ord") % 3 == 0, F.col("type")).otherwise(F.concat("type", F.lit(".out."), F.col("ord").cast("string"))).alias("ref"))
    alias, port = t.port_ref(F.col("ref"))
    return rows.select("id", alias.alias("alias"), port.alias("port"))


@query("sc_link_addr", WP + ", r AS (SELECT id, CASE WHEN ord % 3 = 0 THEN type ELSE type || '.out.' || ord END AS ref FROM p) SELECT id, split_part(ref, '.', 1) AS processor, CASE WHEN contains(ref, '.') THEN ref[instr(ref, '.') + 1:] ELSE '' END AS port FROM r")
def sc_link_addr(spark, sf):
    rows = processors(spark, sf).select("id", F.when(F.col("ord") % 3 == 0, F.col("type")).otherwise(F.concat("type", F.lit(".out."), F.col("ord").cast("string"))).alias("ref"))
    processor, port = t.link_address(F.col("ref"))
    return rows.select("id", processor.alias("processor"), port.alias("port"))


@query("sc_channel_name", WP + "SELECT id, lower(id) || '/videoOut' AS channel FROM p")
def sc_channel_name(spark, sf):
    return processors(spark, sf).select("id", t.channel_name(F.col("id"), F.lit("videoOut")).alias("channel"))


@query("sc_channel_name_long", WP + "SELECT id, 63 AS n, true AS ok FROM p")
def sc_channel_name_long(spark, sf):
    name = t.channel_name(F.concat(F.repeat(F.lit("Long"), F.lit(20)), "id"), F.lit("videoOut"))
    return processors(spark, sf).select("id", F.octet_length(name).alias("n"), name.rlike("^[a-z]+-[0-9a-f]{12}/videoOut$").alias("ok"))


@query("sc_moq_track_name", WP + "SELECT id, id || '/video' AS track FROM p")
def sc_moq_track_name(spark, sf):
    return processors(spark, sf).select("id", t.track_name(F.col("id"), F.lit("video")).alias("track"))


@query("sc_config_checksum")
def sc_config_checksum(spark, sf):
    return processors(spark, sf).select("id", t.config_checksum(F.to_json(F.struct("type", "display_name"))).alias("checksum"))


@query("sc_hex", WP + "SELECT id, lower(hex(encode(display_name))) AS hex FROM p")
def sc_hex(spark, sf):
    return processors(spark, sf).select("id", F.lower(F.hex(F.col("display_name").cast("binary"))).alias("hex"))


@query("lim_preview", WP + "SELECT id, lower(hex(encode(display_name[1:8]))) AS hex, strlen(display_name) AS n, strlen(display_name) > 8 AS truncated FROM p")
def lim_preview(spark, sf):
    h, n, cut = t.preview(F.col("display_name").cast("binary"), 8)
    return processors(spark, sf).select("id", h.alias("hex"), n.alias("n"), cut.alias("truncated"))


@query("sc_format_size", "SELECT o_orderkey AS id, CASE WHEN n >= 1073741824 THEN printf('%.1f GiB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MiB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024.0) ELSE n || ' B' END AS size FROM (SELECT o_orderkey, CAST((o_orderkey % 3000) * (o_orderkey % 3000) * (1 + (o_orderkey % 7) * 1024) // 2 * 2 + 1 AS BIGINT) AS n FROM orders)")
def sc_format_size(spark, sf):
    k = F.col("o_orderkey")
    n = F.floor((k % 3000) * (k % 3000) * (1 + (k % 7) * 1024) / 2) * 2 + 1  # odd sizes: no ties at one decimal
    return spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("id"), t.format_size(n.cast("long")).alias("size"))


@query("sc_format_started", with_(FR) + "SELECT seq, strftime(make_timestamp(timestamp_ns // 1000), '%Y-%m-%dT%H:%M:%SZ') AS started FROM f")
def sc_format_started(spark, sf):
    return frames(spark, sf).select("seq", t.format_started(whole(F.col("timestamp_ns"), 1_000_000)).alias("started"))


@query("sc_wall_clock", with_(FR) + "SELECT seq, strftime(make_timestamp(timestamp_ns // 1000), '%H:%M:%S.%g') AS clock FROM f")
def sc_wall_clock(spark, sf):
    return frames(spark, sf).select("seq", t.wall_clock(F.col("timestamp_ns")).alias("clock"))


@query("sc_attr_value", WP + "SELECT id, CAST(to_json(display_name) AS VARCHAR) AS s, CAST(to_json(ord) AS VARCHAR) AS n, CASE WHEN type = 'Region' THEN 'true' ELSE 'false' END AS b FROM p")
def sc_attr_value(spark, sf):
    text = F.to_json(F.array("display_name"))
    return processors(spark, sf).select("id", F.substring(text, 2, F.length(text) - 2).alias("s"), F.col("ord").cast("string").alias("n"), (F.col("type") == "Region").cast("string").alias("b"))


@query("sc_pascal_to_camel", WP + "SELECT id, lower(type[1]) || type[2:] AS camel FROM p")
def sc_pascal_to_camel(spark, sf):
    return processors(spark, sf).select("id", t.camel(F.col("type")).alias("camel"))


@query("sc_frame_header", with_(FR) + "SELECT seq, channel, timestamp_ns, CAST(len AS BIGINT) AS len FROM f")
def sc_frame_header(spark, sf):
    """Packed into 76 bytes and read back."""
    from ..functions.header import pack, unpack

    f = frames(spark, sf)
    h = f.select("seq", pack(F.col("channel"), F.col("timestamp_ns"), F.col("len")).alias("h"))
    port, stamp, n = unpack(F.col("h"))
    return h.where(F.octet_length("h") == 76).select("seq", port.alias("channel"), stamp.alias("timestamp_ns"), n.alias("len"))
