"""Observation queries: health, metrics, logs, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import observe as o
from ..sources import files
from ..sources.tables import FR, LG, L, M, P, counters, frames, links, logs, metrics, processors, with_
from .catalog import query

WM, WL = with_(FR, M), with_(FR, LG)


@query("agg_health", with_(P, L, FR, M) + "SELECT (SELECT count(*) FROM p) AS processor_count, (SELECT count(*) FROM l) AS link_count, CAST(sum(frames_dropped) AS BIGINT) AS frames_dropped, count(*) FILTER (frames_processed > 0 AND frames_dropped > 0.01 * frames_processed) AS bottlenecks, 0 AS error_count FROM m")
def agg_health(spark, sf):
    return o.health(processors(spark, sf), links(spark, sf), counters(spark, sf))


@query("agg_bottlenecks", WM + "SELECT processor_id FROM m WHERE frames_processed > 0 AND frames_dropped > 0.01 * frames_processed")
def agg_bottlenecks(spark, sf):
    return o.bottlenecks(counters(spark, sf))


@query("agg_proc_snapshot", WM + "SELECT processor_id, frames_processed, frames_dropped, 0.0::DOUBLE AS latency_p90_ms, 0.0::DOUBLE AS latency_max_ms FROM m WHERE processor_id = 7")
def agg_proc_snapshot(spark, sf):
    return o.processor_snapshot(counters(spark, sf), 7).select("processor_id", "frames_processed", "frames_dropped", "latency_p90_ms", "latency_max_ms")


@query("agg_latency", WM + "SELECT processor_id, round(latency_p50_ms, 6) AS p50, round(latency_p99_ms, 6) AS p99, round(throughput_fps, 9) AS fps FROM m")
def agg_latency(spark, sf):
    return metrics(spark, sf).select("processor_id", F.round("latency_p50_ms", 6).alias("p50"), F.round("latency_p99_ms", 6).alias("p99"), F.round("throughput_fps", 9).alias("fps"))


RANK = "CASE coalesce(level, 'trace') WHEN 'trace' THEN 0 WHEN 'debug' THEN 1 WHEN 'info' THEN 2 WHEN 'warn' THEN 3 WHEN 'error' THEN 4 END"


@query("flt_log", WL + f"SELECT source_seq FROM g WHERE pipeline_id = 'pipe1' AND source = 'python' AND {RANK} >= 2")
def flt_log(spark, sf):
    return o.filter_logs(logs(spark, sf), pipeline="pipe1", source="python", floor="info").select("source_seq")


@query("flt_log_gpu", WL + "SELECT source_seq FROM g WHERE rhi_op IS NOT NULL AND intercepted AND processor_id < '5'")
def flt_log_gpu(spark, sf):
    return o.filter_logs(logs(spark, sf), gpu=True, intercepted=True).where("processor_id < '5'").select("source_seq")


@query("srt_logs", WL + "SELECT host_ts, source_seq, row_number() OVER (PARTITION BY runtime_id ORDER BY host_ts, source_seq) AS place FROM g")
def srt_logs(spark, sf):
    from pyspark.sql.window import Window

    return logs(spark, sf).select("host_ts", "source_seq", F.row_number().over(Window.partitionBy("runtime_id").orderBy("host_ts", "source_seq")).alias("place"))


PRETTY = """lpad(CAST((host_ts // 3600000000000) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST((host_ts // 60000000000) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((host_ts // 1000000000) % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST((host_ts % 1000000000) // 1000000 AS VARCHAR), 3, '0')"""


@query("snk_log_pretty", WL + f"SELECT source_seq, {PRETTY} || ' [' || lpad(upper(level), 5, ' ') || '] [' || runtime_id || '/' || source || '] ' || target || ' — ' || message || coalesce(' pipeline_id=' || pipeline_id, '') || ' processor_id=' || processor_id || coalesce(' rhi_op=' || rhi_op, '') || ' k=' || json_extract_string(attrs, '$.k') AS line FROM g")
def snk_log_pretty(spark, sf):
    from ..functions.text import log_pretty

    g = logs(spark, sf)
    columns = {c: F.col(c) for c in g.columns} | {"attrs": F.create_map(F.lit("k"), F.get_json_object("attrs", "$.k"))}
    return g.select("source_seq", log_pretty(columns).alias("line"))


@query("sc_log_pretty", WL + f"SELECT source_seq, {PRETTY} || ' [' || lpad(upper(level), 5, ' ') || '] [' || runtime_id || '/' || source || '] ' || target || ' — ' || message AS line FROM g")
def sc_log_pretty(spark, sf):
    from ..functions.text import log_pretty

    g = logs(spark, sf)
    return g.select("source_seq", log_pretty({c: F.col(c) for c in ("host_ts", "level", "runtime_id", "source", "target", "message")}).alias("line"))


@query("srt_attrs", WL + "SELECT source_seq, 'a=' || channel || ' k=' || json_extract_string(attrs, '$.k') || ' z=1' AS attrs FROM g")
def srt_attrs(spark, sf):
    m = F.create_map(F.lit("z"), F.lit("1"), F.lit("k"), F.get_json_object("attrs", "$.k"), F.lit("a"), F.col("channel"))
    return logs(spark, sf).select("source_seq", F.concat_ws(" ", F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("attrs"))


NAMES = "n AS (SELECT CASE WHEN ord % 10 = 3 THEN 'odd-' || ord || '.txt' ELSE 'run-' || type || '-' || (1700000000000 + ord) || '.jsonl' END AS name, ord FROM p)"


def _names(spark, sf):
    p = processors(spark, sf)
    return p.select(F.when(F.col("ord") % 10 == 3, F.format_string("odd-%d.txt", "ord")).otherwise(F.format_string("run-%s-%d.jsonl", "type", F.lit(1_700_000_000_000) + F.col("ord"))).alias("name"), "ord")


LISTED = ", x AS (SELECT name, regexp_extract(name, '^(.+)-([0-9]+)\\.jsonl$', 1) AS runtime_id, CAST(regexp_extract(name, '^(.+)-([0-9]+)\\.jsonl$', 2) AS BIGINT) AS started FROM n WHERE regexp_matches(name, '^(.+)-([0-9]+)\\.jsonl$'))"


@query("src_log_list", with_(P, NAMES) + LISTED + " SELECT * FROM x")
def src_log_list(spark, sf):
    return files.listed(_names(spark, sf))


@query("src_log_latest", with_(P, NAMES) + LISTED + " SELECT runtime_id, arg_max(name, started) AS name FROM x GROUP BY runtime_id")
def src_log_latest(spark, sf):
    return files.newest(files.listed(_names(spark, sf)))


@query("sc_log_file_name", with_(P, NAMES) + LISTED + " SELECT runtime_id, started FROM x")
def sc_log_file_name(spark, sf):
    return files.listed(_names(spark, sf)).select("runtime_id", "started")


LINES = with_(FR, LG) + """, t AS (SELECT CASE WHEN source_seq % 13 = 0 THEN '{broken' WHEN source_seq % 17 = 0 THEN '[1]' ELSE CAST(to_json({'host_ts': host_ts, 'level': level, 'message': message, 'source_seq': source_seq}) AS VARCHAR) END AS value, source_seq FROM g)"""


def _lines(spark, sf):
    g = logs(spark, sf)
    good = F.to_json(F.struct("host_ts", "level", "message", "source_seq"))
    return g.select(F.when(F.col("source_seq") % 13 == 0, "{broken").when(F.col("source_seq") % 17 == 0, "[1]").otherwise(good).alias("value"))


@query("src_log_read", LINES + " SELECT source_seq, level, message FROM g WHERE source_seq % 13 <> 0 AND source_seq % 17 <> 0")
def src_log_read(spark, sf):
    return files.decode(_lines(spark, sf))[0].select("source_seq", "level", "message")


@query("src_log_rejects", LINES + " SELECT value, count(*) AS n FROM t WHERE source_seq % 13 = 0 OR source_seq % 17 = 0 GROUP BY value")
def src_log_rejects(spark, sf):
    return files.decode(_lines(spark, sf))[1].groupBy("value").agg(F.count("*").alias("n"))


@query("src_nodes", "SELECT 'run' || s_suppkey AS runtime_id, s_suppkey AS pid FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0")
def src_nodes(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    entry = F.to_json(F.struct(F.when(F.col("s_suppkey") % 5 == 0, 9).otherwise(1).alias("schema_version"), F.concat(F.lit("run"), "s_suppkey").alias("runtime_id"), F.lit("http://h").alias("control_url"), F.col("s_suppkey").alias("pid")))
    return files.nodes(s.select(F.when(F.col("s_suppkey") % 7 == 0, "{torn").otherwise(entry).alias("value"))).select("runtime_id", "pid")


@query("src_catalog", with_(P) + "SELECT id || '/video' AS track_name, type AS source_processor_type, 'video' AS source_port_name FROM p")
def src_catalog(spark, sf):
    one = F.struct(F.concat("id", F.lit("/video")).alias("track_name"), F.col("type").alias("source_processor_type"), F.lit("video").alias("source_port_name"))
    docs = processors(spark, sf).select(F.to_json(F.struct(F.lit(1).alias("version"), F.array(one).alias("tracks"))).alias("value"))
    return files.tracks(docs)


FORMATS = """fm AS (SELECT p_partkey % 997 AS device, CASE (p_partkey * 7 + p_size) % 5 WHEN 0 THEN 'NV12' WHEN 1 THEN 'YUYV' ELSE 'MJPG' END AS format, p_size % 4 = 3 AS stepwise, 320 + 160 * (p_size % 12) AS width, 240 + 120 * (p_size % 10) AS height, p_partkey AS ord FROM part),
cu AS (SELECT device, 640 + 2 * device AS width, 480 AS height FROM fm GROUP BY device)"""


@query("srt_format_pick", with_(FORMATS) + """, s AS (SELECT device, format, CASE WHEN stepwise THEN least(width, 1280) ELSE width END AS width, CASE WHEN stepwise THEN least(height, 720) ELSE height END AS height, ord FROM fm WHERE format IN ('NV12', 'YUYV')),
r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY CASE format WHEN 'NV12' THEN 0 ELSE 1 END, width * height DESC, ord) AS r FROM s WHERE width <= 1280 AND height <= 720)
SELECT device, format, width, height FROM r WHERE r = 1
UNION ALL SELECT DISTINCT cu.device, 'YUYV', cu.width, cu.height FROM s JOIN cu USING (device) WHERE device NOT IN (SELECT device FROM r)""")
def srt_format_pick(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    kind = (F.col("p_partkey") * 7 + F.col("p_size")) % 5
    fmt = F.when(kind == 0, "NV12").when(kind == 1, "YUYV").otherwise("MJPG")
    rows = p.select((F.col("p_partkey") % 997).alias("device"), fmt.alias("format"), (F.col("p_size") % 4 == 3).alias("stepwise"), (320 + 160 * (F.col("p_size") % 12)).alias("width"), (240 + 120 * (F.col("p_size") % 10)).alias("height"), F.col("p_partkey").alias("ord"))
    current = rows.select("device").distinct().select("device", (640 + 2 * F.col("device")).alias("width"), F.lit(480).alias("height"))
    return o.pick_format(rows, current, 1280, 720)


@query("sc_elapsed", with_(FR) + "SELECT seq, timestamp_ns - min(timestamp_ns) OVER (PARTITION BY channel) AS elapsed_ns FROM f")
def sc_elapsed(spark, sf):
    f = frames(spark, sf)
    start = f.groupBy("channel").agg(F.min("timestamp_ns").alias("t0"))
    return f.join(start, "channel").select("seq", (F.col("timestamp_ns") - F.col("t0")).alias("elapsed_ns"))
