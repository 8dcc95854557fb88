"""Queries over timestamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timing as t
from ..sources.tables import FR, frames, with_
from .catalog import query

PAIRS = with_(FR) + ", pr AS (SELECT seq, timestamp_ns AS v, timestamp_ns + (seq % 9 - 4) * 8300000 AS a FROM f)"


def _pairs(spark, sf):
    return frames(spark, sf).select("seq", F.col("timestamp_ns").alias("v"), (F.col("timestamp_ns") + (F.col("seq") % 9 - 4) * 8_300_000).alias("a"))


@query("sc_ts_delta_ms", PAIRS + " SELECT seq, round(abs(v - a) / 1e6, 6) AS ms FROM pr")
def sc_ts_delta_ms(spark, sf):
    return _pairs(spark, sf).select("seq", F.round(t.delta_ms(F.col("v"), F.col("a")), 6).alias("ms"))


@query("sc_is_synced", PAIRS + " SELECT seq, abs(v - a) / 1e6 <= 16.6 AS ok FROM pr")
def sc_is_synced(spark, sf):
    return _pairs(spark, sf).select("seq", t.is_synced(F.col("v"), F.col("a")).alias("ok"))


@query("sc_sync_action", PAIRS + " SELECT seq, CASE WHEN abs(v - a) / 1e6 <= 16.6 THEN 'none' WHEN v > a THEN 'drop' ELSE 'duplicate' END AS action FROM pr")
def sc_sync_action(spark, sf):
    return _pairs(spark, sf).select("seq", t.sync_action(F.col("v"), F.col("a")).alias("action"))


@query("sc_tick_duration", "SELECT i AS buffer, r AS rate, round(i / r::DOUBLE, 9) AS s, CAST(floor(i * 1000000000.0::DOUBLE / r) AS BIGINT) AS ns FROM (VALUES (256), (512), (1024)) a(i), (VALUES (44100), (48000)) b(r)")
def sc_tick_duration(spark, sf):
    rows = spark.createDataFrame([(i, r) for i in (256, 512, 1024) for r in (44_100, 48_000)], "buffer int, rate int")
    return rows.select("buffer", "rate", F.round(t.tick_duration_s(F.col("buffer"), F.col("rate")), 9).alias("s"), F.floor(F.col("buffer") * F.lit(1e9) / F.col("rate")).cast("long").alias("ns"))


@query("sc_latency_budget", "SELECT p AS priority, CASE p WHEN 'realtime' THEN 10.0::DOUBLE WHEN 'high' THEN 33.0::DOUBLE END AS ms FROM (VALUES ('realtime'), ('high'), ('normal')) t(p)")
def sc_latency_budget(spark, sf):
    rows = spark.createDataFrame([("realtime",), ("high",), ("normal",)], "priority string")
    return rows.select("priority", t.latency_budget_ms(F.col("priority")).alias("ms"))
