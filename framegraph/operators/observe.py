"""Observation queries: health, log filters and the choice of a capture format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import level_rank

BOTTLENECK = 0.01


def health(processors: DataFrame, links: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: processor_count, link_count, frames_dropped, bottlenecks (how many drop over 1 % of what they process), error_count."""
    n_v, n_e = processors.agg(F.count("*").alias("processor_count")), links.agg(F.count("*").alias("link_count"))
    m = metrics.agg(F.coalesce(F.sum("frames_dropped"), F.lit(0)).alias("frames_dropped"), F.count_if(is_bottleneck()).alias("bottlenecks"))
    return n_v.join(F.broadcast(n_e)).join(F.broadcast(m)).withColumn("error_count", F.lit(0))  # one row each


def is_bottleneck():
    processed = F.col("frames_processed")
    return (processed > 0) & (F.col("frames_dropped") > BOTTLENECK * processed)


def bottlenecks(metrics: DataFrame) -> DataFrame:
    return metrics.where(is_bottleneck()).select("processor_id")


def processor_snapshot(metrics: DataFrame, id_) -> DataFrame:
    return metrics.where(F.col("processor_id") == id_).withColumn("latency_p90_ms", F.lit(0.0)).withColumn("latency_max_ms", F.lit(0.0))


def filter_logs(logs: DataFrame, processor=None, pipeline=None, gpu=False, floor=None, source=None, intercepted=False) -> DataFrame:
    """All given conditions together; an unknown level passes no floor, a missing one counts as trace."""
    if processor is not None:
        logs = logs.where(F.col("processor_id") == processor)
    if pipeline is not None:
        logs = logs.where(F.col("pipeline_id") == pipeline)
    if gpu:
        logs = logs.where(F.col("rhi_op").isNotNull())
    if floor is not None:
        logs = logs.where(level_rank(F.col("level")) >= level_rank(F.lit(floor)))
    if source is not None:
        logs = logs.where(F.col("source") == source)
    return logs.where("intercepted") if intercepted else logs


def pick_format(formats: DataFrame, current: DataFrame, max_w: int, max_h: int) -> DataFrame:
    """The capture format per device: NV12 in its largest area within the cap (the first listed of equals), else YUYV in
    its, else YUYV in the device's current size. Devices that list neither format are missing.

    formats: device, format, stepwise, width, height, ord; a stepwise range gives its largest size, which is clamped to
    the cap, other sizes beyond it are left out. current: device, width, height.
    """
    rank = F.when(F.col("format") == "NV12", 0).when(F.col("format") == "YUYV", 1)
    clamp = lambda c, most: F.when(F.col("stepwise"), F.least(c, F.lit(most))).otherwise(F.col(c))
    sized = formats.where(rank.isNotNull()).withColumn("width", clamp("width", max_w)).withColumn("height", clamp("height", max_h))
    area = F.col("width").cast("long") * F.col("height")
    fits = (F.col("width") <= max_w) & (F.col("height") <= max_h) & (area > 0)
    best = F.min_by(F.when(fits, F.struct("format", "width", "height")), F.when(fits, F.struct(rank, -area, "ord")))
    picked = sized.groupBy("device").agg(best.alias("x"))
    size = current.select("device", F.col("width").alias("_w"), F.col("height").alias("_h"))
    own = lambda c, other: F.coalesce(F.col(f"x.{c}"), other).alias(c)
    return picked.join(size, "device", "left").select("device", own("format", F.lit("YUYV")), own("width", F.col("_w")), own("height", F.col("_h")))
