"""Processors of the library itself, as pipelines take them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.delivery import every_nth
from ..operators.samples import rechunk
from .registry import processor


@processor(inputs={"in": "latest"}, outputs=("out",), description="the newest frame of each tick")
def newest(inputs, n: int = 1):
    return {"out": every_nth(inputs["in"], n)}


@processor(inputs={"audio": "lossless"}, outputs=("chunks",), description="samples in chunks of one size")
def rechunked(inputs, size: int = 512):
    return {"chunks": rechunk(inputs["audio"], size)}


@processor(outputs=("out",), execution="continuous", interval_ms=33, description="numbered ticks of a clock")
def ticks(inputs, spark, n: int = 1000, interval_ms: int = 33):
    seq = F.col("id")
    return {"out": spark.range(n).select(F.lit("tick").alias("channel"), seq.alias("seq"), (seq * interval_ms * 1_000_000).alias("timestamp_ns"), seq.alias("tick"))}
