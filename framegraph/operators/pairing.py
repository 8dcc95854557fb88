"""Join-shaped operators over timestamped streams: zip, interval, as-of, fan-in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timing import whole
from .running import numbered


def zip_streams(left: DataFrame, right: DataFrame, key: str | None = None) -> DataFrame:
    """The k-th frame of one side with the k-th of the other, as (l, r, timestamp_ns); ends with the shorter side.

    Each side needs timestamp_ns and seq; with a key, streams are zipped per key.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df if key else df.withColumn("_one", F.lit(1))
        at = key or "_one"
        return numbered(rows, at).select(F.col(at).alias("key"), "n", F.struct(*df.columns).alias(name))

    both = side(left, "l").join(side(right, "r"), ["key", "n"])
    return both.withColumn("timestamp_ns", F.greatest("l.timestamp_ns", "r.timestamp_ns"))


def interval_pairs(left: DataFrame, right: DataFrame, tolerance_ns: int) -> DataFrame:
    """All (l_seq, r_seq, l_ts, r_ts) with timestamps at most the tolerance apart.

    Timestamps fall into buckets as wide as the tolerance; the right side goes to its bucket and both neighbours, so the
    join is an equi-join on the bucket with a filter.
    """
    l_ = left.select(F.col("seq").alias("l_seq"), F.col("timestamp_ns").alias("l_ts"), whole(F.col("timestamp_ns"), max(tolerance_ns, 1)).alias("bucket"))
    near = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: whole(F.col("timestamp_ns"), max(tolerance_ns, 1)) + d))
    r_ = right.select(F.col("seq").alias("r_seq"), F.col("timestamp_ns").alias("r_ts"), near.alias("bucket"))
    return l_.join(r_, "bucket").where(F.abs(F.col("l_ts") - F.col("r_ts")) <= tolerance_ns).drop("bucket")


def asof(left: DataFrame, right: DataFrame, bucket_ns: int, value: str = "seq") -> DataFrame:
    """left with r_ts and r_<value>: the newest right row not later than it; null where there is none.

    Time is cut into buckets. Inside a bucket the last right row so far is found by a window over the bucket; a left
    row before its bucket's first right row takes the last one of the buckets before, which a window over one row a
    bucket carries on. No window spans the streams.
    """
    tag = lambda df, side: df.select(F.col("timestamp_ns").alias("t"), F.col("seq"), F.lit(side).alias("side"), (F.col(value) if side == 0 else F.lit(None)).cast("long").alias("v"), whole(F.col("timestamp_ns"), bucket_ns).alias("b"))
    both = tag(right, 0).unionByName(tag(left, 1))
    inside = Window.partitionBy("b").orderBy("t", "side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.when(F.col("side") == 0, F.struct(F.col("t").alias("r_ts"), F.col("v").alias("r_v")))
    found = both.withColumn("hit", F.last(hit, ignorenulls=True).over(inside)).where("side = 1")
    ends = tag(right, 0).groupBy("b").agg(F.max_by(F.struct(F.col("t").alias("r_ts"), F.col("v").alias("r_v")), F.struct("t", "seq")).alias("end"))
    buckets = tag(left, 1).select("b").distinct().join(ends, "b", "full")
    carried = buckets.withColumn("carried", F.last("end", ignorenulls=True).over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).select("b", "carried")
    out = found.join(carried, "b", "left").withColumn("hit", F.coalesce("hit", "carried"))
    return out.select("seq", F.col("t").alias("timestamp_ns"), F.col("hit.r_ts").alias("r_ts"), F.col("hit.r_v").alias(f"r_{value}"))


def fan_in(*streams: DataFrame) -> DataFrame:
    """Several links into one port: one stream, columns that one lacks being null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)
