"""Running numbers, sums, maxima and last values of a stream, without one task per stream.

A window over a stream as a whole would walk a busy channel in one task. Here the order column is cut into buckets: a
window inside each (stream, bucket), a window over one row per bucket for what the buckets before it bring, and a join of
the two. Buckets of WIDTH order numbers keep both windows short; an order column in other units than row numbers needs a
width in its own units, such that a bucket holds many rows and a stream many buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timing import whole

WIDTH = 100_000


def _running(df: DataFrame, key: str, order: str, out: str, inside: Column, total: Column, carry, combine, width: int, inclusive: bool = True, by: list[str] | None = None) -> DataFrame:
    """by: the order inside a bucket, where order is only what buckets are cut by; inside: window function of rows up to the row's own (or before it); total: aggregate of a bucket; carry: of totals; combine: of both."""
    cut = df.withColumn("_run_bucket", whole(F.col(order), width))
    w = Window.partitionBy(key, "_run_bucket").orderBy(*(by or [order])).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    totals = cut.groupBy(key, "_run_bucket").agg(total.alias("_run_total"))
    before = carry(F.col("_run_total")).over(Window.partitionBy(key).orderBy("_run_bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.select(F.col(key).alias("_run_key"), F.col("_run_bucket").alias("_run_at"), before.alias("_run_before"))
    rows = cut.withColumn("_run_inside", inside.over(w)).join(carried, F.col(key).eqNullSafe(F.col("_run_key")) & F.col("_run_bucket").eqNullSafe(F.col("_run_at")))
    return rows.withColumn(out, combine(F.col("_run_before"), F.col("_run_inside"))).drop("_run_bucket", "_run_inside", "_run_key", "_run_at", "_run_before")


def numbered(df: DataFrame, key: str, order: str = "seq", out: str = "n", width: int = WIDTH, by: list[str] | None = None) -> DataFrame:
    """out: the row's number in its stream, from 0."""
    zero = lambda x: F.coalesce(x, F.lit(0))
    return _running(df, key, order, out, F.count(F.lit(1)), F.count(F.lit(1)), F.sum, lambda c, i: zero(c) + i - 1, width, by=by)


def running_sum(df: DataFrame, key: str, value: Column, order: str = "seq", out: str = "sum", inclusive: bool = True, width: int = WIDTH, by: list[str] | None = None) -> DataFrame:
    zero = lambda x: F.coalesce(x, F.lit(0))
    return _running(df, key, order, out, F.sum(value), F.sum(value), F.sum, lambda c, i: zero(c) + zero(i), width, inclusive, by)


def running_max(df: DataFrame, key: str, value: Column, order: str = "seq", out: str = "max", inclusive: bool = True, width: int = WIDTH) -> DataFrame:
    return _running(df, key, order, out, F.max(value), F.max(value), F.max, lambda c, i: F.greatest(c, i), width, inclusive)


def running_last(df: DataFrame, key: str, column: str, order: str = "seq", out: str = "last", inclusive: bool = True, width: int = WIDTH) -> DataFrame:
    """out: the last value that was there, up to and including the row's own (or before it)."""
    newest = F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))
    return _running(df, key, order, out, F.last(column, ignorenulls=True), newest, lambda t: F.last(t, ignorenulls=True), lambda c, i: F.coalesce(i, c), width, inclusive)
