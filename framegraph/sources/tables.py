"""The stream-graph tables as seen through the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timing import whole
from ..operators.running import numbered

HOUR_NS = 3_600_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def processors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, display_name, ord, parent (id or null), balance: regions, nations, customers and suppliers as vertices."""
    r, n, c, s = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))

    def part(df: DataFrame, kind: str, base: int, key: str, name: str, parent, balance) -> DataFrame:
        return df.select(F.concat(F.lit(kind + "/"), F.col(key)).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("display_name"), (F.lit(base) + F.col(key).cast("long")).alias("ord"), parent.alias("parent"), balance.alias("balance"))

    none = F.lit(None).cast("string"), F.lit(None).cast("double")
    return (
        part(r, "Region", 0, "r_regionkey", "r_name", *none)
        .unionByName(part(n, "Nation", 1_000, "n_nationkey", "n_name", F.concat(F.lit("Region/"), F.col("n_regionkey")), none[1]))
        .unionByName(part(c, "Customer", 10_000_000_000, "c_custkey", "c_name", F.concat(F.lit("Nation/"), F.col("c_nationkey")), F.col("c_acctbal")))
        .unionByName(part(s, "Supplier", 20_000_000_000, "s_suppkey", "s_name", F.concat(F.lit("Nation/"), F.col("s_nationkey")), F.col("s_acctbal")))
    )


P = """p AS (
  SELECT 'Region/' || r_regionkey AS id, 'Region' AS type, r_name AS display_name, CAST(r_regionkey AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS DOUBLE) AS balance FROM region
  UNION ALL SELECT 'Nation/' || n_nationkey, 'Nation', n_name, 1000 + n_nationkey, 'Region/' || n_regionkey, NULL FROM nation
  UNION ALL SELECT 'Customer/' || c_custkey, 'Customer', c_name, 10000000000 + c_custkey, 'Nation/' || c_nationkey, c_acctbal FROM customer
  UNION ALL SELECT 'Supplier/' || s_suppkey, 'Supplier', s_name, 20000000000 + s_suppkey, 'Nation/' || s_nationkey, s_acctbal FROM supplier)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, src_id, src_port, dst_id, dst_port, capacity, state, ord: every vertex with a parent sends to it."""
    p = processors(spark, sf_dir).where("parent is not null")
    port = F.when(F.col("type") == "Supplier", "in2").otherwise("in1")
    return p.select(F.concat(F.lit("link/"), F.col("id")).alias("id"), F.col("id").alias("src_id"), F.lit("out1").alias("src_port"), F.col("parent").alias("dst_id"), port.alias("dst_port"), F.lit(4).alias("capacity"), F.lit("Wired").alias("state"), "ord")


L = """l AS (
  SELECT 'link/' || id AS id, id AS src_id, 'out1' AS src_port, parent AS dst_id, CASE WHEN type = 'Supplier' THEN 'in2' ELSE 'in1' END AS dst_port,
         4 AS capacity, 'Wired' AS state, ord FROM p WHERE parent IS NOT NULL)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, seq, timestamp_ns, payload, len (76-byte header included), tick of an hour, user_id, value."""
    e = read(spark, sf_dir, "events")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return e.select(F.col("event_type").alias("channel"), F.col("event_id").alias("seq"), ns.alias("timestamp_ns"), F.col("props").alias("payload"), (F.octet_length("props") + 76).alias("len"), whole(ns, HOUR_NS).alias("tick"), "user_id", "value")


FR = f"""f AS (
  SELECT event_type AS channel, event_id AS seq, epoch_us(ts) * 1000 AS timestamp_ns, props AS payload, strlen(props) + 76 AS len,
         epoch_us(ts) * 1000 // {HOUR_NS} AS tick, user_id, value FROM events)"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """processor_id, frames_processed, frames_dropped, throughput_fps per user of events."""
    f = frames(spark, sf_dir)
    span = (F.max("timestamp_ns") - F.min("timestamp_ns")) / 1e9
    return f.groupBy(F.col("user_id").alias("processor_id")).agg(
        F.count("*").alias("frames_processed"), F.count_if(F.col("channel") == "error").alias("frames_dropped"),
        F.when(span > 0, F.count("*") / span).alias("throughput_fps"),
    )


#: Latencies (ms) of a bucket in which they are ranked.
LATENCY_WIDTH = 5


def percentiles(values: DataFrame, key: str, value: str, shares: dict[str, float], width: int = LATENCY_WIDTH) -> DataFrame:
    """Exact percentiles per key, linear between neighbouring ranks, null values left out.

    Values are ranked in buckets of their size with a carry, so no task holds all values of a busy key.
    """
    there = values.where(F.col(value).isNotNull()).select(key, value)
    ranked = numbered(there.withColumn("_size", F.floor(value).cast("long")), key, "_size", "_rank", width, by=[value])
    last = there.groupBy(F.col(key).alias("_key")).agg((F.count("*") - 1).alias("_last"))
    rows = ranked.join(last, F.col(key).eqNullSafe(F.col("_key")))

    def at(share: float):
        place = F.col("_last") * F.lit(share)
        own = lambda k: F.max(F.when(F.col("_rank") == k, F.col(value)))
        low, high = own(F.floor(place)), own(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return rows.groupBy(key).agg(*(at(share).alias(name) for name, share in shares.items()))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """counters with latency_p50_ms and latency_p99_ms."""
    f = frames(spark, sf_dir).select(F.col("user_id").alias("processor_id"), "value")
    return counters(spark, sf_dir).join(percentiles(f, "processor_id", "value", {"latency_p50_ms": 0.5, "latency_p99_ms": 0.99}), "processor_id", "left")


M = """m AS (
  SELECT user_id AS processor_id, count(*) AS frames_processed, count(*) FILTER (channel = 'error') AS frames_dropped,
         quantile_cont(value, 0.5) AS latency_p50_ms, quantile_cont(value, 0.99) AS latency_p99_ms,
         CASE WHEN max(timestamp_ns) > min(timestamp_ns) THEN count(*) / ((max(timestamp_ns) - min(timestamp_ns)) / 1e9) END AS throughput_fps
  FROM f GROUP BY user_id)"""


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, seq, samples (64), timestamp_ns: one frame per embedding, 10 ms apart."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("stream"), F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("samples"), (F.col("vec_id") * 10_000_000).alias("timestamp_ns"))


A = "a AS (SELECT label AS stream, vec_id AS seq, CAST(embedding AS DOUBLE[]) AS samples, vec_id * 10000000 AS timestamp_ns FROM embeddings)"


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records over events: level by event type, attrs from props."""
    f = frames(spark, sf_dir)
    level = F.when(F.col("channel") == "error", "error").when(F.col("channel") == "purchase", "warn").when(F.col("channel") == "view", "debug").when(F.col("channel") == "click", "trace").otherwise("info")
    return f.select(
        F.lit(1).alias("schema_version"), F.col("timestamp_ns").alias("host_ts"), F.concat(F.lit("run"), F.col("user_id") % 3).alias("runtime_id"),
        F.when(F.col("seq") % 2 == 0, "rust").otherwise("python").alias("source"), level.alias("level"), F.concat(F.lit("event "), F.col("channel")).alias("message"), F.lit("core").alias("target"),
        F.when(F.col("seq") % 5 == 0, F.concat(F.lit("pipe"), F.col("seq") % 4)).alias("pipeline_id"), F.col("user_id").cast("string").alias("processor_id"),
        F.when(F.col("seq") % 7 == 0, "draw").alias("rhi_op"), F.col("seq").alias("source_seq"), (F.col("seq") % 11 == 0).alias("intercepted"), "channel", F.col("payload").alias("attrs"),
    )


LG = """g AS (
  SELECT 1 AS schema_version, timestamp_ns AS host_ts, 'run' || (user_id % 3) AS runtime_id, CASE WHEN seq % 2 = 0 THEN 'rust' ELSE 'python' END AS source,
         CASE channel WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'view' THEN 'debug' WHEN 'click' THEN 'trace' ELSE 'info' END AS level,
         'event ' || channel AS message, 'core' AS target, CASE WHEN seq % 5 = 0 THEN 'pipe' || (seq % 4) END AS pipeline_id, CAST(user_id AS VARCHAR) AS processor_id,
         CASE WHEN seq % 7 = 0 THEN 'draw' END AS rhi_op, seq AS source_seq, seq % 11 = 0 AS intercepted, channel, payload AS attrs FROM f)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
