"""Queries over frames on links: profiles, taps, sampling, pairing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delivery as d
from ..operators import pairing as j
from ..sources.tables import FR, frames, with_
from .catalog import query

W = with_(FR)
COLS = ("channel", "seq", "tick")


@query("st_latest", W + "SELECT channel, tick, max(seq) AS seq, arg_max(payload, seq) AS payload, count(*) AS arrived FROM f GROUP BY channel, tick")
def st_latest(spark, sf):
    return d.latest(frames(spark, sf).select(*COLS, "payload"))


@query("st_every_sample", W + ", r AS (SELECT *, row_number() OVER (PARTITION BY channel, tick ORDER BY seq DESC) AS r, count(*) OVER (PARTITION BY channel, tick) AS n FROM f) SELECT channel, seq, tick, greatest(n - 4, 0) AS dropped FROM r WHERE r <= 4")
def st_every_sample(spark, sf):
    return d.every_sample(frames(spark, sf).select(*COLS), 4)


@query("st_lossless", W + "SELECT channel, seq, tick, row_number() OVER (PARTITION BY channel, tick ORDER BY seq) AS place FROM f")
def st_lossless(spark, sf):
    return d.lossless(frames(spark, sf).select(*COLS))


@query("st_tap", W + ", r AS (SELECT *, row_number() OVER (PARTITION BY channel, tick ORDER BY seq) AS r FROM f) SELECT channel, seq, tick FROM r WHERE r <= 3")
def st_tap(spark, sf):
    return d.tap(frames(spark, sf).select(*COLS), 3)


@query("st_log_drop_oldest", W + ", r AS (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY seq DESC) AS r, count(*) OVER (PARTITION BY tick) AS n FROM f) SELECT channel, seq, tick, greatest(n - 8, 0) AS dropped FROM r WHERE r <= 8")
def st_log_drop_oldest(spark, sf):
    return d.every_sample(frames(spark, sf).select(*COLS), 8, "tick")


@query("st_pause_resume", W + "SELECT channel, seq, tick FROM f WHERE NOT (channel = 'view' AND tick - (SELECT min(tick) FROM f) BETWEEN 24 AND 47) AND NOT (channel = 'click' AND tick - (SELECT min(tick) FROM f) < 12)")
def st_pause_resume(spark, sf):
    f = frames(spark, sf).select(*COLS)
    t0 = f.agg(F.min("tick").alias("t0"))
    spans = spark.createDataFrame([("view", 24, 48), ("click", 0, 12)], "channel string, a long, b long")
    pauses = t0.join(spans).select("channel", (F.col("t0") + F.col("a")).alias("from_tick"), (F.col("t0") + F.col("b")).alias("to_tick"))
    return d.outside_pauses(f, pauses)


@query("st_frame_hold", W + "SELECT channel, seq, last_value(CASE WHEN value > 30 THEN value END IGNORE NULLS) OVER (PARTITION BY channel ORDER BY seq) AS held FROM f")
def st_frame_hold(spark, sf):
    f = frames(spark, sf).select("channel", "seq", F.when(F.col("value") > 30, F.col("value")).alias("big"))
    return d.hold_last(f, "big").select("channel", "seq", "held")


@query("st_state_machine", W + "SELECT user_id AS id, arg_max(CASE channel WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'Running' WHEN 'purchase' THEN 'Paused' ELSE 'Idle' END, seq) AS state FROM f GROUP BY user_id")
def st_state_machine(spark, sf):
    state = F.when(F.col("channel") == "error", "Error").when(F.col("channel") == "signup", "Running").when(F.col("channel") == "purchase", "Paused").otherwise("Idle")
    return frames(spark, sf).groupBy(F.col("user_id").alias("id")).agg(F.max_by(state, "seq").alias("state"))


@query("st_clock_tick", "SELECT i AS tick_number, i * 10666666 AS timestamp_ns, 512 AS samples_needed, 48000 AS sample_rate FROM range(1000) AS t(i)")
def st_clock_tick(spark, sf):
    return spark.range(1000).select(F.col("id").alias("tick_number"), (F.col("id") * 10666666).alias("timestamp_ns"), F.lit(512).alias("samples_needed"), F.lit(48000).alias("sample_rate"))


@query("st_timer", W + "SELECT seq, greatest((timestamp_ns - (SELECT min(timestamp_ns) FROM f)) // 5000000000, 0) AS expired FROM f")
def st_timer(spark, sf):
    from ..functions.timing import expirations

    f = frames(spark, sf)
    return f.join(F.broadcast(f.agg(F.min("timestamp_ns").alias("t0")))).select("seq", expirations(F.col("timestamp_ns"), F.col("t0"), 5_000_000_000).alias("expired"))  # one row


@query("src_tap", W + "SELECT seq, payload FROM f WHERE channel = 'view' ORDER BY timestamp_ns, seq LIMIT 8")
def src_tap(spark, sf):
    return d.bounded_sample(frames(spark, sf).where("channel = 'view'")).select("seq", "payload")


@query("lim_sample", W + "SELECT seq FROM f ORDER BY timestamp_ns, seq LIMIT 1024")
def lim_sample(spark, sf):
    return d.bounded_sample(frames(spark, sf), 5000).select("seq")


@query("lim_sample_least", W + "SELECT seq FROM f ORDER BY timestamp_ns, seq LIMIT 1")
def lim_sample_least(spark, sf):
    return d.bounded_sample(frames(spark, sf), 0).select("seq")


@query("lim_window", W + "SELECT seq FROM f WHERE timestamp_ns < (SELECT min(timestamp_ns) FROM f) + 3600000000000 ORDER BY timestamp_ns, seq LIMIT 16")
def lim_window(spark, sf):
    return d.sample_window(frames(spark, sf), 16, 3_600_000_000_000).select("seq")


@query("lim_tap_zero", W + "SELECT seq FROM f LIMIT 0")
def lim_tap_zero(spark, sf):
    return frames(spark, sf).select("seq").limit(0)


@query("flt_admission", W + """, c AS (SELECT *, len <= 84 AS admitted, max(CASE WHEN len <= 84 THEN len END) OVER (PARTITION BY channel ORDER BY seq) AS top FROM f),
k AS (SELECT *, CASE WHEN top > 16 THEN 1::BIGINT << CAST(len(bin(top - 1)) AS INT) ELSE 16 END AS capacity FROM c)
SELECT channel, seq, admitted, capacity, capacity > 21 AND NOT coalesce(lag(capacity > 21) OVER (PARTITION BY channel ORDER BY seq), false) AS crossed FROM k""")
def flt_admission(spark, sf):
    return d.admission(frames(spark, sf), ceiling=84, first_capacity=16).select("channel", "seq", "admitted", "capacity", "crossed")


@query("flt_topic", W + "SELECT seq FROM f WHERE channel = 'error'")
def flt_topic(spark, sf):
    return d.topic(frames(spark, sf), "error").select("seq")


@query("src_events", W + "SELECT channel, seq FROM f")
def src_events(spark, sf):
    return d.topic(frames(spark, sf), "*").select("channel", "seq")


@query("flt_event_size", W + "SELECT seq FROM f WHERE strlen(payload) * 1000 <= 8192")
def flt_event_size(spark, sf):
    return d.within_size(frames(spark, sf), F.repeat("payload", F.lit(1000))).select("seq")


@query("flt_channel_src", W + "SELECT DISTINCT 'user' || (user_id % 5) || '/' || channel AS name FROM f WHERE 'user' || (user_id % 5) || '/' || channel = 'user3/view'")
def flt_channel_src(spark, sf):
    from ..functions.text import channel_name

    name = channel_name(F.concat(F.lit("USER"), (F.col("user_id") % 5).cast("string")), F.col("channel"))
    return frames(spark, sf).select(name.alias("name")).where(F.col("name") == "user3/view").distinct()


@query("win_every_n", W + ", r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY seq) AS r FROM f) SELECT channel, seq FROM r WHERE r % 30 = 0")
def win_every_n(spark, sf):
    return d.every_nth(frames(spark, sf)).select("channel", "seq")


def spaced(ns: int) -> str:
    """Frames of each channel at least so far after the last one taken."""
    return "WITH RECURSIVE " + FR + f""", o AS (SELECT channel, seq, timestamp_ns, row_number() OVER (PARTITION BY channel ORDER BY timestamp_ns, seq) AS r FROM f),
k AS (SELECT channel, seq, timestamp_ns FROM o WHERE r = 1
      UNION ALL SELECT n.channel, n.seq, n.timestamp_ns FROM (SELECT o.channel, o.seq, o.timestamp_ns, row_number() OVER (PARTITION BY o.channel ORDER BY o.timestamp_ns, o.seq) AS q FROM k JOIN o ON o.channel = k.channel AND o.timestamp_ns >= k.timestamp_ns + {ns}) n WHERE q = 1)
SELECT channel, seq FROM k"""


@query("win_every_duration", spaced(86_400_000_000_000))
def win_every_duration(spark, sf):
    return d.every_interval(frames(spark, sf).select("channel", "seq", "timestamp_ns"), 86_400_000_000_000).select("channel", "seq")


@query("st_sample_drop_busy", spaced(36_000_000_000_000))
def st_sample_drop_busy(spark, sf):
    return d.drop_busy(frames(spark, sf).select("channel", "seq", "timestamp_ns"), 36_000_000_000_000).select("channel", "seq")


@query("win_keep_last_k", W + ", r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY seq DESC) AS r FROM f) SELECT channel, seq FROM r WHERE r <= 8")
def win_keep_last_k(spark, sf):
    return d.keep_last(frames(spark, sf)).select("channel", "seq")


@query("win_frame_index", W + "SELECT channel, seq, CAST(row_number() OVER (PARTITION BY channel ORDER BY seq) - 1 AS VARCHAR) AS frame_index FROM f")
def win_frame_index(spark, sf):
    return d.frame_index(frames(spark, sf)).select("channel", "seq", "frame_index")


@query("agg_frame_count", W + "SELECT channel, count(*) AS n, min(seq) AS first_seq, arg_min(payload, seq) AS first_payload FROM f GROUP BY channel")
def agg_frame_count(spark, sf):
    return frames(spark, sf).groupBy("channel").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.min_by("payload", "seq").alias("first_payload"))


@query("snk_frame_counter", W + "SELECT count(*) AS n, arg_min(payload, seq) AS first_payload FROM f WHERE channel = 'view'")
def snk_frame_counter(spark, sf):
    return frames(spark, sf).where("channel = 'view'").agg(F.count("*").alias("n"), F.min_by("payload", "seq").alias("first_payload"))


FILES = "files AS (SELECT o_custkey AS dir, CAST(o_orderkey AS VARCHAR) AS path, o_orderkey AS mtime, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders)"
KEPT = """, r AS (SELECT *, row_number() OVER w AS n, sum(size) OVER (PARTITION BY dir ORDER BY mtime DESC, path DESC ROWS UNBOUNDED PRECEDING) AS b FROM files WINDOW w AS (PARTITION BY dir ORDER BY mtime DESC, path DESC))"""


def _files(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select(F.col("o_custkey").alias("dir"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderkey").alias("mtime"), F.floor("o_totalprice").cast("long").alias("size"))


@query("agg_evict", with_(FILES) + KEPT + " SELECT path, n <= 6 AND b <= 800000 AS kept FROM r")
def agg_evict(spark, sf):
    return d.evict(_files(spark, sf), 6, 800_000).select("path", "kept")


@query("snk_frame_tap", with_(FILES) + KEPT + " SELECT dir, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM r WHERE n <= 6 AND b <= 800000 GROUP BY dir")
def snk_frame_tap(spark, sf):
    return d.evict(_files(spark, sf), 6, 800_000).where("kept").groupBy("dir").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("agg_dropped_logs", "WITH RECURSIVE " + FR + """, c AS (SELECT user_id AS source, timestamp_ns, CAST(sum(CASE WHEN channel = 'error' THEN 40 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY timestamp_ns, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS dropped FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY timestamp_ns, dropped) AS r FROM c),
w AS (SELECT source, CAST(0 AS BIGINT) AS r, timestamp_ns, CAST(0 AS BIGINT) AS seen, timestamp_ns AS last, CAST(0 AS BIGINT) AS new_drops FROM o WHERE r = 1
  UNION ALL
  SELECT source, r, timestamp_ns, CASE WHEN told THEN dropped ELSE seen END, CASE WHEN told THEN timestamp_ns ELSE last END, CASE WHEN told THEN dropped - seen ELSE 0 END
  FROM (SELECT o.source, o.r, o.timestamp_ns, o.dropped, w.seen, w.last, o.dropped > w.seen AND (o.timestamp_ns - w.last >= 86400000000000 OR o.dropped - w.seen >= 1000) AS told FROM w JOIN o ON o.source = w.source AND o.r = w.r + 1))
SELECT source, timestamp_ns, new_drops FROM w WHERE new_drops > 0""")
def agg_dropped_logs(spark, sf):
    from ..operators.running import running_sum

    f = frames(spark, sf).select(F.col("user_id").alias("source"), "timestamp_ns", "channel", "seq")
    # cumulative in the order of (timestamp_ns, seq), a day a bucket
    c = running_sum(f, "source", F.when(F.col("channel") == "error", 40).otherwise(0), "timestamp_ns", "dropped", width=86_400_000_000_000, by=["timestamp_ns", "seq"])
    return d.dropped_reports(c, 86_400_000_000_000).select("source", "timestamp_ns", "new_drops")


@query("st_ring_two_level", "WITH RECURSIVE " + FR + """, k AS (SELECT channel, seq, tick, row_number() OVER (PARTITION BY channel, tick ORDER BY seq DESC) AS back FROM f),
e AS (SELECT channel, seq, tick, row_number() OVER (PARTITION BY channel ORDER BY tick, seq) - 1 AS e FROM k WHERE back <= 3),
t AS (SELECT channel, tick, max(e) + 1 AS came, row_number() OVER (PARTITION BY channel ORDER BY tick) AS r FROM e GROUP BY channel, tick),
w AS (SELECT channel, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS tick, CAST(0 AS BIGINT) AS head, CAST(0 AS BIGINT) AS stop FROM t WHERE r = 1
  UNION ALL SELECT t.channel, t.r, t.tick, greatest(w.stop, t.came - 3), least(t.came, greatest(w.stop, t.came - 3) + 2) FROM w JOIN t ON t.channel = w.channel AND t.r = w.r + 1)
SELECT e.channel, e.seq, e.tick, w.tick AS read_tick FROM e JOIN w ON w.channel = e.channel AND w.r > 0 AND e.e >= w.head AND e.e < w.stop""")
def st_ring_two_level(spark, sf):
    return d.two_level(frames(spark, sf).select(*COLS), 3, 2)


@query("set_fanin", W + "SELECT seq, channel, payload FROM f WHERE channel = 'view' UNION ALL SELECT seq, channel, NULL FROM f WHERE channel = 'click'")
def set_fanin(spark, sf):
    f = frames(spark, sf)
    return j.fan_in(f.where("channel = 'view'").select("seq", "channel", "payload"), f.where("channel = 'click'").select("seq", "channel"))


@query("set_fanout", W + "SELECT seq, s AS subscriber FROM f, (VALUES ('a'), ('b'), ('tap')) AS t(s) WHERE channel = 'view'")
def set_fanout(spark, sf):
    return frames(spark, sf).where("channel = 'view'").select("seq", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("tap"))).alias("subscriber"))


@query("jn_zip", W + """, l AS (SELECT seq, timestamp_ns, row_number() OVER (ORDER BY seq) AS n FROM f WHERE channel = 'view'), r AS (SELECT seq, timestamp_ns, row_number() OVER (ORDER BY seq) AS n FROM f WHERE channel = 'click')
SELECT l.seq AS l_seq, r.seq AS r_seq, greatest(l.timestamp_ns, r.timestamp_ns) AS timestamp_ns FROM l JOIN r USING (n)""")
def jn_zip(spark, sf):
    f = frames(spark, sf).select("channel", "seq", "timestamp_ns")
    both = j.zip_streams(f.where("channel = 'view'"), f.where("channel = 'click'"))
    return both.select(F.col("l.seq").alias("l_seq"), F.col("r.seq").alias("r_seq"), "timestamp_ns")


@query("jn_interval", W + "SELECT l.seq AS l_seq, r.seq AS r_seq, l.timestamp_ns AS l_ts, r.timestamp_ns AS r_ts FROM f l JOIN f r ON abs(l.timestamp_ns - r.timestamp_ns) <= 60000000000 WHERE l.channel = 'view' AND r.channel = 'click'")
def jn_interval(spark, sf):
    f = frames(spark, sf)
    return j.interval_pairs(f.where("channel = 'view'"), f.where("channel = 'click'"), 60_000_000_000)


ASOF = W + """, v AS (SELECT * FROM f WHERE channel = 'view'), c AS (SELECT * FROM f WHERE channel = 'click'),
x AS (SELECT v.seq, v.timestamp_ns, c.timestamp_ns AS r_ts, c.seq AS r_seq FROM v ASOF LEFT JOIN c ON v.timestamp_ns >= c.timestamp_ns)"""


@query("jn_asof", ASOF + " SELECT * FROM x")
def jn_asof(spark, sf):
    f = frames(spark, sf)
    return j.asof(f.where("channel = 'view'"), f.where("channel = 'click'"), 3_600_000_000_000)


@query("agg_drift", ASOF + " SELECT count(*) AS pairs, count(*) FILTER (abs(timestamp_ns - r_ts) / 1e6 <= 60000) AS in_sync, round(avg(abs(timestamp_ns - r_ts) / 1e6), 3) AS mean_drift_ms FROM x WHERE r_ts IS NOT NULL")
def agg_drift(spark, sf):
    from ..functions.timing import delta_ms, is_synced

    x = jn_asof(spark, sf).where("r_ts is not null")
    a, b = F.col("timestamp_ns"), F.col("r_ts")
    return x.agg(F.count("*").alias("pairs"), F.count_if(is_synced(a, b, 60_000.0)).alias("in_sync"), F.round(F.avg(delta_ms(a, b)), 3).alias("mean_drift_ms"))


@query("prj_read_ts", W + "SELECT seq, timestamp_ns, payload FROM f")
def prj_read_ts(spark, sf):
    return frames(spark, sf).select("seq", "timestamp_ns", "payload")


@query("prj_typed_read", W + "SELECT seq, CAST(json_extract(payload, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM f")
def prj_typed_read(spark, sf):
    bag = F.parse_json("payload")
    return frames(spark, sf).select("seq", F.variant_get(bag, "$.k", "bigint").alias("k"), F.try_variant_get(bag, "$.none", "string").alias("missing"))


@query("sc_next_required_len", W + "SELECT channel, arg_min(len, seq) AS in_order, arg_max(len, seq) AS newest FROM f GROUP BY channel")
def sc_next_required_len(spark, sf):
    return frames(spark, sf).groupBy("channel").agg(F.min_by("len", "seq").alias("in_order"), F.max_by("len", "seq").alias("newest"))
