"""Queries over sample arrays, planes and control signals."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import audio as a
from ..operators import samples as s
from ..sources.tables import A, audio, with_
from .catalog import query

W = with_(A)


def _summary(name: str) -> tuple:
    """What an array holds, in columns that compare across engines."""
    x = F.col(name)
    weighted = F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda t, v: t + v)
    return F.size(x).cast("long").alias("n"), F.round(weighted, 6).alias("weighted"), F.round(F.get(x, 0), 6).alias("head"), F.round(F.get(x, F.size(x) - 1), 6).alias("tail")


def summary(x: str) -> str:
    return f"len({x}) AS n, round(coalesce(list_sum(list_transform({x}, lambda v, i: v * i)), 0), 6) AS weighted, round({x}[1], 6) AS head, round({x}[len({x})], 6) AS tail"


def _converted(source: int, target: int) -> None:
    if source == target:
        e = "samples"
    elif target == 1:
        e = f"list_transform(range(0, len(samples) // {source}), lambda i: (" + " + ".join(f"samples[i * {source} + {c + 1}]" for c in range(source)) + f") / {source}.0)"
    elif source == 1:
        e = "flatten(list_transform(samples, lambda v: [" + ", ".join(["v"] * target) + "]))"
    else:
        e = f"flatten(list_transform(range(0, len(samples) // {source}), lambda i: [" + ", ".join(f"samples[i * {source} + {c + 1}]" if c < source else "0.0" for c in range(target)) + "]))"

    @query(f"ar_convert_channels_{source}_{target}", W + f", y AS (SELECT seq, {e} AS y FROM a) SELECT seq, {summary('y')} FROM y")
    def run(spark, sf):
        return audio(spark, sf).select("seq", a.convert_channels(F.col("samples"), source, target).alias("y")).select("seq", *_summary("y"))


for _pair in ((2, 2), (1, 2), (2, 1), (1, 4), (4, 1), (2, 4), (4, 2), (4, 8)):
    _converted(*_pair)

PAIR = W + ", q AS (SELECT x.seq, x.samples AS l, y.samples AS r, greatest(x.timestamp_ns, y.timestamp_ns) AS timestamp_ns FROM a x JOIN a y ON y.seq = x.seq + 1)"


def _pair(spark, sf):
    x = audio(spark, sf)
    y = x.select((F.col("seq") - 1).alias("seq"), F.col("samples").alias("r"), F.col("timestamp_ns").alias("r_ts"))
    return x.join(y, "seq").select("seq", F.col("samples").alias("l"), "r", F.greatest("timestamp_ns", "r_ts").alias("timestamp_ns"))


@query("ar_interleave_mix", PAIR + f", y AS (SELECT seq, timestamp_ns, flatten(list_transform(list_zip(l, r), lambda v: [greatest(-1.0, least(1.0, v[1] * 4)), greatest(-1.0, least(1.0, v[2] * 4))])) AS y FROM q) SELECT seq, timestamp_ns, {summary('y')} FROM y")
def ar_interleave_mix(spark, sf):
    loud = lambda c: F.transform(c, lambda v: v * 4)
    y = _pair(spark, sf).select("seq", "timestamp_ns", a.interleave(loud("l"), loud("r"), clip=True).alias("y"))
    return y.select("seq", "timestamp_ns", *_summary("y"))


for _mode, _sql in (("duplicate", "[v, v, v]"), ("left", "[v, 0.0, 0.0]"), ("right", "[0.0, 0.0, v]")):

    @query(f"ar_mono_expand_{_mode}", W + f", y AS (SELECT seq, flatten(list_transform(samples, lambda v: {_sql})) AS y FROM a) SELECT seq, {summary('y')} FROM y")
    def _run(spark, sf, mode=_mode):
        return audio(spark, sf).select("seq", a.expand_mono(F.col("samples"), 3, mode).alias("y")).select("seq", *_summary("y"))


@query("ar_planar", W + ", y AS (SELECT seq, list_filter(samples, lambda v, i: (i - 1) % 4 = 2) AS y FROM a) SELECT seq, " + summary("y") + ", true AS back FROM y")
def ar_planar(spark, sf):
    rows = audio(spark, sf).withColumn("planes", a.planar(F.col("samples"), 4))
    return rows.select("seq", "samples", "planes", F.get("planes", 2).alias("y")).select("seq", *_summary("y"), (a.interleaved(F.col("planes")) == F.col("samples")).alias("back"))


FLAT = W + """, o AS (SELECT stream, seq, timestamp_ns, v, row_number() OVER (PARTITION BY stream ORDER BY seq, i) - 1 AS n FROM a, unnest(samples) WITH ORDINALITY AS u(v, i)),
c AS (SELECT stream, n // 100 AS chunk, list(v ORDER BY n) AS y, arg_max(timestamp_ns, n) AS timestamp_ns FROM o GROUP BY ALL)"""


@query("ar_rechunk", FLAT + f" SELECT stream, CAST(chunk AS BIGINT) AS chunk, timestamp_ns, {summary('y')} FROM c WHERE len(y) = 100")
def ar_rechunk(spark, sf):
    return s.rechunk(audio(spark, sf), 100).select("stream", "chunk", "timestamp_ns", *_summary("samples"))


@query("ar_rechunk_flush", FLAT + " SELECT stream, CAST(chunk AS BIGINT) AS chunk, timestamp_ns, len(y) AS n FROM c WHERE len(y) < 100")
def ar_rechunk_flush(spark, sf):
    out = s.rechunk(audio(spark, sf), 100, keep_tail=True).where(F.size("samples") < 100)
    return out.select("stream", "chunk", "timestamp_ns", F.size("samples").cast("long").alias("n"))


@query("ar_rechunk_single", FLAT + ", r AS (SELECT *, row_number() OVER (PARTITION BY stream, timestamp_ns ORDER BY chunk) AS r FROM c WHERE len(y) = 100) SELECT stream, CAST(chunk AS BIGINT) AS chunk, r AS call FROM r")
def ar_rechunk_single(spark, sf):
    """Which call gives a chunk, when a frame's call gives at most one and further calls follow with nothing new."""
    from pyspark.sql.window import Window

    out = s.rechunk(audio(spark, sf), 100)
    return out.select("stream", "chunk", F.row_number().over(Window.partitionBy("stream", "timestamp_ns").orderBy("chunk")).alias("call"))


#: Weight of tap m of a sample whose place lies `part` after a whole one, 32 taps, from a lower to a higher rate.
TAP = "(CASE WHEN part - m = 0 THEN 1.0::DOUBLE ELSE sin(pi() * (part - m)) / (pi() * (part - m)) END * (0.5::DOUBLE + 0.5::DOUBLE * cos(pi() / 16 * (part - m))))"
#: From frames fr(stream, seq, timestamp_ns, samples) of mono samples at 32 kHz to rs at 48 kHz; outputs wait for 16 samples.
RESAMPLED = f"""pl AS (SELECT *, CAST(coalesce(sum(len(samples)) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM fr),
sm AS (SELECT stream, a + i - 1 AS n, v FROM pl, unnest(samples) WITH ORDINALITY AS u(v, i)),
ask AS (SELECT stream, seq, timestamp_ns, CASE WHEN a > 16 THEN ((a - 16) * 48000 + 31999) // 32000 ELSE 0 END AS f, CASE WHEN a + len(samples) > 16 THEN ((a + len(samples) - 16) * 48000 + 31999) // 32000 ELSE 0 END AS t FROM pl),
j AS (SELECT stream, seq, j, j * 32000 // 48000 AS base, (j * 32000 % 48000) / 48000.0::DOUBLE AS part FROM ask, unnest(range(f, t)) AS u(j)),
y AS (SELECT j.stream, seq, j, sum(coalesce(v, 0.0::DOUBLE) * {TAP}) AS y FROM j, range(-15, 17) r(m) LEFT JOIN sm ON sm.stream = j.stream AND sm.n = base + m GROUP BY ALL),
yl AS (SELECT stream, seq, list(y ORDER BY j) AS y FROM y GROUP BY ALL),
rs AS (SELECT stream, seq, timestamp_ns, coalesce(y, []) AS samples FROM ask LEFT JOIN yl USING (stream, seq))"""


@query("ar_convert_pipeline", W + """, src AS (SELECT stream, seq, timestamp_ns, samples, (seq // 150) % 2 AS kind FROM a),
ch AS (SELECT *, coalesce(kind <> lag(kind) OVER (PARTITION BY stream ORDER BY seq), false) AS new FROM src),
se AS (SELECT *, CAST(sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM ch),
mono AS (SELECT {'s': stream, 'n': session} AS stream, seq, timestamp_ns, kind, CASE kind WHEN 0 THEN list_transform(range(0, len(samples) // 2), lambda i: (samples[i * 2 + 1] + samples[i * 2 + 2]) / 2.0) ELSE list_transform(range(0, len(samples) // 4), lambda i: (samples[i * 4 + 1] + samples[i * 4 + 2] + samples[i * 4 + 3] + samples[i * 4 + 4]) / 4.0) END AS samples FROM se),
fr AS (SELECT stream, seq, timestamp_ns, samples FROM mono WHERE kind = 0), """ + RESAMPLED + """,
al AS (SELECT * FROM rs UNION ALL SELECT stream, seq, timestamp_ns, samples FROM mono WHERE kind = 1),
o AS (SELECT stream, seq, timestamp_ns, v, row_number() OVER (PARTITION BY stream ORDER BY seq, i) - 1 AS n FROM al, unnest(samples) WITH ORDINALITY AS u(v, i)),
c AS (SELECT stream, n // 48 AS chunk, list(v ORDER BY n) AS y, arg_max(timestamp_ns, n) AS timestamp_ns FROM o GROUP BY ALL)
SELECT stream.s AS stream, stream.n AS session, CAST(chunk AS BIGINT) AS chunk, timestamp_ns, """ + summary("y") + " FROM c WHERE len(y) = 48")
def ar_convert_pipeline(spark, sf):
    """Streams that change between two channels at 32 kHz and four at 48 kHz, to mono chunks at 48 kHz."""
    from ..operators.resample import convert

    kind = F.floor(F.col("seq") / 150) % 2
    rows = audio(spark, sf).withColumn("rate", F.when(kind == 0, 32_000).otherwise(48_000)).withColumn("channels", F.when(kind == 0, 2).otherwise(4))
    out = convert(rows, [(32_000, 2), (48_000, 4)], 1, 48_000, 48)
    return out.select("stream", "session", "chunk", "timestamp_ns", *_summary("samples"))


@query("ar_resample_frame", W + ", y AS (SELECT seq, list_transform(range(0, len(samples) * 48000 // 32000), lambda j: list_sum(list_transform(range(-15, 17), lambda m: CASE WHEN j * 32000 // 48000 + m BETWEEN 0 AND len(samples) - 1 THEN samples[j * 32000 // 48000 + m + 1] ELSE 0.0 END * " + TAP.replace("part", "(j * 32000 % 48000) / 48000.0::DOUBLE") + "))) AS y FROM a) SELECT seq, " + summary("y") + " FROM y")
def ar_resample_frame(spark, sf):
    return audio(spark, sf).select("seq", a.resample_frame(F.col("samples"), 32_000, 48_000).alias("y")).select("seq", *_summary("y"))


@query("ar_resample", W + ", fr AS (SELECT * FROM a), " + RESAMPLED + " SELECT stream, seq, " + summary("samples") + " FROM rs")
def ar_resample(spark, sf):
    """Windowed-sinc resampling of whole streams."""
    from ..operators.resample import resample

    return resample(audio(spark, sf), 32_000, 48_000).select("stream", "seq", *_summary("samples"))


@query("flt_audio_match", W + ", b AS (SELECT stream, seq, 44100 + seq % 2 AS rate FROM a), h AS (SELECT stream, arg_min(rate, seq) AS first FROM b GROUP BY stream) SELECT stream, seq FROM b JOIN h USING (stream) WHERE rate = first")
def flt_audio_match(spark, sf):
    rows = audio(spark, sf).select("stream", "seq", (44_100 + F.col("seq") % 2).alias("rate"))
    return s.matching_first(rows, "rate").select("stream", "seq")


@query("win_first_param", W + "SELECT stream, seq, first_value(44100 + seq % 2) OVER (PARTITION BY stream ORDER BY seq) AS rate FROM a")
def win_first_param(spark, sf):
    rows = audio(spark, sf).select("stream", "seq", (44_100 + F.col("seq") % 2).alias("r"))
    head = rows.groupBy("stream").agg(F.min_by("r", "seq").alias("rate"))
    return rows.join(head, "stream").select("stream", "seq", "rate")


@query("ar_format_sessions", W + ", b AS (SELECT stream, seq, seq // 60 AS rate FROM a), c AS (SELECT *, coalesce(rate <> lag(rate) OVER (PARTITION BY stream ORDER BY seq), false) AS new FROM b) SELECT stream, seq, CAST(sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM c")
def ar_format_sessions(spark, sf):
    rows = audio(spark, sf).select("stream", "seq", F.floor(F.col("seq") / 60).alias("rate"))
    return s.format_sessions(rows, "rate").select("stream", "seq", "session")


T = "t AS (SELECT i / 16.0 AS t FROM range(64) r(i))"
WAVES = {"sine": "(sin(ph * 2 * pi()) + 1) / 2", "triangle": "CASE WHEN ph < 0.5 THEN ph * 2 ELSE 2 - ph * 2 END", "square": "CASE WHEN ph < 0.5 THEN 0.0 ELSE 1.0 END", "sawtooth": "ph"}


def _wave(name: str) -> None:
    @query(f"sc_{name}_lfo", f"WITH t AS (SELECT i / 16.0::DOUBLE AS t FROM range(64) r(i)), p AS (SELECT t, (t * 0.75::DOUBLE + 0.125) % 1 AS ph FROM t) SELECT t, round(CAST({WAVES[name]} AS DOUBLE), 6) AS y FROM p")
    def run(spark, sf):
        t = spark.range(64).select((F.col("id") / 16.0).alias("t"))
        return t.select("t", F.round(a.lfo(name, F.col("t"), F.lit(0.75), F.lit(0.125)), 6).alias("y"))


for _w in WAVES:
    _wave(_w)


@query("sc_ramp", "WITH t AS (SELECT i / 16.0::DOUBLE AS t FROM range(64) r(i)) SELECT t, round(CASE WHEN t < 1 THEN 0.25::DOUBLE WHEN t >= 3 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE + 0.5::DOUBLE * (t - 1) / 2 END, 6) AS y FROM t")
def sc_ramp(spark, sf):
    t = spark.range(64).select((F.col("id") / 16.0).alias("t"))
    return t.select("t", F.round(a.ramp(F.col("t"), F.lit(1.0), F.lit(2.0), F.lit(0.25), F.lit(0.75)), 6).alias("y"))


@query("sc_scale_range", W + "SELECT seq, round(-2 + samples[1] * 5, 6) AS y FROM a")
def sc_scale_range(spark, sf):
    return audio(spark, sf).select("seq", F.round(a.scale_range(F.get("samples", 0), F.lit(-2.0), F.lit(3.0)), 6).alias("y"))


@query("sc_clamp_sample", W + "SELECT seq, round(greatest(-1.0, least(1.0, samples[1] * 8)), 6) AS y FROM a")
def sc_clamp_sample(spark, sf):
    return audio(spark, sf).select("seq", F.round(a.clamp(F.get("samples", 0) * 8), 6).alias("y"))


@query("src_chord", "SELECT i AS sample, round((sin(" + f"{2 * math.pi * 261.63 / 48000!r}::DOUBLE * i) + sin({2 * math.pi * 329.63 / 48000!r}::DOUBLE * i) + sin({2 * math.pi * 392.00 / 48000!r}::DOUBLE * i)) * 0.15::DOUBLE, 6) AS y FROM range(4800) t(i)")
def src_chord(spark, sf):
    return spark.range(4800).select(F.col("id").alias("sample"), F.round(a.chord(F.col("id"), 48_000), 6).alias("y"))


@query("srt_schedule", "SELECT event_id AS ord, row_number() OVER (PARTITION BY user_id ORDER BY floor(value), event_id) AS place FROM events")
def srt_schedule(spark, sf):
    from pyspark.sql.window import Window

    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("event_id").alias("ord"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.floor("value"), "event_id")).alias("place"))


MODS = "md AS (SELECT s_suppkey % 10 AS param_id, (s_suppkey % 7) * 1.0::DOUBLE AS start, (s_suppkey % 7) + 2.0::DOUBLE AS e, s_nationkey * 1.0::DOUBLE AS lo, s_nationkey + 10.0::DOUBLE AS hi, s_suppkey AS ord FROM supplier)"


@query("ar_automation", f"WITH t AS (SELECT i / 4.0::DOUBLE AS t FROM range(40) r(i)), {MODS}, x AS (SELECT t, param_id, lo + (hi - lo) * (t - start) / (e - start) AS v, ord FROM t JOIN md ON t >= start AND t < e) SELECT t, param_id, round(arg_max(v, ord), 6) AS value FROM x GROUP BY ALL")
def ar_automation(spark, sf):
    t = spark.range(40).select((F.col("id") / 4.0).alias("t"))
    k = F.col("s_suppkey")
    mods = spark.read.parquet(f"{sf}/supplier.parquet").select((k % 10).alias("param_id"), (k % 7).cast("double").alias("start"), (k % 7 + 2.0).alias("end"), F.col("s_nationkey").cast("double").alias("lo"), (F.col("s_nationkey") + 10.0).alias("hi"), k.alias("ord"))
    return s.automate(t, mods).select("t", "param_id", F.round("value", 6).alias("value"))


PLANES = W + ", q AS (SELECT x.seq, list_transform(x.samples, lambda v: CAST(floor((v + 1) * 127) AS INT)) AS src, list_transform(y.samples, lambda v: CAST(floor((v + 1) * 127) AS INT)) AS recon FROM a x JOIN a y ON y.seq = x.seq + x.seq % 3), m AS (SELECT seq, list_sum(list_transform(list_zip(src, recon), lambda v: (v[1] - v[2]) * (v[1] - v[2]))) / 64.0 AS mse FROM q), d AS (SELECT seq, CASE WHEN mse <= 1e-10 THEN 100.0 ELSE 10 * log10(65025.0 / mse) END AS psnr FROM m)"


def _planes(spark, sf):
    q = audio(spark, sf).select("seq", F.transform("samples", lambda v: F.floor((v + 1) * 127).cast("int")).alias("src"))
    other = q.select(F.col("seq").alias("o"), F.col("src").alias("recon"))
    return q.join(other, F.col("o") == F.col("seq") + F.col("seq") % 3).drop("o")


@query("agg_psnr_plane", PLANES + " SELECT seq, round(psnr, 6) AS psnr FROM d")
def agg_psnr_plane(spark, sf):
    return s.psnr_planes(_planes(spark, sf), "seq").select("seq", F.round("psnr", 6).alias("psnr"))


@query("agg_psnr_frame", PLANES + " SELECT seq % 3 AS plane, round(avg(psnr), 6) AS psnr, count(*) AS frames FROM d GROUP BY ALL")
def agg_psnr_frame(spark, sf):
    """Mean of the planes' decibels."""
    d = s.psnr_planes(_planes(spark, sf), "seq")
    return d.groupBy((F.col("seq") % 3).alias("plane")).agg(F.round(F.avg("psnr"), 6).alias("psnr"), F.count("*").alias("frames"))


@query("agg_channel_mean", W + ", m AS (SELECT stream, avg(v) AS mean FROM a, unnest(samples) AS u(v) GROUP BY stream) SELECT stream, round(mean, 9) AS mean, abs(mean - 0.002) <= 0.005 AS ok FROM m")
def agg_channel_mean(spark, sf):
    m = audio(spark, sf).select("stream", F.explode("samples").alias("v")).groupBy("stream").agg(F.avg("v").alias("mean"))
    return m.select("stream", F.round("mean", 9).alias("mean"), (F.abs(F.col("mean") - 0.002) <= 0.005).alias("ok"))


#: One sample of a stream after the other: (stage, since) before it, its level, and what comes next.
ENVELOPE = """WITH RECURSIVE g AS (SELECT user_id AS stream, epoch_us(ts) AS t, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END AS up FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY t, CASE WHEN up IS NULL THEN 0 WHEN up THEN 2 ELSE 1 END) AS r FROM g),
w AS (SELECT stream, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS t, 'idle' AS stage, CAST(0 AS BIGINT) AS since, 0.0::DOUBLE AS level FROM (SELECT DISTINCT stream FROM o)
  UNION ALL
  SELECT stream, r, t, CASE WHEN share >= 1 THEN CASE now WHEN 'attack' THEN 'decay' WHEN 'decay' THEN 'sustain' WHEN 'release' THEN 'idle' ELSE now END ELSE now END,
         CASE WHEN share >= 1 AND now IN ('attack', 'decay', 'release') THEN t ELSE began END,
         CASE now WHEN 'attack' THEN least(share, 1) WHEN 'decay' THEN CASE WHEN share >= 1 THEN 0.6 ELSE 1 - 0.4 * share END WHEN 'release' THEN CASE WHEN share >= 1 THEN 0 ELSE 0.6 * (1 - share) END WHEN 'sustain' THEN 0.6 ELSE 0 END
  FROM (SELECT *, (t - began) / 1e6 / CASE now WHEN 'attack' THEN 600.0::DOUBLE WHEN 'decay' THEN 1200 WHEN 'release' THEN 1800 ELSE 1e18 END AS share
        FROM (SELECT o.stream, o.r, o.t, CASE WHEN up THEN 'attack' WHEN NOT up AND w.stage <> 'idle' THEN 'release' ELSE w.stage END AS now,
                     CASE WHEN up OR (NOT up AND w.stage <> 'idle') THEN o.t ELSE w.since END AS began FROM w JOIN o ON o.stream = w.stream AND o.r = w.r + 1)))
SELECT stream, t AS t_us, round(level, 6) AS level FROM w WHERE r > 0"""


@query("ar_adsr", ENVELOPE)
def ar_adsr(spark, sf):
    from ..operators.resample import envelope

    e = spark.read.parquet(f"{sf}/events.parquet")
    gates = e.select(F.col("user_id").alias("stream"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), F.when(F.col("event_type") == "click", True).when(F.col("event_type") == "view", False).alias("on"))
    return envelope(gates).select("stream", "t_us", F.round("level", 6).alias("level"))
