"""Edge cases of operators on literal rows."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framegraph.functions import audio, color, text
from framegraph.functions.header import pack, unpack
from framegraph.operators import delivery as d
from framegraph.operators import graph as g
from framegraph.operators import pairing
from framegraph.operators.resample import envelope, resample
from framegraph.operators.samples import rechunk
from framegraph.plans.registry import Pipeline, execution_of, processor

P = "id string, type string, display_name string, ord long"
L = "id string, src_id string, src_port string, dst_id string, dst_port string, ord long"


def graph(spark, links, ids="abcd"):
    p = spark.createDataFrame([(i, "T", i, k) for k, i in enumerate(ids)], P)
    rows = [(s + t, s, "out1", t, "in1", k) for k, (s, t) in enumerate(links)]
    return g.Graph(p, spark.createDataFrame(rows, L))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_fan_out_and_in(spark):
    x = graph(spark, ["ab", "ac", "bd", "cd"])
    assert ids(x.v("a").out_e().in_v().ids()) == ["b", "c"]
    assert ids(x.v("a").out_e().in_v().out_e().in_v().ids()) == ["d", "d"]  # paths, not vertices
    assert ids(x.v("nobody").ids()) == []
    assert x.v().nth(9).count() == 0


def test_empty_graph(spark):
    x = graph(spark, [], "")
    assert x.v().count().first()["n"] == 0
    assert not x.v().exists().first()["found"]
    assert x.v().first().count() == 0


def test_removal_takes_links_along(spark):
    left, missing = graph(spark, ["ab", "bc", "cd"]).drop_vertices(spark.createDataFrame([("b",), ("zz",)], "id string"))
    assert ids(left.links) == ["cd"] and ids(left.processors) == ["a", "c", "d"] and ids(missing) == ["zz"]


def test_cycles(spark):
    assert ids(graph(spark, ["ab", "bc", "ca", "cd"]).cyclic()) == ["a", "b", "c"]
    assert ids(graph(spark, ["ab", "bc", "cd"]).cyclic()) == []


def test_a_long_chain_is_no_cycle(spark):
    chain = [chr(0x4E00 + k) for k in range(140)]
    assert ids(graph(spark, [a + b for a, b in zip(chain[:-1], chain[1:], strict=True)], chain).cyclic()) == []


def test_display_names_skip_taken_suffixes(spark):
    rows = spark.createDataFrame([("1", "T", "N", 0), ("2", "T", "N 2", 1), ("3", "T", "N", 2), ("4", "T", "N", 3)], P)
    assert [r["shown"] for r in g.display_names(rows).orderBy("ord").collect()] == ["N", "N 2", "N 3", "N 4"]


F3 = "channel string, seq long, timestamp_ns long, payload string, len int, tick long"


@pytest.mark.parametrize("n", [0, 1, 4, 5])
def test_profiles_at_their_depth(spark, n):
    f = spark.createDataFrame([("c", k, k, "p", 100, 0) for k in range(n)], F3)
    assert d.latest(f).count() == min(n, 1)
    kept = d.every_sample(f, 4).collect()
    assert sorted(r["seq"] for r in kept) == list(range(max(0, n - 4), n)) and all(r["dropped"] == max(0, n - 4) for r in kept)
    assert sorted(r["seq"] for r in d.tap(f, 4).collect()) == list(range(min(n, 4)))
    assert d.lossless(f).count() == n


def test_admission_at_the_ceiling(spark):
    f = spark.createDataFrame([("c", k, k, "p", n, 0) for k, n in enumerate((90, 1000, 1001, 200, 300))], F3)
    out = d.admission(f, ceiling=1000).orderBy("seq").collect()
    assert [r["admitted"] for r in out] == [True, True, False, True, True]
    assert [r["crossed"] for r in out] == [False, True, False, False, False]


def test_kept_interval_depends_on_what_was_kept(spark):
    f = spark.createDataFrame([("c", k, t, "p", 0, 0) for k, t in enumerate((0, 6, 10, 15, 19, 20))], F3)
    assert [r["timestamp_ns"] for r in d.every_interval(f, 10).orderBy("seq").collect()] == [0, 10, 20]


def test_unknown_profile(spark):
    with pytest.raises(ValueError):
        d.apply_profile(spark.createDataFrame([], F3), "newest")
    with pytest.raises(Exception, match="unknown delivery profile"):
        spark.range(1).select(text.profile(F.lit("newest"), strict=True)).collect()


def test_asof_reaches_back_over_empty_buckets(spark):
    left = spark.createDataFrame([(1, 5), (2, 1000), (3, 20)], "seq long, timestamp_ns long")
    right = spark.createDataFrame([(7, 10), (8, 20)], "seq long, timestamp_ns long")
    got = {r["seq"]: r["r_seq"] for r in pairing.asof(left, right, 100).collect()}
    assert got == {1: None, 2: 8, 3: 8}


def test_zip_ends_with_the_shorter_side(spark):
    rows = lambda n, t: spark.createDataFrame([(1, k, t + k) for k in range(n)], "key long, seq long, timestamp_ns long")
    out = pairing.zip_streams(rows(3, 0), rows(2, 100), "key").collect()
    assert sorted(r["timestamp_ns"] for r in out) == [100, 101]


@pytest.mark.parametrize(("lengths", "size", "chunks"), [((4, 4), 4, [0, 1]), ((3, 3, 3), 4, [1, 2]), ((10,), 4, [0, 0]), ((3,), 4, [])])
def test_rechunk(spark, lengths, size, chunks):
    start, rows = 0, []
    for k, n in enumerate(lengths):
        rows.append((0, k, k, [float(start + i) for i in range(n)]))
        start += n
    out = rechunk(spark.createDataFrame(rows, "stream long, seq long, timestamp_ns long, samples array<double>"), size).orderBy("chunk").collect()
    assert [r["timestamp_ns"] for r in out] == chunks
    assert [x for r in out for x in r["samples"]] == [float(i) for i in range(size * len(chunks))]


def test_sinc_resampling_keeps_a_slow_sine(spark):
    t = np.arange(4000)
    wave = np.sin(2 * np.pi * t * 100 / 32_000)
    rows = [(0, k, k, wave[k * 400 : (k + 1) * 400].tolist()) for k in range(10)]
    out = resample(spark.createDataFrame(rows, "stream long, seq long, timestamp_ns long, samples array<double>"), 32_000, 48_000).orderBy("seq").collect()
    y = np.concatenate([r["samples"] for r in out])
    want = np.sin(2 * np.pi * np.arange(len(y)) * 100 / 48_000)
    assert len(y) > 5900 and np.abs(y - want)[50:].max() < 0.01


def test_envelope(spark):
    steps = [(0, None, 0.0), (10, True, 0.0), (310, None, 0.5), (700, None, 1.0), (1300, None, 0.8), (1900, None, 0.6), (5000, None, 0.6), (6000, False, 0.6), (6900, None, 0.3), (7800, None, 0.0), (7900, False, 0.0)]
    gates = spark.createDataFrame([(1, t * 1_000_000, on) for t, on, _ in steps], "stream long, t_us long, on boolean")
    assert [r["level"] for r in envelope(gates).orderBy("t_us").collect()] == pytest.approx([x for _, _, x in steps])


def test_channels_there_and_back(spark):
    x = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "s array<double>")
    planes = audio.planar(F.col("s"), 2)
    assert x.select(audio.interleaved(planes).alias("y")).first()["y"] == [1.0, 2.0, 3.0, 4.0]
    assert x.select(audio.convert_channels(F.col("s"), 2, 1).alias("y")).first()["y"] == [1.5, 3.5]


def test_psnr_cases(spark):
    row = spark.range(1).select(
        audio.psnr(audio.plane_mse(F.array_repeat(F.lit(128), 16), F.array_repeat(F.lit(138), 16)), F.lit(16)).alias("ten"),
        audio.psnr(F.lit(0.0), F.lit(16)).alias("equal"), audio.psnr(F.lit(None).cast("double"), F.lit(0)).alias("none"),
    ).first()
    assert row["ten"] == pytest.approx(28.13, abs=0.01) and row["equal"] == 100 and row["none"] == -1


def test_tone_curves_are_monotonic_and_keep_the_peak(spark):
    x = spark.range(101).select((F.col("id") / 100.0).alias("x"))
    y = [r["y"] for r in x.select("x", color.bt2390_eetf(F.col("x"), F.lit(1000.0), F.lit(100.0)).alias("y")).orderBy("x").collect()]
    assert all(a <= b + 1e-12 for a, b in zip(y, y[1:], strict=False)) and y[-1] == pytest.approx(1, abs=1e-6)


def test_header_round_trip(spark):
    x = spark.createDataFrame([("port", -5, 4_000_000_000), ("", 2**62, 0)], "p string, t long, n long")
    h = x.select(pack(F.col("p"), F.col("t"), F.col("n")).alias("h"), "p", "t", "n")
    for r in h.select(*(c.alias(k) for c, k in zip(unpack(F.col("h")), ("a", "b", "c"), strict=True)), "p", "t", "n").collect():
        assert (r["a"], r["b"], r["c"]) == (r["p"], r["t"], r["n"])


def test_channel_name_without_room(spark):
    with pytest.raises(Exception, match="no room"):
        spark.range(1).select(text.channel_name(F.lit("s" * 60), F.lit("p" * 60))).collect()


def test_pipelines(spark):
    @processor(outputs=("out",), execution="manual")
    def source(inputs, n=3):
        return {"out": spark.range(n).select(F.lit("c").alias("channel"), F.col("id").alias("seq"), F.lit(0).alias("tick"))}

    @processor(inputs={"in": "latest"}, outputs=("out",))
    def forward(inputs):
        return {"out": inputs["in"]}

    p = Pipeline()
    a, b = p.add("a", source, n=5), p.add("b", forward)
    p.connect(f"{a}.out", f"{b}.in")
    assert [r["seq"] for r in p.run()["b.out"].collect()] == [4]
    with pytest.raises(ValueError):
        p.connect("a.nothing", "b.in")
    with pytest.raises(ValueError):
        p.connect("a", "b.in")
    p.add("c", forward)
    p.connect("b.out", "c.in")
    p.connect("c.out", "b.in")
    with pytest.raises(ValueError, match="cycle"):
        p.run()
    with pytest.raises(ValueError):
        execution_of({}, None)


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_running_values_do_not_depend_on_buckets(spark, width):
    from framegraph.operators import running as r

    data = [("a", k, v) for k, v in enumerate([5, None, 2, 9, None, None, 1, 9])] + [("b", 4, None), ("b", 9, 3), (None, 2, 7)]
    df = spark.createDataFrame(data, "key string, seq long, v long")
    out = r.numbered(df, "key", width=width)
    out = r.running_sum(out, "key", F.col("v"), width=width)
    out = r.running_max(out, "key", F.col("v"), out="before", inclusive=False, width=width)
    out = r.running_last(out, "key", "v", width=width)
    got = {(x["key"], x["seq"]): (x["n"], x["sum"], x["before"], x["last"]) for x in out.collect()}
    for key in ("a", "b", None):
        seen = []
        for n, (_, seq, v) in enumerate(x for x in data if x[0] == key):
            there = [x for x in seen if x is not None]
            now = there + [v] * (v is not None)
            assert got[key, seq] == (n, sum(now), max(there, default=None), now[-1] if now else None)
            seen.append(v)


def test_fnv(spark):
    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    texts = ["", "a", "foobar", "é漢字", "x" * 200, "camera/7"]
    got = {r["s"]: r["h"] for r in spark.createDataFrame([(x,) for x in texts], "s string").select("s", text.fnv1a_64(F.col("s")).alias("h")).collect()}
    assert got == {x: fnv(x.encode()) for x in texts}
    long = "Proc" * 30
    name = spark.range(1).select(text.channel_name(F.lit(long), F.lit("out")).alias("n")).first()["n"]
    assert name == f"{long.lower()[:46]}-{fnv(long.lower().encode())[-12:]}/out" and len(name) == 63


EPOCH = 1_700_000_000_012_999_980


def test_whole_nanoseconds(spark):
    """Buckets, ticks and clocks of nanoseconds since 1970, which doubles do not hold."""
    from framegraph.functions import timing

    tolerance = 16_600_000
    left = spark.createDataFrame([(1, EPOCH), (2, -5)], "seq long, timestamp_ns long")
    right = spark.createDataFrame([(1, EPOCH - tolerance), (2, EPOCH + tolerance), (3, EPOCH - tolerance - 1), (4, -5 - tolerance)], "seq long, timestamp_ns long")
    assert sorted((r["l_seq"], r["r_seq"]) for r in pairing.interval_pairs(left, right, tolerance).collect()) == [(1, 1), (1, 2), (2, 4)]
    assert {r["seq"]: r["r_seq"] for r in pairing.asof(left, right, 1_000_000).collect()} == {1: 1, 2: 4}
    times = [1_700_000_000_000_000_000 - 100, EPOCH, -1, 0, 3_600_000_000_000 - 1]
    rows = spark.createDataFrame([(t,) for t in times], "t long").select("t", timing.tick(F.col("t"), 7).alias("k"), text.wall_clock(F.col("t")).alias("w"))
    got = {r["t"]: (r["k"], r["w"]) for r in rows.collect()}
    assert [got[t][0] for t in times] == [t // 7 for t in times]
    assert [got[t][1] for t in times] == ["22:13:19.999", "22:13:20.012", "23:59:59.999", "00:00:00.000", "00:59:59.999"]
    assert spark.range(1).select(timing.expirations(F.lit(EPOCH), F.lit(EPOCH - 2 * tolerance), tolerance).alias("n")).first()["n"] == 2


def test_reports_count_drops_since_the_last_one(spark):
    """Ten drops every tenth of a second are told about once a second; a thousand at once are told at once."""
    rows = [("a", k * 100_000_000, 10 * k) for k in range(51)] + [("b", 5, 0), ("b", 6, 1000), ("b", 7, 1999), ("b", 8, 2000), ("b", 10**10, 2000)]
    out = [tuple(r) for r in d.dropped_reports(spark.createDataFrame(rows, "source string, timestamp_ns long, dropped long")).select("source", "timestamp_ns", "new_drops").orderBy("source", "timestamp_ns").collect()]
    assert out == [("a", k * 10**9, 100) for k in range(1, 6)] + [("b", 6, 1000), ("b", 8, 1000)]


def test_ring_and_mailbox(spark):
    """Against queues that are filled and emptied tick by tick."""
    rng = np.random.default_rng(3)
    rows, seq = [], 0
    for channel in "xy":
        for tick in range(40):
            for _ in range(int(rng.integers(0, 7))):
                rows.append((channel, seq, tick))
                seq += 1
    want = []
    for channel in "xy":
        mailbox = []
        for tick in range(40):
            ring = [s for c, s, t in rows if (c, t) == (channel, tick)][-3:]
            if ring:
                mailbox = (mailbox + ring)[-3:]
                want += [(channel, s, tick) for s in mailbox[:2]]
                mailbox = mailbox[2:]
    out = d.two_level(spark.createDataFrame(rows, "channel string, seq long, tick long"), 3, 2)
    assert sorted((r["channel"], r["seq"], r["read_tick"]) for r in out.collect()) == sorted(want)


def test_fnv_of_many_names_at_once(spark):
    """Nulls, equal and empty names and lengths of any order in one batch; a hundred thousand long names take seconds."""

    def fnv(data):
        h = 14695981039346656037
        for b in data:
            h = (h ^ b) * 1099511628211 % 2**64
        return f"{h:016x}"

    names = [None, "", "ä" * 70, "b", None, "a", "", "Ab" * 300, "b"]
    rows = spark.createDataFrame(list(enumerate(names)), "k int, s string").coalesce(1)
    got = {r["k"]: r["h"] for r in rows.select("k", text.fnv1a_64(F.col("s")).alias("h")).collect()}
    assert got == {k: None if x is None else fnv(x.encode()) for k, x in enumerate(names)}
    begun = time.monotonic()
    many = spark.range(100_000).select(text.fnv1a_64(F.concat(F.repeat(F.lit("long"), F.lit(50)), F.col("id").cast("string"))).alias("h"))
    assert many.distinct().count() == 100_000 and time.monotonic() - begun < 15


def test_channel_names_are_cut_by_bytes(spark):
    for source in ("é" * 60, "aé" * 40, "漢" * 40, "😀" * 30, "x漢😀" * 20):
        name = spark.range(1).select(text.channel_name(F.lit(source), F.lit("out")).alias("n")).first()["n"]
        head = name.rsplit("-", 1)[0]
        assert 63 - 4 < len(name.encode()) <= 63 and source.startswith(head) and "\ufffd" not in name


def test_a_name_that_many_want(spark):
    rows = spark.createDataFrame([(f"{k:05}", "T", "N" if k % 2 else "M 7", k) for k in range(5000)], P)
    shown = [r["shown"] for r in g.display_names(rows).orderBy("ord").collect()]
    assert shown[:6] == ["M 7", "N", "M 7 2", "N 2", "M 7 3", "N 3"] and len(set(shown)) == 5000


def test_percentiles_are_exact(spark):
    from framegraph.sources.tables import percentiles

    rng = np.random.default_rng(4)
    data = [(k, float(v)) for k, n in ((1, 1), (2, 2), (3, 1001), (4, 400)) for v in np.round(rng.exponential(20, n), 2)] + [(5, None)]
    out = {r["k"]: (r["a"], r["b"]) for r in percentiles(spark.createDataFrame(data, "k long, v double"), "k", "v", {"a": 0.5, "b": 0.99}).collect()}
    assert out == {k: tuple(pytest.approx(np.percentile([v for j, v in data if j == k], q)) for q in (50, 99)) for k in (1, 2, 3, 4)}


def test_resampled_frames_do_not_depend_on_how_a_stream_is_cut(spark):
    rng = np.random.default_rng(5)
    wave = rng.normal(size=(3000, 2))
    outs = []
    for cuts in (range(0, 3001, 3000), [0, 1, 2, 40, 41, 700, 2999, 3000], range(0, 3001, 8)):
        rows = [(0, k, k, wave[s:e].ravel().tolist()) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
        out = resample(spark.createDataFrame(rows, "stream long, seq long, timestamp_ns long, samples array<double>"), 48_000, 44_100, "low", channels=2).orderBy("seq").collect()
        assert len(out) == len(rows)
        outs.append(np.array([x for r in out for x in r["samples"]]))
    assert len(outs[0]) == 2 * -(-(3000 - 8) * 44_100 // 48_000) and all(np.allclose(x, outs[0]) for x in outs)


def test_one_frame_resampled_keeps_a_slow_sine(spark):
    wave = np.sin(2 * np.pi * np.arange(400) * 100 / 32_000)
    y = np.array(spark.createDataFrame([(wave.tolist(),)], "s array<double>").select(audio.resample_frame(F.col("s"), 32_000, 48_000).alias("y")).first()["y"])
    want = np.sin(2 * np.pi * np.arange(600) * 100 / 48_000)
    assert len(y) == 600 and np.abs(y - want)[30:-30].max() < 0.01


def test_stream_state_takes_parts_in_any_order(spark, tmp_path):
    """More frames of a key than an Arrow batch holds, not in order, in one micro-batch."""
    from framegraph.plans.stream_queries import finish
    from framegraph.streaming import links as st

    n = 25_000
    order = np.random.default_rng(6).permutation(n)
    rows = spark.createDataFrame([(1, int(k), int(k), float(k)) for k in order], "key long, seq long, timestamp_ns long, value double")
    for side in "lr":
        rows.coalesce(1).write.parquet(f"{tmp_path}/{side}")
    left, right = (spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/{side}") for side in "lr")
    out = finish(st.zip_ports(left, right))
    assert out.where("l_seq = r_seq").count() == n == out.count()
    audio_rows = left.select(F.col("key").alias("stream"), "seq", "timestamp_ns", F.array("value").alias("samples"))
    chunks = finish(st.rechunk(audio_rows, 100)).orderBy("chunk").collect()
    assert [x for r in chunks for x in r["samples"]] == [float(k) for k in range(n)]


def test_streamed_chunks_over_files_in_no_order(spark, tmp_path):
    """More files than a micro-batch of four, the first written holding the last frames."""
    from framegraph.plans.catalog import QUERIES

    rng = np.random.default_rng(8)
    frames = [(k, rng.normal(size=64).tolist(), k % 2) for k in range(60)]
    for part in reversed(range(6)):
        one = spark.createDataFrame(frames[part * 10 : part * 10 + 10], "vec_id long, embedding array<float>, label int")
        one.coalesce(1).write.mode("append").parquet(f"{tmp_path}/embeddings.parquet")
    key = lambda r: (r["stream"], r["chunk"], r["timestamp_ns"], r["n"], round(r["weighted"], 4))
    got, want = (sorted(map(key, QUERIES[name](spark, str(tmp_path)).collect())) for name in ("st_rechunk", "ar_rechunk"))
    assert got == want and len(got) == 38


def test_chunks_go_on_from_micro_batch_to_micro_batch(spark, tmp_path):
    """Streams that rest for a micro-batch, whose samples come out even, that come late or have no name."""
    from framegraph.streaming import links as st

    schema = "stream long, seq long, timestamp_ns long, samples array<double>"
    plan = [{0: 7, 1: 4, None: 3}, {0: 6, None: 9}, {1: 3, 2: 2}, {0: 3, 1: 1, 2: 2, None: 1}]
    sent: dict = {}
    for k, batch in enumerate(plan):
        rows = []
        for stream, n in batch.items():
            for _ in range(n):
                at = sent.setdefault(stream, [])
                rows.append((stream, len(at), 100 * k + len(at), [float(3 * len(at) + i) for i in range(3)]))
                at.append(rows[-1][2])
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        frames = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        st.rechunk_batches(frames, 4, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r["stream"], r["chunk"]): (r["timestamp_ns"], r["samples"]) for r in st.rechunked(spark, 4, f"{tmp_path}/out").collect()}
    want = {(s, c): (at[(4 * c + 3) // 3], [float(4 * c + i) for i in range(4)]) for s, at in sent.items() for c in range(3 * len(at) // 4)}
    assert got == want


def test_checksums_are_xxhash64(spark):
    import xxhash

    from framegraph.plans.catalog import QUERIES
    from framegraph.sources.tables import processors

    sf = "/root/testdata/sf0.001"
    shown = {r["id"]: r["c"] for r in processors(spark, sf).select("id", F.to_json(F.struct("type", "display_name")).alias("c")).collect()}
    for r in QUERIES["sc_config_checksum"](spark, sf).collect():
        assert r["checksum"] % 2**64 == xxhash.xxh64(shown[r["id"]].encode(), seed=42).intdigest()


def test_every_sample_stream_accounts_for_all_frames(spark):
    from framegraph.plans.catalog import QUERIES
    from framegraph.sources.tables import frames

    sf = "/root/testdata/sf0.001"
    there = {r["channel"]: (r["n"], r["newest"]) for r in frames(spark, sf).groupBy("channel").agg(F.count("*").alias("n"), F.max("seq").alias("newest")).collect()}
    out = QUERIES["st_every_sample_stream"](spark, sf).groupBy("channel").agg(F.count_distinct("seq").alias("n"), F.max("dropped").alias("dropped"), F.max("seq").alias("newest")).collect()
    assert {r["channel"]: (r["n"] + r["dropped"], r["newest"]) for r in out} == there


def test_a_large_graph_is_no_document(spark, monkeypatch):
    from framegraph.sources import snapshot

    monkeypatch.setattr(snapshot, "MOST", 3)
    x = graph(spark, ["ab"])
    x = g.Graph(x.processors, x.links.withColumn("state", F.lit("Wired")))
    with pytest.raises(ValueError, match="too many"):
        snapshot.export_json(x)
    assert snapshot.export_lines(x).count() == 5


def test_kept_intervals_over_many_segments(spark, monkeypatch):
    """Against a plain fold: dense and sparse channels, ties, a missing channel name, times before 1970."""
    monkeypatch.setattr(d, "SEGMENT", 3)
    rng = np.random.default_rng(7)
    rows, want = [], []
    for channel, gap in (("dense", 3), ("sparse", 400), (None, 30)):
        times = np.cumsum(rng.integers(0, gap, 700)) - 500
        mine = [(channel, k, int(t)) for k, t in enumerate(times)]
        rows += mine
        last = None
        for c, k, t in mine:
            if last is None or t - last >= 25:
                want.append((c, k))
                last = t
    out = d.every_interval(spark.createDataFrame(rows, "channel string, seq long, timestamp_ns long").repartition(5), 25)
    assert out.columns == ["channel", "seq", "timestamp_ns"]
    assert sorted(((r["channel"], r["seq"]) for r in out.collect()), key=str) == sorted(want, key=str)
