"""Queries over colour functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color as c
from .catalog import query

#: x in [0, 1] from discounts and taxes, on both sides of every knee.
X = "x AS (SELECT DISTINCT l_discount * 9 AS x FROM lineitem UNION SELECT DISTINCT l_tax / 4 FROM lineitem)"


def _x(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    return t.select((F.col("l_discount") * 9).alias("x")).union(t.select(F.col("l_tax") / 4)).distinct()


M1, M2, C1, C2, C3 = c.PQ_M1, c.PQ_M2, c.PQ_C1, c.PQ_C2, c.PQ_C3
A, B, C = c.HLG_A, c.HLG_B, c.HLG_C


def pq(x: str) -> str:
    return f"pow(({C1} + {C2} * pow(greatest({x}, 0.0), {M1})) / (1 + {C3} * pow(greatest({x}, 0.0), {M1})), {M2})"


def unpq(x: str) -> str:
    p = f"pow(greatest({x}, 0.0), {1 / M2})"
    return f"pow(greatest({p} - {C1}, 0.0) / ({C2} - {C3} * {p}), {1 / M1})"


SQL = {
    "srgb_to_linear": "CASE WHEN x <= 0.04045 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END",
    "linear_to_srgb": f"CASE WHEN x <= 0.0031308 THEN x * 12.92 ELSE 1.055 * pow(x, {1 / 2.4}) - 0.055 END",
    "bt709_to_linear": f"CASE WHEN x < 0.081 THEN x / 4.5 ELSE pow((x + 0.099) / 1.099, {1 / 0.45}) END",
    "linear_to_bt709": "CASE WHEN x < 0.018 THEN x * 4.5 ELSE 1.099 * pow(x, 0.45) - 0.099 END",
    "pq_to_linear": unpq("x"),
    "linear_to_pq": pq("x"),
    "hlg_to_linear": f"CASE WHEN x <= 0.5 THEN x * x / 3 ELSE (exp((x - {C}) / {A}) + {B}) / 12 END",
    "linear_to_hlg": f"CASE WHEN x <= {1 / 12} THEN sqrt(3 * x) ELSE {A} * ln(greatest(12 * x - {B}, 1e-9)) + {C} END",
}


def _curve(name: str) -> None:
    f = getattr(c, name)

    @query("sc_" + name, f"WITH {X} SELECT round(x, 9) AS x, round({SQL[name]}, 6) AS y FROM x")
    def run(spark, sf):
        return _x(spark, sf).select(F.round("x", 9).alias("x"), F.round(f(F.col("x")), 6).alias("y"))


for _name in SQL:
    _curve(_name)

NAMES = "t(transfer) AS (VALUES ('linear'), ('srgb'), ('bt709'), ('pq'), ('hlg'), ('other'))"
TO = "CASE transfer WHEN 'linear' THEN x " + " ".join(f"WHEN '{n}' THEN {SQL[n + '_to_linear']}" for n in ("srgb", "bt709", "pq", "hlg")) + " END"


@query("sc_transfer_dispatch", f"WITH {X}, {NAMES} SELECT transfer, round(x, 9) AS x, round({TO}, 6) AS linear FROM x, t")
def sc_transfer_dispatch(spark, sf):
    names = F.explode(F.array(*(F.lit(n) for n in (*c.TRANSFERS, "other")))).alias("transfer")
    return _x(spark, sf).select("x", names).select("transfer", F.round("x", 9).alias("x"), F.round(c.to_linear(F.col("transfer"), F.col("x")), 6).alias("linear"))


@query("sc_transfer_round_trip", f"WITH {X}, {NAMES} SELECT transfer, round(x, 5) AS x, round(x, 5) AS back FROM x, t WHERE transfer <> 'other'")
def sc_transfer_round_trip(spark, sf):
    names = F.explode(F.array(*(F.lit(n) for n in c.TRANSFERS))).alias("transfer")
    rows = _x(spark, sf).select("x", names)
    back = c.from_linear(F.col("transfer"), c.to_linear(F.col("transfer"), F.col("x")))
    return rows.select("transfer", F.round("x", 5).alias("x"), F.round(back, 5).alias("back"))


PEAKS = "pk(pi, po) AS (VALUES (1000.0, 100.0), (4000.0, 1000.0), (1000.0, 1000.0), (100.0, 1000.0))"


def _peaks(spark, sf):
    pk = spark.createDataFrame([(1000.0, 100.0), (4000.0, 1000.0), (1000.0, 1000.0), (100.0, 1000.0)], "pi double, po double")
    return _x(spark, sf).join(F.broadcast(pk))  # four rows


EETF = f"""e AS (SELECT x, CAST(pi AS DOUBLE) AS pi, CAST(po AS DOUBLE) AS po, {pq('CAST(pi AS DOUBLE) / 10000')} AS s FROM x, pk), f AS (SELECT *, {pq('po / 10000')} / s AS m, {pq('x * pi / 10000')} / s AS e1 FROM e),
g AS (SELECT *, 1.5 * m - 0.5 AS ks, (e1 - (1.5 * m - 0.5)) / greatest(1 - (1.5 * m - 0.5), 1e-6) AS t FROM f),
h AS (SELECT *, s * CASE WHEN e1 < ks THEN e1 ELSE (2*t*t*t - 3*t*t + 1) * ks + (t*t*t - 2*t*t + t) * (1 - ks) + (3*t*t - 2*t*t*t) * m END AS o FROM g)"""


@query("sc_bt2390_eetf", f"WITH {X}, {PEAKS}, {EETF} SELECT round(x, 9) AS x, pi, po, round({unpq('o')} * 10000 / po, 5) AS y FROM h")
def sc_bt2390_eetf(spark, sf):
    y = c.bt2390_eetf(F.col("x"), F.col("pi"), F.col("po"))
    return _peaks(spark, sf).select(F.round("x", 9).alias("x"), "pi", "po", F.round(y, 5).alias("y"))


@query("sc_bt2446a_inverse", f"""WITH {X}, {PEAKS}, e AS (SELECT x, CAST(pi AS DOUBLE) AS pi, CAST(po AS DOUBLE) AS po, CAST(po AS DOUBLE) / pi AS r, (x - 0.5) / 0.5 AS t FROM x, pk)
SELECT round(x, 9) AS x, pi, po, round(CASE WHEN po <= pi THEN x * pi / po WHEN x <= 0.5 THEN x / r ELSE (2*t*t*t - 3*t*t + 1) * 0.5 / r + (t*t*t - 2*t*t + t) / r + (3*t*t - 2*t*t*t) END, 6) AS y FROM e""")
def sc_bt2446a_inverse(spark, sf):
    y = c.bt2446a_inverse(F.col("x"), F.col("pi"), F.col("po"))
    return _peaks(spark, sf).select(F.round("x", 9).alias("x"), "pi", "po", F.round(y, 6).alias("y"))


MATRICES = ("bt709", "fcc", "smpte240m", "bt2020_ncl", "bt2020_cl", "smpte170m", "bt470_bg", "ycgco")
KR = "CASE mx " + " ".join(f"WHEN '{n}' THEN {k[0]}" for n, k in c.KR_KB.items()) + " ELSE 0.299 END"
KB = "CASE mx " + " ".join(f"WHEN '{n}' THEN {k[1]}" for n, k in c.KR_KB.items()) + " ELSE 0.114 END"
MX = "mt AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in MATRICES) + f"]) AS mx), rg AS (SELECT unnest(['full', 'limited']) AS rng), k AS (SELECT mx, rng, CAST({KR} AS DOUBLE) AS kr, CAST({KB} AS DOUBLE) AS kb, CASE rng WHEN 'full' THEN 1.0::DOUBLE ELSE 255.0::DOUBLE / 219 END AS ys, CASE rng WHEN 'full' THEN 1.0::DOUBLE ELSE 255.0::DOUBLE / 224 END AS cs, CASE rng WHEN 'full' THEN 0.0 ELSE 16.0 END AS yo FROM mt, rg)"


def _matrices(spark):
    return spark.createDataFrame([(m, r) for m in MATRICES for r in ("full", "limited")], "mx string, rng string")


@query("sc_ycbcr_matrix", f"WITH {MX} SELECT mx, rng, round(ys, 6) AS y, round(2 * (1 - kr) * cs, 6) AS r_cr, round(-2 * (1 - kb) * kb / (1 - kr - kb) * cs, 6) AS g_cb, round(-2 * (1 - kr) * kr / (1 - kr - kb) * cs, 6) AS g_cr, round(2 * (1 - kb) * cs, 6) AS b_cb, CAST(yo AS DOUBLE) AS y_off FROM k")
def sc_ycbcr_matrix(spark, sf):
    d = c.ycbcr_matrix(F.col("mx"), F.col("rng"))
    at = lambda k: F.round(F.get(d["m"], k), 6)
    return _matrices(spark).select("mx", "rng", at(0).alias("y"), at(2).alias("r_cr"), at(4).alias("g_cb"), at(5).alias("g_cr"), at(7).alias("b_cb"), F.get(d["offset"], 0).alias("y_off"))


@query("sc_nv12_to_rgb", f"WITH {MX}, px AS (SELECT p_partkey AS id, p_partkey % 256 AS y, (p_partkey * 7) % 256 AS cb, (p_partkey * 13) % 256 AS cr FROM part) SELECT id, CAST(greatest(0, least(255, floor(ys * (y - yo) + 2 * (1 - kr) * cs * (cr - 128) + 0.5))) AS INT) AS r, CAST(greatest(0, least(255, floor(ys * (y - yo) + 2 * (1 - kb) * cs * (cb - 128) + 0.5))) AS INT) AS b FROM px, k WHERE mx = 'bt709' AND rng = 'limited'")
def sc_nv12_to_rgb(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    k = F.col("p_partkey")
    rgb = c.ycbcr_to_rgb(F.lit("bt709"), F.lit("limited"), k % 256, (k * 7) % 256, (k * 13) % 256)
    return p.select(k.alias("id"), F.get(rgb, 0).alias("r"), F.get(rgb, 2).alias("b"))


@query("sc_yuyv_to_rgba", f"WITH {MX}, px AS (SELECT p_partkey AS id, j, (p_partkey * (2 * j + 1)) % 256 AS y, (p_partkey * 7) % 256 AS cb, (p_partkey * 13) % 256 AS cr FROM part, (VALUES (0), (1)) AS t(j)) SELECT id * 2 + j AS pixel, CAST(greatest(0, least(255, floor(ys * (y - yo) + 2 * (1 - kr) * cs * (cr - 128) + 0.5))) AS INT) AS r, 255 AS a FROM px, k WHERE mx = 'smpte170m' AND rng = 'full'")
def sc_yuyv_to_rgba(spark, sf):
    """Four bytes Y0 U Y1 V make two pixels."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    k = F.col("p_partkey")
    quad = p.select(k.alias("id"), F.array(k % 256, (k * 7) % 256, (k * 3) % 256, (k * 13) % 256).alias("q"))
    pixels = quad.select("id", "q", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    rgb = c.ycbcr_to_rgb(F.lit("smpte170m"), F.lit("full"), F.get("q", F.col("j") * 2), F.get("q", F.lit(1)), F.get("q", F.lit(3)))
    return pixels.select((F.col("id") * 2 + F.col("j")).alias("pixel"), F.get(rgb, 0).alias("r"), F.lit(255).alias("a"))


AXES = "ax AS (SELECT p_partkey AS id, CASE p_partkey % 2 WHEN 0 THEN 'rgb' ELSE 'yuv' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'bt2020' END AS primaries, CASE WHEN p_partkey % 5 = 0 THEN 'pq' END AS transfer, CASE WHEN p_partkey % 7 = 0 THEN 'bt709' END AS matrix, CASE WHEN p_partkey % 11 = 0 THEN 'full' END AS rng FROM part)"
RESOLVED = "SELECT id, coalesce(primaries, 'bt709') AS primaries, coalesce(transfer, CASE kind WHEN 'rgb' THEN 'srgb' ELSE 'bt709' END) AS transfer, CASE kind WHEN 'rgb' THEN 'identity' ELSE coalesce(matrix, 'smpte170m') END AS matrix, coalesce(rng, CASE kind WHEN 'rgb' THEN 'full' ELSE 'limited' END) AS rng FROM ax"


def _axes(spark, sf):
    k = F.col("p_partkey")
    return spark.read.parquet(f"{sf}/part.parquet").select(k.alias("id"), F.when(k % 2 == 0, "rgb").otherwise("yuv").alias("kind"), F.when(k % 3 == 0, "bt2020").alias("primaries"), F.when(k % 5 == 0, "pq").alias("transfer"), F.when(k % 7 == 0, "bt709").alias("matrix"), F.when(k % 11 == 0, "full").alias("rng"))


def _resolved(spark, sf):
    axes = c.resolve_defaults(*(F.col(x) for x in ("kind", "primaries", "transfer", "matrix", "rng")))
    return _axes(spark, sf).select("id", *(x.alias(n) for x, n in zip(axes, ("primaries", "transfer", "matrix", "rng"), strict=True)))


@query("jn_config_default", f"WITH {AXES} {RESOLVED}")
def jn_config_default(spark, sf):
    return _resolved(spark, sf)


@query("sc_color_defaults", f"WITH {AXES}, z AS ({RESOLVED}) SELECT primaries, transfer, matrix, rng, count(*) AS n FROM z GROUP BY ALL")
def sc_color_defaults(spark, sf):
    return _resolved(spark, sf).groupBy("primaries", "transfer", "matrix", "rng").agg(F.count("*").alias("n"))


@query("sc_jpeg_color", f"WITH {AXES}, z AS ({RESOLVED}) SELECT id, CASE transfer WHEN 'pq' THEN 'smpte2084' WHEN 'hlg' THEN 'arib_std_b67' ELSE transfer END AS transfer, primaries FROM z")
def sc_jpeg_color(spark, sf):
    t = F.col("transfer")
    return _resolved(spark, sf).select("id", F.when(t == "pq", "smpte2084").when(t == "hlg", "arib_std_b67").otherwise(t).alias("transfer"), "primaries")


CODES = "cd AS (SELECT s, x, e, q FROM range(14) a(s), range(9) b(x), range(10) c(e), range(4) d(q))"


def _case(code: str, table: dict) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN '{v}'" if isinstance(v, str) else f"WHEN {k} THEN {v}" for k, v in table.items()) + " END"


DRIVER = f"""rs AS (SELECT *, CASE WHEN x <> 0 THEN x WHEN s <> 0 THEN coalesce({_case('s', c._TRANSFER_DEFAULT)}, 1) END AS x2, CASE WHEN e <> 0 THEN e WHEN s <> 0 THEN coalesce({_case('s', c._MATRIX_DEFAULT)}, 1) END AS e2, CASE WHEN q <> 0 THEN q WHEN s = 7 THEN 1 WHEN s <> 0 THEN 2 END AS q2 FROM cd)
SELECT s, x, e, q, {_case('s', c._PRIMARIES)} AS primaries, {_case('x2', c._TRANSFER)} AS transfer, {_case('e2', c._MATRIX)} AS matrix, {_case('q2', c._RANGE)} AS rng FROM rs"""


def _driver(spark):
    n = spark.range(14 * 9 * 10 * 4)
    i = F.col("id")
    codes = n.select(F.floor(i / 360).alias("s"), (F.floor(i / 40) % 9).alias("x"), (F.floor(i / 4) % 10).alias("e"), (i % 4).alias("q"))
    d = c.driver_color(*(F.col(k) for k in "sxeq"))
    return codes.select("s", "x", "e", "q", d["primaries"].alias("primaries"), d["transfer"].alias("transfer"), d["matrix"].alias("matrix"), d["range"].alias("rng"))


@query("sc_v4l2_color", f"WITH {CODES}, {DRIVER}")
def sc_v4l2_color(spark, sf):
    return _driver(spark)


@query("sc_v4l2_color_pkg", f"WITH {CODES}, {DRIVER} WHERE s = 8 AND x = 0 AND e = 0 AND q = 0")
def sc_v4l2_color_pkg(spark, sf):
    """The sRGB defaults: limited range."""
    return _driver(spark).where("s = 8 and x = 0 and e = 0 and q = 0")


def _h273(axis: str) -> None:
    table = c.H273[axis]

    @query("sc_h273_" + axis, "SELECT i AS code, " + _case("i", {v: k for k, v in table.items()}) + " AS name FROM range(32) t(i)")
    def run(spark, sf):
        rows = spark.range(32).select(F.col("id").alias("code"), c.h273_decode(axis, F.col("id")).alias("name"))
        # encoding gives the code back wherever there is a name
        return rows.where(F.col("name").isNull() | (c.h273_encode(axis, F.col("name")) == F.col("code")))


for _axis in c.H273:
    _h273(_axis)

PX = "px AS (SELECT p_partkey AS id, p_partkey % 256 AS r, (p_partkey * 3) % 256 AS g, (p_partkey * 11) % 256 AS b FROM part)"


def _pixels(spark, sf):
    k = F.col("p_partkey")
    return spark.read.parquet(f"{sf}/part.parquet").select(k.alias("id"), (k % 256).alias("r"), (k * 3 % 256).alias("g"), (k * 11 % 256).alias("b"))


@query("sc_luma601", f"WITH {PX} SELECT id, round(CAST(0.299 * r + 0.587 * g + 0.114 * b AS DOUBLE), 3) AS luma FROM px")
def sc_luma601(spark, sf):
    return _pixels(spark, sf).select("id", F.round(c.luma601(F.col("r"), F.col("g"), F.col("b")), 3).alias("luma"))


@query("sc_invert", f"WITH {PX} SELECT id, 255 - r AS r, 255 - g AS g, 255 - b AS b, 7 AS a FROM px")
def sc_invert(spark, sf):
    p = _pixels(spark, sf).select("id", c.invert_rgba(F.array("r", "g", "b", F.lit(7).cast("long"))).alias("x"))
    return p.select("id", *(F.get("x", i).alias(n) for i, n in enumerate("rgba")))


@query("sc_double", f"WITH {PX} SELECT id, (id * 3000000) * 2 % 4294967296 AS y FROM px")
def sc_double(spark, sf):
    return _pixels(spark, sf).select("id", (F.col("id") * 3_000_000 * 2 % 4_294_967_296).alias("y"))


@query("sc_hdr_scale", f"WITH {PX} SELECT id, round(r * 100 / 50000.0, 8) AS x, round(CAST(g * 1000 * 0.0001 AS DOUBLE), 8) AS nits, coalesce(CASE WHEN b > 100 THEN b END, 0) AS max_cll FROM px")
def sc_hdr_scale(spark, sf):
    return _pixels(spark, sf).select("id", F.round(F.col("r") * 100 / 50_000.0, 8).alias("x"), F.round(F.col("g") * 1000 * 0.0001, 8).alias("nits"), F.coalesce(F.when(F.col("b") > 100, F.col("b")), F.lit(0)).alias("max_cll"))


@query("src_test_pattern", "SELECT y * 64 + x AS pixel, x, y, least(x * 8 // 64, 7) AS bar FROM range(64) a(x), range(16) b(y)")
def src_test_pattern(spark, sf):
    i = F.col("id")
    return spark.range(64 * 16).select(i.alias("pixel"), (i % 64).alias("x"), F.floor(i / 64).alias("y"), F.least(F.floor((i % 64) * 8 / 64), F.lit(7)).alias("bar"))


GRID = "gr AS (SELECT x, y, (x * 37 + y * 11) % 256 AS r, (x * 5 + y * 71) % 256 AS g, (x * 91 + y * 3) % 256 AS b FROM range(32) a(x), range(16) b(y))"


@query("sc_rgb_to_nv12", f"""WITH {GRID}, cc AS (SELECT x, y, -0.1146 * r - 0.3854 * g + 0.5 * b AS cb FROM gr),
h AS (SELECT x, y, (coalesce(lag(cb) OVER w, cb) + 2 * cb + coalesce(lead(cb) OVER w, cb)) / 4 AS cb FROM cc WINDOW w AS (PARTITION BY y ORDER BY x))
SELECT x // 2 AS cx, y // 2 AS cy, round(128 + 224.0 / 255 * sum(cb) / 2, 4) AS u FROM h WHERE x % 2 = 0 GROUP BY ALL""")
def sc_rgb_to_nv12(spark, sf):
    """Chroma of 4:2:0 with left siting: weights 1 2 1 across, both rows down (six taps)."""
    from pyspark.sql.window import Window

    i = F.col("id")
    x, y = i % 32, F.floor(i / 32)
    grid = spark.range(512).select(x.alias("x"), y.alias("y"), ((x * 37 + y * 11) % 256).alias("r"), ((x * 5 + y * 71) % 256).alias("g"), ((x * 91 + y * 3) % 256).alias("b"))
    cc = grid.select("x", "y", (-0.1146 * F.col("r") - 0.3854 * F.col("g") + 0.5 * F.col("b")).alias("cb"))
    w = Window.partitionBy("y").orderBy("x")
    cb = F.col("cb")
    h = cc.select("x", "y", ((F.coalesce(F.lag(cb).over(w), cb) + 2 * cb + F.coalesce(F.lead(cb).over(w), cb)) / 4).alias("cb")).where("x % 2 = 0")
    return h.groupBy(F.floor(F.col("x") / 2).alias("cx"), F.floor(F.col("y") / 2).alias("cy")).agg(F.round(128 + 224.0 / 255 * F.sum("cb") / 2, 4).alias("u"))
