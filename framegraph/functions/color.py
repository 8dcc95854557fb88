"""Colour transfer, tone and matrix functions as Column expressions (IEC 61966-2-1, BT.709, ST 2084, B67, BT.2390, BT.2446)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of SMPTE ST 2084.
PQ_M1, PQ_M2 = 2610 / 16384, 2523 / 4096 * 128
PQ_C1, PQ_C2, PQ_C3 = 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
#: Fixed values of ARIB STD-B67.
HLG_A, HLG_B, HLG_C = 0.17883277, 0.28466892, 0.55991073
#: Fixed values: (Kr, Kb) of the H.273 matrices; any other counts as smpte170m.
KR_KB = {"bt709": (0.2126, 0.0722), "fcc": (0.30, 0.11), "smpte240m": (0.212, 0.087), "bt2020_ncl": (0.2627, 0.0593), "bt2020_cl": (0.2627, 0.0593), "smpte170m": (0.299, 0.114), "bt470_bg": (0.299, 0.114)}
TRANSFERS = ("linear", "srgb", "bt709", "pq", "hlg")


def srgb_to_linear(x: Column) -> Column:
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(x: Column) -> Column:
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def bt709_to_linear(x: Column) -> Column:
    return F.when(x < 0.081, x / 4.5).otherwise(F.pow((x + 0.099) / 1.099, F.lit(1 / 0.45)))


def linear_to_bt709(x: Column) -> Column:
    return F.when(x < 0.018, x * 4.5).otherwise(1.099 * F.pow(x, F.lit(0.45)) - 0.099)


def pq_to_linear(x: Column) -> Column:
    p = F.pow(F.greatest(x, F.lit(0.0)), F.lit(1 / PQ_M2))
    return F.pow(F.greatest(p - PQ_C1, F.lit(0.0)) / (PQ_C2 - PQ_C3 * p), F.lit(1 / PQ_M1))


def linear_to_pq(x: Column) -> Column:
    p = F.pow(F.greatest(x, F.lit(0.0)), F.lit(PQ_M1))
    return F.pow((PQ_C1 + PQ_C2 * p) / (1 + PQ_C3 * p), F.lit(PQ_M2))


def hlg_to_linear(x: Column) -> Column:
    return F.when(x <= 0.5, x * x / 3).otherwise((F.exp((x - HLG_C) / HLG_A) + HLG_B) / 12)


def linear_to_hlg(x: Column) -> Column:
    return F.when(x <= 1 / 12, F.sqrt(3 * x)).otherwise(HLG_A * F.ln(12 * x - HLG_B) + HLG_C)


_TO = {"srgb": srgb_to_linear, "bt709": bt709_to_linear, "pq": pq_to_linear, "hlg": hlg_to_linear}
_FROM = {"srgb": linear_to_srgb, "bt709": linear_to_bt709, "pq": linear_to_pq, "hlg": linear_to_hlg}


def _dispatch(table: dict, transfer: Column, x: Column) -> Column:
    out = F.when(transfer == "linear", x)
    for name, f in table.items():
        out = out.when(transfer == name, f(x))
    return out


def to_linear(transfer: Column, x: Column) -> Column:
    """x decoded by the named transfer; null for an unknown name."""
    return _dispatch(_TO, transfer, x)


def from_linear(transfer: Column, x: Column) -> Column:
    return _dispatch(_FROM, transfer, x)


def bt2390_eetf(linear: Column, peak_in: Column, peak_out: Column) -> Column:
    """Tone curve of BT.2390 per channel: identity in PQ below the knee, a Hermite spline to the target's peak above."""
    source = linear_to_pq(peak_in / 10_000.0)
    target = linear_to_pq(peak_out / 10_000.0) / source
    e = linear_to_pq(linear * peak_in / 10_000.0) / source
    knee = 1.5 * target - 0.5
    t = (e - knee) / F.greatest(1 - knee, F.lit(1e-6))
    spline = (2 * t * t * t - 3 * t * t + 1) * knee + (t * t * t - 2 * t * t + t) * (1 - knee) + (3 * t * t - 2 * t * t * t) * target
    return pq_to_linear(F.when(e < knee, e).otherwise(spline) * source) * 10_000.0 / peak_out


def bt2446a_inverse(linear: Column, peak_in: Column, peak_out: Column) -> Column:
    """Expansion of BT.2446: scaled below 0.5, a Hermite spline to one above; without headroom the light level stays."""
    ratio = peak_out / peak_in
    t = (linear - 0.5) / 0.5
    spline = (2 * t * t * t - 3 * t * t + 1) * 0.5 / ratio + (t * t * t - 2 * t * t + t) / ratio + (3 * t * t - 2 * t * t * t)
    return F.when(peak_out <= peak_in, linear * peak_in / peak_out).when(linear <= 0.5, linear / ratio).otherwise(spline)


def ycbcr_matrix(matrix: Column, range_: Column) -> Column:
    """struct(m: row-major 3x3, offset: 3 bytes) that turns YCbCr bytes into RGB; identity passes through."""
    kr = kb = None
    for name, (r, b) in KR_KB.items():
        kr = (F if kr is None else kr).when(matrix == name, r)
        kb = (F if kb is None else kb).when(matrix == name, b)
    kr, kb = kr.otherwise(0.299), kb.otherwise(0.114)
    kg = 1 - kr - kb
    full = range_ == "full"
    y, c, off = F.when(full, 1.0).otherwise(255.0 / 219.0), F.when(full, 1.0).otherwise(255.0 / 224.0), F.when(full, 0.0).otherwise(16.0)
    zero = F.lit(0.0)
    m = F.array(y, zero, 2 * (1 - kr) * c, y, -2 * (1 - kb) * kb / kg * c, -2 * (1 - kr) * kr / kg * c, y, 2 * (1 - kb) * c, zero)
    identity = F.struct(F.array(*(F.lit(float(i % 4 == 0)) for i in range(9))).alias("m"), F.array(zero, zero, zero).alias("offset"))
    return F.when(matrix == "identity", identity).otherwise(F.struct(m.alias("m"), F.array(off, F.lit(128.0), F.lit(128.0)).alias("offset")))


def ycbcr_to_rgb(matrix: Column, range_: Column, y: Column, cb: Column, cr: Column) -> Column:
    """array(r, g, b) as bytes, rounded and clamped."""
    d = ycbcr_matrix(matrix, range_)
    part = [y - F.get(d["offset"], 0), cb - F.get(d["offset"], 1), cr - F.get(d["offset"], 2)]
    row = lambda k: sum((F.get(d["m"], 3 * k + j) * part[j] for j in range(1, 3)), F.get(d["m"], 3 * k) * part[0])
    return F.array(*(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(row(k) + 0.5).cast("int"))) for k in range(3)))


def resolve_defaults(kind: Column, primaries: Column, transfer: Column, matrix: Column, range_: Column) -> list[Column]:
    """The four axes with defaults by kind (rgb or yuv); rgb always has the identity matrix."""
    rgb = kind == "rgb"
    return [
        F.coalesce(primaries, F.lit("bt709")),
        F.coalesce(transfer, F.when(rgb, "srgb").otherwise("bt709")),
        F.when(rgb, "identity").otherwise(F.coalesce(matrix, F.lit("smpte170m"))),
        F.coalesce(range_, F.when(rgb, "full").otherwise("limited")),
    ]


#: Capture-driver colour spaces by name and code (public kernel header).
V4L2 = {"default": 0, "smpte170m": 1, "smpte240m": 2, "rec709": 3, "bt878": 4, "470m": 5, "470bg": 6, "jpeg": 7, "srgb": 8, "oprgb": 9, "bt2020": 10, "raw": 11, "dci_p3": 12}
_PRIMARIES = {1: "smpte170m", 2: "smpte240m", 3: "bt709", 4: "smpte170m", 5: "bt470_m", 6: "bt470_bg", 7: "bt709", 8: "bt709", 10: "bt2020", 12: "smpte431"}
_TRANSFER = {1: "bt709", 2: "srgb", 4: "smpte240m", 5: "linear", 7: "smpte2084"}
_TRANSFER_DEFAULT = {2: 4, 7: 2, 8: 2, 9: 3, 11: 5, 12: 6}
_MATRIX = {1: "smpte170m", 2: "bt709", 3: "smpte170m", 4: "bt709", 5: "smpte170m", 6: "bt2020_ncl", 7: "bt2020_cl", 8: "smpte240m"}
_MATRIX_DEFAULT = {2: 8, 3: 2, 10: 6, 12: 2}
_RANGE = {1: "full", 2: "limited"}


def _look(code: Column, table: dict) -> Column:
    out = None
    for k, v in table.items():
        out = (F if out is None else out).when(code == k, v)
    return out


def driver_color(space: Column, transfer: Column, encoding: Column, quantization: Column) -> Column:
    """struct(primaries, transfer, matrix, range) of driver codes; code 0 is derived from the space, unmapped codes are null."""
    known = space != 0
    x = F.when(transfer != 0, transfer).when(known, F.coalesce(_look(space, _TRANSFER_DEFAULT), F.lit(1)))
    e = F.when(encoding != 0, encoding).when(known, F.coalesce(_look(space, _MATRIX_DEFAULT), F.lit(1)))
    q = F.when(quantization != 0, quantization).when(known, F.when(space == 7, 1).otherwise(2))
    return F.struct(_look(space, _PRIMARIES).alias("primaries"), _look(x, _TRANSFER).alias("transfer"), _look(e, _MATRIX).alias("matrix"), _look(q, _RANGE).alias("range"))


#: Byte codes of ITU-T H.273.
H273 = {
    "primaries": {"bt709": 1, "bt470_m": 4, "bt470_bg": 5, "smpte170m": 6, "smpte240m": 7, "film": 8, "bt2020": 9, "smpte428": 10, "smpte431": 11, "smpte432": 12, "ebu3213": 22},
    "transfer": {"bt709": 1, "bt470_m": 4, "bt470_bg": 5, "smpte170m": 6, "smpte240m": 7, "linear": 8, "log100": 9, "log100_sqrt10": 10, "xvycc": 11, "bt1361": 12, "srgb": 13, "bt2020_ten_bit": 14, "bt2020_twelve_bit": 15, "smpte2084": 16, "smpte428": 17, "arib_std_b67": 18},
    "matrix": {"identity": 0, "bt709": 1, "fcc": 4, "bt470_bg": 5, "smpte170m": 6, "smpte240m": 7, "ycgco": 8, "bt2020_ncl": 9, "bt2020_cl": 10, "smpte2085": 11, "chroma_ncl": 12, "chroma_cl": 13, "ictcp": 14},
}


def h273_encode(axis: str, name: Column) -> Column:
    return _look(name, H273[axis])


def h273_decode(axis: str, code: Column) -> Column:
    """Name of a byte code; null for a code that the axis does not have."""
    return _look(code, {v: k for k, v in H273[axis].items()})


def luma601(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def invert_rgba(pixels: Column) -> Column:
    """255 - c for every byte but each fourth (alpha)."""
    return F.transform(pixels, lambda x, i: F.when(i % 4 == 3, x).otherwise(255 - x))
