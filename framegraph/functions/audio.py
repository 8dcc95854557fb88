"""Sample arrays (interleaved channels) and control signals as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timing import whole


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def interleave(left: Column, right: Column, clip: bool = False) -> Column:
    """L, R, L, R ... of two mono arrays of one length."""
    f = clamp if clip else lambda x: x
    return F.flatten(F.zip_with(left, right, lambda a, b: F.array(f(a), f(b))))


def expand_mono(samples: Column, channels: int = 2, mode: str = "duplicate") -> Column:
    """Each sample to `channels`: in all, in the first (left) or in the last one (right), zeros elsewhere."""
    zeros = [F.lit(0.0)] * (channels - 1)
    spread = {"duplicate": lambda x: F.array(*[x] * channels), "left": lambda x: F.array(x, *zeros), "right": lambda x: F.array(*zeros, x)}[mode]
    return F.flatten(F.transform(samples, spread))


def _frames(samples: Column, channels: int) -> Column:
    return F.sequence(F.lit(0), F.floor(F.size(samples) / channels).cast("int") - 1)


def convert_channels(samples: Column, source: int, target: int) -> Column:
    """Between channel counts: to mono the mean, from mono copies, else channels in front kept and zeros behind."""
    if source == target:
        return samples
    at = lambda i, c: F.get(samples, i * source + c)
    if target == 1:
        one = lambda i: F.array(sum((at(i, c) for c in range(1, source)), at(i, F.lit(0))) / float(source))
    elif source == 1:
        one = lambda i: F.array(*[F.get(samples, i)] * target)
    else:
        one = lambda i: F.array(*(at(i, c) if c < source else F.lit(0.0) for c in range(target)))
    return F.when(F.size(samples) < source, F.array().cast("array<double>")).otherwise(F.flatten(F.transform(_frames(samples, source), one)))


def planar(samples: Column, channels: int) -> Column:
    """array of one array per channel."""
    return F.array(*(F.filter(samples, (lambda c: lambda x, i: i % channels == c)(c)) for c in range(channels)))


def interleaved(planes: Column) -> Column:
    """Back from planar: the k-th samples of all channels together."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(F.get(planes, 0)) - 1), lambda i: F.transform(planes, lambda p: F.get(p, i))))


#: Half the taps of the Hann-windowed sinc, by quality.
TAPS = {"low": 8, "medium": 16, "high": 32}


def sinc_kernel(source_rate: int, target_rate: int, half: int) -> list[list[float]]:
    """Weights of the 2 * half samples around an output's place, one row for each place between samples that occurs.

    Output j lies at j * source / target; its row is (j * source mod target) / gcd of the rates.
    """
    step, cut = math.gcd(source_rate, target_rate), min(1.0, target_rate / source_rate)
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    parts = [k * step / target_rate for k in range(target_rate // step)]
    return [[cut * sinc(cut * (part - m)) * (0.5 + 0.5 * math.cos(math.pi / half * (part - m))) for m in range(1 - half, half + 1)] for part in parts]


def resample_frame(samples: Column, source_rate: int, target_rate: int, quality: str = "medium") -> Column:
    """One frame of mono samples at another rate, on its own: what lies beyond its ends counts as silence."""
    if source_rate == target_rate:
        return samples
    half, step = TAPS[quality], math.gcd(source_rate, target_rate)
    kernel = F.array(*(F.array(*(F.lit(x) for x in row)) for row in sinc_kernel(source_rate, target_rate, half)))
    padded = F.concat(F.array_repeat(F.lit(0.0), half - 1), samples, F.array_repeat(F.lit(0.0), half))
    n = whole(F.size(samples).cast("long") * target_rate, source_rate).cast("int")

    def one(j: Column) -> Column:
        at = j.cast("long") * source_rate
        near = F.slice(padded, (whole(at, target_rate) + 1).cast("int"), F.lit(2 * half))
        row = F.get(kernel, whole(F.pmod(at, F.lit(target_rate).cast("long")), step).cast("int"))
        return F.aggregate(F.zip_with(near, row, lambda x, w: x * w), F.lit(0.0), lambda total, x: total + x)

    return F.when(n < 1, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), one))


def lfo(waveform: str, time: Column, frequency: Column, offset: Column) -> Column:
    """sine, triangle, square or sawtooth in [0, 1] at phase (time * frequency + offset) mod 1."""
    phase = (time * frequency + offset) % 1
    return {
        "sine": (F.sin(phase * (2 * math.pi)) + 1) / 2,
        "triangle": F.when(phase < 0.5, phase * 2).otherwise(2 - phase * 2),
        "square": F.when(phase < 0.5, 0.0).otherwise(1.0),
        "sawtooth": phase,
    }[waveform]


def ramp(time: Column, start: Column, duration: Column, low: Column, high: Column) -> Column:
    gone = time - start
    return F.when(gone < 0, low).when(gone >= duration, high).otherwise(low + (high - low) * gone / duration)


def scale_range(x: Column, low: Column, high: Column) -> Column:
    return low + x * (high - low)


#: The notes of the test chord in Hz.
CHORD = (261.63, 329.63, 392.00)


def chord(sample: Column, rate: int, amplitude: float = 0.15) -> Column:
    """Sum of the chord's sines at a running sample number."""
    parts = [F.sin(F.lit(2 * math.pi * f / rate) * sample) for f in CHORD]
    return (parts[0] + parts[1] + parts[2]) * amplitude


def psnr(mse: Column, n: Column) -> Column:
    """Peak signal-to-noise ratio in dB of bytes: 100 for equal planes, -1 for none."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, -1.0).when(mse <= 1e-10, 100.0).otherwise(10 * F.log10(F.lit(255.0 * 255.0) / mse))


def plane_mse(a: Column, b: Column) -> Column:
    """Mean squared difference of two arrays of one length; null for empty ones."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) > 0, total / F.size(a))
