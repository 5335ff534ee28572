"""Scalar functions of the acoustic front end, as Column expressions on arrays and numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_add(a: Column, b: Column) -> Column:
    """ln(e^a + e^b) without overflow."""
    high, low = F.greatest(a, b), F.least(a, b)
    return high + F.log1p(F.exp(low - high))


def mel(hertz: Column) -> Column:
    return 2595.0 * F.log10(1 + hertz / 700.0)


def hertz(mel_: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), mel_ / 2595.0) - 1)


def hamming(samples: Column) -> Column:
    """The samples under a Hamming window; a single sample is unchanged."""
    n = F.size(samples)
    return F.transform(samples, lambda x, i: x * (0.54 - 0.46 * F.cos(2 * math.pi * i / F.greatest(n - 1, F.lit(1)))))


def without_mean(samples: Column) -> Column:
    shifted = lambda total: F.transform(samples, lambda x: x - total / F.size(samples))
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + x, shifted)


def power_spectrum(samples: Column, size: int) -> Column:
    """Squared magnitude of the bins 0 to size/2 of the discrete Fourier transform of up to size samples."""
    def part(k: Column, wave) -> Column:
        terms = F.transform(samples, lambda x, i: x * wave(-2 * math.pi * k * i / size))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    return F.transform(F.sequence(F.lit(0), F.lit(size // 2)), lambda k: F.pow(part(k, F.cos), 2) + F.pow(part(k, F.sin), 2))


def filter_bank(rate: float, size: int, filters: int, low: float, high: float) -> list[list[float]]:
    """Weights (filters, size/2 + 1) of triangles of unit area whose edges are even on the mel scale."""
    to_mel = lambda f: 2595.0 * math.log10(1 + f / 700.0)
    to_hertz = lambda m: 700.0 * (10 ** (m / 2595.0) - 1)
    step = (to_mel(high) - to_mel(low)) / (filters + 1)
    edges = [to_hertz(to_mel(low) + n * step) for n in range(filters + 2)]
    out = []
    for left, top, right in zip(edges, edges[1:], edges[2:], strict=False):
        height = 2 / (right - left)
        bins = [n * rate / size for n in range(size // 2 + 1)]
        out.append([height * max(0.0, min((f - left) / (top - left), (right - f) / (right - top))) for f in bins])
    return out


def filtered(spectrum: Column, bank: list[list[float]]) -> Column:
    """The spectrum through each filter; the bank is small and becomes literals."""
    dot = lambda row: F.aggregate(F.zip_with(spectrum, F.array(*map(F.lit, row)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.array(*[dot(row) for row in bank])


def log_floor(spectrum: Column, floor: float = 1e-4) -> Column:
    return F.transform(spectrum, lambda x: F.log(x + floor))


def dct(values: Column, size: int, keep: int) -> Column:
    """Orthonormal DCT-II: the first keep coefficients of size values."""
    def coefficient(k: int) -> Column:
        scale = math.sqrt((1 if k == 0 else 2) / size)
        wave = F.array(*[F.lit(scale * math.cos(math.pi * k * (n + 0.5) / size)) for n in range(size)])
        return F.aggregate(F.zip_with(values, wave, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)

    return F.array(*[coefficient(k) for k in range(keep)])


def lifter(cepstra: Column, strength: int) -> Column:
    return F.transform(cepstra, lambda x, i: x * (1 + strength / 2 * F.sin(i * math.pi / strength)))


def frame_seconds(start: Column, end: Column, shift: float) -> tuple[Column, Column]:
    """Begin and end in seconds of the inclusive frames start to end."""
    return start * shift, (end + 1) * shift
