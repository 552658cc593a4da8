"""Signals, one a row, as array<double> columns: transforms, convolution, filters, spectra; and tapers as columns.

Kernels run on Arrow batches. A signal that is null or holds null gives null, an empty one an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR = "struct<re:array<double>,im:array<double>>"


def _whole(x) -> bool:
    return x is not None and not any(v is None or v != v for v in x)


def _pairs(f: Callable[..., np.ndarray], *columns: Column) -> Column:
    """f of signals, complex results."""

    def run(*series: pd.Series) -> pd.DataFrame:
        rows = [f(*(np.asarray(x, float) for x in row)) if all(map(_whole, row)) else None for row in zip(*series, strict=True)]
        return pd.DataFrame({"re": [None if z is None else z.real.tolist() for z in rows], "im": [None if z is None else z.imag.tolist() for z in rows]})

    return _udf(run, PAIR, pd.DataFrame, columns)


def _reals(f: Callable[..., np.ndarray], *columns: Column) -> Column:
    """f of signals, real results."""

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(f(*(np.asarray(x, float) for x in row)), float).tolist() if all(map(_whole, row)) else None for row in zip(*series, strict=True)], dtype=object)

    return _udf(run, "array<double>", pd.Series, columns)


def _udf(run, kind: str, out: type, columns: tuple[Column, ...]) -> Column:
    g = {1: lambda a: run(a), 2: lambda a, b: run(a, b)}[len(columns)]
    g.__annotations__ = dict.fromkeys(g.__code__.co_varnames[: len(columns)], pd.Series) | {"return": out}
    return F.pandas_udf(g, kind)(*columns)


def fft(x: Column) -> Column:
    return _pairs(np.fft.fft, x)


def ifft(re: Column, im: Column) -> Column:
    return _pairs(lambda a, b: np.fft.ifft(a + 1j * b) if len(a) else a + 0j, re, im)


def real_fft(x: Column) -> Column:
    """The first half of the spectrum of a real signal, which says all."""
    return _pairs(lambda a: np.fft.rfft(a) if len(a) else a + 0j, x)


def fft_2d(x: Column, width: int) -> Column:
    """The transform of an image in row order."""
    return _pairs(lambda a: np.fft.fft2(a.reshape(-1, width)).ravel(), x)


def ifft_2d(re: Column, im: Column, width: int) -> Column:
    return _pairs(lambda a, b: np.fft.ifft2((a + 1j * b).reshape(-1, width)).ravel(), re, im)


def magnitude_2d(x: Column, width: int) -> Column:
    return _reals(lambda a: np.abs(np.fft.fft2(a.reshape(-1, width))).ravel(), x)


def _long(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def _convolve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a) or not len(b):
        return np.zeros(0)
    n = len(a) + len(b) - 1
    return np.fft.irfft(np.fft.rfft(a, _long(n) * 2) * np.fft.rfft(b, _long(n) * 2))[:n]


def convolve(a: Column, b: Column) -> Column:
    """Whole convolution, through spectra."""
    return _reals(_convolve, a, b)


def correlate(a: Column, b: Column) -> Column:
    """Whole cross-correlation: sums of a[i + k] * b[i] for k from 1 - len(b) on."""
    return _reals(lambda x, y: _convolve(x, y[::-1]), a, b)


def periodogram(x: Column, rate: float = 1.0) -> Column:
    """One-sided power density at the frequencies of real_fft."""

    def one(a: np.ndarray) -> np.ndarray:
        if not len(a):
            return a
        p = np.abs(np.fft.rfft(a - a.mean())) ** 2 / (rate * len(a))
        p[1 : (len(a) + 1) // 2] *= 2
        return p

    return _reals(one, x)


def _analytic(a: np.ndarray) -> np.ndarray:
    n = len(a)
    if not n:
        return a + 0j
    w = np.zeros(n)
    w[0] = 1
    w[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        w[n // 2] = 1
    return np.fft.ifft(np.fft.fft(a) * w)


def hilbert(x: Column) -> Column:
    """The analytic signal: x and its quadrature."""
    return _pairs(_analytic, x)


def instantaneous_frequency(x: Column, rate: float = 1.0) -> Column:
    """Turns a second between neighbouring samples of the analytic signal."""
    return _reals(lambda a: np.diff(np.unwrap(np.angle(_analytic(a)))) * rate / (2 * math.pi), x)


def sections(x: Column, parts: list[tuple[float, ...]], both_ways: bool = False) -> Column:
    """Second-order sections (b0, b1, b2, a1, a2) in turn; both ways: forward and back, without a shift in phase."""

    def one(a: np.ndarray) -> np.ndarray:
        for _ in range(2 if both_ways else 1):
            for b0, b1, b2, a1, a2 in parts:
                y, z1, z2 = np.empty(len(a)), 0.0, 0.0
                for i, v in enumerate(a.tolist()):
                    w = b0 * v + z1
                    z1, z2 = b1 * v - a1 * w + z2, b2 * v - a2 * w
                    y[i] = w
                a = y
            if both_ways:
                a = a[::-1]
        return a

    return _reals(one, x)


def notch(frequency: float, quality: float = 30.0) -> list[tuple[float, ...]]:
    """A section that takes out one frequency, in turns a sample."""
    w = 2 * math.pi * frequency
    k = math.tan(w / (2 * quality))
    g, c = 1 / (1 + k), math.cos(w)
    return [(g, -2 * g * c, g, -2 * g * c, 2 * g - 1)]


def chebyshev_low(order: int, ripple: float, cutoff: float) -> list[tuple[float, ...]]:
    """Sections of a Chebyshev low-pass of the first kind: ripple in decibels, cutoff in turns a sample below 0.5."""
    eps = math.sqrt(10 ** (ripple / 10) - 1)
    v = math.asinh(1 / eps) / order
    warp = 2 * math.tan(math.pi * cutoff)
    out, gain = [], 1.0 if order % 2 else 1 / math.sqrt(1 + eps * eps)
    for k in range(order // 2):
        a = math.pi * (2 * k + 1) / (2 * order)
        p = complex(-math.sinh(v) * math.sin(a), math.cosh(v) * math.cos(a)) * warp
        z = (2 + p) / (2 - p)
        a1, a2 = -2 * z.real, abs(z) ** 2
        g = (1 + a1 + a2) / 4
        out.append((g, 2 * g, g, a1, a2))
    if order % 2:
        z = (2 - math.sinh(v) * warp) / (2 + math.sinh(v) * warp)
        g = (1 - z) / 2
        out.append((g, g, 0.0, -z, 0.0))
    b0, b1, b2, a1, a2 = out[0]
    out[0] = (gain * b0, gain * b1, gain * b2, a1, a2)
    return out


def response(parts: list[tuple[float, ...]], frequency: float) -> float:
    """Gain of sections at a frequency in turns a sample."""
    z = complex(math.cos(2 * math.pi * frequency), -math.sin(2 * math.pi * frequency))
    return abs(math.prod((b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in parts))


_COSINES = {
    "rectangular": (1.0,),
    "hann": (0.5, 0.5),
    "hamming": (0.54, 0.46),
    "blackman": (0.42, 0.5, 0.08),
    # fixed values: the usual five-term flat top
    "flat top": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
}


def taper(name: str, i: Column, n: Column | int) -> Column:
    """A window's value at sample i of n (symmetric; a single sample has 1)."""
    n = n if isinstance(n, Column) else F.lit(n)
    x = 2 * math.pi * i / F.when(n > 1, n - 1)
    out = F.lit(0.0)
    for k, c in enumerate(_COSINES[name]):
        out = out + F.lit((-1) ** k * c) * F.cos(k * x)
    return F.when(n > 1, out).otherwise(1.0)


def bessel_i0(x: Column, terms: int = 30) -> Column:
    """Modified Bessel function of order 0, by its series (for |x| up to about 20)."""
    y, out = x * x / 4, F.lit(1.0)
    for k in range(terms - 1, 0, -1):
        out = 1 + y / float(k * k) * out
    return out


def kaiser(i: Column, n: int, beta: float) -> Column:
    if n < 2:
        return F.lit(1.0)
    r = 2 * i / (n - 1) - 1
    return bessel_i0(beta * F.sqrt(F.greatest(1 - r * r, F.lit(0.0)))) / bessel_i0(F.lit(float(beta)))


def fir_taps(cutoff: float, taps: int, high: bool = False, window: str = "hamming") -> list[float]:
    """A windowed sinc: low-pass with gain 1 at nothing, or its complement; taps must be odd, cutoff in turns a sample."""
    if taps % 2 == 0:
        raise ValueError("an odd number of taps")
    k = np.arange(taps) - taps // 2
    w = sum((-1) ** j * c * np.cos(2 * np.pi * j * np.arange(taps) / max(1, taps - 1)) for j, c in enumerate(_COSINES[window]))
    h = 2 * cutoff * np.sinc(2 * cutoff * k) * w
    h /= h.sum()
    return ((k == 0) - h if high else h).tolist()
