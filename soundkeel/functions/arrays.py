"""Array functions on samples, spectra and targets."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    A lambda body is evaluated per element; binding an array-wide value this way
    keeps it out of the inner loop.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def multi_hot(classes: Column, m: int, collapse: bool = False) -> Column:
    """Array of m zeros and ones; with ``collapse`` one element, the maximum."""
    hot = F.transform(
        F.sequence(F.lit(0), F.lit(m - 1)),
        lambda i: F.array_contains(classes, i.cast("int")).cast("double"),
    )
    return F.array(F.array_max(hot)) if collapse else hot


def l2_normalise(x: Column) -> Column:
    def unit(a: Column) -> Column:
        norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v)) + 1e-7
        return let(norm, lambda n: F.transform(a, lambda v: v / n))

    return let(x, unit)


def centred_slice(x: Column, s: Column, w: int) -> Column:
    """``w`` samples centred on index ``s``, zero beyond the ends."""
    lo = (s - w // 2).cast("int")
    places = F.sequence(F.lit(0), F.lit(w - 1))

    def cut(a: Column) -> Column:
        return F.transform(
            places,
            lambda i: F.when((lo + i >= 0) & (lo + i < F.size(a)), F.get(a, lo + i).cast("double")).otherwise(0.0),
        )

    return let(x, cut)


def resample_linear(x: Column, scale: float | Column, n_out: int | None = None) -> Column:
    """Linear interpolation at 0, scale, 2*scale ...; the last value is held."""
    step = scale if isinstance(scale, Column) else F.lit(float(scale))

    def resampled(a: Column) -> Column:
        n = F.size(a)
        out = F.lit(n_out) if n_out else F.floor(n / step).cast("int")

        def at(i: Column) -> Column:
            t = F.least(i * step, (n - 1).cast("double"))
            k = F.floor(t).cast("int")
            return F.get(a, k) * (1 - (t - k)) + F.coalesce(F.get(a, k + 1), F.get(a, k)) * (t - k)

        return F.transform(F.sequence(F.lit(0), out - 1), at)

    return let(x, resampled)


def taper_weight(i: Column, n: Column | int, kind: str) -> Column:
    """Window weight at sample ``i``: hann, hamming (symmetric) or cosine mask
    ``1 - cos`` (periodic)."""
    n = n if isinstance(n, Column) else F.lit(n)
    if kind == "hann":
        return 0.5 - 0.5 * F.cos(2 * math.pi * i / (n - 1))
    if kind == "hamming":
        return 0.54 - 0.46 * F.cos(2 * math.pi * i / (n - 1))
    if kind == "mask":
        return 1 - F.cos(2 * math.pi * i / n)
    raise ValueError(kind)


def taper(x: Column, kind: str) -> Column:
    return let(x, lambda a: F.transform(a, lambda v, i: v * taper_weight(i, F.size(a), kind)))


def mono(ch: Column, how: str = "sum", k: int = 0) -> Column:
    """One channel from an array of channels: ``pick`` channel k, or ``sum``."""
    if how == "pick":
        return F.try_element_at(ch, F.lit(k + 1))
    if how == "sum":
        return F.aggregate(
            F.slice(ch, F.lit(2), F.greatest(F.size(ch) - 1, F.lit(0))),
            F.get(ch, F.lit(0)),
            lambda acc, c: F.zip_with(acc, c, lambda a, b: a + b),
        )
    raise ValueError(how)


def highpass(psd: Column, first_bin: int = 25) -> Column:
    """Zero the bins below ``first_bin``."""
    return F.transform(psd, lambda v, i: F.when(i < first_bin, 0.0).otherwise(v.cast("double")))


def gate(psd: Column, threshold: Column | float) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.transform(psd, lambda v: F.when(v < t, 0.0).otherwise(v))


def mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(x)


def std_pop(x: Column) -> Column:
    """Population standard deviation of an array."""

    def spread(y: Column, m: Column) -> Column:
        squares = F.aggregate(y, F.lit(0.0), lambda a, v: a + (v.cast("double") - m) * (v.cast("double") - m))
        return F.sqrt(squares / F.size(y))

    return let(x, lambda y: let(mean(y), lambda m: spread(y, m)))
