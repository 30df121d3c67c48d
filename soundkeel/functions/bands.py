"""Frequency band edges as small tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def band_edges(lo: float, hi: float, n: int, log: bool = False) -> Column:
    """n+1 edges from lo to hi, linear or log spaced."""
    if log:
        step = (math.log10(hi) - math.log10(lo)) / n
        return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.pow(F.lit(10.0), math.log10(lo) + i * step))
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: lo + i * ((hi - lo) / n))


def bands(spark: SparkSession, lo: float, hi: float, n: int, log: bool = False) -> DataFrame:
    """``band, f_lo, f_hi``; n rows, so it may always be broadcast."""
    edges = spark.range(1).select(band_edges(lo, hi, n, log).alias("e"))
    return edges.select(F.posexplode(F.slice("e", 1, n)).alias("band", "f_lo"), "e").select(
        "band", "f_lo", F.get("e", F.col("band") + 1).alias("f_hi")
    )


def _highest(lo: float, hi: float, n: int, nfft: int, fs: float) -> float:
    hi = min(hi, fs / 2)
    narrowest = lo ** (1 - 1 / n) * hi ** (1 / n) - 1
    if fs / nfft > narrowest:
        raise ValueError(f"bin width {fs / nfft} Hz exceeds {narrowest} Hz: raise nfft or the lower limit")
    return hi


def geo_bin_edges(lo: float, hi: float, n: int, nfft: int, fs: float) -> list[int]:
    """The n + 1 bins at or above the edges of ``geo_bands``, as numbers for the plan."""
    hi = _highest(lo, hi, n, nfft, fs)
    return [math.ceil(round(lo ** (1 - i / n) * hi ** (i / n) * nfft / fs, 9)) for i in range(n + 1)]


def geo_bands(spark: SparkSession, lo: float, hi: float, n: int, nfft: int, fs: float) -> DataFrame:
    """Geometric bands with the index of the first bin at or above each edge.

    The upper limit is lowered to the Nyquist frequency; bins wider than the
    first band are refused.
    """
    hi = _highest(lo, hi, n, nfft, fs)
    edge = lambda i: F.pow(F.lit(float(lo)), 1 - i / n) * F.pow(F.lit(float(hi)), i / n)
    first = lambda f: F.ceil(F.round(f * nfft / fs, 9)).cast("int")
    b = F.col("id")
    return spark.range(n).select(
        b.cast("int").alias("band"),
        edge(b).alias("f_lo"),
        edge(b + 1).alias("f_hi"),
        first(edge(b)).alias("bin_lo"),
        first(edge(b + 1)).alias("bin_hi"),
    )
