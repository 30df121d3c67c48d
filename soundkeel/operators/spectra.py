"""Spectra and spectrograms.

A spectrogram is stored as one row per time slice, ``clip_id, slice, x`` with
``x ARRAY<DOUBLE>`` over frequency.  Work along frequency is an array expression
inside the row (no shuffle); work along time is a grouped aggregate or a
neighbourhood window of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from ..functions.arrays import let, mean, std_pop
from ..plans.halo import drop_halo, halo_window, with_halo
from ..plans.sizes import join_small
from .kernels import by_length

# First bin kept by the high pass, smallest peak spacing (Hz),
# floor added after min-max scaling, floor added before the clip logarithm.
HIGHPASS_BIN = 25
MIN_SPACING_HZ = 100.0
MINMAX_FLOOR = 0.01
CLIP_FLOOR = 0.001


def _get(x: Column, i: Column) -> Column:
    return F.get(x, i.cast("int"))


def spectral_peaks(x: Column) -> Column:
    """Indexes of strict local maxima at least as high as the spectrum's
    population standard deviation."""

    def peaks(a: Column) -> Column:
        inner = F.slice(
            F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0))), F.lit(2), F.greatest(F.size(a) - 2, F.lit(0))
        )
        return let(
            std_pop(a),
            lambda s: F.filter(
                inner,
                lambda i: (F.get(a, i) > F.get(a, i - 1)) & (F.get(a, i) > F.get(a, i + 1)) & (F.get(a, i) >= s),
            ),
        )

    return let(x, peaks)


def compact_peaks(peaks: Column, bin_hz: Column | float, min_hz: float = MIN_SPACING_HZ) -> Column:
    """``n, spacing_mean, spacing_std, kept`` of peak indexes.

    Neighbouring peaks further apart than ``min_hz`` keep their right end; the
    first such pair keeps both ends.  A lone peak counts as one; several peaks
    with no wide spacing count as none.
    """
    hz = bin_hz if isinstance(bin_hz, Column) else F.lit(float(bin_hz))

    def gap(p: Column, i: Column) -> Column:
        return (F.get(p, i) - F.get(p, i - 1)) * hz

    def summary(p: Column, right: Column) -> Column:
        n, wide = F.size(p), F.size(right) > 0
        kept = F.concat(
            F.array(F.get(p, F.get(right, F.lit(0)) - 1)), F.transform(right, lambda i: F.get(p, i))
        )
        return let(
            F.transform(right, lambda i: gap(p, i)),
            lambda gaps: F.struct(
                F.when(n == 1, 1).when(wide, F.size(right) + 1).otherwise(0).alias("n"),
                F.when(wide, mean(gaps)).otherwise(0.0).alias("spacing_mean"),
                F.when(wide, std_pop(gaps)).otherwise(0.0).alias("spacing_std"),
                F.when(n == 1, p).when(wide, kept).otherwise(F.slice(p, 1, 0)).alias("kept"),
            ),
        )

    def wide_pairs(p: Column) -> Column:
        """Positions whose peak lies more than ``min_hz`` above the one before."""
        n = F.size(p)
        places = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
        return F.filter(places, lambda i: (i < n) & (gap(p, i) > min_hz))

    return let(peaks, lambda p: let(wide_pairs(p), lambda right: summary(p, right)))


def peak_stats(spectra: DataFrame, bin_hz: float, min_hz: float = MIN_SPACING_HZ, psd: str = "psd") -> DataFrame:
    """Peak count, spacing and highest kept peak per spectrum; no shuffle."""
    x = F.col(psd)
    found = spectra.withColumn("_p", compact_peaks(spectral_peaks(x), bin_hz, min_hz))
    keep = [c for c in spectra.columns if c != psd]
    return found.select(
        *keep,
        F.col("_p.n").alias("n_peaks"),
        F.col("_p.spacing_mean").alias("f0"),
        F.col("_p.spacing_std").alias("f0_std"),
        F.array_max(F.transform("_p.kept", lambda i: F.get(x, i))).cast("double").alias("peak"),
    )


def long_form(spec: DataFrame, x: str = "x", value: str = "v") -> DataFrame:
    keep = [c for c in spec.columns if c != x]
    return spec.select(*keep, F.posexplode(x).alias("band", value))


def packed_form(cells: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Cells back to one array per slice; a slice has a fixed number of bands."""
    ordered = F.array_sort(F.collect_list(F.struct("band", value)))
    return cells.groupBy(*keys).agg(F.transform(ordered, lambda c: c[value]).alias("x"))


def band_power(psd: Column, bin_hz: Column | float, edges: Sequence[float]) -> Column:
    """Power per band: bin ``i`` spans ``(i +- 0.5) * bin_hz`` and gives each band
    the fraction of its span that lies inside the band."""
    hz = bin_hz if isinstance(bin_hz, Column) else F.lit(float(bin_hz))
    table = F.array(
        *[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in zip(edges, edges[1:], strict=False)]
    )

    def one(p: Column, b: Column) -> Column:
        lo, hi = b["lo"] / hz, b["hi"] / hz
        first = F.greatest(F.floor(lo + 0.5), F.lit(0)).cast("int")
        last = F.least(F.ceil(hi + 0.5), F.size(p) - 1).cast("int")
        share = lambda i: F.greatest(F.least(i + 0.5, hi) - F.greatest(i - 0.5, lo), F.lit(0.0))
        bins = F.sequence(first, F.greatest(first, last))
        return F.aggregate(bins, F.lit(0.0), lambda a, i: a + F.coalesce(F.get(p, i), F.lit(0.0)) * share(i))

    return let(psd, lambda p: F.transform(table, lambda b: one(p, b)))


def integrate_bands(x: Column, bin_edges: Sequence[int]) -> Column:
    """Sum of the bins ``[edge_k, edge_k+1)`` per band."""
    table = F.array(*[F.array(F.lit(int(a)), F.lit(int(b))) for a, b in zip(bin_edges, bin_edges[1:], strict=False)])
    return let(
        x,
        lambda y: F.transform(
            table,
            lambda e: F.aggregate(F.slice(y, F.get(e, 0) + 1, F.get(e, 1) - F.get(e, 0)), F.lit(0.0), lambda a, v: a + v),
        ),
    )


def with_broadband(bands: Column) -> Column:
    """Band powers with their total in front."""
    return let(bands, lambda b: F.concat(F.array(F.aggregate(b, F.lit(0.0), lambda a, v: a + v)), b))


def band_levels(spectra: DataFrame, keys: Sequence[str], bin_hz: float, edges: Sequence[float], psd: str = "psd") -> DataFrame:
    """Long form: one row per band plus the broadband row (band -1)."""
    total = spectra.select(*keys, F.posexplode(with_broadband(band_power(F.col(psd), bin_hz, edges))).alias("band", "power"))
    return total.withColumn("band", F.col("band") - 1)


def band_totals(bands: DataFrame, recording: str, frame: str = "frame", band: str = "band", power: str = "power") -> DataFrame:
    """Band rows, the broadband of each frame, the mean of each band and the mean broadband of each recording in one pass.

    Grouping sets over rows of single bands: ``level`` is Spark's grouping id, 0 for (recording, frame, band), 1 for (recording, frame),
    2 for (recording, band) and 3 for the recording; what is summed over is null.  ``power`` is the
    sum over bands, averaged over frames; ``peak`` the greatest single value.  Every frame has its bands from 0 on.
    """
    sets = [[recording, frame, band], [recording, frame], [recording, band], [recording]]
    out = bands.groupingSets([[F.col(c) for c in x] for x in sets], recording, frame, band).agg(
        F.grouping_id().cast("int").alias("level"), F.sum(power).alias("_sum"), F.max(power).alias("peak"), F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col(band) == 0).alias("_frames"),
    )
    frames = F.when(F.col("level") == 2, F.col("cells")).when(F.col("level") == 3, F.col("_frames")).otherwise(F.lit(1))
    return out.select(recording, frame, band, "level", (F.col("_sum") / frames).alias("power"), "peak", "cells")


def compress(
    spec: DataFrame, n_bands: int, n_slices: int, in_slices: Column | int, edges: Sequence[int] | None = None,
    keys: Sequence[str] = ("clip_id",), per_row_division: bool = False,
) -> DataFrame:
    """Shrink spectrograms to ``n_bands x n_slices``: sum over the frequency
    cells, mean over the time cells of each output cell.

    Bands are equal index ranges, or ``edges``.  Output band sums are formed
    inside each row, so only reduced rows are shuffled.  ``per_row_division``
    divides by the number of time cells after every frequency row instead of
    once, so the k-th row from the end is divided k times.
    """
    total = in_slices if isinstance(in_slices, Column) else F.lit(in_slices)
    x = F.col("x")

    def edge(i: Column) -> Column:
        if edges is not None:
            return F.get(F.array(*[F.lit(int(e)) for e in edges]), i)
        return F.floor(i * F.size(x) / n_bands).cast("int")

    t = F.col("slice").cast("long")
    out_slice = (F.ceil((t + 1) * n_slices / total) - 1).cast("int")
    width = (
        F.floor((F.col("_slice") + 1) * total / n_slices) - F.floor(F.col("_slice") * total / n_slices)
    ).cast("double")

    def band_sum(i: Column) -> Column:
        lo = edge(i)
        part = F.slice(x, lo + 1, edge(i + 1) - lo)
        if not per_row_division:
            return F.aggregate(part, F.lit(0.0), lambda a, v: a + v) / F.col("_width")
        return F.aggregate(part, F.lit(0.0), lambda a, v: (a + v) / F.col("_width"))

    rows = spec.withColumn("_slice", out_slice).withColumn("_width", width)
    cells = rows.select(
        *keys, F.col("_slice").alias("slice"),
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), band_sum)).alias("band", "v"),
    )
    return cells.groupBy(*keys, "slice", "band").agg(F.sum("v").alias("v"))


def extent(spec: DataFrame, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    return spec.groupBy(*keys).agg(F.min(F.array_min("x")).alias("lo"), F.max(F.array_max("x")).alias("hi"))


def minmax(spec: DataFrame, keys: Sequence[str] = ("clip_id",), bounded: bool = False) -> DataFrame:
    """Scale each clip to [0.01, 1.01]; constant clips are unchanged.

    Clips of any length: the extent is a grouped aggregate, joined back.  Clips
    of a fixed number of slices (``bounded``): a window per clip, which later
    steps on the same key reuse without another shuffle.
    """
    if bounded:
        w = Window.partitionBy(*keys)
        with_ends = spec.withColumns(
            {"lo": F.min(F.array_min("x")).over(w), "hi": F.max(F.array_max("x")).over(w)}
        )
    else:
        with_ends = join_small(spec, extent(spec, keys), list(keys))
    span = F.col("hi") - F.col("lo")
    scaled = F.transform("x", lambda v: (v - F.col("lo")) / span + MINMAX_FLOOR)
    return with_ends.withColumn("x", F.when(span == 0, F.col("x")).otherwise(scaled)).drop("lo", "hi")


def display_curve(spec: DataFrame, kind: str, keys: Sequence[str] = ("clip_id",), bounded: bool = False) -> DataFrame:
    """Min-max scale, decibels, min-max scale, then a curve: ``root4`` (double
    square root) or ``square``.

    The first scaling leaves [0.01, 1.01] and decibels keep the order, so the
    second extent is known; a clip that the first left unchanged is constant.
    """
    curve = {"root4": lambda v: F.sqrt(F.sqrt(v)), "square": lambda v: v * v, "none": lambda v: v}[kind]
    lo, hi = 10 * F.log10(F.lit(MINMAX_FLOOR)), 10 * F.log10(F.lit(1.0) + MINMAX_FLOOR)
    once = minmax(spec.withColumn("_x", F.col("x")), keys, bounded)
    db_ = F.transform("x", lambda v: 10 * F.log10(v))
    flat = F.col("x") == F.col("_x")
    again = F.transform(db_, lambda v: (v - lo) / (hi - lo) + MINMAX_FLOOR)
    return once.withColumn("x", F.transform(F.when(flat, db_).otherwise(again), curve)).drop("_x")


def zmask(spec: DataFrame, k: float, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """1 where a cell exceeds mean + k sigma of its slice and of its band.

    Slice statistics stay in the row; band statistics are a grouped aggregate of
    one row per band, packed into one array per clip and joined back.
    """
    bands = long_form(spec.select(*keys, "x")).groupBy(*keys, "band").agg(
        (F.avg("v") + k * F.stddev_pop("v")).alias("v")
    )
    limits = packed_form(bands, keys).withColumnRenamed("x", "_band_limit")
    x = F.col("x")
    row_limit = let(mean(x) + k * std_pop(x), lambda r: F.zip_with(
        x, F.col("_band_limit"), lambda v, b: ((v > r) & (v > b)).cast("int")))
    return join_small(spec, limits, list(keys)).withColumn("x", row_limit).drop("_band_limit")


def _morph(spec: DataFrame, k: int, n: int, keys: Sequence[str], grow: bool) -> DataFrame:
    """n passes of a k x k maximum (or minimum); same as one pass of reach
    ``n (k-1)/2``.  Bands first, inside the row; then time, as a window over
    chunks of slices with copied edges."""
    reach = n * (k - 1) // 2
    pick = F.array_max if grow else F.array_min
    x = F.col("x")
    along = F.transform(
        x,
        lambda v, i: pick(F.slice(x, F.greatest(i - reach, F.lit(0)) + 1, i + reach + 1 - F.greatest(i - reach, F.lit(0)))),
    )
    cells = long_form(spec.withColumn("x", along))
    halo = with_halo(cells, "slice", 512, before=reach, after=reach)
    w = halo_window([*keys, "band"], "slice").rangeBetween(-reach, reach)
    out = drop_halo(halo.withColumn("v", (F.max if grow else F.min)("v").over(w)))
    return packed_form(out, [*keys, "slice"])


def dilate(spec: DataFrame, k: int = 5, n: int = 1, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    return _morph(spec, k, n, keys, True)


def erode(spec: DataFrame, k: int = 5, n: int = 1, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    return _morph(spec, k, n, keys, False)


def frame_peak_norm(x: Column) -> Column:
    """Spectrum with the first bin zeroed, divided by its maximum."""
    no_dc = F.transform(x, lambda v, i: F.when(i == 0, 0.0).otherwise(v.cast("double")))
    return let(no_dc, lambda y: let(F.array_max(y), lambda top: F.transform(y, lambda v: F.when(top == 0, v).otherwise(v / top))))


def clip_bins(x: Column, lo: int, hi: int) -> Column:
    return F.slice(x, lo + 1, hi - lo)


def running_levels(bands: DataFrame, keys: Sequence[str], index: str, value: str, lengths: Sequence[int]) -> DataFrame:
    """Trailing means of band levels over several numbers of frames."""
    longest = max(lengths)
    halo = with_halo(bands, index, max(4096, longest), before=longest - 1, after=0)
    w = halo_window(keys, index)
    out = halo.withColumns({f"avg_{n}": F.avg(value).over(w.rangeBetween(-n + 1, 0)) for n in lengths})
    return drop_halo(out)


# 11-point cubic smoothing weights and their divisor.
SMOOTH_WEIGHTS = (-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36)
SMOOTH_DIVISOR = 429


def _edge_fit() -> np.ndarray:
    """The cubic fitted to 11 points, evaluated at them."""
    basis = np.vander(np.arange(11.0) - 5, 4)
    return basis @ np.linalg.pinv(basis)


def _smooth(m: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Sliding weights; the first and last 5 bins evaluate the cubic of the 11 at that end."""
    n = m.shape[1]
    out = np.zeros_like(m)
    for i, w in enumerate(SMOOTH_WEIGHTS):
        out[:, 5 : n - 5] += w / SMOOTH_DIVISOR * m[:, i : n - 10 + i]
    out[:, :5] = m[:, :11] @ fit[:5].T
    out[:, n - 5 :] = m[:, n - 11 :] @ fit[6:].T
    return out


def _detrended(m: np.ndarray) -> np.ndarray:
    at = np.arange(m.shape[1]) - (m.shape[1] - 1) / 2
    return m - m.mean(axis=1, keepdims=True) - (m @ at / (at @ at))[:, None] * at


def smooth_spectrum(psd: Column) -> Column:
    """Smooth, remove the straight-line trend, smooth again (11 bins at least)."""
    fit = _edge_fit()

    @arrow_udf("array<double>")
    def kernel(v: pa.Array) -> pa.Array:
        def fn(m: np.ndarray) -> np.ndarray:
            if m.shape[1] < 11:
                raise ValueError("a spectrum needs 11 bins to be smoothed")
            return _smooth(_detrended(_smooth(m, fit)), fit)

        return by_length(v, fn)

    return kernel(psd)
