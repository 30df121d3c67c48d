"""Small numpy kernels behind Arrow UDFs (Spark has no Fourier transform).

Spark hands each kernel an Arrow batch of arrays; rows of equal length are
stacked into a matrix, transformed at once, and returned as an Arrow list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import arrow_udf

MINMAX_FLOOR = 0.01  # what scaled values are lifted by
_BLOCK_VALUES = 4_000_000  # matrix cells transformed at a time


def flat(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (float64) and row offsets of a list array; null rows are empty."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    sizes = np.nan_to_num(v.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    values = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values, np.concatenate([[0], np.cumsum(sizes)])


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    sizes = [len(r) for r in rows]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def by_length(v: pa.Array, fn: Callable[[np.ndarray], np.ndarray]) -> pa.ListArray:
    """Apply a matrix function to the rows, stacked per row length."""
    values, off = flat(v)
    sizes = np.diff(off)
    out: list[np.ndarray] = [np.empty(0)] * len(sizes)
    for n in np.unique(sizes):
        if n == 0:
            continue
        rows = np.flatnonzero(sizes == n)
        step = max(1, _BLOCK_VALUES // int(n))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            m = fn(values[off[part][:, None] + np.arange(n)])
            for r, y in zip(part, m, strict=True):
                out[r] = y
    return lists(out)


def window(kind: str | None, n: int) -> np.ndarray:
    """Tapers by their published definitions: periodic ``hann``, symmetric
    ``hann_sym`` and ``hamming``, periodic ``mask`` = 1 - cos."""
    i = np.arange(n)
    if kind is None:
        return np.ones(n)
    if kind == "hann":
        return 0.5 - 0.5 * np.cos(2 * np.pi * i / n)
    if kind == "hann_sym":
        return 0.5 - 0.5 * np.cos(2 * np.pi * i / max(n - 1, 1))
    if kind == "hamming":
        return 0.54 - 0.46 * np.cos(2 * np.pi * i / max(n - 1, 1))
    if kind == "mask":
        return 1 - np.cos(2 * np.pi * i / n)
    raise ValueError(kind)


def welch_matrix(
    x: np.ndarray, fs: float, nperseg: int, nfft: int | None = None, scaling: str = "density", taper: str = "hann"
) -> np.ndarray:
    """Averaged periodogram of each row: half-overlapping segments, segment mean
    removed, one-sided."""
    nperseg = min(nperseg, x.shape[1])
    nfft = max(nfft or nperseg, nperseg)
    w = window(taper, nperseg)
    seg = np.lib.stride_tricks.sliding_window_view(x, nperseg, axis=1)[:, :: nperseg - nperseg // 2]
    seg = (seg - seg.mean(axis=2, keepdims=True)) * w
    p = np.abs(np.fft.rfft(seg, n=nfft, axis=2)) ** 2
    p *= 1 / (fs * (w**2).sum()) if scaling == "density" else 1 / w.sum() ** 2
    p[..., 1 : -1 if nfft % 2 == 0 else None] *= 2
    return p.mean(axis=1)


def amplitude_spectrum(x: Column, nfft: int | None = None, taper: str | None = None, power: bool = False) -> Column:
    """abs(rfft) of each frame (squared with ``power``)."""

    @arrow_udf("array<double>")
    def kernel(v: pa.Array) -> pa.Array:
        def fn(m: np.ndarray) -> np.ndarray:
            a = np.abs(np.fft.rfft(m * window(taper, m.shape[1]), n=nfft, axis=1))
            return a**2 if power else a

        return by_length(v, fn)

    return kernel(x)


def welch(
    x: Column, fs: float, nperseg: int = 1024, nfft: int | None = None, scaling: str = "density"
) -> Column:
    """Welch spectrum of each frame."""

    @arrow_udf("array<double>")
    def kernel(v: pa.Array) -> pa.Array:
        return by_length(v, lambda m: welch_matrix(m, fs, nperseg, nfft, scaling))

    return kernel(x)


def _strided(x: np.ndarray, fs: float, nfft: int, step: int, reach: int, n: int, bins: tuple[int, int]) -> np.ndarray:
    """Spectra of n frames of ``reach`` samples every ``step``; frames that end early use what there is, from nfft samples on."""
    out = np.zeros((n, bins[1] - bins[0]))
    full = min(n, max(0, (len(x) - reach) // step + 1))
    if full:
        frames = np.lib.stride_tricks.sliding_window_view(x, reach)[::step][:full]
        out[:full] = welch_matrix(frames, fs, 256, nfft, "spectrum")[:, bins[0] : bins[1]]
    for i in range(full, n):
        rest = x[i * step : i * step + reach]
        if len(rest) >= nfft:
            out[i] = welch_matrix(rest[None, :], fs, 256, nfft, "spectrum")[0, bins[0] : bins[1]]
    return out


def _scaled(m: np.ndarray) -> np.ndarray:
    """To [0.01, 1.01]; a constant matrix is unchanged."""
    lo, span = m.min(), m.max() - m.min()
    return m if span == 0 else (m - lo) / span + MINMAX_FLOOR


def _shrunk(m: np.ndarray, edges: list[int], n_slices: int, per_row_division: bool) -> np.ndarray:
    """Sums over the bins between edges, means over the rows of each slice."""
    cuts = [-(-k * len(m) // n_slices) for k in range(n_slices + 1)]
    out = np.zeros((n_slices, len(edges) - 1))
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        width = (k + 1) * len(m) // n_slices - k * len(m) // n_slices
        for j, (a, b) in enumerate(zip(edges, edges[1:])):
            if per_row_division:
                # the k-th bin from the end is divided k times
                weight = float(width) ** -np.arange(b - a, 0, -1)
                out[k, j] = (m[lo:hi, a:b] * weight).sum()
            else:
                out[k, j] = m[lo:hi, a:b].sum() / width
    return out


def _curved(m: np.ndarray, curve: str) -> np.ndarray:
    """Scaled, in decibels, scaled again by the known extent, and curved; values without a logarithm are NaN."""
    once = _scaled(m)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = 10 * np.log10(once)
        if m.max() != m.min():
            lo, hi = 10 * np.log10(MINMAX_FLOOR), 10 * np.log10(1 + MINMAX_FLOOR)
            x = (x - lo) / (hi - lo) + MINMAX_FLOOR
        return {"root4": lambda v: np.sqrt(np.sqrt(v)), "square": np.square, "none": lambda v: v}[curve](x)


def clip_matrices(
    clips: DataFrame, key: str, x: str, fs: float, nfft: int, step: int, reach: int, n: int, bins: tuple[int, int],
    edges: list[int], n_slices: int, curve: str, per_row_division: bool = False,
) -> DataFrame:
    """(key, spectrogram): the scaled, shrunk and curved spectrogram of each clip, which is bounded, in one step.

    ``n`` overlapping frames of a clip become ``n_slices`` rows of the bands between ``edges``, counted from the first of
    the wanted ``bins``.  The samples travel once and only the matrix leaves the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                samples = batch.column(1)[i].values
                y = np.zeros(0) if samples is None else samples.to_numpy(zero_copy_only=False).astype(float)
                m = _scaled(_strided(y, fs, nfft, step, reach, n, bins))
                out.append(_curved(_shrunk(m, edges, n_slices, per_row_division), curve))
            if out:
                values, width = np.concatenate(out).reshape(-1), len(edges) - 1
                rows = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, len(values) + 1, width, dtype=np.int32)), pa.array(values, mask=~np.isfinite(values))
                )
                matrices = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) * n_slices + 1, n_slices, dtype=np.int32)), rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), matrices], [key, "spectrogram"])

    kind = clips.schema[key].dataType.simpleString()
    return clips.select(key, x).mapInArrow(run, f"{key} {kind}, spectrogram array<array<double>>")


def filter_basis(k: int, d: int, low: float, high: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Sine and cosine filters, log spaced from ``low``, under a 1 - cos mask."""
    x = 2 * np.pi * np.arange(d) / d
    cycles = low * d / fs * np.exp(np.arange(k) * np.log(high / low) / k)
    phase = cycles[:, None] * x[None, :]
    mask = 1 - np.cos(x)
    return mask * np.sin(phase), mask * np.cos(phase)


def filterbank(
    x: Column, k: int = 512, d: int = 1024, hop: int = 512, low: float = 50.0, high: float = 6000.0,
    fs: float = 44000.0, log1p: bool = False,
) -> Column:
    """Filter power per hop of each window: k values per region, region by region."""

    @arrow_udf("array<double>")
    def kernel(v: pa.Array) -> pa.Array:
        ws, wc = filter_basis(k, d, low, high, fs)

        def fn(m: np.ndarray) -> np.ndarray:
            if m.shape[1] < d:
                return np.empty((m.shape[0], 0))
            frames = np.lib.stride_tricks.sliding_window_view(m, d, axis=1)[:, ::hop]
            z = (frames @ ws.T) ** 2 + (frames @ wc.T) ** 2
            z = z.reshape(m.shape[0], -1)
            return np.log1p(z) if log1p else z

        return by_length(v, fn)

    return kernel(x)


def pcm_decode(content: Column, subtype: str = "PCM_16", scale: bool = True) -> Column:
    """Little-endian PCM bytes to samples; int16 is scaled to [-1, 1)."""

    @arrow_udf("array<double>")
    def kernel(v: pa.Array) -> pa.Array:
        rows = []
        for b in v.to_pylist():
            if subtype == "PCM_16":
                y = np.frombuffer(b or b"", "<i2").astype(np.float64)
                rows.append(y / 32768 if scale else y)
            else:
                rows.append(np.frombuffer(b or b"", "<f4").astype(np.float64))
        return lists(rows)

    return kernel(content)


LEVEL_SUMS = "struct<n: bigint, s_abs: double, s2: double, s_db: double, s_db2: double, hi: double, s1: double>"


def level_sums(x: Column) -> Column:
    """Per-chunk partial sums behind the level aggregates."""

    @arrow_udf(LEVEL_SUMS)
    def kernel(v: pa.Array) -> pa.Array:
        values, off = flat(v)
        db = 10 * np.log10(values * values + 1)

        def total(a: np.ndarray) -> np.ndarray:
            c = np.concatenate([[0.0], np.cumsum(a)])
            return c[off[1:]] - c[off[:-1]]

        hi = [values[a:b].max() if b > a else None for a, b in zip(off[:-1], off[1:], strict=True)]
        cols = [
            pa.array(np.diff(off)), pa.array(total(np.abs(values))), pa.array(total(values**2)),
            pa.array(total(db)), pa.array(total(db**2)), pa.array(hi, pa.float64()), pa.array(total(values)),
        ]
        return pa.StructArray.from_arrays(cols, ["n", "s_abs", "s2", "s_db", "s_db2", "hi", "s1"])

    return kernel(x)


class _Ranges:
    """Greatest or least values of ranges whose length is a power of two."""

    def __init__(self, x: np.ndarray, pick: np.ufunc):
        self.x, self.pick, self.rows = x, pick, [x]
        while 2 * (step := 1 << (len(self.rows) - 1)) <= len(x):
            last = self.rows[-1]
            self.rows.append(pick(last[:-step], last[step:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of each [lo, hi), which is not empty."""
        k = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(lo))
        for level in np.unique(k):
            at = k == level
            row = self.rows[level]
            out[at] = self.pick(row[lo[at]], row[hi[at] - (1 << level)])
        return out

    def left(self, at: np.ndarray, low: np.ndarray, inside) -> np.ndarray:
        """The least start >= low from which all values before ``at`` satisfy ``inside(rows, values)``."""
        at = at.copy()
        for level in reversed(range(len(self.rows))):
            to = at - (1 << level)
            ok = to >= low
            ok[ok] = inside(ok, self.rows[level][to[ok]])
            at[ok] = to[ok]
        return at

    def right(self, at: np.ndarray, high: np.ndarray, inside) -> np.ndarray:
        """The greatest end <= high up to which all values from ``at`` on satisfy ``inside``."""
        at = at.copy()
        for level in reversed(range(len(self.rows))):
            ok = at + (1 << level) <= high
            ok[ok] = inside(ok, self.rows[level][at[ok]])
            at[ok] += 1 << level
        return at


def first_peaks(spec: np.ndarray, prominence: float, widths: tuple[float, float]) -> tuple[int, int]:
    """Indexes of the first local peak with half-prominence width inside
    ``widths`` and of the first with at least ``prominence`` (-1 if none).

    All peaks at once: the nearest higher values, the least values up to them and the crossings of the half level come
    from tables of greatest and least values of ranges, in n log n steps without a loop over values.
    """
    p = np.flatnonzero((spec[1:-1] > spec[:-2]) & (spec[1:-1] > spec[2:])) + 1
    if not len(p):
        return -1, -1
    n, top = len(spec), spec[p]
    greatest, least = _Ranges(spec, np.maximum), _Ranges(spec, np.minimum)
    lo = greatest.left(p, np.zeros_like(p), lambda k, v: v <= top[k])
    hi = greatest.right(p + 1, np.full_like(p, n), lambda k, v: v <= top[k])
    prom = top - np.maximum(least.of(lo, p + 1), least.of(p, hi))
    level = top - prom / 2
    # the nearest values at or below the half level, or the ends of the peak's range
    a = np.maximum(least.left(p, lo, lambda k, v: v > level[k]) - 1, lo)
    b = np.minimum(least.right(p + 1, hi, lambda k, v: v > level[k]), hi - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        fa = np.where(spec[a] < level, a + (level - spec[a]) / (spec[np.minimum(a + 1, n - 1)] - spec[a]), a)
        fb = np.where(spec[b] < level, b - (level - spec[b]) / (spec[b - 1] - spec[b]), b)
    wide = (fb - fa >= widths[0]) & (fb - fa <= widths[1])
    return tuple(int(p[found.argmax()]) if found.any() else -1 for found in (wide, prom >= prominence))


def tone_measure(x: Column, nfft: int, prominence: float = 2.0, widths: tuple[float, float] = (1.0, 2.0)) -> Column:
    """First spectral peak of a tapered tone by the width rule and by the
    prominence rule, and the mean square of the tapered samples.

    Marked as not repeatable so that a filter on the result does not make Spark
    evaluate the kernel a second time below it.
    """

    @arrow_udf("struct<by_width: int, by_prominence: int, mean_square: double>")
    def kernel(v: pa.Array) -> pa.Array:
        values, off = flat(v)
        found, power = [], []
        for a, b in zip(off[:-1], off[1:], strict=True):
            y = values[a:b] * window("hamming", b - a)
            spec = np.abs(np.fft.rfft(y, n=nfft)) if b > a else np.empty(0)
            found.append(first_peaks(spec, prominence, widths) if len(spec) > 2 else (-1, -1))
            power.append(float(np.mean(y * y)) if b > a else None)
        cols = [pa.array([None if f[k] < 0 else f[k] for f in found], pa.int32()) for k in (0, 1)]
        return pa.StructArray.from_arrays(
            [*cols, pa.array(power, pa.float64())], ["by_width", "by_prominence", "mean_square"]
        )

    return kernel.asNondeterministic()(x)
