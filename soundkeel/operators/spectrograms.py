"""Whole spectrogram jobs built from framing, spectra and bands.

Input chunks carry a tail of at least one frame (see ``framing``), so frames and
spectra are computed where the samples are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import geo_bin_edges
from ..functions.geo import db, pitch_scale
from ..plans.sizes import join_small
from ..session import shared_dir
from . import kernels
from .framing import PROFILES, centred_windows, cut_clips, frames
from .levels import peak_norm
from .spectra import (
    CLIP_FLOOR,
    band_power,
    clip_bins,
    frame_peak_norm,
    with_broadband,
)


def _edges(lo: float, hi: float, n: int, log: bool = False) -> list[float]:
    if log:
        return [lo * (hi / lo) ** (i / n) for i in range(n + 1)]
    return [lo + (hi - lo) * i / n for i in range(n + 1)]


def stft_db(
    chunks: DataFrame, n_bins: int = 512, win: int = PROFILES["annotator"][0], hop: int = PROFILES["annotator"][1]
) -> DataFrame:
    """Decibel spectrogram over the recording's maximum: 2048 samples every 256,
    lowest ``n_bins`` bins."""
    spec = frames(chunks, win, hop).select(
        "file", "frame", clip_bins(kernels.amplitude_spectrum(F.col("x")), 0, n_bins).alias("a")
    )
    in_db = spec.select("file", "frame", F.transform("a", lambda v: db(v)).alias("x"))
    path = shared_dir(chunks.sparkSession, "stft")  # written once: the transforms are not run again for the maximum
    in_db.write.parquet(path)
    in_db = chunks.sparkSession.read.schema(in_db.schema).parquet(path)
    top = in_db.groupBy("file").agg(F.greatest(F.max(F.array_max("x")), F.lit(0.0)).alias("_top"))
    return join_small(in_db, top, ["file"]).select(
        "file", "frame", F.transform("x", lambda v: F.when(F.col("_top") == 0, v).otherwise(v / F.col("_top"))).alias("x")
    )


def stft_norm(chunks: DataFrame, win: int = 2048, hop: int = 682, lo: int = 4, hi: int = 512) -> DataFrame:
    """Frame-normalised spectrogram of a peak-normalised recording: Hann taper,
    DC dropped, divided by the frame maximum, bins ``lo`` to ``hi - 1``."""
    spec = frames(peak_norm(chunks), win, hop).select(
        "file", "frame", kernels.amplitude_spectrum(F.col("x"), taper="hann_sym").alias("a")
    )
    return spec.select("file", F.col("frame").alias("slice"), clip_bins(frame_peak_norm(F.col("a")), lo, hi).alias("x"))


def clip_spectrogram(
    chunks: DataFrame, fs: int, per_second: int = 100, win: int = 2048, n_bands: int = 512,
    lo: float = 0.0, hi: float = 10000.0,
) -> DataFrame:
    """``log10(band amplitude + 0.001)``, ``per_second`` frames a second."""
    spec = frames(chunks, win, fs // per_second).select(
        "file", "frame", kernels.amplitude_spectrum(F.col("x")).alias("a")
    )
    power = band_power(F.col("a"), fs / win, _edges(lo, hi, n_bands))
    return spec.select(
        "file", F.col("frame").alias("slice"), F.transform(power, lambda v: F.log10(F.abs(v) + CLIP_FLOOR)).alias("x")
    )


def catalog_spectrograms(chunks: DataFrame, fs: float) -> DataFrame:
    """Power density per 256-sample frame with a 32-sample overlap."""
    win, hop = PROFILES["catalog"]
    return frames(chunks, win, hop).select(
        "file", F.col("frame").alias("slice"), kernels.welch(F.col("x"), fs, win).alias("x")
    )


def window_arrays(
    chunks: DataFrame, fs: int, delta_t: float = 3.0, n_slices: int = 100, step_s: float = 1.0, n_bands: int = 150,
    lo: float = 300.0, hi: float = 8000.0, nfft: int = 1024, log: bool = False, cal_db: float = 0.0,
) -> DataFrame:
    """Spectrogram windows of ``delta_t`` seconds every ``step_s`` seconds.

    One row per (file, window, slice) with the broadband value first.  Every
    slice is transformed where its samples are, per window it belongs to.
    """
    block = int(delta_t * fs) // n_slices
    step = int(step_s * fs)
    wins = frames(chunks, block * n_slices, step)
    edges = _edges(lo, hi, n_bands, log)
    slices = wins.select(
        "file",
        F.col("frame").alias("window"),
        (F.col("start_sample") / fs).alias("start_s"),
        F.posexplode(
            F.transform(F.sequence(F.lit(0), F.lit(n_slices - 1)), lambda i: F.slice("x", i * block + 1, F.lit(block)))
        ).alias("slice", "y"),
    )
    psd = slices.withColumn("psd", kernels.welch(F.col("y"), fs, 256, nfft, "spectrum"))
    return psd.select(
        "file",
        "window",
        "start_s",
        (F.col("start_s") + block * n_slices / fs).alias("end_s"),
        "slice",
        with_broadband(band_power(F.col("psd"), fs / nfft, edges)).alias("x"),
    ).withColumn("broadband_db", db(F.get("x", F.lit(0)), cal_db))


def label_windows(
    chunks: DataFrame, labels: DataFrame, fs: int, delta_t: float, chunk_len: int, extra: int,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """Samples of the centred window of each label, with ``extra`` samples after
    it for the frames that reach over its end.

    ``lengths`` (file, n_samples): recordings shorter than the window are first
    put in the middle of a silent window; without it they are left as they are.
    """
    width = int(delta_t * fs)
    spans = centred_windows(labels, fs, delta_t).select("file", "clip_id", F.col("start_idx").alias("_lo"))
    if lengths is None:
        spans = spans.withColumn("_n", F.lit(width).cast("long"))
    else:
        spans = spans.join(lengths.select("file", F.col("n_samples").cast("long").alias("_n")), "file")
    short = F.col("_n") < width
    wanted = spans.withColumns(
        {
            "start_idx": F.when(short, F.lit(0)).otherwise(F.col("_lo")),
            "end_idx": F.when(short, F.col("_n")).otherwise(F.col("_lo") + width + extra),
        }
    )
    cut = cut_clips(chunks, wanted.select("file", "clip_id", "start_idx", "end_idx"), chunk_len)
    if lengths is None:
        return cut.withColumn("end_idx", F.col("start_idx") + width)
    half = F.floor(F.col("_n") / 2).cast("int")
    silence = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)
    padded = F.concat(
        silence(width // 2 - half),
        F.slice(F.col("samples").cast("array<float>"), F.lit(1), 2 * half),
        silence(width + 1 - (width // 2 + half)),
    )
    placed = F.slice(padded, (F.col("_lo") + 1).cast("int"), F.lit(width + extra))
    joined = cut.drop("start_idx", "end_idx").join(spans, ["file", "clip_id"])
    return joined.select(
        "file", "clip_id", F.col("_lo").alias("start_idx"), (F.col("_lo") + width).alias("end_idx"),
        F.when(short, placed).otherwise(F.col("samples").cast("array<float>")).alias("samples"),
    )


def label_matrices(
    chunks: DataFrame, labels: DataFrame, fs: int, chunk_len: int, n_bands: int = 80, n_slices: int = 80,
    lo: float = 400.0, hi: float = 10000.0, delta_t: float = 3.0, nfft: int = 512, log: bool = False,
    per_row_division: bool = False, lengths: DataFrame | None = None,
) -> DataFrame:
    """Scaled ``n_bands x n_slices`` spectrogram per label (``clip_id, spectrogram``).

    Ten overlapping frames per output slice, clipped to [lo, hi), min-max scaled,
    compressed on equal index ranges or (``log``) geometric bands, then passed
    through the display curve.  Slices past the end of the recording are zero.
    """
    hi = min(hi, fs / 2)
    n_raw = n_slices * 10
    width = int(delta_t * fs)
    step = width // n_raw
    reach = int(max(1.25 * nfft, step))
    clips = label_windows(chunks, labels, fs, delta_t, chunk_len, reach, lengths)
    first, last = -int(-lo * nfft // fs), -int(-hi * nfft // fs)
    n_bins = last - first
    if log:
        edges = [min(max(b - first, 0), n_bins) for b in geo_bin_edges(lo, hi, n_bands, nfft, fs)]
    else:
        edges = [i * n_bins // n_bands for i in range(n_bands + 1)]
    return kernels.clip_matrices(
        clips, "clip_id", "samples", fs, nfft, step, reach, n_raw, (first, last), edges, n_slices, "square" if log else "root4",
        per_row_division,
    )


def label_spectrogram(chunks: DataFrame, labels: DataFrame, *args, **kwargs) -> DataFrame:
    """The matrices of ``label_matrices`` as rows ``clip_id, slice, x``."""
    return label_matrices(chunks, labels, *args, **kwargs).select("clip_id", F.posexplode("spectrogram").alias("slice", "x"))


def spectrogram_records(matrices: DataFrame, labels: DataFrame, fs: int, **params) -> DataFrame:
    """One row per clip: the matrix and the metadata of its label (by clip_id)."""
    meta = centred_windows(labels, fs, params["delta_t"]).select(
        "clip_id",
        F.struct(
            F.col("object_class"),
            F.col("file").alias("wav_filename"),
            F.lit(fs).alias("sample_rate"),
            F.col("start_s").alias("start_time_s"),
            "duration_s",
            F.col("start_idx").alias("window_start_idx"),
            F.col("end_idx").alias("window_stop_idx"),
            *[F.lit(v).alias(k) for k, v in params.items()],
        ).alias("record"),
    )
    return matrices.join(meta, "clip_id")


def training_windows(
    chunks: DataFrame, labels: DataFrame, window: int, stride: int, chunk_len: int, classes: int = 3,
    translate: bool = False, semitones: int = 0, jitter: float = 0.0, seed: int = 0, collapse: bool = True,
    normalize: bool = True,
) -> DataFrame:
    """Training examples: ``file, s, shift, x ARRAY<DOUBLE>, y ARRAY<DOUBLE>``.

    Centres every ``stride`` samples, moved by less than a stride
    (``translate``), pitch shifted by whole semitones plus jitter, zero padded at
    the ends, unit length, resampled to ``window`` samples.  All random draws are
    hashes of (file, example, seed), so a retried task draws the same.
    """
    from .labels import presence
    from ..functions.arrays import l2_normalise, resample_linear
    from ..functions.draws import unit

    own = F.col("n_own") if "n_own" in chunks.columns else F.size("samples")
    lengths = chunks.groupBy("file").agg(F.max(F.col("start_sample") + own).alias("_len"))

    def draw(tag: str):
        return unit([F.col("file"), F.col("example")], seed, tag)

    n = F.floor(F.col("_len") / stride).cast("long")
    centres = lengths.filter(n > 0).withColumn("example", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    s = F.col("example") * stride + (F.floor(draw("s") * stride).cast("long") if translate else F.lit(0))
    shift = F.floor((2 * draw("p") - 1) * semitones).cast("double") if semitones else F.lit(0.0)
    shift = shift + (2 * draw("j") - 1) * jitter if jitter else shift
    centres = centres.withColumn("s", s).withColumn("shift", shift)
    centres = centres.withColumn("scale", pitch_scale(F.col("shift")))
    half = F.floor(F.floor(F.col("scale") * window) / 2).cast("long")
    centres = centres.withColumns(
        {"lo": F.col("s") - half, "hi": F.col("s") + half,
         "start_idx": F.greatest(F.col("s") - half, F.lit(0)), "end_idx": F.least(F.col("s") + half, F.col("_len"))}
    )
    flagged = presence(
        centres, labels, ["file"], "s", "start_idx", "end_idx", classes=list(range(classes)), label="label"
    )
    cut = cut_clips(chunks, centres.select("file", "example", "start_idx", "end_idx"), chunk_len, label_id="example")
    joined = flagged.join(cut.select("file", "example", "samples"), ["file", "example"])
    pad = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
    x = F.concat(
        pad(F.col("start_idx") - F.col("lo")),
        F.transform("samples", lambda v: v.cast("double")),
        pad(F.col("hi") - F.col("end_idx")),
    )
    if normalize:
        x = l2_normalise(x)

    hot = F.array(*[F.col(f"has_{c}").cast("double") for c in range(classes)])
    return joined.select(
        "file", "example", "s", "shift", resample_linear(x, F.col("scale"), window).alias("x"), (F.array(F.array_max(hot)) if collapse else hot).alias("y")
    )
