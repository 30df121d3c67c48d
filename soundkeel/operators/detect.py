"""Call detection over recordings.

Framing and spectra run in parallel over chunks.  The gate has a feedback: the subtracted background follows the quiet frames,
and whether a frame is quiet depends on the background.  It runs in parallel all the same, over blocks of
frames of a recording.  A first pass runs every block from the recording's starting background.  Which frames it finds quiet
makes a block an affine map from the background before it to the one after it, so the true starts of all
blocks follow by composing one small map per block.  Blocks are then run again from their new starts; only where that
changes which frames are quiet do later starts change, and only blocks whose start changed are
run again.  When no start changes, every block has run from what the frames before it left, and its frames
are those of a run through the whole recording.  Every pass settles at least one block more; two are the rule.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from . import kernels
from .bouts import segment_calls
from .framing import frames
from .spectra import HIGHPASS_BIN, MIN_SPACING_HZ

# Samples behind the first background, its weight per quiet
# frame, gate in standard deviations, segment length of the spectra.
BACKGROUND_FROM, BACKGROUND_TO = 5000, 10000
KEEP = 0.99
GATE_SIGMAS = 4.0
SEGMENT = 1024
WIN, HOP = 4096, 1024
#: Frames of a recording that one task runs through: some 8 MB of spectra.
BLOCK_FRAMES = 2048
#: Most frames that are tried as quiet at once.
STRETCH = 64

FRAME_SCHEMA = (
    "file string, frame long, start_sample long, n_peaks int, f0 double, f0_std double, peak double"
)
_RUN_SCHEMA = FRAME_SCHEMA + ", block long, quiet long, carried array<double>, choices string, used array<double>"


def initial_background(chunks: DataFrame, fs: float, lo: int = BACKGROUND_FROM, hi: int = BACKGROUND_TO,
                       segment: int = SEGMENT) -> DataFrame:
    """Spectrum of samples [lo, hi) per file; files without all of them drop out."""
    start, own = F.col("start_sample"), F.col("n_own")
    a, b = F.greatest(start, F.lit(lo)), F.least(start + own, F.lit(hi))
    pieces = chunks.filter((start < hi) & (start + own > lo)).select(
        "file", "start_sample", F.slice("samples", (a - start + 1).cast("int"), (b - a).cast("int")).alias("piece")
    )
    whole = pieces.groupBy("file").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start_sample", "piece"))), lambda p: p["piece"])).alias("x")
    )
    spectrum = whole.filter(F.size("x") == hi - lo).select("file", kernels.welch(F.col("x"), fs, segment).alias("psd"))
    quiet = F.transform("psd", lambda v, i: F.when((i > 0) & (i < HIGHPASS_BIN), 0.0).otherwise(v))
    return spectrum.select("file", quiet.alias("psd"))


class Gate:
    """Background, threshold and the step from one spectrum to its peaks."""

    def __init__(self, background: np.ndarray, bin_hz: float, threshold: float | None = None, adaptive: bool = False):
        self.background = background.astype(float)
        self.bin_hz = bin_hz
        self.adaptive = adaptive
        self.threshold = self._level() if threshold is None else threshold

    def _level(self) -> float:
        return float(self.background.mean() + GATE_SIGMAS * self.background.std())

    def step(self, psd: np.ndarray) -> tuple[int, float, float, float]:
        return self.run(psd[None, :])[0]

    def run(self, psds: np.ndarray) -> list[tuple[int, float, float, float]]:
        """Peaks, spacing, its spread and the highest peak of each spectrum, in order.

        A stretch is tried as if all of its frames were quiet, which gives the background before each of them; up to the first
        that is not, this was right.  Stretches grow while frames are quiet.
        """
        out: list[tuple[int, float, float, float]] = []
        length = 1
        while len(out) < len(psds):
            block = psds[len(out) : len(out) + length]
            before = np.empty((len(block) + 1, block.shape[1]))
            before[0] = self.background
            for k, psd in enumerate(block):
                before[k + 1] = KEEP * before[k] + (1 - KEEP) * psd
                before[k + 1, :HIGHPASS_BIN] = 0
            d = block - before[:-1]
            d[:, :HIGHPASS_BIN] = 0
            if self.adaptive:
                levels = before.mean(axis=1) + GATE_SIGMAS * before.std(axis=1)
                levels[0] = self.threshold
                d[d < levels[:-1, None]] = 0
            else:
                d[d < self.threshold] = 0
            mid = d[:, 1:-1]
            high = (mid > d[:, :-2]) & (mid > d[:, 2:]) & (mid >= d.std(axis=1)[:, None])
            quiet, loud = len(block), None
            for k in np.flatnonzero(high.any(axis=1)):
                loud = self._peaks(d[k], np.flatnonzero(high[k]) + 1)
                if loud:
                    quiet = int(k)
                    break
            out += [(0, 0.0, 0.0, float("nan"))] * quiet
            self.background = before[quiet].copy()
            if self.adaptive and quiet:
                self.threshold = float(levels[quiet])
            if loud:
                out.append(loud)
            length = 1 if loud else min(2 * length, STRETCH)
        return out

    def _peaks(self, d: np.ndarray, at: np.ndarray) -> tuple[int, float, float, float] | None:
        """What a frame with peaks at these bins gives; None where they make it a quiet one."""
        if len(at) == 1:
            return 1, 0.0, 0.0, float(d[at[0]])
        gaps = np.diff(at) * self.bin_hz
        wide = gaps > MIN_SPACING_HZ
        if not wide.any():
            return None
        kept = np.append(at[1:][wide], at[np.flatnonzero(wide)[0]])
        return len(kept), float(gaps[wide].mean()), float(gaps[wide].std()), float(d[kept].max())


def _stored(df: DataFrame) -> DataFrame:
    path = shared_dir(df.sparkSession, "gate")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _after(background: np.ndarray, quiet: int, carried: np.ndarray) -> np.ndarray:
    """The background after ``quiet`` quiet frames whose weighted sum is ``carried``."""
    if quiet:
        background = KEEP**quiet * background + carried
        background[:HIGHPASS_BIN] = 0
    return background


def _run_blocks(spectra: DataFrame, starts: DataFrame, bin_hz: float, adaptive: bool) -> DataFrame:
    """Frames of the blocks in ``starts`` (file, block, psd, threshold), run from there.

    The last frame of a block carries its affine map (quiet, carried), a digest of which frames were quiet, and the start.
    """
    ends = {"frame": F.lit(-1).cast("long"), "start_sample": F.lit(-1).cast("long")}
    mine = spectra.join(starts.select("file", "block"), ["file", "block"], "left_semi").withColumn("threshold", F.lit(None).cast("double"))
    rows = mine.unionByName(starts.withColumns(ends))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame", kind="stable")
        start, threshold = np.array(pdf["psd"].iloc[0], dtype=float), pdf["threshold"].iloc[0]
        gate = Gate(start, bin_hz, None if pd.isna(threshold) else threshold, adaptive)
        psds = np.array(pdf["psd"].iloc[1:].tolist(), dtype=float).reshape(len(pdf) - 1, len(start))
        found = gate.run(psds)
        quiet = np.array([x[0] == 0 for x in found], bool)
        carried = np.zeros(len(start))
        for psd in psds[quiet]:
            carried = KEEP * carried + (1 - KEEP) * psd
        out = pd.DataFrame(found, columns=["n_peaks", "f0", "f0_std", "peak"])
        out.insert(0, "start_sample", pdf["start_sample"].iloc[1:].to_numpy())
        out.insert(0, "frame", pdf["frame"].iloc[1:].to_numpy())
        out.insert(0, "file", pdf["file"].iloc[0])
        out["block"], last = pdf["block"].iloc[0], len(out) - 1
        carried[:HIGHPASS_BIN] = 0
        digest = hashlib.sha1(np.packbits(quiet).tobytes()).hexdigest()
        for name, value in (("quiet", int(quiet.sum())), ("carried", carried), ("choices", digest), ("used", start)):
            out[name] = [None] * last + [value] if last >= 0 else []
        return out

    return rows.groupBy("file", "block").applyInPandas(run, _RUN_SCHEMA)


def _composed(maps: DataFrame, background: DataFrame, adaptive: bool) -> DataFrame:
    """The start (file, block, psd, threshold) of every block, from the maps of the blocks before it; a recording has one small map per block."""
    first = background.select("file", F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("quiet"), F.col("psd").alias("carried"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", kind="stable")
        now = np.array(pdf["carried"].iloc[0], dtype=float)
        threshold, out = None if adaptive else Gate(now, 1.0).threshold, []
        for block, quiet, carried in zip(pdf["block"].iloc[1:], pdf["quiet"].iloc[1:], pdf["carried"].iloc[1:], strict=True):
            out.append((pdf["file"].iloc[0], block, now, threshold))
            now = _after(now, int(quiet), np.array(carried, dtype=float))
        return pd.DataFrame(out, columns=["file", "block", "psd", "threshold"])

    rows = maps.select("file", "block", "quiet", "carried").unionByName(first)
    return rows.groupBy("file").applyInPandas(run, "file string, block long, psd array<double>, threshold double")


def gate_frames(spectra: DataFrame, background: DataFrame, bin_hz: float, adaptive: bool = False, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """Peaks per frame of each recording that has a starting background; see the module for how blocks of frames run in parallel."""
    background = _stored(background.select("file", "psd"))
    blocked = spectra.join(background.select("file"), "file", "left_semi")
    spectra = _stored(blocked.select("file", F.floor(F.col("frame") / block_frames).cast("long").alias("block"), "frame", "start_sample", "psd"))
    blocks = spectra.select("file", "block").distinct()
    starts = blocks.join(background, "file").withColumn("threshold", F.lit(None).cast("double"))
    passes, settled = [], None
    while settled is None or not starts.isEmpty():
        ran = _stored(_run_blocks(spectra, starts, bin_hz, adaptive))
        turn = F.lit(len(passes)).alias("turn")
        passes.append(ran.select("*", turn))
        maps = ran.filter("quiet IS NOT NULL").select("file", "block", "quiet", "carried", "choices", "used", turn)
        if settled is not None:
            maps = maps.unionByName(settled.join(maps.select("file", "block"), ["file", "block"], "left_anti"))
        settled = _stored(maps)
        due = _composed(settled, background, adaptive).join(settled.select("file", "block", "used"), ["file", "block"])
        starts = _stored(due.filter(F.col("psd") != F.col("used")).drop("used"))
    rows = passes[0]
    for more in passes[1:]:
        rows = rows.unionByName(more)
    names = [x.split()[0] for x in FRAME_SCHEMA.split(", ")]
    found = rows.join(settled.select("file", "block", "turn"), ["file", "block", "turn"]).select(*names)
    return found.withColumn("peak", F.when(~F.isnan("peak"), F.col("peak")))


def detector_frames(
    chunks: DataFrame, fs: float, adaptive: bool = False, smooth: bool = False, heads: DataFrame | None = None,
    block_frames: int = BLOCK_FRAMES,
) -> DataFrame:
    """Gated frames of chunks that carry a tail of ``WIN - 1`` samples.

    Frames cut by the end of the recording are kept from one hop upwards.
    ``heads``: the chunks with the first samples of each recording, when they can
    be read on their own.
    """
    from .spectra import smooth_spectrum

    framed = frames(chunks, WIN, HOP, min_len=HOP)
    psd = kernels.welch(F.col("x"), fs, SEGMENT)
    spectra = framed.select("file", "frame", "start_sample", (smooth_spectrum(psd) if smooth else psd).alias("psd"))
    return gate_frames(spectra, initial_background(chunks if heads is None else heads, fs), fs / SEGMENT, adaptive, block_frames)


def detect_calls(chunks: DataFrame, fs: float, adaptive: bool = False, smooth: bool = False,
                 keep_open: bool = False, heads: DataFrame | None = None, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    return segment_calls(detector_frames(chunks, fs, adaptive, smooth, heads, block_frames), keep_open=keep_open)


def scan_folder(spark, path: str, fs: float, chunk_samples: int = 1 << 16, **options) -> DataFrame:
    """Calls in all recordings of a folder.

    Frames need no shuffle (chunks are read with their tails) and the starting
    backgrounds come from a second, small read of the first chunks.
    """
    from ..sources.wav import first_channel, read_wav

    chunks = first_channel(read_wav(spark, path, chunk_samples, WIN - 1))
    heads = first_channel(read_wav(spark, path, chunk_samples, stop=BACKGROUND_TO))
    return detect_calls(chunks, fs, heads=heads, **options)


def scan_status(chunks: DataFrame) -> DataFrame:
    """Per recording: samples, and whether it is long enough to be searched."""
    return chunks.groupBy("file").agg(F.sum("n_own").alias("n_samples")).withColumn(
        "status", F.when(F.col("n_samples") >= BACKGROUND_TO, "ok").otherwise("too short")
    )
