"""Call detection on a stream of spectra, one state per recorder.

State: background spectrum, threshold, the next frame and the open call's sums.
Rows of one recorder are handled in frame order, block by block as they come: only
frames that arrive before their predecessors wait, so memory follows the disorder
within a trigger, not its length.  Frames missing at the end of a trigger are passed
over; triggers must arrive in order.  The first row of a recorder is its starting
background (``frame = -1``).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import kernels
from ..operators.detect import BACKGROUND_FROM, BACKGROUND_TO, HOP, SEGMENT, WIN, Gate
from ..operators.spectra import HIGHPASS_BIN
from ..sources.wav import first_channel, follow_wav

OUTPUT = (
    "file string, startidx long, stopidx long, lencall long, n_frames long, f0 double, sigma_f0 double, "
    "mean_peak double, sigma_peak double"
)
STATE = (
    "background array<double>, threshold double, start long, n long, f0 double, f0_sq double, peak double, peak_sq double, "
    "due long"
)


def _db(v: float) -> float | None:
    return 10 * math.log10(v) if v > 0 else None


def _in_order(blocks: Iterator[pd.DataFrame], due: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(frame, start_sample, psd) by frame; a frame waits until those before it have come or the blocks end."""
    early: list[tuple[int, int, int, np.ndarray]] = []
    turn = 0  # keeps equal frames in their order of arrival
    for pdf in blocks:
        for frame, at, psd in zip(pdf["frame"], pdf["start_sample"], pdf["psd"], strict=True):
            heapq.heappush(early, (int(frame), turn, int(at), psd))
            turn += 1
            while early and early[0][0] <= due:
                f, _, a, p = heapq.heappop(early)
                due = max(due, f + 1)
                yield f, a, p
    while early:
        f, _, a, p = heapq.heappop(early)
        yield f, a, p


def _stretches(frames: Iterator[tuple[int, int, np.ndarray]], most: int = 1024) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Frames in lists of bounded length; a starting background is alone."""
    held: list[tuple[int, int, np.ndarray]] = []
    for x in frames:
        if held and (x[0] < 0 or held[0][0] < 0 or len(held) == most):
            yield held
            held = []
        held.append(x)
    if held:
        yield held


class CallDetector(StatefulProcessor):
    def __init__(self, bin_hz: float, adaptive: bool = False):
        self.bin_hz = bin_hz
        self.adaptive = adaptive

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("detector", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        saved = self.state.get() if self.state.exists() else None
        gate, start, n, f0, f0_sq, peak, peak_sq, due = None, -1, 0, 0.0, 0.0, 0.0, 0.0, -1
        if saved:
            gate = Gate(np.array(saved[0], dtype=float), self.bin_hz, saved[1], self.adaptive)
            start, n, f0, f0_sq, peak, peak_sq, due = saved[2:]
        out = []
        for stretch in _stretches(_in_order(rows, due)):
            due = max(due, stretch[-1][0] + 1)
            if stretch[0][0] < 0:
                gate = Gate(np.array(stretch[0][2], dtype=float), self.bin_hz, adaptive=self.adaptive)
                continue
            if gate is None:
                continue
            found = gate.run(np.array([psd for *_, psd in stretch], dtype=float))
            for (_, at, _), (peaks, spacing, _, top) in zip(stretch, found, strict=True):
                if peaks > 0:
                    if n == 0:
                        start = int(at)
                    n, f0, f0_sq = n + 1, f0 + spacing, f0_sq + spacing**2
                    peak, peak_sq = peak + top, peak_sq + top**2
                elif n > 0:
                    mf, mp = f0 / n, peak / n
                    sd_f = math.sqrt(max(f0_sq / n - mf * mf, 0.0))
                    sd_p = math.sqrt(max(peak_sq / n - mp * mp, 0.0))
                    out.append((key[0], start, int(at), int(at) - start, n, mf, sd_f, _db(mp), 0.0 if n == 1 else _db(sd_p)))
                    start, n, f0, f0_sq, peak, peak_sq = -1, 0, 0.0, 0.0, 0.0, 0.0
        if gate is not None:
            self.state.update((gate.background.tolist(), gate.threshold, start, n, f0, f0_sq, peak, peak_sq, due))
        yield pd.DataFrame(
            out,
            columns=["file", "startidx", "stopidx", "lencall", "n_frames", "f0", "sigma_f0", "mean_peak", "sigma_peak"],
        )

    def close(self) -> None:
        pass


def streaming_calls(spectra: DataFrame, bin_hz: float, adaptive: bool = False) -> DataFrame:
    """Closed calls of a stream ``file, frame, start_sample, psd``.

    Needs the RocksDB state store provider.
    """
    return spectra.groupBy("file").transformWithStateInPandas(
        statefulProcessor=CallDetector(bin_hz, adaptive), outputStructType=OUTPUT, outputMode="append", timeMode="None"
    )


def spectra_of(chunks: DataFrame, fs: float) -> DataFrame:
    """``file, frame, start_sample, psd`` of chunks that carry a tail of ``WIN - 1`` samples, row by row.

    The first chunk of a recording gives its starting background as frame -1; it must hold
    ``BACKGROUND_TO`` samples, so that a recording without them drops out, as in a batch.
    """
    start, own = F.col("start_sample"), F.col("n_own")
    first = F.ceil(start / HOP).cast("long")
    last = F.least(F.floor((start + own - 1) / HOP), F.floor((start + F.size("samples") - HOP) / HOP)).cast("long")

    def frame(i):
        return F.struct(i.alias("frame"), (i * HOP).alias("at"), F.slice("samples", (i * HOP - start + 1).cast("int"), F.lit(WIN)).alias("x"))

    none = F.lit(-1).cast("long")
    head = F.struct(none.alias("frame"), none.alias("at"), F.slice("samples", BACKGROUND_FROM + 1, BACKGROUND_TO - BACKGROUND_FROM).alias("x"))
    heads = F.when((start == 0) & (own >= BACKGROUND_TO), F.array(head)).otherwise(F.array())
    framed = F.when(last >= first, F.transform(F.sequence(first, F.greatest(first, last)), frame)).otherwise(F.array())
    rows = chunks.select("file", F.explode(F.concat(heads, framed)).alias("f"))
    spectra = rows.select("file", "f.frame", F.col("f.at").alias("start_sample"), kernels.welch(F.col("f.x"), fs, SEGMENT).alias("psd"))
    quiet = F.transform("psd", lambda v, i: F.when((i > 0) & (i < HIGHPASS_BIN), 0.0).otherwise(v))
    return spectra.withColumn("psd", F.when(F.col("frame") < 0, quiet).otherwise(F.col("psd")))


def follow_calls(spark: SparkSession, path: str, fs: float, chunk_samples: int = 1 << 16, adaptive: bool = False) -> DataFrame:
    """Closed calls in the recordings of a folder, as they are recorded: those that a scan of the finished folder finds."""
    if chunk_samples < BACKGROUND_TO:
        raise ValueError(f"a chunk must hold the {BACKGROUND_TO} samples of the starting background")
    chunks = first_channel(follow_wav(spark, path, chunk_samples, WIN - 1))
    return streaming_calls(spectra_of(chunks, fs), fs / SEGMENT, adaptive)
