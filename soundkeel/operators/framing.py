"""Fixed windows over recordings stored as chunks.

Chunk rows: ``file, sample_rate, chunk_no, start_sample, n_own, samples``.
``samples`` holds the chunk's ``n_own`` samples and, when the chunk carries a
tail, the samples that follow.  With a tail of ``win - 1`` every frame that
starts in a chunk lies inside its row, so framing needs no shuffle at all; the
recording source reads such tails directly.  ``with_tail`` builds them with one
shuffle for chunks that came without.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import unit

# Window and hop (samples) of the framing profiles; hop 0 means
# "from the sample rate" and is given by the caller.
PROFILES = {
    "detector": (4096, 1024),
    "annotator": (2048, 256),
    "notebook": (2048, 682),
    "catalog": (256, 224),
    "filterbank": (1024, 512),
}


def with_tail(chunks: DataFrame, tail: int, chunk_len: int, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Chunks with up to ``tail`` following samples.

    Input chunks are numbered densely and hold ``chunk_len`` samples except the
    last.  Short ones are joined into blocks of at least four tails; a block also
    receives the first samples of the chunks after it.  One shuffle, and at most
    a quarter of the samples is copied.
    """
    per_block = max(1, math.ceil(4 * tail / chunk_len))
    own_block = F.floor(F.col("chunk_no") / per_block).cast("long")
    first_block = F.floor((F.col("chunk_no") - math.ceil(tail / chunk_len)) / per_block).cast("long")
    spread = chunks.withColumn("_own", own_block).withColumn(
        "_block", F.explode(F.sequence(F.greatest(first_block, F.lit(0)), F.col("_own")))
    )
    own = F.col("_block") == F.col("_own")
    piece = F.when(own, F.col("samples")).otherwise(F.slice("samples", 1, min(tail, chunk_len)))
    rest = [c for c in chunks.columns if c not in (*keys, "chunk_no", "start_sample", "samples", "n_own")]
    pieces = F.array_sort(F.collect_list(F.struct("chunk_no", piece.alias("piece"))))
    blocks = spread.groupBy(*keys, "_block").agg(
        F.min(F.when(own, F.col("start_sample"))).alias("start_sample"),
        F.sum(F.when(own, F.size("samples")).otherwise(0)).cast("int").alias("n_own"),
        F.flatten(F.transform(pieces, lambda p: p["piece"])).alias("samples"),
        *[F.first(c).alias(c) for c in rest],
    )
    return blocks.filter("n_own > 0").select(
        *keys,
        *rest,
        F.col("_block").alias("chunk_no"),
        "start_sample",
        "n_own",
        F.slice("samples", F.lit(1), F.col("n_own") + F.lit(tail)).alias("samples"),
    )


def frames(chunks: DataFrame, win: int, hop: int, min_len: int | None = None) -> DataFrame:
    """One row per frame of chunks that carry a tail of at least ``win - 1``.

    Frame ``i`` covers samples ``[i*hop, i*hop + win)``.  Frames cut by the end
    of the recording are kept when at least ``min_len`` samples remain (default:
    only full frames).
    """
    need = min_len or win
    start = F.col("start_sample")
    first = F.ceil(start / hop).cast("long")
    last_own = F.floor((start + F.col("n_own") - 1) / hop).cast("long")
    last_full = F.floor((start + F.size("samples") - need) / hop).cast("long")
    last = F.least(last_own, last_full)
    cols = [c for c in chunks.columns if c not in ("samples", "n_own", "chunk_no", "start_sample")]
    listed = chunks.filter((F.col("n_own") > 0) & (last >= first)).select(
        *cols, "samples", F.col("start_sample").alias("_start"), F.explode(F.sequence(first, last)).alias("frame")
    )
    return listed.select(
        *cols,
        "frame",
        (F.col("frame") * hop).alias("start_sample"),
        F.slice("samples", (F.col("frame") * hop - F.col("_start") + 1).cast("int"), F.lit(win)).alias("x"),
    )


def frames_from_chunks(
    chunks: DataFrame, win: int, hop: int, chunk_len: int, min_len: int | None = None,
    keys: Sequence[str] = ("file",),
) -> DataFrame:
    """Frames of chunks without tails."""
    return frames(with_tail(chunks, win - 1, chunk_len, keys), win, hop, min_len)


def cut_clips(
    chunks: DataFrame, labels: DataFrame, chunk_len: int, keys: Sequence[str] = ("file",), label_id: str = "clip_id",
) -> DataFrame:
    """Samples inside each ``[start_idx, end_idx)`` label.

    A label is listed under every chunk it touches, matched by (file, chunk_no),
    and its pieces are put together in order; a piece never exceeds a chunk.
    Chunks start at ``chunk_no * chunk_len``.
    """
    touched = labels.filter("end_idx > start_idx").withColumn(
        "chunk_no",
        F.explode(
            F.sequence(
                F.floor(F.greatest("start_idx", F.lit(0)) / chunk_len).cast("long"),
                F.floor((F.greatest(F.col("end_idx"), F.lit(1)) - 1) / chunk_len).cast("long"),
            )
        ),
    )
    on = [*keys, "chunk_no"]
    own = F.col("n_own") if "n_own" in chunks.columns else F.size("samples")
    have = chunks.select(*on, "start_sample", "samples", (F.col("start_sample") + own).alias("_stop"))
    lo = F.greatest(F.col("start_idx"), F.col("start_sample"))
    hi = F.least(F.col("end_idx"), F.col("_stop"))
    pieces = (
        touched.join(have, on)
        .filter(hi > lo)
        .withColumn("piece", F.slice("samples", (lo - F.col("start_sample") + 1).cast("int"), (hi - lo).cast("int")))
    )
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "piece")))
    return pieces.groupBy(*keys, label_id, "start_idx", "end_idx").agg(
        F.flatten(F.transform(ordered, lambda p: p["piece"])).alias("samples")
    )


def centred_windows(labels: DataFrame, fs: float, dt: float) -> DataFrame:
    """Window of ``dt`` seconds centred on each label, moved right to start at 0
    at the earliest; adds ``start_idx`` and ``end_idx``."""
    width = int(dt * fs)
    mid = ((F.col("start_s") + F.col("duration_s") / 2) * fs).cast("long")
    lo = F.greatest(mid - width // 2, F.lit(0))
    return labels.withColumn("start_idx", lo).withColumn("end_idx", lo + width)


def jittered_windows(labels: DataFrame, n: int, max_shift_s: float, seed: int, label_id: str = "clip_id") -> DataFrame:
    """``n`` copies of each label, shifted by up to ``max_shift_s`` either way.

    The shift is a hash of (label, copy, seed): the same on every run and retry.
    """
    copies = labels.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    shifted = copies.withColumn("shift_s", (2 * unit([F.col(label_id), F.col("copy")], seed) - 1) * max_shift_s)
    return shifted.withColumn("start_s", F.greatest(F.col("start_s") + F.col("shift_s"), F.lit(0.0)))
