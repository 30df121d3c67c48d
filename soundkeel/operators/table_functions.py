"""Frames as table functions, for SQL.

    SELECT * FROM frames_of(TABLE(chunks) PARTITION BY file ORDER BY chunk_no)
    SELECT c.file, f.* FROM chunks_with_tails c, LATERAL chunk_frames(c.samples, c.start_sample, c.n_own) f

The first takes the chunks of a recording in order and holds no more than a window of samples between batches; a
recording is one task.  The second needs chunks that carry a tail; every chunk is cut on its own, without a shuffle.
Spark takes no Arrow table function beside a lateral join, so the second gets its chunks one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

FRAMES = "file string, frame long, start_sample long, x array<float>"
CHUNK_FRAMES = "frame long, frame_start long, x array<float>"


def _cut(file: str, samples: np.ndarray, at: int, lo: int, hi: int, win: int, hop: int) -> pa.Table:
    """The frames lo..hi of samples that begin at ``at``."""
    no = np.arange(lo, hi + 1, dtype=np.int64)
    pieces = [samples[s - at : s - at + win] for s in (no * hop).tolist()]
    x = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, pieces)]), pa.int32()), pa.array(np.concatenate(pieces), pa.float32()))
    return pa.Table.from_arrays([pa.array([file] * len(no), pa.string()), pa.array(no), pa.array(no * hop), x], ["file", "frame", "start_sample", "x"])


def frames_of(win: int, hop: int, min_len: int | None = None):
    """Table function of one recording's chunks (file, chunk_no, start_sample, samples), in order and without tails."""
    need = min_len or win

    class FramesOf:
        def __init__(self):
            self.file, self.at, self.next, self.held = None, 0, 0, np.empty(0, np.float32)

        def _ready(self, hi: int) -> Iterator[pa.Table]:
            if hi >= self.next:
                yield _cut(self.file, self.held, self.at, self.next, hi, win, hop)
                self.next = hi + 1
                done = min(max(0, self.next * hop - self.at), len(self.held))
                self.at, self.held = self.at + done, self.held[done:]

        def eval(self, chunks: pa.RecordBatch) -> Iterator[pa.Table]:
            if isinstance(chunks, pa.Table):
                chunks = chunks.combine_chunks().to_batches()[0] if chunks.num_rows else chunks
            if not chunks.num_rows:
                return
            if self.file is None:
                self.file = chunks.column("file")[0].as_py()
                self.at = chunks.column("start_sample")[0].as_py()
                self.next = -(-self.at // hop)
            samples = chunks.column("samples").flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            self.held = np.concatenate([self.held, samples])
            yield from self._ready((self.at + len(self.held) - win) // hop)

        def terminate(self) -> Iterator[pa.Table]:
            # frames that the recording's end cuts
            yield from self._ready((self.at + len(self.held) - need) // hop)

    return F.arrow_udtf(FramesOf, returnType=FRAMES)


def chunk_frames(win: int, hop: int, min_len: int | None = None):
    """Table function of one chunk with its tail: (samples, start_sample, n_own)."""
    need = min_len or win

    class ChunkFrames:
        def eval(self, samples: list, start_sample: int, n_own: int) -> Iterator[tuple]:
            samples = samples or []
            lo, hi = -(-start_sample // hop), min((start_sample + n_own - 1) // hop, (start_sample + len(samples) - need) // hop)
            for i in range(lo, hi + 1 if n_own > 0 else lo):
                at = i * hop - start_sample
                yield i, i * hop, samples[at : at + win]

    return F.udtf(ChunkFrames, returnType=CHUNK_FRAMES)


def register(spark: SparkSession, win: int, hop: int, min_len: int | None = None) -> None:
    """Registers ``frames_of`` and ``chunk_frames`` for SQL with one window and hop."""
    spark.udtf.register("frames_of", frames_of(win, hop, min_len))
    spark.udtf.register("chunk_frames", chunk_frames(win, hop, min_len))
