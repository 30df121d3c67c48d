"""A quality classifier over bytes: a small convolutional network in numpy.

A text is cut into overlapping chunks of its UTF-8 bytes, from the first to the last.
Each byte is an embedded vector; learned filters run over windows of consecutive bytes, and each
filter's response is max-pooled over its chunk.  The greatest and the mean response over
all chunks give one probability by a logistic layer.

Training uses a bounded sample of labelled rows (``TRAIN_ROWS`` ids of least hash and at most
``TRAIN_CHUNKS`` chunks of a text); scoring runs in the scan of the documents, over every window of bytes (``STRIDE`` 1).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw

CHUNK, HOP = 256, 224  # bytes of a chunk, and from one chunk to the next
WIDTH, STRIDE, DIM, FILTERS = 8, 1, 4, 12
#: Bounds of the sample that the network is fitted on.
TRAIN_ROWS, TRAIN_CHUNKS = 4096, 16
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.01, 7
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
_BLOCK = 256  # chunks that are convolved together
_PAD = 256  # the embedding of what lies behind a text's end
_PLACES = (CHUNK - WIDTH) // STRIDE + 1


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; also for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def chunks(text: bytes) -> np.ndarray:
    """(n, CHUNK) byte values; the last chunk is padded, an empty text has one empty chunk."""
    n = max(1, -(-(len(text) - CHUNK) // HOP) + 1)
    flat = np.full((n - 1) * HOP + CHUNK, _PAD, np.int16)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (n, CHUNK), (flat.itemsize * HOP, flat.itemsize)).copy()


@dataclass
class Network:
    embed: np.ndarray  # (257, DIM)
    filters: np.ndarray  # (WIDTH * DIM, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS + 1,)

    @classmethod
    def new(cls, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.5, (_PAD + 1, DIM)).astype(np.float32)
        embed[_PAD] = 0
        return cls(
            embed, rng.normal(0, 0.3, (WIDTH * DIM, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
            np.concatenate([rng.normal(0, 0.3, 2 * FILTERS), [0.0]]).astype(np.float32),
        )

    def _patches(self, block: np.ndarray) -> np.ndarray:
        x = self.embed[block].reshape(len(block), CHUNK * DIM)
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (len(block), _PLACES, WIDTH * DIM), (s[0], s[1] * STRIDE * DIM, s[1]))

    def pooled(self, all_chunks: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's greatest response in each chunk (and where)."""
        tops, at = [], []
        for i in range(0, len(all_chunks), _BLOCK):
            block = all_chunks[i : i + _BLOCK]
            r = (np.ascontiguousarray(self._patches(block)).reshape(-1, WIDTH * DIM) @ self.filters).reshape(len(block), _PLACES, FILTERS)
            tops.append(r.max(axis=1))
            if places:
                at.append(r.argmax(axis=1))
        top = np.maximum(np.concatenate(tops) + self.bias, 0)
        return top, np.concatenate(at) if places else None

    def score(self, texts: Sequence[bytes]) -> np.ndarray:
        """Probability of label 1 for each text."""
        out, held, sizes, total = [], [], [], 0

        def flush() -> None:
            if held:
                top, _ = self.pooled(np.concatenate(held))
                starts = np.cumsum([0, *sizes[:-1]])
                most = np.maximum.reduceat(top, starts, axis=0)
                mean = np.add.reduceat(top, starts, axis=0) / np.array(sizes)[:, None]
                z = np.concatenate([most, mean], axis=1) @ self.out[:-1] + self.out[-1]
                out.append(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))))
            held.clear(), sizes.clear()

        for t in texts:
            c = chunks(t)
            held.append(c)
            sizes.append(len(c))
            total += len(c)
            if total > 8192:
                flush()
                total = 0
        flush()
        return np.concatenate(out) if out else np.zeros(0)


def fit(texts: Sequence[bytes], marks: Sequence[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Trains on whole small texts by Adam; both labels weigh the same in all.  Without labels nothing is learned."""
    net, rng = Network.new(seed), np.random.default_rng(seed)
    pieces = [chunks(t) for t in texts]
    y = np.array(marks, np.float32)
    share = y.mean() if len(y) else 0.5
    weight = np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)).astype(np.float32)
    names = ("embed", "filters", "bias", "out")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    step = 0
    reach = (np.arange(WIDTH))[None, None, :]
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            block = np.concatenate([pieces[r] for r in rows])
            sizes = np.array([len(pieces[r]) for r in rows])
            starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(rows)), sizes)
            top, at = net.pooled(block, places=True)
            most = np.maximum.reduceat(top, starts, axis=0)
            mean = np.add.reduceat(top, starts, axis=0) / sizes[:, None]
            features = np.concatenate([most, mean, np.ones((len(rows), 1), np.float32)], axis=1)
            z = features @ net.out
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            d_feature = error[:, None] * net.out[None, :-1]
            d_top = d_feature[owner, FILTERS:] / sizes[owner, None]
            is_most = top == most[owner]
            ties = np.add.reduceat(is_most, starts, axis=0, dtype=np.float32)
            d_top = (d_top + d_feature[owner, :FILTERS] * is_most / np.maximum(ties[owner], 1)) * (top > 0)
            # the bytes under each filter's best place
            spot = at[:, :, None] * STRIDE + reach  # (chunks, FILTERS, WIDTH)
            under = block[np.arange(len(block))[:, None, None], spot]
            patch = net.embed[under].reshape(len(block), FILTERS, WIDTH * DIM)
            grads = {
                "out": features.T @ error, "bias": d_top.sum(axis=0), "filters": np.einsum("cf,cfk->kf", d_top, patch),
                "embed": np.zeros_like(net.embed),
            }
            back = d_top[:, :, None] * net.filters.T[None]
            np.add.at(grads["embed"], under.reshape(-1), back.reshape(-1, DIM))
            grads["embed"][_PAD] = 0
            step += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                move = RATE * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                setattr(net, n, (getattr(net, n) - move).astype(np.float32))
    return net


def _excerpt(text: bytes, seed: int) -> bytes:
    """At most TRAIN_CHUNKS chunks' worth of a text: a run that the seed places."""
    most = (TRAIN_CHUNKS - 1) * HOP + CHUNK
    if len(text) <= most:
        return text
    at = seed % (len(text) - most + 1)
    return text[at : at + most]


@F.arrow_udf(T.BinaryType())
def _excerpts(text: pa.Array, seed: pa.Array) -> pa.Array:
    return pa.array([_excerpt(t or b"", s) for t, s in zip(raw(text), seed.to_pylist())], pa.binary())


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, rows: int = TRAIN_ROWS) -> list[tuple[bytes, int]]:
    """At most ``rows`` (excerpt, label), both bounded, of ids that are not held out."""
    known = labels.select(F.col(id_col).alias("_l"), F.col(label).cast("int").alias("_y")).filter("_l IS NOT NULL AND _y IS NOT NULL")
    known = known.filter(~held_out(F.col("_l"))).groupBy("_l").agg(F.min("_y").alias("_y"))
    known = F.broadcast(known.orderBy(F.xxhash64("_l"), "_l").limit(rows))  # bounded by the parameter
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")).join(known, F.col("_id") == F.col("_l"))
    seed = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)).cast("long")
    sample = sample.select("_id", _excerpts(F.col("_t"), seed).alias("_x"), "_y")
    # repeated ids: the least excerpt stands for the id
    got = sample.groupBy("_id").agg(F.min(F.struct("_x", "_y")).alias("r")).orderBy("_id").collect()
    return [(bytes(r["r"]["_x"]), r["r"]["_y"]) for r in got]


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD
) -> DataFrame:
    """id, held_out, score and predicted of every row.

    Null texts are scored as empty ones: the network's value without any bytes.
    Labels with a null id or mark are left out; of several marks of an id the
    least holds.  Without labels every score comes from the untrained network.
    """
    sample = training_rows(docs, labels, id_col, text, label)
    net = fit([x for x, _ in sample], [y for _, y in sample])

    @F.arrow_udf(T.DoubleType())
    def probability(column: pa.Array) -> pa.Array:
        return pa.array(net.score([t or b"" for t in raw(column)]))

    out = docs.select(F.col(id_col).alias("_id"), held_out(F.col(id_col)).alias("held_out"), probability(F.col(text)).alias("score"))
    return out.select(F.col("_id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
