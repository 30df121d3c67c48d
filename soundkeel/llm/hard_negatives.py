"""Hard negatives of anchors by exact integer scores, a tile of anchors by a block of candidates at a time.

Vectors become integers once.  Candidates, sorted by label, are written in blocks, anchors in tiles; a stored list
names the files of tasks that ended well.  A cell of work is a tile and a bounded list of blocks: a task
multiplies the tile by each of them (Strassen's recursion on int64, zero padding, integer additions) and
keeps, per anchor, a heap of the first positives, or per anchor and positive a heap of the first negatives in
its window.  Heaps of cells are merged by ranks.  Positives meet blocks of their tile's labels
alone, negatives all blocks: this is the stated query set against all rows.  No score leaves a
task unless it is in a heap, and no vector is shuffled more than once.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_dir
from .common import stored
from .warc import file_system

#: Rows of an anchor tile and of a candidate block, and the most numbers that either holds.
TILE_ROWS = 512
BLOCK_ROWS = 4096
MAX_NUMBERS = 1 << 21
#: Most blocks of one cell of work.
CELL_BLOCKS = 1024
#: About the vectors of a sorting task.
RANGE_ROWS = 50_000
#: Sides up to this length are multiplied directly.
LEAF = 32
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these tenths of the positive's.
LOW, HIGH = 3, 9
_MIN, _MAX = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _even(x: np.ndarray) -> np.ndarray:
    return np.pad(x, [(0, n & 1) for n in x.shape]) if any(n & 1 for n in x.shape) else x


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with the rows of ``b``, int64, by Strassen's recursion.

    All arithmetic is modulo 2**64, so a product that fits 64 bits is exact whatever the sums between.
    """
    rows, columns = len(a), len(b)
    if min(rows, columns, a.shape[1]) <= LEAF:
        return np.einsum("ik,jk->ij", a, b)
    a, b = _even(a), _even(b)
    m, n, k = len(a) // 2, len(b) // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    # b is the transposed right side: its upper right quarter is b[n:, :k]
    b11, b21, b12, b22 = b[:n, :k], b[:n, k:], b[n:, :k], b[n:, k:]
    p1 = products(a11 + a22, b11 + b22)
    p2 = products(a21 + a22, b11)
    p3 = products(a11, b12 - b22)
    p4 = products(a22, b21 - b11)
    p5 = products(a11 + a12, b22)
    p6 = products(a21 - a11, b11 + b12)
    p7 = products(a12 - a22, b21 + b22)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out[:rows, :columns]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows of unequal length: the shorter end in zeros."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, [(0, 0), (0, width - x.shape[1])]).astype(np.int64) for x in (a, b))
    return products(a, b)


class Heaps:
    """The first ``k`` (score, id) of each of ``rows``: higher scores first, then smaller ids."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.row, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.full = np.zeros(rows, bool)
        self.last_score, self.last_id = np.full(rows, _MIN), np.full(rows, _MAX)

    def offer(self, score: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Entries of a matrix of rows by ids, which ascend, where ``fits`` is true."""
        last = self.last_score[:, None]
        fits = fits & (~self.full[:, None] | (score > last) | ((score == last) & (ids[None, :] < self.last_id[:, None])))
        if fits.sum() > 4 * self.k * len(score) and score.shape[1] > self.k:
            # of a row's entries above or at its k-th, and of those at it the first k, which have the smallest ids
            masked = np.where(fits, score, _MIN)
            kth = np.partition(masked, -self.k, axis=1)[:, -self.k, None]
            ties = fits & (score == kth)
            fits &= (score > kth) | (ties & (np.cumsum(ties, axis=1) <= self.k))
        at, column = np.nonzero(fits)
        self.push(at, score[at, column], ids[column])

    def push(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(row):
            return
        row, score, ids = (np.concatenate(x) for x in ((self.row, row), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, row))  # ~ turns the order over and cannot overflow
        row, score, ids = row[order], score[order], ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < self.k
        self.row, self.score, self.id, rank = row[kept], score[kept], ids[kept], rank[kept]
        end = rank == self.k - 1
        self.full[self.row[end]] = True
        self.last_score[self.row[end]], self.last_id[self.row[end]] = self.score[end], self.id[end]


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of unequal length as a matrix that ends in zeros, in the narrowest integers that hold them."""
    lengths, values = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    for kind in (np.int8, np.int16, np.int32):
        if out.size and np.iinfo(kind).min <= out.min() and out.max() <= np.iinfo(kind).max:
            return out.astype(kind)
    return out


def _blocks(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        piece = batch.slice(at, rows)
        widest = max(piece.column(2).value_lengths().to_pylist(), default=0)
        if piece.num_rows > 1 and piece.num_rows * widest > MAX_NUMBERS:
            yield from _blocks(piece, max(1, MAX_NUMBERS // max(widest, 1)) if MAX_NUMBERS // max(widest, 1) < piece.num_rows else piece.num_rows // 2)
        else:
            yield piece


def _written(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Writes sorted vectors (_id, _label, _q) in files of at most ``rows``; the stored list (path, labels)."""
    spark = vectors.sparkSession
    folder = shared_dir(spark, name)
    parts = max(1, -(-vectors.count() // RANGE_ROWS))
    ranges = vectors.repartitionByRange(parts, "_label", "_id").sortWithinPartitions("_label", "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for piece in _blocks(batch, rows):
                ids, labels = piece.column(0).to_numpy(), piece.column(1).to_numpy()
                order = np.argsort(ids, kind="stable")
                data, path = io.BytesIO(), f"{uuid.uuid4().hex}.npz"
                np.savez(data, ids=ids[order], labels=labels[order], q=_matrix(piece.column(2))[order])
                with system.open_output_stream(f"{base}/{path}", compression=None) as f:
                    f.write(data.getvalue())
                row = {"path": f"{folder}/{path}", "labels": np.unique(labels).tolist()}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("labels", pa.list_(pa.int64()))]))

    return stored(ranges.select("_id", "_label", "_q").mapInArrow(run, "path string, labels array<long>"), f"{name}-list")


def _read(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    system, name = file_system(path)
    with system.open_input_file(name) as f:
        z = np.load(io.BytesIO(f.read()))
        return z["ids"], z["labels"], z["q"]


def _rows(tile: str, **columns: np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array([tile] * n, pa.string()), *map(pa.array, columns.values())], ["tile", *columns])


def _first_positives(cells: DataFrame, k: int) -> DataFrame:
    """(tile, row, anchor, id, score): the first positives that each cell knows of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in (c for b in batches for c in b.to_pylist()):
            anchors, labels, q = _read(cell["tile"])
            best = Heaps(len(anchors), k)
            for path in cell["blocks"]:
                ids, other, vectors = _read(path)
                best.offer(scores(q, vectors), ids, (labels[:, None] == other) & (anchors[:, None] != ids))
            yield _rows(cell["tile"], row=best.row.astype(np.int32), anchor=anchors[best.row], id=best.id, score=best.score)

    return cells.mapInArrow(run, "tile string, row int, anchor long, id long, score long")


def window(score: np.ndarray, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest negative score, low and high tenths of a positive's, without leaving 64 bits."""
    tens, rest = score // 10, score % 10
    return tens * low - (-rest * low // 10), tens * high + rest * high // 10


def _first_negatives(cells: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """(tile, row, k, id, score): per positive the first negatives that each cell knows of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in (c for b in batches for c in b.to_pylist()):
            anchors, labels, q = _read(cell["tile"])
            bounds = {}
            for x in cell["windows"]:
                if x["k"] not in bounds:  # an empty window for anchors without such a positive
                    bounds[x["k"]] = np.ones((len(anchors), 1), np.int64), np.zeros((len(anchors), 1), np.int64)
                least, most = window(np.array([x["score"]], np.int64), low, high)
                bounds[x["k"]][0][x["row"]], bounds[x["k"]][1][x["row"]] = least, most
            best = {turn: Heaps(len(anchors), k) for turn in bounds}
            for path in cell["blocks"]:
                ids, other, vectors = _read(path)
                differ = labels[:, None] != other
                if not differ.any():
                    continue
                s = scores(q, vectors)
                for turn, (least, most) in bounds.items():
                    best[turn].offer(s, ids, differ & (s >= least) & (s <= most))
            for turn, heap in best.items():
                k_ = np.full(len(heap.row), turn, np.int32)
                yield _rows(cell["tile"], row=heap.row.astype(np.int32), k=k_, id=heap.id, score=heap.score)

    return cells.mapInArrow(run, "tile string, row int, k int, id long, score long")


def _merged(heaps: DataFrame, by: list[str], k: int) -> DataFrame:
    """Heaps of cells as one: the first ``k`` of each, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _spread(cells: DataFrame) -> DataFrame:
    """Cells dealt evenly over several tasks a core, each of a few cells."""
    cells = stored(cells, "negatives-cells")
    n = cells.count()
    return cells.repartition(max(1, min(n, max(4 * cells.sparkSession.sparkContext.defaultParallelism, n // 8))))


def quantised(vector: Column, scale: int = 256) -> Column:
    """Components as integers: floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False))


def mine(
    df: DataFrame, anchors: Column, id_col: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
    n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows where ``anchors`` holds.

    A score is the inner product of two rows' components as integers; higher ones come first, ties by
    the smaller id.  An anchor's positives are its first ``n_positives`` rows of the same label and another id; for each the first
    ``n_negatives`` rows of another label are returned whose score is at least ``low`` and at most ``high`` tenths of the positive's.
    A positive without such rows, as any with a negative score, returns none.

    Rows with a null label, id, vector or component, or a component that is not finite, take no part.
    Rows repeated in id, label and vector count once; rows that share an id but differ are rows of their own.
    Vectors of unequal length are filled with zeros, so an empty one scores 0.  Labels are integers.  Scores are 64-bit integers.
    Other columns are left out; an empty table gives none.  Every row is scored: no index, no cap.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = df.select(F.col(id_col).alias("_id"), label.cast("long").alias("_label"), F.col(vector).alias("_v"), F.coalesce(anchors, F.lit(False)).alias("_anchor"))
    rows = rows.filter(F.col("_id").isNotNull() & F.col("_label").isNotNull() & usable(F.col("_v")))
    rows = stored(rows.select("_id", "_label", quantised(F.col("_v"), scale).alias("_q"), "_anchor").distinct(), "negatives-rows")
    tiles = _written(rows.filter("_anchor"), TILE_ROWS, "negatives-tiles")
    blocks = _written(rows, BLOCK_ROWS, "negatives-blocks")

    n_tiles, n_blocks = tiles.count(), blocks.count()
    each = min(CELL_BLOCKS, max(1, n_tiles * n_blocks // (4 * df.sparkSession.sparkContext.defaultParallelism)))
    n_groups = max(1, -(-n_blocks // each))
    grouped = blocks.withColumn("g", F.pmod(F.xxhash64("path"), F.lit(n_groups)).cast("int"))

    wanted = tiles.select(F.col("path").alias("tile"), F.explode("labels").alias("label"))
    offered = grouped.select(F.col("path").alias("block"), "g", F.explode("labels").alias("label"))
    met = wanted.join(offered, "label").select("tile", "g", "block").distinct()
    cells = met.groupBy("tile", "g").agg(F.collect_list("block").alias("blocks"))
    found = _merged(_first_positives(_spread(cells.select("tile", "blocks")), n_positives), ["tile", "row"], n_positives)
    positives = stored(found.select("tile", "row", "anchor", F.col("rank").alias("k"), F.col("id").alias("positive"), F.col("score").alias("own")), "negatives-positives")

    windows = positives.groupBy("tile").agg(F.collect_list(F.struct("row", "k", F.col("own").alias("score"))).alias("windows"))
    lists = grouped.groupBy("g").agg(F.collect_list("path").alias("blocks"))
    every = windows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).join(lists, "g")
    heaps = _first_negatives(_spread(every.select("tile", "windows", "blocks")), n_negatives, low, high)
    out = _merged(stored(heaps, "negatives-heaps"), ["tile", "row", "k"], n_negatives).join(positives, ["tile", "row", "k"])
    return out.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), F.col("own").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def mine_embeddings(df: DataFrame, id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 100; where it is by 7, the label first becomes the next of ten."""
    number = F.col(id_col)
    moved = F.when(number % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))
    return mine(df, number % 100 == 0, id_col=id_col, label=moved)
