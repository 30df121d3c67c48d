"""Near duplicates by SimHash fingerprints and generalised pigeonhole search.

A fingerprint is 64 bits: bit k is set where more than half of a text's shingle
hashes have it set.  Texts are linked where fingerprints differ in at most ``tau``
bits.  The search partitions the bits: if two fingerprints differ in at most tau
bits, and part i has a threshold t_i (-1: not looked at) with
sum(t_i + 1) = tau + 1, they differ in at most t_i bits within some part i.  So

* correlated bits are put into the same part, measured on all fingerprints;
* for every number of parts a dynamic programme allots the thresholds at the least
  estimated cost (rows shuffled and candidates verified), and the cheapest plan wins;
* every fingerprint is listed under its value of each part, and probes the values
  within t_i bits; rows of one (part, value) meet in a task and are verified.

Links leave a task as a spanning forest (star edges), never as all pairs.  Parts'
values with more than ``cap`` rows are cut into blocks, and pairs of blocks meet in
different tasks, which is exact.

The stage of the corpus pipeline takes such pairs for candidates only.  A Jaccard index of 4/5 needs set sizes within 4/5,
so a row is listed in the band of its size, and in the next one if it is near its edge: exact, and pairs of
very different length never meet.  The distinct shingle sets are signed first.  Only the texts whose bits have a candidate, mostly few,
are read again, and their sets are written to files of the shared folder; a node's number says where its
set lies.  A task reads the sets of its candidates and links them by their exact Jaccard index; pairs
that it has already joined over others are not read again.  The files go when all links are known.
"""

from __future__ import annotations

import itertools
from collections import OrderedDict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from .common import components, content_keys, mixed, raw, split_by, stored
from .warc import file_system

BITS = 64
_LANES = np.uint64(0x0101010101010101)
_GAPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
#: Costs in the same unit: one shuffled row (about 5 microseconds, sort and network included), one verified
#: pair (about 1.2 nanoseconds).
ROW_COST, PAIR_COST = 1.0, 0.00025
_CELLS = 500_000  # pairs that are verified at once; they stay in the cache
CAP = 16_384
_SKETCH = 1024


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """XXH64 (seed 42) of every k-word shingle, repeats included.

    A-Z are lower-cased; words end at ASCII white space; a text of fewer than k
    words is one shingle, one without words has none.
    """
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(b" ".join(words), 42)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return [digest(line[s:e], 42) for s, e in zip(starts, ends[k - 1 :].tolist())]


def majority(h: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One word per segment of ``h``: bits set in over half of its hashes.

    Bits are counted in byte lanes of a word, at most 255 hashes at a time.
    """
    cuts = np.concatenate([np.arange(s, s + n, 255) for s, n in zip(starts, counts)])
    owner = np.searchsorted(cuts, starts)
    out = np.zeros(len(starts), np.uint64)
    for b in range(8):
        lanes = np.add.reduceat((h >> np.uint64(b)) & _LANES, cuts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
        bits = (2 * sums > counts[:, None]).astype(np.uint64)
        for byte in range(8):
            out |= bits[:, byte] << np.uint64(8 * byte + b)
    return out


def signatures(texts: Sequence[bytes | None], k: int, words: int = 1) -> np.ndarray:
    """(len(texts), words) array: the fingerprint, then further words of 64 bits."""
    return _signed_bags((shingle_hashes(text, k) if text else [] for text in texts), len(texts), words)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(np.array(shingle_hashes(text, k) if text else [], np.uint64))


def _signed_bags(bags: Iterable[Sequence[int] | np.ndarray], size: int, words: int) -> np.ndarray:
    """Signatures of bags of shingle hashes; those of empty bags are zeros."""
    out = np.zeros((size, words), np.uint64)
    hashes: list[np.ndarray] = []
    rows: list[int] = []
    counts: list[int] = []

    def flush() -> None:
        if hashes:
            h = np.concatenate(hashes)
            n = np.array(counts, np.int64)
            starts = np.cumsum(n) - n
            for w in range(words):
                out[rows, w] = majority(h if w == 0 else mixed(h + np.uint64(_GAPS[w - 1])), starts, n)
        hashes.clear(), rows.clear(), counts.clear()

    held = 0
    for i, got in enumerate(bags):
        if len(got):
            hashes.append(np.asarray(got, np.uint64))
            rows.append(i)
            counts.append(len(got))
            held += len(got)
        if held > 200_000:
            flush()
            held = 0
    flush()
    return out


def with_signature(df: DataFrame, text: str, k: int, words: int = 1, name: str = "_sig") -> DataFrame:
    """Adds ``name``: array of ``words`` longs; null and empty texts get zeros."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def udf(column: pa.Array) -> pa.Array:
        sig = signatures(raw(column), k, words).view(np.int64)
        offsets = np.arange(len(sig) + 1, dtype=np.int32) * words
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.reshape(-1)))

    return df.withColumn(name, udf(F.col(text)))


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _co_occurrence(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j set; over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            b = _bits(batch.column(0).to_numpy()).astype(np.float32)
            total += b.T @ b
            n += len(b)
        cells = total.astype(np.int64).reshape(-1)
        at = np.arange(BITS * BITS + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(cells, n))], ["cell", "n"])

    got = fps.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect()  # 4,097 rows
    flat = np.zeros(BITS * BITS + 1)
    for cell, n in got:
        flat[cell] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def grouped_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to ``parts`` parts so that correlated bits share a part."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, out = list(range(BITS)), []
    for i in range(parts):
        size = len(left) // (parts - i)
        part = [max(left, key=lambda b: tie[b, left].max())]
        left.remove(part[0])
        while len(part) < size:
            part.append(max(left, key=lambda b: tie[b, part].mean()))
            left.remove(part[-1])
        out.append(sorted(part))
    return out


def _mask(bits: Sequence[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pairs_by_part(fps: DataFrame, masks: Sequence[int]) -> np.ndarray:
    """Estimated ordered pairs with equal values of each mask (and of the band, if there is one), by a signed sketch of all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(masks), _SKETCH), np.int64)
        for batch in batches:
            v = batch.column(0).to_numpy().view(np.uint64)
            band = mixed(batch.column(1).to_numpy().view(np.uint64)) if batch.num_columns > 1 else np.uint64(0)
            for i, m in enumerate(masks):
                h = mixed(((v & np.uint64(m)) ^ band) + np.uint64(_GAPS[1]))
                sign = np.where(h >> np.uint64(63), 1, -1)
                total[i] += np.bincount((h % np.uint64(_SKETCH)).astype(np.int64), sign, _SKETCH).astype(np.int64)
        at = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1))], ["cell", "n"])

    got = fps.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    squares = got.groupBy(F.floor(F.col("cell") / _SKETCH).alias("i")).agg(F.sum(F.col("n") * F.col("n")))
    out = np.zeros(len(masks))
    for i, s in squares.collect():  # one row for each mask
        out[i] = s
    return out


def allot(cost: Sequence[Sequence[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) = tau + 1 at the least cost; cost[i][t + 1] is part i's at t."""
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * (tau + 1)
    for row in cost:
        after = [(float("inf"), [])] * (tau + 2)
        for spent, (c, ts) in enumerate(best):
            for step, extra in enumerate(row):
                if spent + step <= tau + 1 and c + extra < after[spent + step][0]:
                    after[spent + step] = (c + extra, [*ts, step - 1])
        best = after
    return best[-1]


def plan(fps: DataFrame, tau: int, deepest: int = 2, cap: int = CAP) -> list[tuple[list[int], int]]:
    """The cheapest (bits, threshold) list; ``fps``: distinct fingerprints, a long column, and their bands where there are any.

    With bands, comparing all rows of a band is a plan as well: one part of no bits.  It is the cheapest for small tables.
    """
    banded = len(fps.columns) > 1
    n, together = _co_occurrence(fps)
    p = np.diag(together) / max(n, 1)
    odds = np.maximum(2 * p * (1 - p), 1e-6) / np.maximum(1 - 2 * p * (1 - p), 1e-6)
    options = [grouped_bits(n, together, m) for m in range(max(1, (tau + 1) // (deepest + 1)), min(tau + 2, 16) + 1)]
    parts = [part for option in options for part in option]
    pairs = _pairs_by_part(fps, [_mask(x) for x in parts] + [0] * banded)
    same = iter(pairs)

    def listed(equal: float, rows: float) -> float:
        # rows of a value with more than cap of them are listed once for each block
        return ROW_COST * rows * max(1.0, equal / max(n, 1) / cap)

    found = []
    for option in options:
        cost = []
        for part in option:
            equal = max(next(same), n)
            row = [0.0]
            for t in range(deepest + 1):
                ball = sum(1 for d in range(t + 1) for _ in itertools.combinations(part, d))
                reach = sum(np.prod(odds[list(x)]) for d in range(t + 1) for x in itertools.combinations(part, d))
                row.append((listed(equal * reach, n * ball) if banded else ROW_COST * n * ball) + PAIR_COST * equal * reach)
            cost.append(row)
        total, ts = allot(cost, tau)
        if ts:
            found.append((total, [(b, t) for b, t in zip(option, ts) if t >= 0]))
    if banded:
        equal = max(pairs[-1], n)
        found.append((listed(equal, n) + PAIR_COST * equal, [([], 0)]))
    return min(found, key=lambda x: x[0])[1]


#: A band holds sizes within (5/4)**BAND of its least; a row within one 5/4 of the upper edge is listed in the next one too.
BAND = 2


def _banded(size: Column) -> Column:
    """(band, high) under which a row is listed; two rows meet if their sizes are within 4/5, and are judged where one is high."""
    place = F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(float(np.log(1.25)))
    band = F.when(size > 0, F.floor(place / BAND)).otherwise(F.lit(-1)).cast("long")
    own = F.struct(band.alias("band"), F.lit(True).alias("high"))
    over = F.struct((band + 1).alias("band"), F.lit(False).alias("high"))
    # a little more than 5/4, for the rounding of the logarithm
    return F.when((size > 0) & (place >= BAND * (band + 1) - 1 - 1e-6), F.array(own, over)).otherwise(F.array(own))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, node) with the same components as the links a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            moved = label != np.arange(len(nodes))
            return nodes[label[moved]], nodes[moved]
        label = new


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y)


#: A node's number is the attempt of the task that wrote its set, and the place in that task's file.
_PLACE_BITS = 33
_CACHE_BYTES, _OPEN_FILES = 64 << 20, 64


def _set_file(folder: str, attempt: int) -> str:
    return f"{folder}/{attempt}.sets"


def signed(rows: DataFrame, k: int, words: int) -> DataFrame:
    """_rank, hash of the set (s1, s2), its size and w0.. of every row (_rank, text); signatures are those of the distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, k) for text in raw(batch.column(1))]
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), "<i8").reshape(-1, 2)
            sig = _signed_bags(sets, len(sets), words).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array([len(x) for x in sets], pa.int64()),
                 *[pa.array(sig[:, i].copy()) for i in range(words)]],
                ["_rank", "s1", "s2", "size", *[f"w{i}" for i in range(words)]],
            )

    longs = ["s1", "s2", "size", *[f"w{i}" for i in range(words)]]
    schema = T.StructType([rows.schema[0], *[T.StructField(c, T.LongType()) for c in longs]])
    return rows.mapInArrow(run, schema)


def written_sets(rows: DataFrame, folder: str, k: int) -> DataFrame:
    """(id, node) of rows (id long, text), whose sets of distinct shingles go to ``folder``.

    Attempts of a task write different files, and node names the one whose rows count.
    """
    none = np.zeros(1, np.uint64)  # an empty set takes a place as well, so that nodes differ

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        out, at = None, 0
        for batch in batches:
            if out is None:
                system, base = file_system(folder)
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(_set_file(base, attempt), compression=None)
            nodes = []
            for text in raw(batch.column(1)):
                x = shingle_set(text, k)
                out.write((x if len(x) else none).tobytes())
                nodes.append(attempt << _PLACE_BITS | at)
                at += max(len(x), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64())], ["id", "node"])
        if out is not None:
            out.close()

    return rows.mapInArrow(run, "id long, node long")


class _Sets:
    """Joins candidates whose shingle sets have a Jaccard index of at least 4/5."""

    def __init__(self, folder: str, parts: Sequence[tuple[int, int]]):
        self.folder, self.parts = folder, parts
        self.root: dict[int, int] = {}
        self.left: list[int] = []
        self.right: list[int] = []
        self.files: dict = {}
        self.cache: OrderedDict[int, np.ndarray] = OrderedDict()
        self.bytes = 0

    def read(self, node: int, size: int) -> np.ndarray:
        got = self.cache.get(node)
        if got is not None:
            self.cache.move_to_end(node)
            return got
        attempt, place = node >> _PLACE_BITS, node & (1 << _PLACE_BITS) - 1
        if attempt not in self.files:
            if len(self.files) >= _OPEN_FILES:
                self.close()
            system, base = file_system(self.folder)
            self.files[attempt] = system.open_input_file(_set_file(base, attempt))
        got = np.frombuffer(self.files[attempt].read_at(8 * size, 8 * place), np.uint64)
        self.cache[node] = got
        self.bytes += got.nbytes
        while self.bytes > _CACHE_BYTES and len(self.cache) > 2:
            self.bytes -= self.cache.popitem(last=False)[1].nbytes
        return got

    def close(self) -> None:
        for f in self.files.values():
            f.close()
        self.files = {}

    def find(self, x: int) -> int:
        root = self.root
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    def join(self, a: int, a_size: int, b: int, b_size: int) -> bool:
        """Whether a and b are in one component now."""
        ra, rb = self.find(a), self.find(b)
        if ra == rb:
            return True
        x, y = self.read(a, a_size), self.read(b, b_size)
        at = np.searchsorted(x, y)
        at[at == len(x)] = 0
        common = int(np.count_nonzero(x[at] == y)) if len(x) else 0
        if 9 * common < 4 * (a_size + b_size):
            return False
        self.root[ra] = rb
        self.left.append(a)
        self.right.append(b)
        return True

    def open_pairs(self, part: np.ndarray, fp: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs whose sizes allow a link and that meet in no earlier part, where they are judged."""
        a, b = size[i], size[j]
        out = 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)
        differ = fp[i] ^ fp[j]
        for n, (mask, t) in enumerate(self.parts):
            out &= (part[i] <= n) | (np.bitwise_count(differ & np.uint64(mask)) > t)
        return out

    def settle(self, node: np.ndarray, size: np.ndarray, label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Judges pairs sorted by i; equal labels are of rows that are joined already."""
        while len(i):
            x, n = int(i[0]), int(np.searchsorted(i, i[0], "right"))
            mine = {int(label[x])}
            for y in j[:n].tolist():
                other = int(label[y])
                if other not in mine and self.join(int(node[x]), int(size[x]), int(node[y]), int(size[y])):
                    mine.add(other)
            if len(mine) > 1:
                label[np.isin(label, list(mine))] = label[x]
            i, j = i[n:], j[n:]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]


class _Bucket:
    """Verifies rows (node, own, words...) of consecutive buckets; with ``sets`` also by their shingles.

    ``sized``: whether rows have sizes, which must be within 4/5, and a flag, which one of a pair must have.
    """

    def __init__(self, tau: int, wide: int, sets: _Sets | None = None, sized: bool = False):
        self.tau, self.wide, self.left, self.right, self.held = tau, wide, [], [], 0
        self.sets, self.sized = sets, sized

    def keep(
        self, node: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray, part: np.ndarray, size: np.ndarray | None, high: np.ndarray | None,
        label: np.ndarray,
    ) -> None:
        if self.sized and len(i):
            a, b = size[i], size[j]
            fit = (high[i] | high[j]) & (5 * np.minimum(a, b) >= 4 * np.maximum(a, b))
            i, j = i[fit], j[fit]
        if self.sets is not None and len(i):
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
        if words.shape[1] > 1 and len(i):
            near = _far(words[i, 1:], words[j, 1:]).sum(axis=1) <= self.wide
            i, j = i[near], j[near]
        if self.sets is not None:
            judged = self.sets.open_pairs(part, words[:, 0], size, i, j)
            self.sets.settle(node, size, label, i[judged], j[judged])
            return
        if len(i):
            self.left.append(node[i])
            self.right.append(node[j])
            self.held += len(i)
        if self.held > 2_000_000:
            a, b = _stars(np.concatenate(self.left), np.concatenate(self.right))
            self.left, self.right, self.held = [a], [b], len(a)

    def small(
        self, bucket: np.ndarray, node: np.ndarray, own: np.ndarray, words: np.ndarray, part: np.ndarray, size: np.ndarray | None,
        high: np.ndarray | None, longest: int,
    ) -> None:
        fp = words[:, 0]
        found = []
        for lag in range(1, longest):
            i = np.flatnonzero((bucket[lag:] == bucket[:-lag]) & (own[lag:] | own[:-lag]))
            i = i[_far(fp[i], fp[i + lag]) <= self.tau]
            if self.sets is None:
                self.keep(node, words, i, i + lag, part, size, high, node)
            else:
                found.append((i, i + lag))
        if found:
            i, j = (np.concatenate(x) for x in zip(*found))
            near = (high[i] | high[j]) & (_far(words[i, 1:], words[j, 1:]).sum(axis=1) <= self.wide)
            i, j = i[near], j[near]
            judged = self.sets.open_pairs(part, fp, size, i, j)
            for x, y in zip(i[judged].tolist(), j[judged].tolist()):
                self.sets.join(int(node[x]), int(size[x]), int(node[y]), int(size[y]))

    def large(
        self, node: np.ndarray, own: np.ndarray, words: np.ndarray, part: np.ndarray, size: np.ndarray | None, high: np.ndarray | None
    ) -> None:
        order = np.argsort(~own, kind="stable")
        node, words, part = node[order], words[order], part[order]
        if self.sized:
            size, high = size[order], high[order]
        _, label = np.unique(node, return_inverse=True)
        fp, n_own = words[:, 0], int(own.sum())
        step = max(1, _CELLS // len(fp))
        room = step * len(fp)
        mixed_bits, counts, near = np.empty(room, np.uint64), np.empty(room, np.uint8), np.empty(room, bool)
        for at in range(0, n_own, step):
            # rows at.. against all that follow the first of them
            k, m = min(step, n_own - at), len(fp) - at - 1
            block = mixed_bits[: k * m].reshape(k, m)
            np.bitwise_xor(fp[at : at + k, None], fp[None, at + 1 :], out=block)
            np.bitwise_count(mixed_bits[: k * m], out=counts[: k * m])
            np.less_equal(counts[: k * m], self.tau, out=near[: k * m])
            i, j = np.divmod(np.flatnonzero(near[: k * m]), max(m, 1))
            i, j = i + at, j + at + 1
            self.keep(node, words, i[j > i], j[j > i], part, size, high, label)

    def edges(self) -> pa.RecordBatch:
        if self.sets is not None:
            self.sets.close()
            a, b = (pa.array(x, pa.int64()) for x in (self.sets.left, self.sets.right))  # joins only: a forest
            return pa.RecordBatch.from_arrays([a, b], ["a", "b"])
        a, b = (np.concatenate(self.left), np.concatenate(self.right)) if self.left else (np.zeros(0, np.int64),) * 2
        a, b = _stars(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _verify(tau: int, wide: int, words: int, folder: str | None, parts: Sequence[tuple[int, int]], key: list[str], sized: bool):
    """Rows sorted by bucket: bucket columns, node, own, words.  Buckets are bounded by the cap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _Bucket(tau, wide, _Sets(folder, parts) if folder else None, sized)
        held: list[pa.RecordBatch] = []

        def handle(t: pa.Table, last: bool) -> pa.Table | None:
            cols = [t.column(c).to_numpy() for c in key]
            new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])
            starts = np.flatnonzero(new)
            end = t.num_rows if last else starts[-1]
            if end:
                starts = starts[starts < end]
                sizes = np.diff(np.append(starts, end))
                node = t.column("node").to_numpy()[:end]
                own = t.column("own").to_numpy()[:end]
                sig = np.stack([t.column(f"w{i}").to_numpy()[:end].view(np.uint64) for i in range(words)], axis=1)
                part = cols[0][:end]
                size, high = (t.column(c).to_numpy()[:end] if sized else None for c in ("size", "high"))
                bucket = np.repeat(np.arange(len(starts)), sizes)
                few = np.repeat((sizes > 1) & (sizes <= 24), sizes)
                if few.any():
                    some, flag = (x[few] if sized else None for x in (size, high))
                    work.small(bucket[few], node[few], own[few], sig[few], part[few], some, flag, int(sizes[sizes <= 24].max()))
                for s, n in zip(starts[sizes > 24], sizes[sizes > 24]):
                    some, flag = (x[s : s + n] if sized else None for x in (size, high))
                    work.large(node[s : s + n], own[s : s + n], sig[s : s + n], part[s : s + n], some, flag)
            return t.slice(end) if end < t.num_rows else None

        rest = 0
        for batch in batches:
            held.append(batch)
            rest += batch.num_rows
            if rest >= 100_000:
                left = handle(pa.Table.from_batches(held).combine_chunks(), False)
                held = left.to_batches() if left is not None else []
                rest = 0
        if held:
            handle(pa.Table.from_batches(held).combine_chunks(), True)
        yield work.edges()

    return run


def links(nodes: DataFrame, tau: int, wide: int = 0, words: int = 1, cap: int = CAP, folder: str | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all links between nodes.

    ``nodes``: node (long, unique), w0 (fingerprint), and with ``words`` > 1 also
    w1.. that must differ in at most ``wide`` bits together.  Where nodes have a size, sizes must
    be within 4/5 as well.  With ``folder``, where ``written_sets`` wrote the nodes' sets, such pairs are linked if these have
    a Jaccard index of at least 4/5.
    """
    sized = "size" in nodes.columns
    if sized:
        nodes = nodes.select("*", F.explode(_banded(F.col("size"))).alias("_b")).select("*", "_b.*").drop("_b")
    bands = ["band"] if sized else []
    parts = plan(nodes.select("w0", *bands).distinct(), tau, cap=cap)
    probes: list[Column] = []
    for i, (bits, t) in enumerate(parts):
        mask = _mask(bits)
        for d in range(t + 1):
            for flip in itertools.combinations(bits, d):
                value = F.col("w0").bitwiseXOR(F.lit(_signed(_mask(flip)))).bitwiseAND(F.lit(_signed(mask)))
                probes.append(F.struct(F.lit(i).alias("part"), value.alias("value"), F.lit(d == 0).alias("own")))
    sig = [f"w{i}" for i in range(words)] + (["size", "high"] if sized else [])
    rows = nodes.select("node", *bands, *sig, F.explode(F.array(*probes)).alias("p")).select("p.*", "node", *bands, *sig)
    # counted on the distinct fingerprints' values, combined in the map tasks
    of = ["part", "value", *bands]
    hot = rows.groupBy(*of).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > cap)
    hot = hot.select(*of, F.ceil(F.col("_n") / cap).cast("int").alias("_blocks"))
    hot = stored(hot, "simhash-hot")
    rows = rows.join(hot, of, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    rows = rows.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select(*of, F.least("_mine", "_other").alias("lo"), F.greatest("_mine", "_other").alias("hi"), "node", "own", *sig)
    key = [*of, "lo", "hi"]
    dealt = rows.repartition(*key).sortWithinPartitions(*key)
    masks = [] if parts == [([], 0)] else [(_mask(bits), t) for bits, t in parts]
    return dealt.mapInArrow(_verify(tau, wide, words, folder, masks, key, sized), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3, tau: int = 2) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest id reachable by links of fingerprints that differ
    in at most ``tau`` bits.  Null and empty texts, and texts without words, have
    fingerprint zero and are linked like any other.  Repeated rows are repeated; a null id
    is never the smallest, and component_id is null where no row of it has an id.
    """
    docs = with_signature(df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text", k)
    docs = stored(docs.select("_id", F.element_at("_sig", 1).alias("w0")), "simhash-docs")
    fps = stored(docs.groupBy("w0").agg(F.min("_id").alias("least")), "simhash-fingerprints")
    roots = components(links(fps.select(F.col("w0").alias("node"), "w0"), tau), "simhash")
    member = fps.join(roots, fps.w0 == roots.node, "left").withColumn("root", F.coalesce("root", "w0"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.select("w0", "root").join(least, "root").select("w0", "component_id")
    return docs.join(named, "w0", "left").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), "component_id"
    )


#: Similarity 0.8 of equally large shingle sets is a cosine of 2 * 0.8 / 1.8, an angle of 0.1516 half turns: 9.7 of 64 and
#: 38.8 of 256 bits differ on average.  Of such pairs 99.4% are within these thresholds (0.82: 99.7%, 0.85: 99.9%).
STAGE_TAU = 17
STAGE_WORDS = 5  # the fingerprint, and 256 bits more that spare the reading of most other sets
STAGE_WIDE = 64


def _exact_roots(texts: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """(node, root) of the components of all links between ``first``, nodes with size, signature and the _rank of a row of ``texts``.

    Sets are written for the nodes whose bits have a candidate alone.
    """
    signature = ["size", *[f"w{i}" for i in range(STAGE_WORDS)]]
    near = stored(links(first.select("node", *signature), STAGE_TAU, STAGE_WIDE, STAGE_WORDS), "simhash-candidates")
    near = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = stored(first.join(near, "node", "left_semi").select("node", *signature, "_rank._k1", "_rank._k2"), "simhash-some")
    there, _ = split_by(texts, "_k1", some.select("_k1"))
    there = there.join(some.select(F.col("node").alias("id"), "_k1", "_k2"), ["_k1", "_k2"]).dropDuplicates(["id"])
    folder = shared_dir(first.sparkSession, "simhash-sets")
    places = stored(written_sets(there.select("id", "_text"), folder, k), "simhash-places")
    placed = some.withColumnRenamed("node", "id").join(places, "id").select("node", *signature)
    found = components(links(placed, STAGE_TAU, STAGE_WIDE, STAGE_WORDS, folder=folder), "simhash-stage")
    named = found.join(places, "node").select(F.col("id"), "root").join(places.toDF("top", "root"), "root")
    named = stored(named.select(F.col("id").alias("node"), F.col("top").alias("root")), "simhash-roots")
    system, base = file_system(folder)
    if system.get_file_info(base).type == pafs.FileType.Directory:
        system.delete_dir(base)
    return named


def first_of_groups(df: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = 5) -> DataFrame:
    """One row of each group of near copies, with the columns of ``df``.

    A link needs an exact Jaccard index of 0.8 or more of the distinct ``k``-word shingles; SimHash
    bits of these only find the candidates.  Of each group the row
    with the smallest id stays (null ids last, then the smaller hash of the text, then of
    the row; of equal rows one).  Null texts and rows without a word are one group.  Texts are not
    stored: rows that a Bloom filter takes for removed ones are shuffled, the others stay in the scan.
    """
    keep = df.columns
    rows = df.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    rows = rows.select("*", *content_keys(["_row"]))
    rank = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.xxhash64("_text").alias("hash"), "_k1", "_k2")
    docs = stored(signed(rows.select(rank.alias("_rank"), "_text"), k, STAGE_WORDS), "simhash-stage")
    # equal sets are one node
    sig = ["size", *[f"w{i}" for i in range(STAGE_WORDS)]]
    first = docs.groupBy("s1", "s2").agg(F.min("_rank").alias("_rank"), F.min(F.struct(*sig)).alias("sig"))
    first = stored(first.select(F.monotonically_increasing_id().alias("node"), "sig.*", "_rank"), "simhash-nodes")
    roots = _exact_roots(rows.select("_k1", "_k2", "_text"), first, k)
    member = first.select("node", "_rank").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stay = stored(member.groupBy("root").agg(F.min("_rank").alias("_rank")).select("_rank._k1", "_rank._k2"), "simhash-stay")
    every = docs.groupBy("_rank._k1", "_rank._k2").agg(F.count(F.lit(1)).alias("n")).toDF("_k1", "_k2", "n")
    gone = stored(every.join(stay, ["_k1", "_k2"], "left_anti").select("_k1", "_k2"), "simhash-gone")
    twice = every.filter("n > 1").select("_k1")  # of equal rows one stays
    some, none = split_by(rows.select("_row", "_k1", "_k2"), "_k1", gone.select("_k1").union(twice))
    some = some.dropDuplicates(["_k1", "_k2"]).join(gone, ["_k1", "_k2"], "left_anti")
    return none.select("_row.*").unionByName(some.select("_row.*"))
