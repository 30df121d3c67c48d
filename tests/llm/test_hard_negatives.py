"""Hard negatives against plain loops over all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from soundkeel.llm import hard_negatives as hn
from soundkeel.llm.queries import op13_hard_negatives

SF = "/root/testdata/sf0.001"


def expected(rows: list[tuple]) -> list[tuple]:
    """From (vec_id, embedding, label)."""
    kept = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(x)) for x in v)))
    out = []
    for a, la, va in kept:
        if a % 100:
            continue
        every = [(-sum(x * y for x, y in zip(va, v)), i, lb) for i, lb, v in kept]
        same = sorted((s, i) for s, i, lb in every if lb == la and i != a)[:5]
        for s, p in same:
            fit = sorted((t, n) for t, n, lb in every if lb != la and 30 * -s <= 100 * -t <= 90 * -s)[:10]
            out += [(a, p, r, n, -s, -t) for r, (t, n) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows: list[tuple]) -> list[tuple]:
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, path string, g int")
    return sorted(map(tuple, hn.mine_embeddings(df.repartition(3)).collect()))


def vectors(n: int, seed: int, dim: int = 6) -> list[tuple]:
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.uniform(-1, 1))) for _ in range(dim)], rng.choice([0, 0, 0, 1, 2, 9])) for i in range(n)]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 90), st.integers(0, 90), st.integers(0, 90), st.integers(0, 2**32), st.sampled_from([100, 2**31, 2**62]))
def test_products(m, n, k, seed, size):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-size, size, (m, k)), rng.integers(-size, size, (n, k))
    leaf, hn.LEAF = hn.LEAF, 4
    try:
        assert (hn.products(a, b) == a @ b.T).all()
    finally:
        hn.LEAF = leaf


def test_rows_of_unequal_length():
    a, b = np.array([[1, 2, 3]], np.int8), np.array([[5], [-1]], np.int8)
    assert hn.scores(a, b).tolist() == [[5, -1]] and hn.scores(a, np.zeros((2, 0), np.int8)).tolist() == [[0, 0]]


@given(st.integers(-(2**63), 2**63 - 1))
def test_window(score):
    low, high = (int(x[0]) for x in hn.window(np.array([score], np.int64)))
    assert low == -(-3 * score // 10) and high == 9 * score // 10


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 6), st.integers(1, 3))
def test_heaps(seed, k, spread):
    rng = np.random.default_rng(seed)
    heap, seen = hn.Heaps(4, k), [[] for _ in range(4)]
    for _ in range(6):
        s, ids, fits = rng.integers(-spread, spread, (4, 80)), np.sort(rng.choice(1000, 80, False)), rng.random((4, 80)) < 0.8
        heap.offer(s, ids, fits)
        for r in range(4):
            seen[r] += [(-int(x), int(i)) for x, i, f in zip(s[r], ids, fits[r]) if f]
    got = [[(-int(s), int(i)) for q, s, i in zip(heap.row, heap.score, heap.id) if q == r] for r in range(4)]
    assert got == [sorted(x)[:k] for x in seen]


@pytest.mark.parametrize("tile,block,cells", [(2, 7, 2), (512, 4096, 1024), (3, 50, 1)])
def test_any_cut(spark, monkeypatch, tile, block, cells):
    for name, value in (("TILE_ROWS", tile), ("BLOCK_ROWS", block), ("CELL_BLOCKS", cells), ("RANGE_ROWS", 200), ("LEAF", 2)):
        monkeypatch.setattr(hn, name, value)
    rows = vectors(700, 5)
    want = expected(rows)
    assert mined(spark, rows) == want and len(want) > 100


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 64)
    monkeypatch.setattr(hn, "MAX_NUMBERS", 500)
    rows = vectors(400, 8)
    rows += [(None, [1.0] * 6, 1), (1000, None, 1), (1100, [1.0] * 6, None), (1200, [None] + [1.0] * 5, 1), (1300, [math.nan] * 6, 1)]
    rows += [(1400, [math.inf] + [1.0] * 5, 1), (1500, [-math.inf] * 6, 1), (1600, [], 1), (1700, [0.5], 0), (1701, [0.5] * 9, 0), (1800, [0.25] * 200, 2)]
    rows += [(2000 + i, [0.5] * 6, 3 if i % 2 else 4) for i in range(300)]  # one common vector
    rows += [rows[5]] * 3 + [rows[100]] * 2 + [(rows[6][0], rows[7][1], 5), (-100, [0.7] * 6, 3), (-7, [0.3] * 6, 9)]
    want = expected(rows)
    assert mined(spark, rows) == want and {r[0] for r in want} >= {-100, 2000, 2100}


def test_no_rows(spark):
    assert mined(spark, [(100, None, None)]) == [] and mined(spark, [(100, [1.0], 1)]) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_large_components(spark):
    """Scores near the end of 64 bits are exact."""
    rows = [(i, [float(2**18 + i), float(-(2**19)), 3.0], i % 2) for i in range(1, 30)] + [(100, [float(2**20)] * 3, 0), (200, [float(2**22), -1.0, 0.0], 1)]
    assert mined(spark, rows) == expected(rows)


def test_query(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = expected(rows)
    assert sorted(map(tuple, op13_hard_negatives(spark, SF).collect())) == want and want
