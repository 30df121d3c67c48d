"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from helpers import awkward, frame, ids_first
from pyspark.sql import functions as F

from soundkeel.llm import merkle
from soundkeel.llm.queries import op11_merkle

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*texts) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def part(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, source, lang, n_chars, text) -> str:
    return h(*map(part, (doc_id, source, lang, n_chars, text)))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """The root, and per leaf its (slot, siblings) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for i, p in enumerate(paths):
            run, slot = runs[at[i] // 3], at[i] % 3
            p.append((slot, run[:slot] + run[slot + 1 :]))
        nodes, at = [h(*r) for r in runs], [a // 3 for a in at]
    return nodes[0], paths


def expected(rows: list[tuple]) -> list[tuple]:
    """From (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        bad = text
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
            bad = text.replace("\n", "")
        groups[source].append((doc_id, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, bad)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = tree([r[1] for r in groups[s]])
    root, tops = tree([trees[s][0] for s in names]) if names else (None, [])
    out = []
    for s, top in zip(names, tops):
        for (doc_id, good, bad), path in zip(groups[s], trees[s][1]):
            path, node = path + top, bad
            for slot, others in path:
                node = h(*others[:slot], node, *others[slot:])
            out.append((doc_id, good, trees[s][0], root, h(*[x for _, o in path for x in o]), node, node == root))
    return out


def as_frame(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("levels,sizes", [(6, [1]), (1, [2]), (1, [4, 9, 10, 1]), (2, [27, 28, 82, 1, 1]), (6, [3, 1])])
def test_tree_shapes(spark, monkeypatch, levels, sizes):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 10)
    rows = [(1000 * g + i, f"{g}\n{i}", "en", f"s{g}", i) for g, n in enumerate(sizes) for i in range(n)]
    got = merkle.verify_documents(as_frame(spark, rows).repartition(5))
    assert sorted(map(tuple, got.collect())) == sorted(expected(rows))


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 7)
    rows = awkward() + [(300 + i, "line\n" * i, None, ["é", "", None, "Z", "\U0001f600", "￿"][i % 6]) for i in range(30)]
    got = merkle.verify_documents(frame(spark, rows))
    assert got.columns == COLUMNS
    want = expected([(i, t, la, so, None if t is None else len(t)) for i, t, la, so in rows])
    assert ids_first(map(tuple, got.collect())) == ids_first(want)
    assert any(not r[-1] for r in want) and merkle.verify_documents(frame(spark, rows).limit(0)).count() == 0


def test_one_source_holds_most(spark, monkeypatch):
    """Groups cut over many ranges and blocks; small statistics joined by salt."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", 100)
    monkeypatch.setattr(merkle, "LEVELS", 3)
    monkeypatch.setattr(merkle, "BLOCK", 27)
    rows = [(i, "a\nb" * (i % 4), "en", "hot" if i % 3 else f"s{i % 50}", 1) for i in range(3000)]
    want = sorted(expected(rows))
    assert sorted(map(tuple, merkle.verify_documents(as_frame(spark, rows).repartition(8)).collect())) == want
    spark.conf.set("spark.soundkeel.broadcastBytes", "0")
    try:
        assert sorted(map(tuple, merkle.verify_documents(as_frame(spark, rows)).collect())) == want
    finally:
        spark.conf.unset("spark.soundkeel.broadcastBytes")


def test_a_path_proves_one_leaf(spark):
    leaves = spark.range(100).select("id", F.lit("g").alias("g"), merkle.leaf_digest(F.col("id")).alias("leaf"))
    m = merkle.manifest(leaves, "g", "id", "leaf")
    good = m.filter(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).count()
    swapped = m.filter(merkle.fold(merkle.leaf_digest(F.col("id") + 1), F.col("path")) == F.col("root")).count()
    assert (good, swapped) == (100, 0)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    got = sorted(map(tuple, op11_merkle(spark, SF).select(*COLUMNS).collect()))
    assert got == sorted(expected(list(map(tuple, docs)))) and {r[-1] for r in got} == {True, False}
