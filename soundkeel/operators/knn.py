"""Nearest-neighbour classification against a bounded set of labelled vectors.

The labelled set is fitted on at most ``train_rows`` rows, drawn by a hash of their ids, so it
is small enough to go to every task.  Queries are scored where they are read, in one pass: a matrix
product per Arrow batch, no copies and no shuffle of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import unit

TRAIN_SEED = 17
_BLOCK = 2048  # queries that are compared at once


def nearest(train: DataFrame, query: DataFrame, k: int, train_rows: int, others: bool = False) -> DataFrame:
    """``query_id, near`` with the k nearest (distance, train id, label), nearest
    first, equal distances by id.  ``train``: id, x, label; ``query``: id, x; ids are unique.

    ``train_rows`` bounds the labelled rows.  ``others``: a query is not its own neighbour.
    """
    drawn = train.select("id", "x", "label").orderBy(unit([F.col("id")], TRAIN_SEED), "id").limit(train_rows)
    rows = sorted(drawn.collect(), key=lambda r: r["id"])  # at most train_rows
    ids = np.array([r["id"] for r in rows], dtype=np.int64)
    labels = np.array([r["label"] for r in rows])
    vectors = np.array([r["x"] for r in rows], dtype=float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        square = (vectors * vectors).sum(axis=1) if len(ids) else None
        for pdf in batches:
            if not len(ids):
                continue
            for i in range(0, len(pdf), _BLOCK):
                part = pdf.iloc[i : i + _BLOCK]
                a, own = np.stack(part["x"].to_numpy()).astype(float), part["id"].to_numpy()
                d = (a * a).sum(axis=1)[:, None] - 2 * a @ vectors.T + square[None, :]
                if others:
                    d[own[:, None] == ids[None, :]] = np.inf
                # a few more by the quick form, whose rounding may swap near ties, then exactly
                most = min(k + 8, len(ids))
                at = np.argpartition(d, most - 1, axis=1)[:, :most]
                exact = np.sqrt(((a[:, None, :] - vectors[at]) ** 2).sum(axis=2))
                if others:
                    exact[own[:, None] == ids[at]] = np.inf
                order = np.lexsort((ids[at], exact), axis=1)[:, :k]
                at, exact = np.take_along_axis(at, order, 1), np.take_along_axis(exact, order, 1)
                near = [
                    [{"dist": float(x), "train_id": int(ids[j]), "label": int(labels[j])} for x, j in zip(xs, js) if np.isfinite(x)]
                    for xs, js in zip(exact, at)
                ]
                yield pd.DataFrame({"query_id": own, "near": near})

    return query.select("id", "x").mapInPandas(run, "query_id long, near array<struct<dist:double,train_id:long,label:int>>")


def knn_classify(train: DataFrame, query: DataFrame, k: int, train_rows: int, others: bool = False) -> DataFrame:
    """Majority label of the k nearest; ties go to the label with the nearest vote."""
    near = nearest(train, query, k, train_rows, others)
    votes = F.transform(
        F.array_distinct(F.transform("near", lambda n: n["label"])),
        lambda lab: F.struct(
            (-F.size(F.filter("near", lambda n: n["label"] == lab))).alias("votes"),
            F.array_min(F.transform(F.filter("near", lambda n: n["label"] == lab), lambda n: n["dist"])).alias("d"),
            lab.alias("label"),
        ),
    )
    return near.select(
        "query_id", F.array_min(votes)["label"].alias("label"), F.get("near", F.lit(0))["dist"].alias("nearest")
    )


def class_prototypes(vectors: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Mean vector per group, one row per group (grouped aggregate per dimension)."""
    cells = vectors.select(*keys, F.posexplode(x).alias("dim", "v")).groupBy(*keys, "dim").agg(F.avg("v").alias("v"))
    packed = F.array_sort(F.collect_list(F.struct("dim", "v")))
    return cells.groupBy(*keys).agg(F.transform(packed, lambda c: c["v"]).alias("x"))
