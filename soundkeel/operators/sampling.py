"""Reproducible samples, shuffles and per-file limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import unit

# Fixed value: seed of the evaluation sample.
SAMPLE_SEED = 999


def _draw(ids: Sequence[str], seed: int) -> Column:
    return unit([F.col(c) for c in ids], seed)


def sample_n(df: DataFrame, ids: Sequence[str], n: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """n rows without replacement, the same on every run: a top-n by draw."""
    return df.orderBy(_draw(ids, seed), *ids).limit(n)


def shuffled(df: DataFrame, ids: Sequence[str], seed: int) -> DataFrame:
    """Rows in random order, with the draw that orders them."""
    return df.withColumn("draw", _draw(ids, seed)).orderBy("draw", *ids)


def first_per_file(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per key.  Spark limits the ranks before the shuffle, so a task
    keeps at most n rows per key and input partition."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def strongest(calls: DataFrame, n: int, *by: Column) -> DataFrame:
    return calls.orderBy(*by).limit(n)
