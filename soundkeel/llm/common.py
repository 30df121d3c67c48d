"""Helpers of the text operators: shared tables, row ids, Arrow columns, Bloom filters, components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Row identity that an operator adds; input columns of that name are replaced.
UID = "_uid"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back.

    Cuts the lineage: what follows survives lost executors without running
    ``df`` again, and ids drawn in ``df`` are fixed from here on.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def raw(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


#: A Bloom filter has 16 bits a value, but never more than this many: its size is bounded.
MAX_BLOOM_BITS = 1 << 27
_PROBES = 4
_GOLDEN = 0x9E3779B97F4A7C15
_STEPS = np.arange(1, _PROBES + 1, dtype=np.uint64) * np.uint64(_GOLDEN)


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of each 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spot(values: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The i-th bit of each value."""
    return mixed(values + _STEPS[i]) & np.uint64(bits - 1)


def bloom(values: DataFrame) -> np.ndarray:
    """Filter of a column of longs; at most MAX_BLOOM_BITS bits reach the driver."""
    n = values.count()
    bits = 1024
    while bits < min(16 * n, MAX_BLOOM_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).to_numpy().view(np.uint64)
            spots = np.unique(np.concatenate([_spot(v, i, bits) for i in range(_PROBES)]))
            mask = (np.uint64(1) << (spots & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((spots >> np.uint64(6)).view(np.int64)), pa.array(mask)], ["word", "mask"])

    words = values.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(bits // 64, np.uint64)
    got = words.toArrow()
    out[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return out


def may_hold(filter_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Positions of the values that the filter may hold."""
    at = np.arange(len(values))
    for i in range(_PROBES):
        spot = _spot(values[at], i, len(filter_) * 64)
        at = at[(filter_[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1]
    return at


def split_by(rows: DataFrame, key: str, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a listed key, rows that have none) by a Bloom filter of ``listed``.

    Only the first need to be shuffled to be joined with what is listed; the others,
    with their texts, stay in the scan.  Both sides read ``rows`` again.
    """
    bits = bloom(listed)

    @F.arrow_udf(T.BooleanType())
    def maybe(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column), bool)
        out[may_hold(bits, column.to_numpy(zero_copy_only=False).view(np.uint64))] = True
        return pa.array(out)

    return rows.filter(maybe(F.col(key))), rows.filter(~maybe(F.col(key)))


def content_keys(columns: Sequence[str]) -> list[Column]:
    """128 bits of a row's content as two longs, _k1 and _k2."""
    return [F.xxhash64(*columns).alias("_k1"), F.xxhash64(F.lit(1), *columns).alias("_k2")]


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of an undirected graph; root is its smallest node.

    ``edges`` has two long columns a and b.  Large-star and small-star rounds:
    every node hands its larger, then its smaller neighbours to the smallest
    node it knows.  Both are a min per node and an equi-join back to the edges, so
    that a node with very many neighbours is split like any skewed join.  Each
    round is written to the shared folder.  Rounds follow the logarithm of the
    longest path; the loop ends when a round changes nothing.
    """
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    now = stored(edges.filter("a <> b").select(*ends).distinct(), f"{name}-edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        before = state
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = stored(large.filter("a <> b").distinct(), f"{name}-large")
        # large has every edge as (smaller, larger): a node's smaller neighbours meet at its least one
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        joined = large.withColumnRenamed("b", "u").join(least, "u")
        small = joined.select(F.col("m").alias("a"), F.explode(F.array("a", "u")).alias("b")).filter("a <> b")
        now = stored(small.distinct(), f"{name}-small")
