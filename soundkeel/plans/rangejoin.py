"""Interval joins as equi-joins on (key, bucket).

Each interval is listed under every bucket it touches, each point under its own
bucket; the remaining predicate is checked after the equi-join.  Spark plans a
sort-merge or hash join instead of comparing every pair, and adaptive execution
splits the partitions of buckets that hold many points or many intervals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point_in_interval(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], pos: str, start: str, end: str, bucket: int, how: str = "inner"
) -> DataFrame:
    """Pairs with ``start <= pos < end`` on equal keys; integer positions.

    ``bucket`` is about the length of a typical interval.
    """
    b = F.lit(int(bucket))
    on = [*keys, "_bucket"]
    p = points.withColumn("_bucket", F.floor(F.col(pos) / b).cast("long"))
    touched = F.sequence(F.floor(F.col(start) / b).cast("long"), F.floor((F.col(end) - 1) / b).cast("long"))
    i = intervals.filter(F.col(end) > F.col(start)).withColumn("_bucket", F.explode(touched))
    i = i.select(*[F.col(c).alias(f"_i_{c}") for c in on], *[c for c in i.columns if c not in on])
    cond: Column = (F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(end))
    for c in on:
        cond = cond & (F.col(c) == F.col(f"_i_{c}"))
    return p.join(i, cond, how).drop("_bucket", *[f"_i_{c}" for c in on])
