"""Neighbourhood windows over a dense integer index.

Rows are grouped by ``index div size``; rows near an edge are also copied into
the neighbour group.  A window inside the group then sees every neighbour it
needs, group size is bounded by ``size + before + after``, and one shuffle is
enough however long the sequence is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

CHUNK = "_halo_chunk"
OWN = "_halo_own"


def with_halo(df: DataFrame, index: str, size: int, before: int, after: int) -> DataFrame:
    """Copy each row into every chunk whose rows look at it.

    ``before``: how many preceding rows a row looks at; ``after``: following.
    """
    if before > size or after > size:
        size = max(before, after, size)
    idx = F.col(index).cast("long")
    own = F.floor(idx / F.lit(size)).cast("long")
    first = F.floor((idx - after) / F.lit(size)).cast("long")
    last = F.floor((idx + before) / F.lit(size)).cast("long")
    return df.withColumn("_own_chunk", own).withColumn(CHUNK, F.explode(F.sequence(first, last))).withColumn(
        OWN, F.col(CHUNK) == F.col("_own_chunk")
    ).drop("_own_chunk")


def halo_window(keys: Sequence[str | Column], index: str) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(index)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(OWN).drop(CHUNK, OWN)
