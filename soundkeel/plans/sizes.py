"""Joins of many rows with a small table of statistics per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_bytes, shared_dir

SALTS = 64


def _row_bytes(df: DataFrame) -> Column:
    total: Column = F.lit(16)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + 8 + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            total = total + 16 + 8 * F.greatest(F.size(f.name), F.lit(0))
        else:
            total = total + 16
    return total


def join_small(
    big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[Column | str] | None = None, how: str = "inner",
    limit: int | None = None, salts: int = SALTS,
) -> DataFrame:
    """``big`` joined with the statistics ``small`` on ``keys`` without moving a key's rows to one task.

    The statistics are computed once, into the shared folder, and measured.  Up to ``limit``
    bytes they are broadcast; beyond it every row of ``small`` is copied to each salt and the rows of
    a key are spread over the salts by the columns ``spread`` (all other columns where not given).
    ``salts`` of 1 copies nothing; it is for keys that have few rows each.
    """
    spark = big.sparkSession
    path = shared_dir(spark, "small")
    small.write.parquet(path)
    small = spark.read.schema(small.schema).parquet(path)
    size = small.agg(F.sum(_row_bytes(small))).first()[0] or 0
    if size <= (broadcast_bytes(spark) if limit is None else limit):
        return big.join(F.broadcast(small), list(keys), how)
    # Spark takes the size of the compressed file for that of the rows, even of the copies, and would broadcast them
    if salts == 1:
        return big.join(small.hint("merge"), list(keys), how)
    copied = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*(spread or [c for c in big.columns if c not in keys])), F.lit(salts)).cast("int"))
    return salted.join(copied.hint("merge"), [*keys, "_salt"], how).drop("_salt")
