"""Ordered scans (running sum / max / last value) that survive hot keys.

A window over ``key ORDER BY position`` puts all rows of a key in one task.  Here the rows
are cut along (key, order) first, whatever their number:

    1. Spark's range partitioning cuts at quantiles of the whole (key, order, row id) tuple, so that
       outliers, equal positions, text keys and any number of hot keys give chunks of
       about equal size; the cut rows are written once, which fixes the chunks;
    2. the window runs per (key, chunk), many tasks per hot key;
    3. one small row per (key, chunk) holds the chunk's total, and a running total over those
       rows, at most one per chunk of a key, gives each chunk the value carried in;
    4. the carried value is joined back on (key, chunk) and combined.

Sum, max, min and last-non-null are associative, so the result is that of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import range_chunks, shared_dir

CHUNK = "_chunk"
KEY = "_key"
_TIE = "_tie"


@dataclass(frozen=True)
class Running:
    """One running value: ``how`` is sum, max, min or last (last non-null)."""

    value: Column
    how: str = "sum"
    inclusive: bool = True
    backward: bool = False


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows with their chunk, stored; ``scan`` takes them, and several scans can share them.

    Chunk numbers grow along ``order`` within a key.  Null keys are a key of their own.
    """
    spark = df.sparkSession
    # a struct is never null, and equal where its fields are equal or both null
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.withColumn(KEY, key).withColumn(_TIE, F.monotonically_increasing_id())
    by = [KEY, *order, F.col(_TIE)]
    rows = rows.repartitionByRange(range_chunks(spark), *by).drop(_TIE).withColumn(CHUNK, F.spark_partition_id())
    path = shared_dir(spark, "ordered")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _local(spec: Running, partition: Sequence[Column | str], order: Sequence[Column]) -> Column:
    ordering = [o.desc() for o in order] if spec.backward else list(order)
    end = 0 if spec.inclusive else -1
    w = Window.partitionBy(*partition).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, end)
    if spec.how == "sum":
        return F.coalesce(F.sum(spec.value).over(w), F.lit(0))
    if spec.how == "last":
        return F.last(spec.value, ignorenulls=True).over(w)
    return {"max": F.max, "min": F.min}[spec.how](spec.value).over(w)


def _total(spec: Running, order: Sequence[Column]) -> Column:
    if spec.how == "sum":
        return F.sum(spec.value)
    if spec.how == "last":
        at = F.when(spec.value.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
        return F.min_by(spec.value, at) if spec.backward else F.max_by(spec.value, at)
    return {"max": F.max, "min": F.min}[spec.how](spec.value)


def scan(rows: DataFrame, order: Sequence[Column], running: Mapping[str, Running]) -> DataFrame:
    """Add running values per key to cut rows; the chunk stays for further scans.

    ``order`` has to be unique per key for results that do not depend on row arrival.
    Rows may have been added columns since the cut, but none may be new.  The rows are read twice, for
    the totals and for the windows.  A chained scan reads the first one's windows again for its totals, with the
    columns that they need, and puts its own on the same partitions: a shuffle for each scan.
    """
    part = [KEY, CHUNK]
    local = rows.withColumns({n: _local(s, part, order) for n, s in running.items()})
    totals = rows.groupBy(*part).agg(*[_total(s, order).alias(f"_t_{n}") for n, s in running.items()])
    carried = totals.select(
        F.col(KEY).alias("_c_key"),
        F.col(CHUNK).alias("_c_chunk"),
        *[
            _local(Running(F.col(f"_t_{n}"), s.how, False, s.backward), [KEY], [F.col(CHUNK)]).alias(f"_c_{n}")
            for n, s in running.items()
        ],
    )
    out = local.join(carried, (F.col(KEY) == F.col("_c_key")) & (F.col(CHUNK) == F.col("_c_chunk")))
    combined = {}
    for n, s in running.items():
        mine, before = F.col(n), F.col(f"_c_{n}")
        if s.how == "sum":
            combined[n] = mine + F.coalesce(before, F.lit(0))
        elif s.how == "last":
            combined[n] = F.coalesce(mine, before)
        else:
            combined[n] = (F.greatest if s.how == "max" else F.least)(mine, before)
    return out.withColumns(combined).drop("_c_key", "_c_chunk", *[f"_c_{n}" for n in running])


def fixed(rows: DataFrame) -> DataFrame:
    """Scanned rows, stored, where both statistics of them and the rows themselves are needed: the scans run once."""
    path = shared_dir(rows.sparkSession, "scanned")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def uncut(rows: DataFrame) -> DataFrame:
    return rows.drop(KEY, CHUNK)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Mapping[str, Running]) -> DataFrame:
    """Cut, scan once, and drop the chunk."""
    return uncut(scan(cut(df, keys, order), order, values))


def previous(value: Column) -> Running:
    """Value of the row before (non-null values only)."""
    return Running(value, "last", inclusive=False)


def following(value: Column) -> Running:
    """Value of the row after (non-null values only)."""
    return Running(value, "last", inclusive=False, backward=True)
