"""Event-time traffic: passages, counts in sliding windows, repeated sentences.

Each works on a batch and on a stream.  On a stream the caller sets the watermark; results
of closed windows are appended once, rows behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of silence that end a passage, by the ship's class; others.
GAPS: Mapping[str, int] = {"passenger": 1800, "fishing": 7200, "cargo": 3600}
OTHER_GAP = 3600


def gap_of(ship_class: Column, gaps: Mapping[str, int] = GAPS, other: int = OTHER_GAP) -> Column:
    """Seconds without a report after which a passage of a class is over."""
    out = F.lit(other)
    for name, seconds in gaps.items():
        out = F.when(ship_class == name, F.lit(seconds)).otherwise(out)
    return out


def _interval(micros: Column) -> Column:
    zero = F.lit(0)
    return F.make_interval(zero, zero, zero, zero, zero, zero, (micros / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(18,6)"))


def passages(reports: DataFrame, keys: Sequence[str], time: str, gap_s: Column, distance: str) -> DataFrame:
    """Passages: reports of a key that follow each other at most ``gap_s`` seconds apart.

    Returns the keys, started and ended (first and last report), reports and nearest.  ``gap_s`` depends on the keys alone.

    In a batch, reports of a key that share a slot of one gap are in one passage, so they are combined in the map tasks
    first; a ship with most of the rows then sends one row per slot, and the session starts as
    long as its slot's reports reach.  On a stream, ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``
    combines sessions before the shuffle.
    """
    gap = gap_s.cast("long") * 1_000_000
    at = F.unix_micros(time)
    if reports.isStreaming:
        rows = reports.withColumns({"_gap": gap, "_n": F.lit(1).cast("long"), "_first": at, "_last": at, "_near": F.col(distance)})
    else:
        slotted = reports.filter(F.col(time).isNotNull()).withColumns({"_gap": gap, "_slot": F.floor(at / gap)})
        rows = slotted.groupBy(*keys, "_gap", "_slot").agg(
            F.min(time).alias(time), F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"), F.max(at).alias("_last"), F.min(distance).alias("_near")
        )
    session = F.session_window(time, _interval((F.col("_last") - F.col("_first") + F.col("_gap")).cast("decimal(18,0)")))
    out = rows.groupBy(*keys, session.alias("_session")).agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("_n").alias("reports"), F.min("_near").alias("nearest")
    )
    return out.select(*keys, F.timestamp_micros("_first").alias("started"), F.timestamp_micros("_last").alias("ended"), "reports", "nearest")


def traffic_counts(
    reports: DataFrame, by: Sequence[str], time: str, distance: str, limit: float, width: str = "1 hour", step: str = "15 minutes"
) -> DataFrame:
    """Reports, reports inside ``limit`` and the nearest per group and sliding window."""
    out = reports.groupBy(*by, F.window(time, width, step).alias("_w")).agg(
        F.count(F.lit(1)).alias("reports"), F.count_if(F.col(distance) < limit).alias("inside"), F.min(distance).alias("nearest")
    )
    return out.select(*by, F.col("_w.start").alias("from_ts"), F.col("_w.end").alias("to_ts"), "reports", "inside", "nearest")


def without_repeats(sentences: DataFrame, time: str, columns: Sequence[str], within: str = "10 minutes") -> DataFrame:
    """One of the sentences of a stream that are equal in ``columns``, which several receivers hear.

    Repeats up to ``within`` after the one kept are removed, whenever they come; of those in one trigger any may be kept.  A sentence is forgotten when the
    watermark, ``within`` behind the newest time, has passed its first time by ``within``; one
    heard again after that is a new one.
    """
    return sentences.withWatermark(time, within).dropDuplicatesWithinWatermark(list(columns))
