"""Runs of consecutive rows: calls, bouts and merged segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import db
from ..plans.ordered import Running, cut, previous, scan, uncut
from ..plans.sizes import join_small


def runs(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], flag: Column) -> DataFrame:
    """Number the runs of flagged rows.

    ``run`` counts the unflagged rows before a row, so a run and the unflagged
    row that ends it share one number: one running count is all it takes.
    """
    marked = rows.withColumn("flag", F.coalesce(flag, F.lit(False)))
    quiet_before = Running((~F.col("flag")).cast("long"), "sum", inclusive=False)
    return uncut(scan(cut(marked, keys, order), order, {"run": quiet_before}))


def segment_calls(
    frames: DataFrame,
    keys: Sequence[str] = ("file",),
    frame: str = "start_sample",
    keep_open: bool = False,
) -> DataFrame:
    """Calls from per-frame detections (``n_peaks, f0, peak``).

    A call runs from its first frame with peaks to the first frame without; one
    still open at the end of the recording is left out unless ``keep_open``.
    """
    at = F.col(frame)
    numbered = runs(frames, keys, [at], F.col("n_peaks") > 0)
    on = F.col("flag")
    n = F.count_if(on)
    std = F.stddev_pop(F.when(on, F.col("peak")))
    calls = numbered.groupBy(*keys, "run").agg(
        F.min(F.when(on, at)).alias("startidx"),
        F.min(F.when(~on, at)).alias("_end"),
        F.max(F.when(on, at)).alias("_last"),
        n.alias("n_frames"),
        F.avg(F.when(on, F.col("f0"))).alias("f0"),
        F.stddev_pop(F.when(on, F.col("f0"))).alias("sigma_f0"),
        db(F.avg(F.when(on, F.col("peak")))).alias("mean_peak"),
        F.when(n == 1, 0.0).otherwise(db(std)).alias("sigma_peak"),
    )
    calls = calls.filter("n_frames > 0")
    if keep_open:
        calls = calls.withColumn("_end", F.coalesce("_end", "_last"))
    calls = calls.filter(F.col("_end").isNotNull())
    return calls.select(
        *keys,
        "startidx",
        F.col("_end").alias("stopidx"),
        (F.col("_end") - F.col("startidx")).alias("lencall"),
        "n_frames",
        "f0",
        "sigma_f0",
        "mean_peak",
        "sigma_peak",
    )


def bout_report(
    levels: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    level: Column,
    at: Column,
    n_sigma: float = 1.0,
) -> DataFrame:
    """Runs louder than mean + n sigma of their recorder, ended by a quiet row.

    The thresholds are one row per recorder, joined back.
    """
    spark_keys = list(keys)
    loud = levels.groupBy(*spark_keys).agg((F.avg(level) + n_sigma * F.stddev_pop(level)).alias("_thr"))
    rows = join_small(levels, loud, spark_keys, order).withColumn("_level", level).withColumn("_at", at)
    numbered = runs(rows, spark_keys, order, F.col("_level") > F.col("_thr"))
    on = F.col("flag")
    out = numbered.groupBy(*spark_keys, "run").agg(
        F.min(F.when(on, F.col("_at"))).alias("start"),
        F.min(F.when(~on, F.col("_at"))).alias("stop"),
        F.count_if(on).alias("n"),
        F.avg(F.when(on, F.col("_level"))).alias("mean_level"),
        F.stddev_pop(F.when(on, F.col("_level"))).alias("sd_level"),
        F.max(F.when(on, F.col("_level"))).alias("peak_level"),
    )
    return out.filter("n > 0 and stop is not null").drop("run")


def merge_segments(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], label: str, at: Column
) -> DataFrame:
    """Merge neighbours with equal labels into segments (label must not be null)."""
    rows = cut(rows.withColumn("_at", at), keys, order)
    seen = scan(rows, order, {"_prev": previous(F.col(label))})
    changed = (F.col("_prev").isNull() | (F.col("_prev") != F.col(label))).cast("long")
    numbered = scan(seen.withColumn("_new", changed), order, {"_seg": Running(F.col("_new"))})
    return (
        numbered.groupBy(*keys, "_seg", label)
        .agg(F.min("_at").alias("start"), F.max("_at").alias("stop"), F.count(F.lit(1)).alias("n"))
        .drop("_seg")
    )


def strong_calls(calls: DataFrame, min_len: float, min_peak: float) -> DataFrame:
    return calls.filter((F.col("lencall") >= min_len) & (F.col("mean_peak") >= min_peak))


def got_signal(
    n_good: Column, good_share: Column, n_contours: Column, area: Column, min_share: float, max_contours: int, min_area: float
) -> Column:
    """Blob statistics that look like a call."""
    return (n_good > 0) & (good_share > min_share) & (n_contours < max_contours) & (area > min_area)


def got_background(n_good: Column, good_share: Column, n_contours: Column, max_share: float, min_contours: int) -> Column:
    """Blob statistics that look like background."""
    return (n_good > 0) & (good_share < max_share) & (n_contours > min_contours)


def detection_series(frames: DataFrame, calls: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Per frame: peaks, and length and peak of the call that ends there; each
    scaled to its maximum per recording."""
    from .levels import scaled_to_max

    ends = calls.select(
        *keys,
        F.col("stopidx").alias("start_sample"),
        F.col("lencall").alias("call_len"),
        F.pow(F.lit(10.0), F.col("mean_peak") / 10).alias("call_peak"),
    )
    series = frames.join(ends, [*keys, "start_sample"], "left").select(
        *keys,
        "start_sample",
        F.col("n_peaks").cast("double").alias("n_peaks"),
        F.coalesce(F.col("call_len").cast("double"), F.lit(0.0)).alias("call_len"),
        F.coalesce("call_peak", F.lit(0.0)).alias("call_peak"),
    )
    return scaled_to_max(series, keys, ["n_peaks", "call_len", "call_peak"])
