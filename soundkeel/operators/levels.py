"""Levels, calibration and per-recording statistics.

All are plain grouped aggregates: Spark pre-aggregates in each task, so one huge
recording only sends one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import db, safediv
from ..functions.text import label_class
from ..plans.sizes import join_small
from . import kernels

# Received level of the calibration tone (dB), tone interval and
# start of the measured part (s), taper transform size, accepted tone (Hz).
TONE_LEVEL_DB = 135.5
TONE_START_S, TONE_STOP_S = 0.2, 0.4
MEASURE_FROM_S = 4.0
TONE_NFFT = 16384
TONE_HZ = (950.0, 1050.0)


def louder_channel(samples: DataFrame, keys: Sequence[str], ch0: str, ch1: str) -> DataFrame:
    """Mean absolute level of two channels; channel 0 only when strictly louder."""
    levels = samples.groupBy(*keys).agg(
        F.avg(F.abs(F.col(ch0))).alias("level0"), F.avg(F.abs(F.col(ch1))).alias("level1")
    )
    return levels.withColumn("channel", F.when(F.col("level0") > F.col("level1"), 0).otherwise(1))


def pick_louder(chunks: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Replace ``ch`` (array of channels) by the louder channel of each file.

    One small row per file is joined back; mono files keep their only channel.
    """
    c0, c1 = F.get("ch", F.lit(0)), F.get("ch", F.lit(1))
    sums = chunks.select(
        *keys,
        kernels.level_sums(c0).alias("a"),
        kernels.level_sums(F.coalesce(c1, F.array().cast("array<float>"))).alias("b"),
    )
    best = sums.groupBy(*keys).agg(F.sum("a.s_abs").alias("s0"), F.sum("b.s_abs").alias("s1"), F.sum("b.n").alias("n1"))
    best = best.select(*keys, F.when((F.col("n1") > 0) & (F.col("s1") >= F.col("s0")), 1).otherwise(0).alias("channel"))
    return join_small(chunks, best, list(keys)).withColumn("samples", F.get("ch", F.col("channel"))).drop("ch")


def level_db(samples: DataFrame, keys: Sequence[str], x: Column, cal: Column | float = 0.0) -> DataFrame:
    """Mean-square level in dB, and spread of the per-sample ``10 log10(x^2+1)``."""
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        db(F.avg(x * x), cal).alias("level_db"),
        F.stddev_pop(10 * F.log10(x * x + 1)).alias("spread_db"),
    )


def calibration(samples: DataFrame, keys: Sequence[str], x: Column, is_tone: Column) -> DataFrame:
    """Calibration constant per file: known tone level minus measured tone level."""
    tone = samples.filter(is_tone).groupBy(*keys).agg(db(F.avg(x * x)).alias("tone_db"))
    return tone.withColumn("cal_db", F.lit(TONE_LEVEL_DB) - F.col("tone_db"))


def calibrated(samples: DataFrame, keys: Sequence[str], x: Column, is_tone: Column, is_measured: Column) -> DataFrame:
    """Constant, level and spread of each file in a single pass over the samples."""
    sq = x * x
    out = samples.groupBy(*keys).agg(
        db(F.avg(F.when(is_tone, sq))).alias("tone_db"),
        db(F.avg(F.when(is_measured, sq))).alias("raw_db"),
        F.stddev_pop(F.when(is_measured, 10 * F.log10(sq + 1))).alias("spread_db"),
    )
    out = out.withColumn("cal_db", F.lit(TONE_LEVEL_DB) - F.col("tone_db"))
    return out.select(*keys, "cal_db", (F.col("raw_db") + F.col("cal_db")).alias("level_db"), "spread_db")


def chunk_levels(chunks: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Count, mean, maximum, deviation, level and spread from array chunks."""
    own = F.slice("samples", F.lit(1), F.col("n_own")) if "n_own" in chunks.columns else F.col("samples")
    s = chunks.select(*keys, kernels.level_sums(own).alias("s"))
    n, s1, s2 = F.sum("s.n"), F.sum("s.s1"), F.sum("s.s2")
    d1, d2 = F.sum("s.s_db"), F.sum("s.s_db2")

    def spread(first: Column, second: Column) -> Column:
        return F.sqrt(F.greatest(second / n - (first / n) * (first / n), F.lit(0.0)))

    return s.groupBy(*keys).agg(
        n.alias("n"),
        (s1 / n).alias("mean"),
        F.max("s.hi").alias("max"),
        spread(s1, s2).alias("std"),
        (F.sum("s.s_abs") / n).alias("mean_abs"),
        db(s2 / n).alias("level_db"),
        spread(d1, d2).alias("spread_db"),
    )


def calibrated_recordings(tone: DataFrame, measured: DataFrame, fs: str = "sample_rate") -> DataFrame:
    """Calibrated level per recording.

    ``tone``: one row per file with the tone samples ``x``; ``measured``: chunks
    after the tone.  Files whose tone is not near 1 kHz are dropped.  The tone is
    tapered before its spectrum and its level are taken.
    """
    hz = lambda c: F.col(c) * F.col(fs) / TONE_NFFT
    found = tone.select("file", fs, kernels.tone_measure(F.col("x"), TONE_NFFT).alias("t"))
    found = found.withColumn("tone_hz", (hz("t.by_width") + hz("t.by_prominence")) / 2)
    good = found.filter(F.col("tone_hz").between(*TONE_HZ)).select(
        "file", "tone_hz", (F.lit(TONE_LEVEL_DB) - db(F.col("t.mean_square"))).alias("cal_db")
    )
    levels = chunk_levels(measured)
    return good.join(levels, "file").select(
        "file", "tone_hz", "cal_db", (F.col("level_db") + F.col("cal_db")).alias("level_db"), "spread_db"
    )


def describe(samples: DataFrame, keys: Sequence[str], x: Column) -> DataFrame:
    return samples.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.max(x).alias("max"), F.stddev_pop(x).alias("std")
    )


def scaled_to_max(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each column divided by its maximum per key (unchanged when that is 0)."""
    tops = df.groupBy(*keys).agg(*[F.max(c).alias(f"_top_{c}") for c in columns])
    out = join_small(df, tops, list(keys))
    return out.withColumns({c: safediv(F.col(c), F.col(f"_top_{c}")) for c in columns}).drop(
        *[f"_top_{c}" for c in columns]
    )


def peak_norm(chunks: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Samples divided by twice the recording's maximum."""
    tops = chunks.groupBy(*keys).agg(F.max(F.array_max("samples")).alias("_top"))
    return (
        join_small(chunks, tops, list(keys))
        .withColumn("_half", 1 / (2 * F.col("_top").cast("double")))
        .withColumn("samples", F.transform("samples", lambda v: v * F.col("_half")))
        .drop("_top", "_half")
    )


def value_range(df: DataFrame, x: Column) -> DataFrame:
    return df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"))


def run_manifest(products: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Arrays written per file and the time span they cover."""
    return products.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_arrays"), F.min("start_s").alias("first_s"), F.max("end_s").alias("last_s")
    )


def unknown_labels(labels: DataFrame, text: str = "label") -> DataFrame:
    """Label regions kept and skipped (text of no known class)."""
    cls = label_class(F.col(text))
    return labels.agg(F.count(cls).alias("n_labels"), F.count_if(cls.isNull()).alias("n_skipped"))
