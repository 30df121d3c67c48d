"""Seconds, sample indexes and wall time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(duration: str) -> int:
    """Microseconds of a duration as Spark's windows take it, such as ``30 minutes``."""
    return pd.Timedelta(duration).value // 1000


def hms_to_s(h: Column, m: Column, s: Column) -> Column:
    return h * 3600 + m * 60 + s


def to_idx(seconds: Column, fs) -> Column:
    """Sample index, truncated toward zero."""
    return (seconds * fs).cast("long")


def to_s(idx: Column, fs) -> Column:
    return idx / fs


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970; the session zone is pinned to UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def frame_ts(file_ts: Column, idx: Column, fs) -> Column:
    """Wall time of a sample of a recording that began at ``file_ts``."""
    return F.timestamp_micros((F.unix_micros(file_ts.cast("timestamp")) + F.round(idx * 1_000_000 / fs)).cast("long"))
