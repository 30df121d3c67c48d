"""Repeatable random draws.

A draw is a hash of the row's identity and a seed, so a retried or relocated task
draws the same value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 13  # hexadecimal digits: 52 bits, exact in a double


def unit(ids: list[Column], seed: int, tag: str = "") -> Column:
    """Uniform number in [0, 1)."""
    text = F.concat_ws("|", *[i.cast("string") for i in ids], F.lit(f"{seed}{tag}"))
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, _DIGITS), 16, 10).cast("double")
    return number / float(16**_DIGITS)
