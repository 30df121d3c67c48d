"""Click removal on sample rows.

Quiet local peaks cut a recording into regions; a region with a sample above
mean + 6 sigma is a click.  Its gain falls toward the highest sample, where the
amplitude becomes the threshold, and keeps falling at the same kind of slope
until the next quiet peak.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import CHUNK, Running, cut, fixed, following, previous, scan
from ..plans.sizes import join_small

# Fixed value: standard deviations above the mean that start a click.
TRIGGER_SIGMAS = 6.0


def declick(
    samples: DataFrame, keys: Sequence[str], index: str, x: str, sigmas: float = TRIGGER_SIGMAS
) -> DataFrame:
    """Adds ``gain`` (1 outside clicks), ``y`` (scaled sample) and ``is_trigger``.

    ``index`` numbers the samples of a key and is unique.
    """
    i, a = F.col(index), F.abs(F.col(x))
    stats = samples.groupBy(*keys).agg(F.avg(a).alias("_ave"), F.stddev_pop(a).alias("_std"))
    rows = cut(join_small(samples, stats, list(keys), [i]).withColumn("_a", a), keys, [i])
    rows = scan(rows, [i], {"_l": previous(F.col("_a")), "_r": following(F.col("_a"))})
    thresh = F.col("_ave") + F.col("_std")
    quiet_peak = F.coalesce(
        (F.col("_a") > F.col("_l")) & (F.col("_a") > F.col("_r")) & (F.col("_a") < thresh), F.lit(False)
    )
    rows = rows.withColumns(
        {
            "_thresh": thresh,
            "_quiet": quiet_peak,
            "is_trigger": F.col("_a") > F.col("_ave") + sigmas * F.col("_std"),
        }
    ).drop("_l", "_r", "_ave", "_std")
    # read again for the regions and their join
    rows = fixed(scan(rows, [i], {"_region": Running(F.col("_quiet").cast("long"))}))
    # A region starts at a quiet peak (inclusive) and ends before the next one.
    regions = (
        rows.groupBy(*keys, "_region")
        .agg(
            F.max("is_trigger").alias("_click"),
            F.min(i).alias("_lo"),
            (F.max(i) + 1).alias("_hi"),
            F.max("_a").alias("_top"),
            F.min_by(i, F.struct(-F.col("_a"), i)).alias("_at"),
            F.sequence(F.min(CHUNK), F.max(CHUNK)).alias("_chunks"),
        )
        .filter("_click")
        .withColumn(CHUNK, F.explode("_chunks"))
        .drop("_click", "_chunks")
    )
    # Most regions hold no click, so the clicks are the small side.  A region is there once for each chunk that it
    # reaches into, and has no more rows there than the chunk, so that long regions need no salts.
    out = join_small(rows, regions, [*keys, CHUNK, "_region"], how="left", salts=1)
    drop_ = F.col("_top") - F.col("_thresh")
    rising = F.col("_top") - (F.col("_at") - i) * F.try_divide(drop_, F.col("_at") - F.col("_lo"))
    falling = F.col("_top") + (i - F.col("_at")) * F.try_divide(drop_, F.col("_hi") - F.col("_at"))
    level = F.when(i < F.col("_at"), rising).otherwise(falling)
    gain: Column = F.when(F.col("_at").isNull(), 1.0).otherwise(F.col("_thresh") / level)
    return out.withColumn("gain", gain).withColumn("y", F.col(x) * F.col("gain")).select(
        *samples.columns, "is_trigger", "gain", "y"
    )
