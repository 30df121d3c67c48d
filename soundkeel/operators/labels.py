"""Interval labels: priors, backgrounds, clips, coverage and presence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import Running, cut, previous, running, scan
from ..plans.rangejoin import point_in_interval

# Training split of a recording (s), shortest usable label (s).
SPLIT_S = 25 * 60
MIN_LABEL_S = 0.1


def usable(labels: DataFrame, min_s: float = MIN_LABEL_S) -> DataFrame:
    return labels.filter(F.col("duration_s") >= min_s)


def with_prior(
    labels: DataFrame, keys: Sequence[str], order: Sequence[Column], start: str, duration: str
) -> DataFrame:
    """Start and duration of the label before in the same file (NULL for the first)."""
    prior = F.struct(F.col(start).alias("start"), F.col(duration).alias("duration"))
    out = running(labels, keys, order, {"_prior": previous(prior)})
    return out.select(
        *labels.columns,
        F.col("_prior.start").alias("prior_start"),
        F.col("_prior.duration").alias("prior_duration"),
    )


def background_intervals(
    labels: DataFrame, keys: Sequence[str], order: Sequence[Column], start: str, duration: str, dt: float
) -> DataFrame:
    """Background windows between neighbouring labels.

    The gap starts one window after the prior label (at 0 for the first label)
    and stops one window before this one.  Gaps longer than 0.75 window give
    windows every half window, starting a quarter window in.
    """
    prior = with_prior(labels, keys, order, start, duration)
    lo = F.coalesce(F.col("prior_start") + F.col("prior_duration") + dt, F.lit(0.0))
    gaps = prior.select(*keys, lo.alias("_lo"), (F.col(start) - dt).alias("_hi"))
    gaps = gaps.filter(F.col("_hi") - F.col("_lo") > 0.75 * dt)
    n = ((F.col("_hi") - F.col("_lo")) / (dt / 2)).cast("long")
    listed = gaps.filter(n > 0).select(*keys, "_lo", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    return listed.select(
        *keys, (F.col("_lo") + dt / 4 + F.col("i") * (dt / 2)).alias("start_s"), F.lit(float(dt)).alias("duration_s")
    )


def clip_intervals(labels: DataFrame, start: str, end: str, lo: float, hi: float) -> DataFrame:
    """Intervals meeting [lo, hi), untrimmed and trimmed to it."""
    return labels.filter((F.col(start) < hi) & (F.col(end) > lo)).withColumns(
        {"clip_start": F.greatest(F.col(start), F.lit(lo)), "clip_end": F.least(F.col(end), F.lit(hi))}
    )


def time_split(df: DataFrame, at: str, split: float) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(at) < split), df.filter(F.col(at) >= split)


def coverage(
    labels: DataFrame, keys: Sequence[str], start: str, end: str, length: str, split: float, stride: float
) -> DataFrame:
    """Labelled span, positive points and percent positive on both sides of a split.

    ``length`` is the recording length column.  Overlapping labels count twice.
    One pass: both sides are conditional sums.
    """
    s, e, n = F.col(start), F.col(end), F.col(length)
    train = F.greatest(F.least(e, F.lit(split)) - F.least(s, F.lit(split)), F.lit(0))
    test = F.greatest(F.greatest(e, F.lit(split)) - F.greatest(s, F.lit(split)), F.lit(0))
    out = labels.groupBy(*keys).agg(
        F.count_if(s < split).alias("train_labels"),
        F.count_if(e > split).alias("test_labels"),
        F.sum(train).alias("train_span"),
        F.sum(test).alias("test_span"),
        F.max(n).alias("_len"),
    )
    train_len = F.least(F.col("_len"), F.lit(split))
    test_len = F.greatest(F.col("_len") - split, F.lit(0))
    return out.select(
        *keys,
        "train_labels",
        "test_labels",
        "train_span",
        "test_span",
        F.floor(F.col("train_span") / stride).cast("long").alias("train_points"),
        F.floor(F.col("test_span") / stride).cast("long").alias("test_points"),
        (100 * F.try_divide(F.col("train_span"), train_len)).alias("train_pct"),
        (100 * F.try_divide(F.col("test_span"), test_len)).alias("test_pct"),
    )


def merged_spans(labels: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Union of overlapping or touching intervals per key."""
    order = [F.col(start), F.col(end)]
    seen = scan(cut(labels, keys, order), order, {"_reach": Running(F.col(end), "max", inclusive=False)})
    fresh = (F.col("_reach").isNull() | (F.col("_reach") < F.col(start))).cast("long")
    # of equal intervals one is fresh: it comes first
    numbered = scan(seen.withColumn("_fresh", fresh), [*order, -F.col("_fresh")], {"_span": Running(F.col("_fresh"))})
    return (
        numbered.groupBy(*keys, "_span")
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_labels"))
        .drop("_span")
    )


def presence(
    points: DataFrame,
    labels: DataFrame,
    keys: Sequence[str],
    pos: str,
    start: str,
    end: str,
    width: int = 0,
    classes: Sequence[int] | None = None,
    label: str | None = None,
) -> DataFrame:
    """Does any label touch each point, or each window ``[pos, pos + width)``?

    Points and labels are merged into one ordered sequence per key.  A label with
    ``start <= p`` (or ``start < p + width``) covers the point when the largest end
    seen so far lies beyond ``p``.  No point-label pairs are formed, however many
    labels overlap.  Adds ``has_label``, or one ``has_<class>`` per class.
    """
    names = {"has_label": None} if classes is None else {f"has_{c}": c for c in classes}
    # A label starting exactly at the point counts; one starting exactly at the
    # end of a window does not.
    label_rank = 1 if width else 0
    p = points.select(
        *keys,
        (F.col(pos) + width).cast("long").alias("_at"),
        F.lit(1 - label_rank).alias("_rank"),
        F.struct(*[c for c in points.columns]).alias("_point"),
        *[F.lit(None).cast("long").alias(f"_end_{n}") for n in names],
    )
    ends = [
        (F.col(end) if c is None else F.when(F.col(label) == c, F.col(end))).cast("long").alias(f"_end_{n}")
        for n, c in names.items()
    ]
    empty = p.schema["_point"].dataType
    lab = labels.filter(F.col(end) > F.col(start)).select(
        *keys,
        F.col(start).cast("long").alias("_at"),
        F.lit(label_rank).alias("_rank"),
        F.lit(None).cast(empty).alias("_point"),
        *ends,
    )
    merged = p.unionByName(lab)
    seen = running(
        merged,
        keys,
        [F.col("_at"), F.col("_rank")],
        {f"_reach_{n}": Running(F.col(f"_end_{n}"), "max") for n in names},
    ).filter(F.col("_point").isNotNull())
    return seen.select(
        "_point.*",
        *[F.coalesce(F.col(f"_reach_{n}") > F.col("_at") - width, F.lit(False)).alias(n) for n in names],
    )


def label_at(
    points: DataFrame, labels: DataFrame, keys: Sequence[str], pos: str, start: str, end: str, bucket: int
) -> DataFrame:
    """Every (point, label) pair with ``start <= pos < end``."""
    return point_in_interval(points, labels, keys, pos, start, end, bucket)


def example_counts(files: DataFrame, key: str, length: str, stride: int) -> DataFrame:
    """Examples per file and the running number of the file's first example."""
    n = F.floor(F.col(length) / stride).cast("long")
    counted = files.select(key, n.alias("n"))
    return running(counted, [], [F.col(key)], {"base": Running(F.col("n"), "sum", inclusive=False)})


def locate(examples: DataFrame, bases: DataFrame, index: str, stride: int) -> DataFrame:
    """Global example numbers to (file, sample): ``base <= i < base + n``."""
    spans = bases.withColumn("_stop", F.col("base") + F.col("n"))
    hit = point_in_interval(examples, spans, [], index, "base", "_stop", 4096)
    return hit.withColumn("sample", (F.col(index) - F.col("base")) * stride).drop("base", "n", "_stop")


def annotation_track(samples: DataFrame, index: str, flag: str, fs: float, hz: float = 5000.0, amp: float = 0.01) -> DataFrame:
    """Quiet tone where a label is present, silence elsewhere."""
    tone = amp * F.sin(2 * 3.141592653589793 * hz * F.col(index) / fs)
    return samples.withColumn("mark", F.when(F.col(flag), tone).otherwise(0.0))


def drop_uncoded(annotations: DataFrame) -> DataFrame:
    """Drop placeholder codes; one row per box."""
    box = ["file", "t_lo", "f_lo", "t_hi", "f_hi"]
    return annotations.filter(F.col("code").isNotNull() & (F.trim("code") != "None")).dropDuplicates([*box, "code"])


def annotation_summary(annotations: DataFrame, keys: Sequence[str] = ("code",)) -> DataFrame:
    return annotations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("t_hi") - F.col("t_lo")).alias("mean_width"),
        F.avg(F.col("f_hi") - F.col("f_lo")).alias("mean_band"),
    )


def annotation_cube(annotations: DataFrame, file: str = "file", code: str = "code") -> DataFrame:
    """The summary by file and code, by each alone and over all; ``level`` is the grouping id: 1 sums over codes, 2 over files, 3 over both."""
    return annotations.cube(file, code).agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("t_hi") - F.col("t_lo")).alias("mean_width"),
        F.avg(F.col("f_hi") - F.col("f_lo")).alias("mean_band"),
    )
