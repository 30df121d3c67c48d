"""Scores: combination over windows and evaluation against truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.halo import OWN, halo_window, with_halo
from ..plans.ordered import Running, running
from ..plans.sizes import join_small

# Histogram bins, added count, smallest logarithm in the loss,
# default prior.
BINS = 50
SMOOTHING = 1e-6
LOG_FLOOR = -100.0
PRIOR = 0.1


def score_bin(yhat: Column, bins: int = BINS) -> Column:
    """Bin 1..bins of a score in [0, 1]; 0 and 1 fall in the first and last."""
    return F.least(F.greatest(F.floor(yhat * bins).cast("int") + 1, F.lit(1)), F.lit(bins))


def nb_counts(scores: DataFrame, n: int, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Histogram counts per (offset, class, bin).

    ``scores``: file, hop (dense), yhat, and ``truth`` = whether the window that
    starts at this hop holds a label (NULL where no full window starts).  The
    score at hop h is offset i of the window that starts at h - i, so each score
    looks back over n starts; counts are combined in the map tasks.
    """
    halo = with_halo(scores, "hop", max(8192, n), before=n, after=0)
    w = halo_window(keys, "hop")
    looked = halo.select(
        OWN,
        score_bin(F.col("yhat")).alias("bin"),
        F.array(
            *[F.struct(F.lit(i).alias("offset"), F.lag("truth", i).over(w).alias("is_pos")) for i in range(n + 1)]
        ).alias("seen"),
    ).filter(OWN)
    return (
        looked.select("bin", F.inline("seen"))
        .filter(F.col("is_pos").isNotNull())
        .groupBy("offset", "is_pos", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def nb_train(scores: DataFrame, n: int, keys: Sequence[str] = ("file",), shared: bool = False) -> DataFrame:
    """Smoothed class-conditional histograms on the full grid of bins.

    ``shared`` uses one distribution per class for all offsets.
    """
    counts = nb_counts(scores, n, keys)
    grid = (
        scores.sparkSession.range((n + 1) * 2 * BINS)
        .select(
            F.floor(F.col("id") / (2 * BINS)).cast("int").alias("offset"),
            (F.floor(F.col("id") / BINS) % 2 == 1).alias("is_pos"),
            (F.col("id") % BINS + 1).cast("int").alias("bin"),
        )
    )
    if shared:
        counts = counts.groupBy("is_pos", "bin").agg(F.sum("n").alias("n"))
        cells = grid.join(counts, ["is_pos", "bin"], "left")
    else:
        cells = grid.join(counts, ["offset", "is_pos", "bin"], "left")
    cells = cells.withColumn("c", F.coalesce(F.col("n"), F.lit(0)) + SMOOTHING)
    total = cells.groupBy("offset", "is_pos").agg(F.sum("c").alias("total"))
    return cells.join(total, ["offset", "is_pos"]).select("offset", "is_pos", "bin", (F.col("c") / F.col("total")).alias("p"))


def nb_prior(scores: DataFrame) -> DataFrame:
    """Share of windows that hold a label."""
    return scores.agg(F.avg(F.col("truth").cast("double")).alias("prior"))


def nb_predict(
    scores: DataFrame, model: DataFrame, n: int, prior: float = PRIOR, keys: Sequence[str] = ("file",)
) -> DataFrame:
    """Decision per block of n hops: log prior plus the sum of log histogram
    values, yes only when strictly greater.

    The model has (n + 1) * 100 rows whatever the data, so it is broadcast.  The
    last block counts only if at least one hop follows it.
    """
    wide = F.broadcast(
        model.groupBy("offset", "bin").agg(
            F.sum(F.when(F.col("is_pos"), F.log("p"))).alias("lp"), F.sum(F.when(~F.col("is_pos"), F.log("p"))).alias("ln")
        )
    )
    rows = scores.select(
        *keys,
        F.col("hop"),
        F.floor(F.col("hop") / n).cast("long").alias("block"),
        (F.col("hop") % n).cast("int").alias("offset"),
        score_bin(F.col("yhat")).alias("bin"),
    )
    lengths = scores.groupBy(*keys).agg((F.max("hop") + 1).alias("_len"))
    summed = rows.join(wide, ["offset", "bin"]).groupBy(*keys, "block").agg(F.sum("lp").alias("log_pos"), F.sum("ln").alias("log_neg"))
    blocks = join_small(summed, lengths, list(keys), ["block"]).filter(F.col("block") * n < F.col("_len") - n)
    log_pos = F.col("log_pos") + F.log(F.lit(prior))
    log_neg = F.col("log_neg") + F.log(F.lit(1 - prior))
    return blocks.select(
        *keys, "block", log_pos.alias("log_pos"), log_neg.alias("log_neg"),
        F.when(log_pos > log_neg, 1).otherwise(0).alias("yes"),
    )


def block_predict(scores: DataFrame, blocks: DataFrame, n: int, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Block decisions written back to every hop; hops after the last full block
    get 0.  Hops are listed from the block rows, not joined."""
    lengths = scores.groupBy(*keys).agg((F.max("hop") + 1).alias("_len"))
    listed = blocks.select(
        *keys, F.explode(F.sequence(F.col("block") * n, F.col("block") * n + n - 1)).alias("hop"), "yes"
    )
    covered = (
        lengths.withColumn("_full", F.greatest(F.ceil(F.col("_len") / n) - 1, F.lit(0)).cast("long") * n)
        .filter(F.col("_full") < F.col("_len"))
        .select(*keys, F.explode(F.sequence(F.col("_full"), F.col("_len") - 1)).alias("hop"), F.lit(0).alias("yes"))
    )
    return listed.unionByName(covered)


def predict_at(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.withColumn("yes", (F.col("yhat") > threshold).cast("int"))


def prf(scores: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall and F1 of ``yhat > threshold``."""
    hit = F.col("yhat") > threshold
    pos = F.col("y") == 1
    c = scores.agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn")
    )
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return c.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def pr_counts(scores: DataFrame) -> DataFrame:
    """Per distinct score, highest first: rows and positives at or above it."""
    by_score = scores.groupBy("yhat").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    down = -F.col("yhat")
    return running(by_score, [], [down], {"tp": Running(F.col("pos")), "seen": Running(F.col("n"))})


def pr_curve(scores: DataFrame) -> DataFrame:
    """Precision and recall at every score threshold."""
    positives = scores.agg(F.sum(F.col("y").cast("long"))).scalar()
    return pr_counts(scores).select(
        F.col("yhat").alias("threshold"),
        (F.col("tp") / F.col("seen")).alias("precision"),
        F.try_divide(F.col("tp"), positives).alias("recall"),
    )


def average_precision(scores: DataFrame) -> DataFrame:
    """Sum over thresholds of recall gained times precision."""
    c = pr_counts(scores)
    return c.agg(
        F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos")).alias("average_precision")
    )


def log_loss(scores: DataFrame) -> DataFrame:
    """Mean binary cross-entropy; logarithms are floored."""
    y, p = F.col("y"), F.col("yhat")

    def ln(v: Column) -> Column:
        return F.when(v > 0, F.greatest(F.log(v), F.lit(LOG_FLOOR))).otherwise(LOG_FLOOR)

    return scores.agg(F.avg(-(y * ln(p) + (1 - y) * ln(1 - p))).alias("log_loss"))


def linear_score(features: DataFrame, x: str, weights: Sequence[float], bias: float) -> DataFrame:
    """Sigmoid of ``weights . x + bias``."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    z = F.aggregate(F.zip_with(F.col(x), w, lambda a, b: a * b), F.lit(float(bias)), lambda s, v: s + v)
    return features.withColumn("yhat", 1 / (1 + F.exp(-z)))


def fit_linear(features: DataFrame, x: str, y: str, max_iter: int = 20, reg: float = 0.01):
    """Distributed logistic regression on an array column; returns the model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    train = features.select(array_to_vector(F.col(x).cast("array<double>")).alias("features"), F.col(y).cast("double").alias("label"))
    return LogisticRegression(maxIter=max_iter, regParam=reg).fit(train)


def score_windows(model, windows: DataFrame, x: str) -> DataFrame:
    """Probability of the positive class per window, by the fitted model."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(windows.withColumn("features", array_to_vector(F.col(x).cast("array<double>"))))
    return scored.withColumn("yhat", F.get(vector_to_array("probability"), F.lit(1))).drop(
        "features", "rawPrediction", "probability", "prediction"
    )
