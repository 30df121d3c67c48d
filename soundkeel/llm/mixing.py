"""Mixing sources to target weights by distributed prefix sums.

Documents of a source are put in a random order that a hash fixes.  Ranges of
hash keys hold about ``RANGE_ROWS`` documents each, whatever the source's
share of the corpus, so running sums need no task that sees a whole source:
sums per range give every range what lies before it.  The order is cut at the
source's exact budget; a budget above the source's size repeats whole epochs first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

WEIGHTS = (1.0, 2.0, 3.0)
MAX_EPOCHS = 3
RANGE_ROWS = 4_000
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(_source, source_size, n_docs, target) from one row per source.

    Sources in code point order, null last, take the weights in turn and share all
    words; a target stops at ``max_epochs`` times its source.  Sharing the excess again
    until none is above is the level x with sum(min(cap, weight * x)) = total, found
    on the sources sorted by the level at which their cap is reached.
    """
    # Spark compares strings by UTF-8 bytes, which is code point order
    order = Window.orderBy(F.col("_source").isNull(), "_source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    t = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_epochs)
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("_source").isNull(), "_source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    t = t.withColumn("level", left / F.sum("w").over(after))
    # the first source below its cap has the level; later ones would leave ever less
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    t = t.withColumn("x", F.max(fits).over(Window.partitionBy()))
    target = F.least(F.col("x") * F.col("w"), F.col("cap").cast("double"))
    return t.select("_source", "source_size", "n_docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def _order(keys: Sequence[Column], seed: int) -> Column:
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return F.md5(text.cast("binary"))


def _mixed(d: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """From _source, _key and _size: source_size, target, _epochs (whole ones) and _part (size taken of the last)."""
    sizes = d.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goal = stored(targets(sizes, weights, max_epochs), "mix-targets").withColumnRenamed("_source", "_g_source")
    unit = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    d = d.join(goal, F.col("_source").eqNullSafe(F.col("_g_source"))).drop("_g_source")
    d = d.withColumn("_range", F.floor(unit * F.ceil(F.col("n_docs") / RANGE_ROWS)).cast("long"))
    part = ["_source", "_range"]
    so_far = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*part).agg(F.sum("_size").alias("_sum")).select(
        F.col("_source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(so_far), F.lit(0)).alias("_ahead")
    )
    inside = Window.partitionBy(*part).orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    d = d.join(sums, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("_ahead") - F.col("_inside")
    d = d.withColumn("_epochs", epochs).withColumn("_part", F.greatest(F.lit(0), F.least(rest, F.col("_size"))).cast("long"))
    return d.drop("_range", "_s", "_r", "_ahead", "_inside", "n_docs")


def mix_documents(
    df: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id",
    weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 42,
) -> DataFrame:
    """id, size (words), source_size, target and taken of every row.

    Null and empty texts have size 0 and are taken 0 times; a null source is a source
    of its own; repeated rows count each.
    """
    sized = _sized(df.select(F.col(id_col).alias("_id"), F.col(source).alias("_source"), F.col(text).alias("_text")), seed)
    out = _mixed(stored(sized.drop("_text"), "mix-sizes"), weights, max_epochs)
    return out.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_epochs") * F.col("_size") + F.col("_part")).alias("taken"),
    )


def _sized(named: DataFrame, seed: int) -> DataFrame:
    """Adds _size and _key to rows with _id and _text."""
    digest = F.md5(F.coalesce("_text", F.lit("")).cast("binary"))
    return named.withColumn("_size", word_count(F.col("_text"))).withColumn("_key", _order([F.col("_id"), digest], seed))


def mixed_rows(
    df: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id",
    weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 42,
) -> DataFrame:
    """The mix as whole documents, with the columns of ``df``.

    A document taken n times its size is there n times; the document that a budget cuts is
    there if the cut leaves it at least half, and so are rows of the same id and text.
    Null texts and texts without words are not taken; a null source is a source of its own, the last in order; an
    empty table gives no rows.  The cut of each source is one key in its
    random order, so the texts are only scanned: keys of few bytes are shuffled.
    """
    keep = df.columns
    named = df.select(
        F.struct(*[F.col(c) for c in keep]).alias("_row"),
        F.col(id_col).alias("_id"), F.col(source).alias("_source"), F.col(text).alias("_text"),
    )
    mixed = _mixed(stored(_sized(named.drop("_row"), seed).drop("_text"), "mix-sizes"), weights, max_epochs)
    last = F.max(F.when((F.col("_size") > 0) & (F.col("_part") * 2 >= F.col("_size")), F.col("_key")))
    cuts = mixed.groupBy(F.col("_source").alias("_c")).agg(F.max("_epochs").alias("_epochs"), last.alias("_last"))
    cuts = stored(cuts, "mix-cuts")
    out = _sized(named, seed).drop("_text").filter("_size > 0")
    out = out.join(cuts, F.col("_source").eqNullSafe(F.col("_c")))
    times = F.col("_epochs") + F.coalesce(F.col("_key") <= F.col("_last"), F.lit(False)).cast("long")
    out = out.withColumn("_times", times).filter("_times > 0")
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select("_row.*")
