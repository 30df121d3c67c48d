"""Quality rules whose cutoffs come from the corpus.

Every text is measured once.  Per language and source each metric has a quantile
sketch: counts by logarithmic bucket, of relative error ``(GAMMA - 1) / 2``.  Such
sketches merge by adding counts, so sums in the map tasks, in the shuffle and over
all sources of a language are the same sketch whatever the order.  A metric's cutoff
is its median plus a multiple of the distance from the lower quartile to it, so that it is set by the better half of a group
and junk up to half of the rows cannot move it.  The quantiles of a group are weighed with those of its language by its
rows, a language's with the corpus's, without a switch at any size, and no group's cutoff is far above
its language's.  The cutoffs, one row per language and source, are joined back and the texts above one of them rejected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import raw, stored

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
_NOT_CHARS = SPACE + bytes(range(0x80, 0xC0))  # white space, and UTF-8 bytes that continue a character
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_NOT_UPPER = bytes(set(range(256)) - set(range(65, 91)))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")

GAMMA = 1.05
FLOOR = 1e-3  # smaller values share the lowest bucket
PRIOR_ROWS = 100  # rows that the quantiles of the language, or of the corpus, weigh beside a group's own
SPREADS = 6.0
ABOVE = 1.5  # a group's cutoff is at most so many times its language's
MIN_WORDS, MAX_REPEAT = 50, 50  # the base rules: words at least, repeated words per cent at most

#: Metric, numerator, denominator, and the least distance of a cutoff from the median.
METRICS = (
    ("symbols", "n_symbols", "n_words", 0.25),
    ("capitals", "n_upper", "word_chars", 0.15),
    ("marks", "n_marks", "n_words", 0.3),
    ("repeats", "n_repeat_words", "n_words", 0.35),
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, first ones included."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    v = len(known)
    if v > n - 3 and v == n:
        return 0
    pair = ids[:-1] * v + ids[1:]
    if v > 2_000_000:  # keeps the triple's key within 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, count = np.unique(pair[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
    twice = count[at] > 1
    hit = np.zeros(n, bool)
    for lag in range(3):
        hit[lag : n - 2 + lag] |= twice
    return int(hit.sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, _NOT_CHARS)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(text.translate(None, _NOT_UPPER)),
        text.count(b"!") + text.count(b"?"),
    )


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _measured(text: pa.Array) -> pa.Array:
    rows = np.array([measure(t) if t else (0,) * len(COUNTS) for t in raw(text)], np.int64).reshape(-1, len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], names=list(COUNTS))


def with_counts(df: DataFrame, text: str, name: str = "_m") -> DataFrame:
    return df.withColumn(name, _measured(F.col(text)))


def _value(num: str, den: str, m: str) -> Column:
    return F.coalesce(F.col(f"{m}.{num}") / F.nullif(F.col(f"{m}.{den}"), F.lit(0)), F.lit(0.0))


def base_failed(m: str = "_m") -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (F.col(f"{m}.n_repeat_words") * 100 > F.col(f"{m}.n_words") * MAX_REPEAT)


def sketches(counted: DataFrame, m: str = "_m") -> DataFrame:
    """Rows (_lang, _source, metric, bucket, n) over all texts."""
    values = F.array(*[F.struct(F.lit(k).alias("metric"), _value(a, b, m).alias("v")) for k, a, b, _ in METRICS])
    flat = counted.select("_lang", "_source", F.explode(values).alias("x"))
    low = math.ceil(math.log(FLOOR) / math.log(GAMMA))
    bucket = F.when(F.col("x.v") <= FLOOR, F.lit(low)).otherwise(F.ceil(F.log("x.v") / math.log(GAMMA)).cast("int"))
    return flat.groupBy("_lang", "_source", F.col("x.metric").alias("metric"), bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Rows, lower quartile and median of every group's metrics; a window sees one row per bucket."""
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "metric")
    merged = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("rows", F.sum("n").over(w))
    low = math.ceil(math.log(FLOOR) / math.log(GAMMA))
    at = F.when(F.col("bucket") <= low, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")))

    def quantile(percent: int) -> Column:
        return F.min(F.when(F.col("upto") * 100 >= F.col("rows") * percent, at))

    return merged.groupBy(*by, "metric").agg(
        F.max("rows").alias("rows"), quantile(25).alias("q1"), quantile(50).alias("q2")
    )


def cutoffs(counted: DataFrame, m: str = "_m") -> DataFrame:
    """One row per language and source: a cutoff for each metric."""
    sketch = stored(sketches(counted, m), "rules-sketch")
    own = _quartiles(sketch, ["_lang", "_source"])
    lang = _quartiles(sketch, ["_lang"]).select("_lang", "metric", *[F.col(c).alias(f"l_{c}") for c in ("rows", "q1", "q2")])
    every = _quartiles(sketch, []).select("metric", *[F.col(c).alias(f"c_{c}") for c in ("q1", "q2")])
    lang = lang.withColumnsRenamed({"_lang": "l_lang", "metric": "l_metric"})
    every = every.withColumnRenamed("metric", "c_metric")
    joined = own.join(lang, F.col("_lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric")))
    joined = joined.join(every, F.col("metric") == F.col("c_metric"))

    def weighed(rows: str, mine: Column, prior: Column) -> Column:
        return (F.col(rows) * mine + PRIOR_ROWS * prior) / (F.col(rows) + PRIOR_ROWS)

    least = F.create_map(*[x for k, _, _, d in METRICS for x in (F.lit(k), F.lit(d))])[F.col("metric")]
    for q in ("q1", "q2"):
        joined = joined.withColumn(f"l_{q}", weighed("l_rows", F.col(f"l_{q}"), F.col(f"c_{q}")))
        joined = joined.withColumn(q, weighed("rows", F.col(q), F.col(f"l_{q}")))

    def cut(low: str, mid: str) -> Column:
        return F.col(mid) + F.greatest((F.col(mid) - F.col(low)) * SPREADS, least)

    bound = F.least(cut("q1", "q2"), cut("l_q1", "l_q2") * ABOVE)
    wide = joined.select("_lang", "_source", "metric", bound.alias("cut")).groupBy("_lang", "_source")
    wide = wide.agg(*[F.max(F.when(F.col("metric") == k, F.col("cut"))).alias(f"cut_{k}") for k, *_ in METRICS])
    return stored(wide.withColumnsRenamed({"_lang": "_c_lang", "_source": "_c_source"}), "rules-cutoffs")


def judged(counted: DataFrame, cuts: DataFrame, m: str = "_m") -> DataFrame:
    """Adds base_failed and kept to rows with _lang, _source and counts."""
    same = F.col("_lang").eqNullSafe(F.col("_c_lang")) & F.col("_source").eqNullSafe(F.col("_c_source"))
    over = F.lit(False)
    for k, a, b, _ in METRICS:
        over = over | (_value(a, b, m) > F.col(f"cut_{k}"))
    out = counted.join(cuts, same, "left").withColumn("base_failed", base_failed(m))
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(over, F.lit(False)))
    return out.drop("_c_lang", "_c_source", *[f"cut_{k}" for k, *_ in METRICS])


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """id, the counts of every row, base_failed and kept.

    Null texts count as empty: no words, so the base rule rejects them.  A null
    language or source is a group of its own.  Repeated rows are judged each.
    """
    docs = df.select(
        F.col(id_col).alias("_id"), F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.col(text).alias("_text")
    )
    docs = stored(with_counts(docs, "_text").drop("_text"), "rules-counts")
    out = judged(docs, cutoffs(docs))
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_m.{c}").alias(c) for c in COUNTS], "base_failed", "kept")


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows that no rule rejects, with the columns of ``df``, as ``judge`` keeps them.

    Null and empty texts, and texts without words, go; a null language or source is a group of its own; repeated rows are
    judged alike and stay or go together; an empty table gives none.  Texts are measured for the sketches and once more for the filter, so that no
    text is shuffled or stored: the cutoffs are joined to the scan.
    """
    keep = df.columns
    named = df.select(
        F.struct(*[F.col(c) for c in keep]).alias("_row"),
        F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.col(text).alias("_text"),
    )
    counted = stored(with_counts(named.drop("_row"), "_text").drop("_text"), "rules-counts")
    cuts = cutoffs(counted)
    again = with_counts(named, "_text").drop("_text")
    return judged(again, cuts).filter("kept").select("_row.*")
