"""Table access and the stand-ins that turn the given tables into recordings,
labels, positions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import epoch_us
from ..session import pin_utc

DAY0_US = 1704067200 * 1_000_000  # 2024-01-01, the first day of the events
DAY_US = 86_400 * 1_000_000
VECTORS_PER_FILE = 256  # a recording is this many vectors of 64 samples
CHUNK = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded, with negative zero removed."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def draw_sql(ids: str, seed) -> str:
    """SQL of a repeatable draw (functions.draws.unit)."""
    return f"(('0x' || substr(md5({ids} || '|{seed}'), 1, 13))::BIGINT / {16**13}.0::DOUBLE)"


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a level per recorder and time."""
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", "event_type", "value", epoch_us(F.col("ts")).alias("t")
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as interval labels: value times ten minutes, in microseconds since day 0."""
    ev = levels(spark, sf_dir)
    start = F.col("t") - DAY0_US
    return ev.select(
        "user_id", "event_id", "event_type", start.alias("start"),
        (start + (F.col("value") * 600).cast("long") * 1_000_000).alias("end"),
    )


LABELS_SQL = f"""lab AS (
  SELECT user_id, event_id, event_type, epoch_us(ts) - {DAY0_US} AS s,
         epoch_us(ts) - {DAY0_US} + trunc(value * 600)::BIGINT * 1000000 AS e
  FROM events)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as consecutive chunks of 64 samples of a recording."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(v / VECTORS_PER_FILE).cast("string").alias("file"),
        (v % VECTORS_PER_FILE).alias("chunk_no"),
        ((v % VECTORS_PER_FILE) * CHUNK).alias("start_sample"),
        F.col("embedding").alias("samples"),
    )


SAMPLES_SQL = """smp AS (
  SELECT (vec_id // 256)::VARCHAR AS file, (vec_id % 256) * 64 + i - 1 AS idx, embedding[i]::DOUBLE AS x
  FROM embeddings, range(1, 65) t(i))"""


def spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as time slices of spectrograms of 50 slices."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(v / 50).cast("long").alias("clip_id"),
        (v % 50).alias("slice"),
        F.transform("embedding", lambda x: x.cast("double")).alias("x"),
    )


CELLS_SQL = """cell AS (
  SELECT vec_id // 50 AS clip_id, vec_id % 50 AS slice, i - 1 AS band, embedding[i]::DOUBLE AS v
  FROM embeddings, range(1, 65) t(i))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document length as a score, quality as truth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    truth = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    yhat = F.col("n_chars") / (F.col("n_chars") + 1000)
    return docs.join(truth, "doc_id").select("doc_id", "y", yhat.alias("yhat"))


SCORES_SQL = """sc AS (
  SELECT doc_id, quality AS y, n_chars / (n_chars + 1000) AS yhat
  FROM documents JOIN labels USING (doc_id))"""


def hops(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Events as one long score series; truth where a full window of n starts."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    total = ev.agg(F.count(F.lit(1))).scalar()
    return ev.select(
        F.lit("all").alias("file"),
        F.col("event_id").alias("hop"),
        (F.col("value") / (F.col("value") + 50)).alias("yhat"),
        F.when(F.col("event_id") < total - n, F.col("event_type") == "error").alias("truth"),
    )


HOPS_SQL = """hop AS (
  SELECT event_id AS hop, value / (value + 50) AS yhat,
         least(50, greatest(1, floor(value / (value + 50) * 50)::INT + 1)) AS bin,
         CASE WHEN event_id < (SELECT count(*) FROM events) - {n} THEN event_type = 'error' END AS truth
  FROM events)"""
