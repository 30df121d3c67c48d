"""Label files, reports, feeds and listings as DataFrames with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_audio
from ..operators.catalog import segments
from .files import relative_to

EXPERT_LABELS = "wav_filename STRING, start_time_s DOUBLE, duration_s DOUBLE, location STRING, date STRING, master STRING"
LABEL_TRACK = "start STRING, end STRING, label STRING"
SELECTIONS = (
    "selection INT, view STRING, channel INT, begin_s DOUBLE, end_s DOUBLE, f_lo DOUBLE, f_hi DOUBLE, "
    "agg_entropy DOUBLE, peak_freq DOUBLE, peak_power DOUBLE, snr DOUBLE, call_type STRING"
)
ANNOTATION_LOG = "file STRING, t_lo LONG, f_lo INT, t_hi LONG, f_hi INT, code STRING"
RANGE_REPORT = (
    "mmsi LONG, time_of_day STRING, range_m INT, bearing_deg INT, sog DOUBLE, nav_status STRING, "
    "lane_range_m INT, lane_minutes INT"
)
SHIP_SPECS = (
    "id INT, mmsi LONG, shipname STRING, shiptype STRING, yearbuild INT, shiplength INT, shipwidth INT, "
    "deadweight INT, maxspeed DOUBLE, avespeed DOUBLE, flag STRING, callsign STRING, imo INT, draught INT, "
    "draughtmax INT, photo STRING"
)


def list_audio(spark: SparkSession, path: str) -> DataFrame:
    """Audio files under a folder or object-store prefix, by their name below it; extensions in any case.

    Only listing columns are selected, so no content is read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{[wW][aA][vV],[fF][lL][aA][cC]}")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length", "modificationTime")
    )
    return files.withColumn("file", relative_to(F.col("path"), path)).filter(is_audio(F.col("file"))).orderBy("file")


def list_keys(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    )
    return files.select(F.col("path").alias("key"))


def read_labels(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Expert labels with a positive duration."""
    raw = spark.read.csv(path, header=True, sep=sep, schema=EXPERT_LABELS, enforceSchema=True)
    return raw.filter("duration_s > 0")


def read_label_track(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated start, end and text; frequency lines begin with a backslash."""
    raw = spark.read.csv(path, sep="\t", schema=LABEL_TRACK, quote="", escape="")
    return raw.filter(~F.col("start").startswith("\\")).select(
        F.col("start").cast("double").alias("start_s"), F.col("end").cast("double").alias("end_s"), "label"
    )


def read_selection_table(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", header=True, schema=SELECTIONS, enforceSchema=True)
    return raw.select(
        "begin_s", "end_s", "f_lo", "f_hi", "agg_entropy", "peak_freq", "peak_power", "snr", F.trim("call_type").alias("call_type")
    )


def read_annotation_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=ANNOTATION_LOG)


def read_ais(
    spark: SparkSession, path: str | None = None, stream: bool = False, source: str = "text", **options: str
) -> DataFrame:
    """Sentence lines with the time they were read, as a batch or a stream.

    ``source`` is any Spark source with a ``value`` column (text, kafka, socket);
    ``options`` are its options.
    """
    reader = (spark.readStream if stream else spark.read).format(source).options(**options)
    raw = reader.load(path) if path else reader.load()
    return raw.select(F.col("value").cast("string").alias("line"), F.current_timestamp().alias("recv_ts"))


def read_range_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=RANGE_REPORT)


def read_ship_specs(spark: SparkSession, source: str, table: str = "ship_specs", **options: str) -> DataFrame:
    """Ship specifications from a parquet path or a JDBC address."""
    if source.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=source, dbtable=table, **options).load()
    return spark.read.schema(SHIP_SPECS).parquet(source)


def read_segments_inventory(spark: SparkSession, path: str) -> DataFrame:
    return segments(list_keys(spark, path, "*.ts"))


def read_photo_index(spark: SparkSession, path: str) -> DataFrame:
    return list_keys(spark, path)
