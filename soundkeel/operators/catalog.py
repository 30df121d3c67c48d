"""Annotation catalog: clips, names, tags and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tags as T
from ..functions import text as X


def clip_records(clips: DataFrame, region: str, node: str, annotator: str, ext: str = "flac") -> DataFrame:
    """Name and tags of extracted clips.

    ``clips``: file, start_s, f_lo, f_hi, snr, call_type, comments, samples.
    """
    comment = T.comment_json(F.col("f_lo"), F.col("f_hi"), F.col("snr"), F.col("comments"))
    taken = F.date_format(X.recording_ts(F.col("file")), "yyyy/MM/dd HH:mm:ss")
    fields = {
        "data_region": F.lit(region),
        "data_node": F.lit(node),
        "annotator": F.lit(annotator),
        "sample_datetime": F.coalesce(taken, F.lit("")),
        "call_type": F.col("call_type"),
        "comments": comment,
    }
    return clips.withColumns(
        {
            "clip_name": X.clip_name(X.base_name(F.col("file")), F.col("start_s"), F.col("call_type"), F.lit(ext)),
            "tags": T.annotation_tags(fields, ext),
        }
    )


def catalog_links(names: DataFrame, name: str, base_url: str, raw_url: str) -> DataFrame:
    """One row per catalog sound with its media links, in name order."""
    stem = F.substring_index(F.col(name), ".", 1)
    heading = X.catalog_id(F.col(name))
    return names.select(
        F.col(name).alias("name"),
        heading.alias("heading"),
        X.media_url(base_url, "mp3", stem, "mp3").alias("mp3"),
        X.media_url(base_url, "ogg", stem, "ogg").alias("ogg"),
        X.media_url(base_url, "spectrogram-pngs", stem, "png").alias("spectrogram"),
        X.media_url(raw_url, "spectrograms", heading, "png").alias("raw_spectrogram"),
    ).orderBy("name")


def segments(keys: DataFrame, key: str = "key") -> DataFrame:
    """Stream segment keys with node, folder time and sequence number."""
    k = F.col(key)
    return keys.withColumns(
        {
            "node": X.hls_node(k),
            "folder_ts": X.hls_folder_ts(k),
            "seq": X.hls_seq(k),
            "padded": X.pad4(X.hls_seq(k)),
        }
    ).filter(F.col("node").isNotNull())


def between_hours(segs: DataFrame, seconds_per_segment: float, start_h: float, stop_h: float) -> DataFrame:
    """Segments between two offsets in hours after their folder's time."""
    at = F.col("seq") * seconds_per_segment / 3600
    return segs.filter((at >= start_h) & (at < stop_h))
