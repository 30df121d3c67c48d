"""Clip tags and the comment text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Catalog field to container tag, per file type.
TAGS = {
    "wav": {
        "data_region": "TIT2",
        "data_node": "TALB",
        "annotator": "TRCK",
        "sample_datetime": "TDRC",
        "call_type": "TCOM",
        "comments": "COMM::XXX",
    },
    "flac": {
        "data_region": "title",
        "data_node": "album",
        "annotator": "tracknum",
        "sample_datetime": "year",
        "call_type": "genre",
        "comments": "comments",
    },
}


def annotation_tags(fields: dict[str, Column], file_type: str) -> Column:
    """Tag map of a clip; empty and missing values are left out."""
    pairs = []
    for field, tag in TAGS[file_type].items():
        pairs += [F.lit(tag), fields.get(field, F.lit("")).cast("string")]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != ""))


def rename_tags(tags: Column, file_type: str) -> Column:
    """Container tags back to catalog field names; unknown tags keep theirs."""
    back = F.create_map(*[F.lit(x) for f, t in TAGS[file_type].items() for x in (t, f)])
    return F.transform_keys(tags, lambda k, v: F.coalesce(F.try_element_at(back, k), k))


COMMENT_SCHEMA = "fmin STRING, fmax STRING, S2N STRING, comments STRING"


def comment_json(fmin: Column, fmax: Column, snr: Column, comments: Column) -> Column:
    return F.to_json(
        F.struct(
            F.format_string("%.1f", fmin.cast("double")).alias("fmin"),
            F.format_string("%.1f", fmax.cast("double")).alias("fmax"),
            F.format_string("%.2f", snr.cast("double")).alias("S2N"),
            comments.alias("comments"),
        )
    )


def parse_comment(text: Column) -> Column:
    return F.from_json(text, COMMENT_SCHEMA)
