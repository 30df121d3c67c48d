"""File names, object keys, label texts and call codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that decide a label's class; the first class wins.
LABEL_CLASSES = (
    (0, ("call", "cll", "cal")),
    (1, ("buzz",)),
    (2, ("whistle",)),
)

# Fixed value: segment keys of a live stream folder.
HLS_KEY = r"rpi_(\w+)/hls/(\d+)/live(\d+)\.ts"

AUDIO_EXTENSIONS = r"(?i)\.(wav|flac)$"


def last_segment(path: Column) -> Column:
    """Text after the last slash."""
    return F.substring_index(path, "/", -1)


def base_name(path: Column) -> Column:
    """File name without folder and without its extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def is_audio(key: Column) -> Column:
    """Audio file with exactly one dot in its key."""
    dots = F.length(key) - F.length(F.replace(key, F.lit("."), F.lit("")))
    return key.rlike(AUDIO_EXTENSIONS) & (dots == 1)


def safe_name(name: Column) -> Column:
    return F.translate(name, ".:/", "___")


def recording_ts(file: Column) -> Column:
    """Start time in names like ``node_MM_DD_YYYY_HH_MM_SS_``; NULL otherwise."""
    part = F.split(last_segment(file), "_")

    def at(i: int) -> Column:
        return F.try_element_at(part, F.lit(i))

    text = F.concat_ws(" ", F.concat_ws("-", at(4), at(2), at(3)), F.concat_ws(":", at(5), at(6), at(7)))
    return F.try_to_timestamp(text, F.lit("yyyy-M-d H:m:s"))


def hls_node(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, HLS_KEY, 1), F.lit(""))


def hls_unix(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, HLS_KEY, 2), F.lit("")).cast("long")


def hls_folder_ts(key: Column) -> Column:
    return F.timestamp_seconds(hls_unix(key))


def hls_seq(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, HLS_KEY, 3), F.lit("")).cast("int")


def pad4(seq: Column) -> Column:
    """Sequence number padded to four digits; longer numbers keep all digits."""
    text = seq.cast("string")
    return F.when(F.length(text) >= 4, text).otherwise(F.lpad(text, 4, "0"))


def clip_name(base: Column, start_s: Column, call: Column, ext: Column) -> Column:
    return F.format_string("%s-%.3f-secs-%s.%s", base, start_s.cast("double"), call, ext)


def label_class(text: Column) -> Column:
    """Class number of a free-text label, NULL when unknown."""
    squeezed = F.replace(F.trim(text), F.lit(" "), F.lit(""))
    out = None
    for number, words in LABEL_CLASSES:
        hit = None
        for word in words:
            c = squeezed.contains(word)
            hit = c if hit is None else hit | c
        out = F.when(hit, number) if out is None else out.when(hit, number)
    return out.cast("int")


def is_call_code(code: Column) -> Column:
    return code.startswith("C_")


def contour(code: Column) -> Column:
    """Contour letters at the end of a call code."""
    return F.substring_index(code, "_", -1)


def catalog_id(name: Column) -> Column:
    """``FO-S01.mp3`` gives ``S01``."""
    return F.try_element_at(F.split(F.substring_index(name, ".", 1), "-"), F.lit(2))


def class_from_name(name: Column) -> Column:
    """Class number in names like ``FO-S01``; NULL when there is none."""
    return F.nullif(F.regexp_extract(name, r"FO-S(\d+)", 1), F.lit("")).cast("int")


def media_url(base_url: str, folder: str, name: Column, ext: str) -> Column:
    return F.concat(F.lit(f"{base_url.rstrip('/')}/{folder}/"), name, F.lit(f".{ext}"))


def product_time(path: Column) -> Column:
    """Seconds in product names ``..._at_<secs>_...``."""
    return F.regexp_extract(path, r"_at_([0-9.]+)_", 1).try_cast("double")


def product_file(path: Column, labeled: bool = False) -> Column:
    """Recording part of a product name: the tokens before ``_at_`` without the
    running number (and without the class when ``labeled``)."""
    name = last_segment(F.substring_index(path, "_at_", 1))
    skip = 2 if labeled else 1
    return F.regexp_replace(name, r"^([^_]*_){%d}" % skip, "")
