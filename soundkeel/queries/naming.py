"""File names, keys, tags and catalog tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags as T
from ..functions import text as X
from ..functions import times as TM
from ..operators import catalog as C
from .common import levels, r, table

BASE_URL = "http://media.example.org/catalog"
RAW_URL = "http://media.example.org/raw"


def _keys(spark, sf):
    """Segment keys of a node per event type, one folder a day."""
    ev = levels(spark, sf)
    folder = F.floor(F.col("t") / 86_400_000_000) * 86_400
    return ev.select(
        "event_id",
        F.concat(F.lit("rpi_"), F.regexp_replace("event_type", "e", "_"), F.lit("/hls/"), folder.cast("string"),
                 F.lit("/live"), (F.col("event_id") % 8640).cast("string"), F.lit(".ts")).alias("key"),
    )


_KEYS = """k AS (SELECT event_id, replace(event_type, 'e', '_') AS node, (epoch_us(ts) // 86400000000) * 86400 AS folder, event_id % 8640 AS seq FROM events)"""


def hls_parts(spark, sf):
    out = C.segments(_keys(spark, sf))
    return out.select("event_id", "node", F.unix_seconds("folder_ts").alias("folder"), "seq", "padded")


def hls_between_hours(spark, sf):
    out = C.between_hours(C.segments(_keys(spark, sf)), 10.0, 1.0, 2.5)
    return out.select("event_id", "node", "seq")


def hls_order(spark, sf):
    """Ordered sequence numbers per node and folder; a folder holds a day."""
    segs = C.segments(_keys(spark, sf))
    return segs.groupBy("node", F.unix_seconds("folder_ts").alias("folder")).agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_set("seq")), X.pad4)).alias("seqs")
    )


def recording_times(spark, sf):
    """Names built from event times, parsed back; sample 1000 at 44.1 kHz."""
    ts = F.timestamp_micros(F.col("t"))
    name = F.concat(F.lit("/data/OS_"), F.date_format(ts, "MM_dd_yyyy_HH_mm_ss"), F.lit("_.wav"))
    named = levels(spark, sf).select("event_id", name.alias("file"))
    at = X.recording_ts(F.col("file"))
    return named.select(
        "event_id",
        X.base_name(F.col("file")).alias("base"),
        F.unix_seconds(at).alias("taken"),
        F.unix_micros(TM.frame_ts(at, F.lit(1000), 44100)).alias("frame_us"),
    )


def clip_names(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey",
        X.clip_name(X.safe_name(F.col("p_name")), F.col("p_retailprice") / 7, F.lower("p_type"), F.lit("flac")).alias("clip"),
    )


def catalog_links(spark, sf):
    p = table(spark, sf, "part").select(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("-S"), F.col("p_partkey").cast("string"), F.lit(".mp3")).alias("name")
    )
    return C.catalog_links(p, "name", BASE_URL, RAW_URL)


def class_names(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("FO-S"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(".flac")).alias("name")
    )
    return p.groupBy(X.class_from_name(F.col("name")).alias("cls"), X.catalog_id(F.col("name")).alias("id")).agg(
        F.count(F.lit(1)).alias("n")
    )


def page_names(spark, sf):
    """Last part, extension and sanitised name of page addresses."""
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", X.last_segment(u).alias("last"), X.extension(u).alias("ext"), X.safe_name(u).alias("safe"),
        X.is_audio(F.concat(F.col("page_id").cast("string"), F.lit(".WAV"))).alias("audio"),
    )


def product_order(spark, sf):
    """Product names sorted by time in file, then by file."""
    li = table(spark, sf, "orders")
    name = F.concat_ws(
        "", F.lit("/p/"), F.col("o_orderkey").cast("string"), F.lit("_Track_"), F.col("o_custkey").cast("string"), F.lit("_at_"),
        F.format_string("%.2f", F.col("o_totalprice")), F.lit("_psd.pkl"),
    )
    p = li.select("o_orderkey", name.alias("path"))
    return p.select("o_orderkey", X.product_time(F.col("path")).alias("t"), X.product_file(F.col("path")).alias("file")).orderBy("t", "file")


def clip_tags(spark, sf):
    """Tags of a clip per part, listed, renamed back, with the parsed comment."""
    p = table(spark, sf, "part")
    comment = T.comment_json(F.col("p_size") * 10, F.col("p_size") * 25.5, F.col("p_retailprice"), F.col("p_brand"))
    tags = T.annotation_tags(
        {
            "data_region": F.lit("Salish Sea"),
            "data_node": F.col("p_brand"),
            "annotator": F.when(F.col("p_size") > 25, "A").otherwise(""),
            "sample_datetime": F.lit("2021/10/03 19:34:00"),
            "call_type": F.col("p_type"),
            "comments": comment,
        },
        "flac",
    )
    back = T.rename_tags(tags, "flac")
    note = T.parse_comment(F.try_element_at(back, F.lit("comments")))
    rows = p.select("p_partkey", F.map_concat(F.map_filter(back, lambda k, v: k != "comments"), F.create_map(
        F.lit("fmin"), note["fmin"], F.lit("fmax"), note["fmax"], F.lit("S2N"), note["S2N"])).alias("m"))
    return rows.select("p_partkey", F.explode("m").alias("field", "value"))


def hms_seconds(spark, sf):
    """Seconds from h, m, s; sample index; and back."""
    ev = levels(spark, sf)
    h, m = F.col("event_id") % 24, F.col("event_id") % 60
    s = TM.hms_to_s(h, m, F.col("value") / 10)
    idx = TM.to_idx(s, 44100)
    return ev.select("event_id", r(s).alias("s"), idx.alias("idx"), r(TM.to_s(idx, 44100), 9).alias("s_back"))


def call_codes(spark, sf):
    code = F.concat(F.when(F.col("value") > 20, F.lit("C_")).otherwise(F.lit("_")), F.substring("event_type", 1, 2))
    ev = levels(spark, sf).select("event_type", code.alias("code"))
    return ev.groupBy(X.is_call_code(F.col("code")).alias("is_call"), X.contour(F.col("code")).alias("contour")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "hls_parts": (hls_parts, f"""WITH {_KEYS} SELECT event_id, node, folder, seq, lpad(seq::VARCHAR, 4, '0') AS padded FROM k"""),
    "hls_between_hours": (hls_between_hours, f"WITH {_KEYS} SELECT event_id, node, seq FROM k WHERE seq * 10.0 / 3600 >= 1 AND seq * 10.0 / 3600 < 2.5"),
    "hls_order": (hls_order, f"""WITH {_KEYS} SELECT node, folder, string_agg(DISTINCT lpad(seq::VARCHAR, 4, '0'), ',' ORDER BY lpad(seq::VARCHAR, 4, '0')) AS seqs FROM k GROUP BY 1, 2"""),
    "recording_times": (recording_times, """SELECT event_id, 'OS_' || strftime(ts, '%m_%d_%Y_%H_%M_%S') || '_' AS base, epoch_us(ts) // 1000000 AS taken,
(epoch_us(ts) // 1000000) * 1000000 + round(1000 * 1000000 / 44100.0::DOUBLE)::BIGINT AS frame_us FROM events"""),
    "clip_names": (clip_names, """SELECT p_partkey, printf('%s-%.3f-secs-%s.flac', translate(p_name, '.:/', '___'), p_retailprice / 7, lower(p_type)) AS clip FROM part"""),
    "catalog_links": (catalog_links, f"""WITH p AS (SELECT replace(p_name, ' ', '') || '-S' || p_partkey AS s, 'S' || p_partkey AS heading FROM part)
SELECT s || '.mp3' AS name, heading, '{BASE_URL}/mp3/' || s || '.mp3' AS mp3, '{BASE_URL}/ogg/' || s || '.ogg' AS ogg,
'{BASE_URL}/spectrogram-pngs/' || s || '.png' AS spectrogram, '{RAW_URL}/spectrograms/' || heading || '.png' AS raw_spectrogram FROM p"""),
    "class_names": (class_names, "SELECT p_size AS cls, 'S' || lpad(p_size::VARCHAR, 2, '0') AS id, count(*) AS n FROM part GROUP BY 1, 2"),
    "page_names": (page_names, """SELECT page_id, split_part(url, '/', -1) AS last, lower(regexp_extract(url, '\\.([^./]*)$', 1)) AS ext, translate(url, '.:/', '___') AS safe, true AS audio FROM pages"""),
    "product_order": (product_order, """SELECT o_orderkey, printf('%.2f', o_totalprice)::DOUBLE AS t, 'Track_' || o_custkey AS file FROM orders"""),
    "clip_tags": (clip_tags, """SELECT p_partkey, f.field, f.value FROM (SELECT p_partkey, unnest([
{'field': 'data_region', 'value': 'Salish Sea'}, {'field': 'data_node', 'value': p_brand}, {'field': 'annotator', 'value': CASE WHEN p_size > 25 THEN 'A' END},
{'field': 'sample_datetime', 'value': '2021/10/03 19:34:00'}, {'field': 'call_type', 'value': p_type},
{'field': 'fmin', 'value': printf('%.1f', p_size * 10.0::DOUBLE)}, {'field': 'fmax', 'value': printf('%.1f', p_size * 25.5::DOUBLE)},
{'field': 'S2N', 'value': printf('%.2f', p_retailprice)}]) AS f FROM part) WHERE f.value IS NOT NULL"""),
    "hms_seconds": (hms_seconds, """WITH a AS (SELECT event_id, (event_id % 24) * 3600 + (event_id % 60) * 60 + value / 10 AS s FROM events)
SELECT event_id, round(s, 6) AS s, trunc(s * 44100)::BIGINT AS idx, round(trunc(s * 44100)::BIGINT / 44100, 9) AS s_back FROM a"""),
    "call_codes": (call_codes, """WITH a AS (SELECT value > 20 AS is_call, substr(event_type, 1, 2) AS contour FROM events) SELECT is_call, contour, count(*) AS n FROM a GROUP BY 1, 2"""),
}
