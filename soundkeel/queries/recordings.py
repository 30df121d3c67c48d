"""Recordings written to folders and read back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracks as T
from ..operators.spectra import long_form, packed_form
from ..session import shared_dir
from ..sources import sinks, tables, wav
from ..sources.files import relative_to
from .common import CELLS_SQL, r, spectrogram, table
from .vessels import _full_specs

PER_FILE = 50  # vectors of a recording
RATE = 8000
OTHERS = [".flac", ".v2.wav", ".txt", ".wav.part", ".FLAC"]
FILTERED = ["site_0/rec_0.WAV", "site_1/rec_0.wav"]


def _written(spark, sf, where: str = "true", path: str | None = None) -> str:
    """Vectors as recordings in folders that share base names: mono and stereo, 16 bits and float."""
    path = path or shared_dir(spark, "recordings")
    v, x = F.col("vec_id"), F.col("embedding").cast("array<float>")
    k = F.floor(v / PER_FILE)
    rows = table(spark, sf, "embeddings").select(
        F.concat(F.lit("site_"), k % 3, F.lit("/rec_"), F.floor(k / 3), F.when(k % 5 == 0, ".WAV").otherwise(".wav")).alias("file"),
        F.lit(RATE).alias("sample_rate"), F.when(k % 4 < 2, "PCM_16").otherwise("FLOAT").alias("subtype"), (v % PER_FILE).alias("chunk_no"),
        F.when(k % 2 == 0, F.array(x)).otherwise(F.array(x, F.transform(x, lambda a: (-a / 2).cast("float")))).alias("ch"),
    )
    rows = rows.filter(where)
    lengths = rows.groupBy("file").agg(F.sum(F.size(F.get("ch", F.lit(0)))).alias("n_samples"))
    wav.write_recordings(rows.join(lengths, "file"), path).write.mode("append").parquet(f"{path}-list")
    return path


def audio_listing(spark, sf):
    """Recordings by their name below the folder, with their bytes; other files and names with several dots are passed over."""
    path, n = _written(spark, sf), F.col("r_regionkey")
    other = F.element_at(F.array(*[F.lit(x) for x in OTHERS]), (n % len(OTHERS) + 1).cast("int"))
    rows = table(spark, sf, "region").select(F.concat(F.lit("site_0/other_"), n, other).alias("key"), F.col("r_name").alias("content"))
    sinks.write_objects(rows, path).write.parquet(f"{path}-others")
    return tables.list_audio(spark, path).select("file", F.col("length").alias("n_bytes"))


def audio_headers(spark, sf):
    """Headers of the recordings of a folder that is named by its URI."""
    path = _written(spark, sf)
    uri = path if ":/" in path else f"file://{path}"
    return wav.read_headers(tables.list_audio(spark, uri), uri)


def wav_filtered(spark, sf):
    """Chunks of some recordings and a stretch of each, by filters that reach the reader."""
    c = wav.select_wav(spark, _written(spark, sf), FILTERED, 500, 2500, 250)
    own = F.slice(F.get("ch", F.lit(0)), F.lit(1), F.col("n_own"))
    return c.select("file", "chunk_no", "start_sample", "n_own", r(F.aggregate(own, F.lit(0.0), lambda s, v: s + v * v), 5).alias("energy"))


def wav_chunks(spark, sf):
    """Whole recordings through the chunk source: lengths and sums of each channel."""
    return _summed(wav.read_wav(spark, _written(spark, sf), 1000, tail=10))


def wav_stream(spark, sf):
    """The same recordings, added to a folder in two steps and followed by a stream."""
    path, out, state = shared_dir(spark, "growing"), shared_dir(spark, "growing-out"), shared_dir(spark, "growing-state")
    for where in ("file LIKE 'site_0/%'", "file NOT LIKE 'site_0/%'"):
        _written(spark, sf, where, path)
        stream = wav.follow_wav(spark, path, 1000, tail=10)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    return _summed(spark.read.schema(wav.SCHEMA).parquet(out))


def _summed(c):
    def total(k: int):
        own = F.slice(F.get("ch", F.lit(k)), F.lit(1), F.col("n_own"))
        return F.sum(F.aggregate(own, F.lit(0.0), lambda s, v: s + v * v))

    out = c.groupBy("file", "sample_rate", "channels", "subtype").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("n_own").alias("n_samples"), total(0).alias("a"), total(1).alias("b")
    )
    return out.withColumns({"a": r("a", 5), "b": r("b", 5)})


def wav_segments(spark, sf):
    """Stretches of recordings, some over the end, read by seeking."""
    path = _written(spark, sf)
    files = tables.list_audio(spark, path).select("file")
    wanted = files.select("file", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    wanted = wanted.select("file", (F.col("i") * 0.0925).alias("start_s"), (F.col("i") * 100 + 7).cast("long").alias("n"))
    got = wav.read_segments(wanted, path)
    first = F.get("ch", F.lit(0))
    return got.select(
        "file", r("start_s", 4).alias("start_s"), "n", "sample_rate", F.size("ch").alias("channels"), F.size(first).alias("n_read"),
        r(F.aggregate(first, F.lit(0.0), lambda s, v: s + v * v), 5).alias("energy"),
    )


def segment_inventory(spark, sf):
    """Segment objects, one for each supplier, written below a folder and listed; other files are passed over."""
    path = shared_dir(spark, "segments")
    e = F.col("s_suppkey")
    other = F.when(e % 5 == 0, "/live.m3u8").otherwise(F.concat(F.lit("/live"), e, F.lit(".ts")))
    key = F.concat(F.lit("rpi_node_"), e % 3, F.lit("/hls/"), 1_600_000_000 + F.floor(e / 10) * 21_600, other)
    rows = table(spark, sf, "supplier").groupBy(key.alias("key")).agg(F.min(F.col("s_name")).alias("content"))
    sinks.write_objects(rows, path).write.parquet(f"{path}-list")
    return tables.read_segments_inventory(spark, path).select("node", F.unix_seconds("folder_ts").alias("folder"), "seq")


def photo_index(spark, sf):
    """Photo keys listed from a folder, and the photo of each ship."""
    path = shared_dir(spark, "photos")
    ships = table(spark, sf, "customer").select(F.col("c_custkey").alias("mmsi"))
    key = F.concat(F.lit("album_"), F.char(97 + F.col("s_suppkey") % 7), F.lit("/ship_"), F.col("s_suppkey"), F.lit(".jpg"))
    photos = table(spark, sf, "supplier").select(key.alias("key"), F.col("s_name").alias("content"))
    sinks.write_objects(photos, path).write.parquet(f"{path}-list")
    index = tables.read_photo_index(spark, path).select(relative_to(F.col("key"), path).alias("key"))
    return T.photo_for(ships, index)


def spec_table(spark, sf):
    """Specification rows written and read back with their fixed columns."""
    path = shared_dir(spark, "specs")
    _full_specs(spark, sf).select(*[F.col(c).cast(t) for c, t in (x.split() for x in tables.SHIP_SPECS.split(", "))]).write.parquet(path)
    return tables.read_ship_specs(spark, path).select("id", "mmsi", "shiptype", "yearbuild", "maxspeed", "imo", "photo")


def spectrogram_sink(spark, sf):
    """Arrays written to the folder that names their parameters, and read back."""
    spec = packed_form(long_form(spectrogram(spark, sf)), ["clip_id", "slice"])
    path = shared_dir(spark, "spectrograms")
    where = sinks.write_spectrograms(spec, path, n_bands=64, n_slices=50, f_low=400, f_high=10000, delta_t=3, log=True)
    got = spark.read.parquet(where).withColumn("folder", F.lit(where.rsplit("/", 1)[1]))
    return got.groupBy("clip_id", "folder").agg(
        F.count(F.lit(1)).alias("n_slices"), r(F.sum(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)), 5).alias("energy")
    )


_REC = f"""e AS (SELECT vec_id // {PER_FILE} AS k, vec_id, embedding FROM embeddings),
f AS (SELECT k, 'site_' || (k % 3) || '/rec_' || (k // 3) || CASE WHEN k % 5 = 0 THEN '.WAV' ELSE '.wav' END AS file, count(*) * 64 AS n_samples,
  CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END AS channels, CASE WHEN k % 4 < 2 THEN 'PCM_16' ELSE 'FLOAT' END AS subtype FROM e GROUP BY 1),
raw AS (SELECT k, (vec_id % {PER_FILE}) * 64 + i - 1 AS idx, embedding[i]::FLOAT AS x0, (-(embedding[i]::DOUBLE) / 2)::FLOAT AS x1 FROM e, range(1, 65) t(i)),
x AS (SELECT file, idx, CASE WHEN subtype = 'PCM_16' THEN round_even((x0 * 32767::FLOAT)::DOUBLE, 0) / 32768 ELSE x0::DOUBLE END AS a,
  CASE WHEN channels = 1 THEN NULL WHEN subtype = 'PCM_16' THEN round_even((x1 * 32767::FLOAT)::DOUBLE, 0) / 32768 ELSE x1::DOUBLE END AS b
  FROM raw JOIN f USING (k))"""

_SUMS = f"""WITH {_REC}
SELECT file, {RATE} AS sample_rate, channels, subtype, (n_samples + 999) // 1000 AS n_chunks, n_samples, round(sum(a * a), 5) AS a, round(sum(b * b), 5) AS b
FROM x JOIN f USING (file) GROUP BY ALL"""

QUERIES = {
    "audio_listing": (audio_listing, f"""WITH {_REC}
SELECT file, 44 + n_samples * channels * CASE subtype WHEN 'PCM_16' THEN 2 ELSE 4 END AS n_bytes FROM f
UNION ALL SELECT 'site_0/other_' || r_regionkey || CASE r_regionkey % 5 WHEN 0 THEN '.flac' ELSE '.FLAC' END, strlen(r_name) FROM region WHERE r_regionkey % 5 IN (0, 4)"""),
    "audio_headers": (audio_headers, f"WITH {_REC} SELECT file, {RATE} AS sample_rate, channels, subtype, n_samples FROM f"),
    "wav_chunks": (wav_chunks, _SUMS),
    "wav_stream": (wav_stream, _SUMS),
    "wav_filtered": (wav_filtered, f"""WITH {_REC}, c AS (SELECT file, idx // 250 AS chunk_no, a FROM x WHERE file IN {tuple(FILTERED)})
SELECT file, chunk_no, chunk_no * 250 AS start_sample, count(*) AS n_own, round(sum(a * a), 5) AS energy FROM c
WHERE chunk_no * 250 >= 500 AND chunk_no * 250 < 2500 GROUP BY 1, 2"""),
    "segment_inventory": (segment_inventory, """SELECT 'node_' || (s_suppkey % 3) AS node, 1600000000 + s_suppkey // 10 * 21600 AS folder, s_suppkey AS seq
FROM supplier WHERE s_suppkey % 5 <> 0"""),
    "photo_index": (photo_index, """SELECT c_custkey AS mmsi, 'album_' || chr((97 + s_suppkey % 7)::INT) || '/ship_' || s_suppkey || '.jpg' AS photo
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey"""),
    "spec_table": (spec_table, """WITH c AS (SELECT c_custkey AS k, c_mktsegment AS s, c_acctbal AS a FROM customer WHERE c_acctbal > 0),
u AS (SELECT k AS id, * FROM c UNION ALL SELECT k + 1000000, k, 'REFIT', a FROM c WHERE k % 5 = 0)
SELECT id, k AS mmsi, s AS shiptype, CASE WHEN k % 7 <> 0 THEN 1950 + k % 70 END AS yearbuild, a / 100 AS maxspeed,
  CASE WHEN k % 13 <> 0 THEN k + 9000000 END AS imo, 'ship_' || k || '.jpg' AS photo FROM u"""),
    "spectrogram_sink": (spectrogram_sink, f"""WITH {CELLS_SQL} SELECT clip_id, '64x50_400to10000_3.0sec_logF' AS folder, count(DISTINCT slice) AS n_slices,
  round(sum(v * v), 5) AS energy FROM cell GROUP BY 1"""),
    "wav_segments": (wav_segments, f"""WITH {_REC},
q AS (SELECT file, channels, n_samples, i, trunc(i * 0.0925::DOUBLE * {RATE})::BIGINT AS lo, i * 100 + 7 AS n FROM f, range(5) t(i))
SELECT q.file, round(i * 0.0925::DOUBLE, 4) AS start_s, n, {RATE} AS sample_rate, channels, count(a) AS n_read, round(coalesce(sum(a * a), 0), 5) AS energy
FROM q LEFT JOIN x ON x.file = q.file AND idx >= lo AND idx < lo + n GROUP BY ALL"""),
}
