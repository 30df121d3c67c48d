"""Recordings: levels, framing, clips, spectrogram jobs and detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bouts as B
from ..operators import detect as D
from ..operators import framing as FR
from ..operators import levels as LV
from ..operators import sampling
from ..operators import table_functions as TF
from ..operators import spectrograms as SG
from ..operators.declick import declick as remove_clicks
from ..operators.spectra import long_form
from . import detector_sql
from .common import CHUNK, SAMPLES_SQL, VECTORS_PER_FILE, chunks, draw_sql, levels, r, table

FS = 3200


def _tailed(spark, sf, tail):
    return FR.with_tail(chunks(spark, sf), tail, CHUNK)


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000).alias("y"),
    )


def level_db(spark, sf):
    out = LV.level_db(_lines(spark, sf), ["file"], F.col("x"), 20.0)
    return out.select("file", "n", r("level_db").alias("level_db"), r("spread_db").alias("spread_db"))


def louder_channel(spark, sf):
    out = LV.louder_channel(_lines(spark, sf), ["file"], "x", "y")
    return out.select("file", "channel", r("level0").alias("level0"), r("level1", 4).alias("level1"))


def calibration(spark, sf):
    out = LV.calibration(_lines(spark, sf), ["file"], F.col("x"), F.col("line") == 1)
    return out.select("file", r("tone_db").alias("tone_db"), r("cal_db").alias("cal_db"))


def calibrated_level(spark, sf):
    x = _lines(spark, sf)
    out = LV.calibrated(x, ["file"], F.col("x"), F.col("line") == 1, F.col("line") > 1)
    return out.select("file", *[r(c).alias(c) for c in ("cal_db", "level_db", "spread_db")])


def describe_audio(spark, sf):
    out = LV.describe(_lines(spark, sf), ["file"], F.col("y"))
    return out.select("file", "n", *[r(c).alias(c) for c in ("mean", "max", "std")])


def chunk_levels(spark, sf):
    out = LV.chunk_levels(chunks(spark, sf))
    return out.select("file", "n", *[r(c).alias(c) for c in ("mean", "max", "std", "mean_abs", "level_db", "spread_db")])


def stereo_pick(spark, sf):
    """Vectors split into two channels; the louder one is kept per recording."""
    two = chunks(spark, sf).select(
        "file", "chunk_no", "start_sample",
        F.array(
            F.filter("samples", lambda v, i: i % 2 == 0), F.filter("samples", lambda v, i: i % 2 == 1)
        ).alias("ch"),
    )
    out = LV.pick_louder(two)
    return out.groupBy("file", "channel").agg(
        F.sum(F.size("samples")).alias("n"),
        r(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v))).alias("total"),
    )


def peak_norm(spark, sf):
    out = LV.peak_norm(chunks(spark, sf))
    return out.groupBy("file").agg(
        r(F.max(F.array_max("samples"))).alias("hi"), r(F.min(F.array_min("samples"))).alias("lo")
    )


def value_range(spark, sf):
    v = table(spark, sf, "embeddings").select(F.explode("embedding").alias("v"))
    out = LV.value_range(v, F.col("v").cast("double"))
    return out.select(*[r(c).alias(c) for c in ("lo", "hi", "mean")])


def frames_chunked(spark, sf):
    """100 samples every 32, across chunk edges."""
    out = FR.frames_from_chunks(chunks(spark, sf), 100, 32, CHUNK)
    return out.select(
        "file", "frame", "start_sample",
        r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("total"), r(F.get("x", F.lit(99)).cast("double")).alias("last"),
    )


def _framed_rows(out):
    return out.select(
        "file", "frame", "start_sample",
        r(F.aggregate(F.col("x"), F.lit(0.0), lambda a, v: a + v)).alias("total"), r(F.get("x", F.lit(99)).cast("double")).alias("last"),
    )


def frames_table_function(spark, sf):
    """The same frames by a table function over the chunks of each recording."""
    TF.register(spark, 100, 32)
    chunks(spark, sf).withColumn("samples", F.col("samples").cast("array<float>")).createOrReplaceTempView("_frame_chunks")
    return _framed_rows(spark.sql("SELECT * FROM frames_of(TABLE(_frame_chunks) PARTITION BY file ORDER BY chunk_no)"))


def frames_lateral(spark, sf):
    """The same frames by a table function of each chunk with its tail."""
    TF.register(spark, 100, 32)
    FR.with_tail(chunks(spark, sf), 99, CHUNK).createOrReplaceTempView("_tail_chunks")
    found = spark.sql("""SELECT c.file, f.frame, f.frame_start AS start_sample, f.x
        FROM _tail_chunks c, LATERAL chunk_frames(c.samples, c.start_sample, c.n_own) f""")
    return _framed_rows(found)


def frames_short_tail(spark, sf):
    """As above, keeping cut frames of at least 32 samples."""
    out = FR.frames_from_chunks(chunks(spark, sf), 100, 32, CHUNK, min_len=32)
    return out.select(
        "file", "frame", F.size("x").alias("n"), r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("total")
    )


def _clips(spark, sf):
    v = F.col("vec_id")
    lo = (v * 131) % 7000
    return table(spark, sf, "embeddings").select(
        F.floor(v / VECTORS_PER_FILE).cast("string").alias("file"), v.alias("clip_id"), lo.alias("start_idx"), (lo + 50 + v % 100).alias("end_idx"),
    )


def cut_clips(spark, sf):
    out = FR.cut_clips(chunks(spark, sf), _clips(spark, sf), CHUNK)
    return out.select(
        "file", "clip_id", F.size("samples").alias("n"), r(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)).alias("total")
    )


def _labels(spark, sf):
    c = _clips(spark, sf)
    return c.select(
        "file", "clip_id", (F.col("start_idx") / FS).alias("start_s"), ((F.col("end_idx") - F.col("start_idx")) / FS).alias("duration_s")
    )


def centred_windows(spark, sf):
    return FR.centred_windows(_labels(spark, sf), FS, 0.25).select("clip_id", "start_idx", "end_idx")


def jittered_windows(spark, sf):
    out = FR.jittered_windows(_labels(spark, sf), 3, 0.1, seed=7)
    return FR.centred_windows(out, FS, 0.25).select("clip_id", "copy", r("shift_s").alias("shift_s"), "start_idx", "end_idx")


def stft_norm(spark, sf):
    out = long_form(SG.stft_norm(_tailed(spark, sf, 127), 128, 42, 4, 33))
    return out.withColumn("v", r("v", 5))


def catalog_spectrograms(spark, sf):
    out = long_form(SG.catalog_spectrograms(_tailed(spark, sf, 255), 44100.0))
    return out.withColumn("v", r(F.col("v") * 1e6, 5))


def stft_db(spark, sf):
    return long_form(SG.stft_db(_tailed(spark, sf, 255), 16, 256, 128)).withColumn("v", r("v", 5))


def clip_spectrogram(spark, sf):
    out = long_form(SG.clip_spectrogram(_tailed(spark, sf, 127), FS, 100, 128, 16, 0.0, 1500.0))
    return out.withColumn("v", r("v", 5))


def window_arrays(spark, sf):
    """Windows with their broadband level, calibrated by 12.5 dB."""
    out = SG.window_arrays(_tailed(spark, sf, 1199), 400, 3.0, 10, 1.0, 12, 20.0, 180.0, 128, cal_db=12.5)
    return long_form(out).withColumns({"v": r(F.col("v") * 1e3, 6), "broadband_db": r("broadband_db", 5)})


def array_manifest(spark, sf):
    """Arrays per file and the seconds they cover."""
    out = SG.window_arrays(_tailed(spark, sf, 1199), 400, 3.0, 10, 1.0, 12, 20.0, 180.0, 128)
    per_window = out.groupBy("file", "window").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    return LV.run_manifest(per_window)


def label_spectrogram(spark, sf):
    lab = _labels(spark, sf)
    out = SG.label_spectrogram(chunks(spark, sf), lab, FS, CHUNK, 4, 2, 100.0, 400.0, 0.5, 256)
    return long_form(out).withColumn("v", r("v", 4))


def label_spectrogram_log(spark, sf):
    """The same on geometric bands."""
    lab = _labels(spark, sf)
    out = SG.label_spectrogram(chunks(spark, sf), lab, FS, CHUNK, 4, 2, 100.0, 400.0, 0.5, 256, log=True)
    return long_form(out).withColumn("v", r("v", 4))


def tone_levels(spark, sf):
    """Calibrated level of a recording per supplier: a tone near 1 kHz from its
    balance, then its order quantities as the measured part."""
    sup = table(spark, sf, "supplier")
    hz = 930 + F.abs(F.col("s_acctbal")) % 140
    i = F.sequence(F.lit(0), F.lit(19199))
    tone = sup.select(
        F.col("s_suppkey").cast("string").alias("file"), F.lit(96000).alias("sample_rate"),
        F.transform(i, lambda k: 1000 * F.sin(2 * 3.141592653589793 * hz * k / 96000)).alias("x"),
    )
    li = table(spark, sf, "lineitem")
    measured = li.groupBy(F.col("l_suppkey").cast("string").alias("file"), F.col("l_linenumber").alias("chunk_no")).agg(
        F.collect_list("l_quantity").alias("samples")
    )
    out = LV.calibrated_recordings(tone, measured)
    return out.select("file", r("tone_hz", 3).alias("tone_hz"), *[r(c, 3).alias(c) for c in ("cal_db", "level_db", "spread_db")])


def blob_classes(spark, sf):
    """Signal and background rules on per-order statistics."""
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") != "R").alias("good"), F.count(F.lit(1)).alias("n"),
        F.countDistinct("l_suppkey").alias("contours"), F.max("l_quantity").alias("area"),
    )
    good, share = F.col("good"), F.col("good") / F.col("n")
    return o.select(
        "l_orderkey",
        B.got_signal(good, share, F.col("contours"), F.col("area"), 0.5, 6, 30.0).alias("signal"),
        B.got_background(good, share, F.col("contours"), 0.6, 3).alias("background"),
    )


def spectrogram_records(spark, sf):
    """Background and call clips with their matrix and record."""
    calls = _labels(spark, sf).withColumn("object_class", F.lit("KW"))
    back = calls.withColumn("object_class", F.lit("Background")).withColumn("start_s", F.col("start_s") + 0.2).withColumn(
        "clip_id", -F.col("clip_id") - 1
    )
    lab = calls.unionByName(back)
    matrices = SG.label_matrices(chunks(spark, sf), lab, FS, CHUNK, 8, 8, 100.0, 1500.0, 0.5, 256, log=False)
    out = SG.spectrogram_records(matrices, lab, FS, delta_t=0.5, n_bands=8, n_slices=8, f_low=100.0, f_high=1500.0)
    # a sum of the rows and one of the columns, each weighted by its place
    rows = F.transform("spectrogram", lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v))
    bands = F.transform("spectrogram", lambda x: F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v))
    return out.select(
        "clip_id", r(F.aggregate(F.transform(rows, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v), 3).alias("by_slice"),
        r(F.aggregate(bands, F.lit(0.0), lambda a, v: a + v), 3).alias("by_band"), r(F.get(F.get("spectrogram", F.lit(2)), F.lit(3)), 4).alias("cell"),
        "record.object_class", "record.window_start_idx", "record.window_stop_idx",
    )


def training_windows(spark, sf):
    """Unit-length windows of 256 samples every 512, with the class target."""
    c = _clips(spark, sf)
    lab = c.select("file", "start_idx", "end_idx", (F.col("clip_id") % 3).cast("int").alias("label"))
    out = SG.training_windows(chunks(spark, sf), lab, 256, 512, CHUNK, collapse=False)
    return out.select(
        "file", "example", "s", r(F.get("x", F.lit(100))).alias("x100"), r(F.get("x", F.lit(200))).alias("x200"),
        r(F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v), 5).alias("weighted"),
        F.transform("y", lambda v: v.cast("int")).alias("y"),
    ).select("file", "example", "s", "x100", "x200", "weighted", *[F.get("y", F.lit(k)).alias(f"y{k}") for k in range(3)])


def augmented_windows(spark, sf):
    c = _clips(spark, sf)
    lab = c.select("file", "start_idx", "end_idx", F.lit(0).alias("label"))
    out = SG.training_windows(
        chunks(spark, sf), lab, 256, 512, CHUNK, classes=1, translate=True, semitones=2, jitter=0.5, seed=3
    )
    return out.select(
        "file", "example", "s", r("shift").alias("shift"), *[r(F.get("x", F.lit(k))).alias(f"x{k}") for k in (0, 100, 255)],
        r(F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v), 5).alias("weighted"),
        F.get("y", F.lit(0)).cast("int").alias("y"),
    )


def declick(spark, sf):
    x = levels(spark, sf).select("user_id", "event_id", (F.col("value") - 50).alias("x"))
    out = remove_clicks(x, ["user_id"], "event_id", "x", sigmas=2.0)
    return out.select("event_id", "is_trigger", r("gain").alias("gain"), r("y").alias("y"))


def _bursts(spark, sf):
    """Recordings with a tenfold louder stretch of 32 vectors."""
    gain = F.when(F.col("chunk_no").between(176, 207), 10.0).otherwise(1.0)
    loud = chunks(spark, sf).withColumn("samples", F.transform("samples", lambda v: v * gain))
    return FR.with_tail(loud, D.WIN - 1, CHUNK)


def detector_frames(spark, sf):
    c = _bursts(spark, sf)
    out = D.detector_frames(c, 44100.0, block_frames=4)  # several blocks of a recording of 16 frames
    return out.select("file", "frame", "n_peaks", r("f0").alias("f0"))


def detect_calls(spark, sf):
    c = _bursts(spark, sf)
    return D.detect_calls(c, 44100.0, keep_open=True).select("file", "startidx", "stopidx", "lencall", "n_frames")


def scan_status(spark, sf):
    return D.scan_status(_tailed(spark, sf, 0))


def first_arrays(spark, sf):
    """First ten products of each recording."""
    out = sampling.first_per_file(levels(spark, sf), ["user_id"], [F.col("t"), F.col("event_id")], 10)
    return out.select("user_id", "event_id")


def sample_n(spark, sf):
    return sampling.sample_n(levels(spark, sf), ["event_id"], 500).select("event_id", "value")


def shuffled(spark, sf):
    return sampling.shuffled(levels(spark, sf).select("event_id"), ["event_id"], 5).select("event_id", r("draw").alias("draw"))


_FRAMED = f"""WITH {SAMPLES_SQL}, len AS (SELECT file, max(idx) + 1 AS n FROM smp GROUP BY 1)"""


def _frames_cte(win: int, hop: int) -> str:
    return f"""fr AS (SELECT file, f, f * {hop} AS st FROM len, range(0, 100000) t(f) WHERE f * {hop} + {win} <= n)"""


_CLIP_SQL = """clip AS (SELECT (vec_id // 256)::VARCHAR AS file, vec_id AS clip_id, (vec_id * 131) % 7000 AS lo,
  (vec_id * 131) % 7000 + 50 + vec_id % 100 AS hi FROM embeddings)"""

def _label_sql(edges: list[int], curve: str) -> str:
    """Spectrograms of 2 slices and 4 bands from 20 frames of 24 bins."""
    band = " ".join(f"WHEN k < {8 + e} THEN {i}" for i, e in enumerate(edges[1:]))
    scale = "(v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) + 0.01::DOUBLE"
    return f"""WITH {SAMPLES_SQL}, {_CLIP_SQL},
win AS (SELECT file, clip_id, greatest(trunc((lo / {FS}.0::DOUBLE + (hi - lo) / {FS}.0::DOUBLE / 2) * {FS})::BIGINT - 800, 0) AS st FROM clip),
fr AS (SELECT file, clip_id, s, st + s * 80 AS st FROM win, range(0, 20) t(s)),
uq AS (SELECT DISTINCT file, st FROM fr),
y AS (SELECT uq.file, st, idx - st AS i, x FROM uq JOIN smp ON smp.file = uq.file AND idx >= st AND idx < st + 256),
z AS (SELECT *, (x - avg(x) OVER (PARTITION BY file, st)) * (0.5 - 0.5 * cos(2 * pi() * i / 256)) AS v FROM y),
tw AS (SELECT k, i, cos(2 * pi() * k * i / 256) AS c, sin(2 * pi() * k * i / 256) AS d FROM range(8, 32) a(k), range(0, 256) b(i)),
p AS (SELECT file, st, k, (pow(sum(v * c), 2) + pow(sum(v * d), 2)) * 2 / 16384 AS v FROM z JOIN tw USING (i) GROUP BY 1, 2, 3),
r AS (SELECT clip_id, s, k, v FROM fr JOIN p USING (file, st)),
m AS (SELECT clip_id, s, k, {scale} AS v FROM r WINDOW w AS (PARTITION BY clip_id)),
c AS (SELECT clip_id, s // 10 AS slice, CASE {band} END AS band, sum(v) / 10 AS v FROM m GROUP BY 1, 2, 3),
d1 AS (SELECT clip_id, slice, band, 10 * log10({scale}) AS v FROM c WINDOW w AS (PARTITION BY clip_id)),
d2 AS (SELECT clip_id, slice, band, {scale} AS v FROM d1 WINDOW w AS (PARTITION BY clip_id))
SELECT clip_id, slice, band, round({curve}, 4) AS v FROM d2"""


_FRAMES_SQL = f"""{_FRAMED}, {_frames_cte(100, 32)}
SELECT fr.file, f AS frame, st AS start_sample, round(sum(x), 6) + 0.0 AS total, round(max(x) FILTER (idx = st + 99), 6) + 0.0 AS last
FROM fr JOIN smp ON smp.file = fr.file AND idx >= st AND idx < st + 100 GROUP BY ALL"""

# A sine under a Hamming taper is six complex exponentials, so each bin of its transform is six geometric sums.
_TONE_SQL = """sup AS (SELECT s_suppkey::VARCHAR AS file, 2 * 3.141592653589793 * (930 + abs(s_acctbal) % 140) / 96000 AS phi FROM supplier),
six AS (SELECT * FROM (VALUES (1, 0, 0.54::DOUBLE), (1, 1, -0.23::DOUBLE), (1, -1, -0.23::DOUBLE), (-1, 0, -0.54::DOUBLE), (-1, 1, 0.23::DOUBLE), (-1, -1, 0.23::DOUBLE)) t(s, j, w)),
th AS (SELECT file, b, w, (s * phi + j * 2 * pi() / 19199 - 2 * pi() * b / 16384) / 2 AS h FROM sup, range(0, 8193) r(b), six),
geo AS (SELECT *, w * CASE WHEN abs(sin(h)) < 1e-14 THEN 16384 ELSE sin(16384 * h) / sin(h) END AS m FROM th),
spec AS MATERIALIZED (SELECT file, b, 500 * sqrt(pow(sum(m * cos(16383 * h)), 2) + pow(sum(m * sin(16383 * h)), 2)) AS v FROM geo GROUP BY 1, 2),
pk AS MATERIALIZED (SELECT file, b AS p, v AS top FROM (SELECT *, lag(v) OVER o AS l, lead(v) OVER o AS n FROM spec WINDOW o AS (PARTITION BY file ORDER BY b)) WHERE v > l AND v > n),
rng AS MATERIALIZED (SELECT pk.file, p, top, coalesce(max(b) FILTER (b < p AND v > top) + 1, 0) AS lo, coalesce(min(b) FILTER (b > p AND v > top), 8193) AS hi
  FROM pk JOIN spec USING (file) GROUP BY ALL),
prm AS MATERIALIZED (SELECT rng.file, p, top, lo, hi, top - greatest(min(v) FILTER (b <= p), min(v) FILTER (b >= p)) AS prom
  FROM rng JOIN spec ON spec.file = rng.file AND b >= lo AND b < hi GROUP BY rng.file, p, top, lo, hi),
crs AS MATERIALIZED (SELECT prm.file, p, prom, top - prom / 2 AS lev, greatest(lo, coalesce(max(b) FILTER (b < p AND v <= top - prom / 2), lo)) AS a,
    least(hi - 1, coalesce(min(b) FILTER (b > p AND v <= top - prom / 2), hi - 1)) AS z
  FROM prm JOIN spec ON spec.file = prm.file AND b >= lo AND b < hi GROUP BY prm.file, p, prom, top, lo, hi),
wid AS MATERIALIZED (SELECT file, p, prom, z - CASE WHEN r0 < lev THEN (lev - r0) / (r1 - r0) ELSE 0 END - a - CASE WHEN l0 < lev THEN (lev - l0) / (l1 - l0) ELSE 0 END AS w
  FROM (SELECT crs.file, p, prom, lev, a, z, max(v) FILTER (b = a) AS l0, max(v) FILTER (b = a + 1) AS l1, max(v) FILTER (b = z) AS r0, max(v) FILTER (b = z - 1) AS r1
    FROM crs JOIN spec ON spec.file = crs.file AND b >= a AND b <= z GROUP BY crs.file, p, prom, lev, a, z)),
hz AS (SELECT file, (min(p) FILTER (w BETWEEN 1 AND 2) + min(p) FILTER (prom >= 2)) / 2 * 96000 / 16384 AS tone_hz FROM wid GROUP BY 1),
pow_ AS (SELECT file, avg(pow(1000 * sin(phi * k) * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * k / 19199)), 2)) AS ms FROM sup, range(0, 19200) r(k) GROUP BY 1),
lev AS (SELECT l_suppkey::VARCHAR AS file, 10 * log10(avg(l_quantity * l_quantity)) AS level_db, stddev_pop(10 * log10(l_quantity * l_quantity + 1)) AS spread_db FROM lineitem GROUP BY 1)"""

QUERIES = {
    "level_db": (level_db, """SELECT l_suppkey AS file, count(*) AS n, round(10 * log10(avg(l_quantity * l_quantity)) + 20, 6) AS level_db,
round(stddev_pop(10 * log10(l_quantity * l_quantity + 1)), 6) AS spread_db FROM lineitem GROUP BY 1"""),
    "louder_channel": (louder_channel, """SELECT l_suppkey AS file, CASE WHEN avg(abs(l_quantity)) > avg(abs(l_extendedprice / 2000)) THEN 0 ELSE 1 END AS channel,
round(avg(abs(l_quantity)), 6) AS level0, round(avg(abs(l_extendedprice / 2000)), 4) AS level1 FROM lineitem GROUP BY 1"""),
    "calibration": (calibration, """SELECT l_suppkey AS file, round(10 * log10(avg(l_quantity * l_quantity)), 6) AS tone_db,
round(135.5 - 10 * log10(avg(l_quantity * l_quantity)), 6) AS cal_db FROM lineitem WHERE l_linenumber = 1 GROUP BY 1"""),
    "calibrated_level": (calibrated_level, """WITH a AS (SELECT l_suppkey AS file, 135.5 - 10 * log10(avg(l_quantity * l_quantity) FILTER (l_linenumber = 1)) AS c,
  10 * log10(avg(l_quantity * l_quantity) FILTER (l_linenumber > 1)) AS l, stddev_pop(10 * log10(l_quantity * l_quantity + 1)) FILTER (l_linenumber > 1) AS s
  FROM lineitem GROUP BY 1) SELECT file, round(c, 6) AS cal_db, round(l + c, 6) AS level_db, round(s, 6) AS spread_db FROM a"""),
    "describe_audio": (describe_audio, """SELECT l_suppkey AS file, count(*) AS n, round(avg(l_extendedprice / 2000), 6) AS mean,
round(max(l_extendedprice / 2000), 6) AS max, round(stddev_pop(l_extendedprice / 2000), 6) AS std FROM lineitem GROUP BY 1"""),
    "chunk_levels": (chunk_levels, f"""WITH {SAMPLES_SQL}
SELECT file, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(max(x), 6) AS max, round(stddev_pop(x), 6) AS std, round(avg(abs(x)), 6) AS mean_abs,
round(10 * log10(avg(x * x)), 6) AS level_db, round(stddev_pop(10 * log10(x * x + 1)), 6) AS spread_db FROM smp GROUP BY 1"""),
    "stereo_pick": (stereo_pick, f"""WITH {SAMPLES_SQL},
l AS (SELECT file, CASE WHEN avg(abs(x)) FILTER (idx % 2 = 0) > avg(abs(x)) FILTER (idx % 2 = 1) THEN 0 ELSE 1 END AS channel FROM smp GROUP BY 1)
SELECT file, channel, count(*) AS n, round(sum(x), 6) + 0.0 AS total FROM smp JOIN l USING (file) WHERE idx % 2 = channel GROUP BY 1, 2"""),
    "peak_norm": (peak_norm, f"""WITH {SAMPLES_SQL} SELECT file, round(max(x) / (2 * max(x)), 6) AS hi, round(min(x) / (2 * max(x)), 6) AS lo FROM smp GROUP BY 1"""),
    "value_range": (value_range, f"WITH {SAMPLES_SQL} SELECT round(min(x), 6) AS lo, round(max(x), 6) AS hi, round(avg(x), 6) + 0.0 AS mean FROM smp"),
    "frames_chunked": (frames_chunked, _FRAMES_SQL),
    "frames_table_function": (frames_table_function, _FRAMES_SQL),
    "frames_lateral": (frames_lateral, _FRAMES_SQL),
    "frames_short_tail": (frames_short_tail, f"""{_FRAMED}, fr AS (SELECT file, f, f * 32 AS st FROM len, range(0, 100000) t(f) WHERE f * 32 + 32 <= n)
SELECT fr.file, f AS frame, count(*) AS n, round(sum(x), 6) + 0.0 AS total FROM fr JOIN smp ON smp.file = fr.file AND idx >= st AND idx < st + 100 GROUP BY 1, 2"""),
    "cut_clips": (cut_clips, f"""WITH {SAMPLES_SQL}, {_CLIP_SQL}
SELECT clip.file, clip_id, count(*) AS n, round(sum(x), 6) + 0.0 AS total FROM clip JOIN smp ON smp.file = clip.file AND idx >= lo AND idx < hi GROUP BY 1, 2"""),
    "centred_windows": (centred_windows, f"""WITH {_CLIP_SQL}, m AS (SELECT clip_id, greatest(trunc((lo / {FS}.0::DOUBLE + (hi - lo) / {FS}.0::DOUBLE / 2) * {FS})::BIGINT - 400, 0) AS s FROM clip)
SELECT clip_id, s AS start_idx, s + 800 AS end_idx FROM m"""),
    "jittered_windows": (jittered_windows, f"""WITH {_CLIP_SQL}, d AS (SELECT clip_id, c AS copy, lo / {FS}.0::DOUBLE AS s, (hi - lo) / {FS}.0::DOUBLE AS dur,
  (2 * {draw_sql("clip_id || '|' || c", 7)} - 1) * 0.1::DOUBLE AS shift FROM clip, range(1, 4) t(c)),
w AS (SELECT *, greatest(trunc((greatest(s + shift, 0) + dur / 2) * {FS})::BIGINT - 400, 0) AS st FROM d)
SELECT clip_id, copy, round(shift, 6) + 0.0 AS shift_s, st AS start_idx, st + 800 AS end_idx FROM w"""),
    "stft_norm": (stft_norm, f"""{_FRAMED}, {_frames_cte(128, 42)},
y AS (SELECT fr.file, f, idx - st AS i, x / (2 * top) * (0.5 - 0.5 * cos(2 * pi() * (idx - st) / 127)) AS v
  FROM fr JOIN smp ON smp.file = fr.file AND idx >= st AND idx < st + 128 JOIN (SELECT file, max(x) AS top FROM smp GROUP BY 1) m ON m.file = fr.file),
a AS (SELECT file, f, k, CASE WHEN k = 0 THEN 0 ELSE sqrt(pow(sum(v * cos(2 * pi() * k * i / 128)), 2) + pow(sum(v * sin(2 * pi() * k * i / 128)), 2)) END AS v
  FROM y, range(0, 65) t(k) GROUP BY file, f, k),
n AS (SELECT *, max(v) OVER (PARTITION BY file, f) AS top FROM a)
SELECT file, f AS slice, k - 4 AS band, round(v / top, 5) AS v FROM n WHERE k BETWEEN 4 AND 32"""),
    "catalog_spectrograms": (catalog_spectrograms, f"""{_FRAMED}, {_frames_cte(256, 224)},
y AS (SELECT fr.file, f, idx - st AS i, x FROM fr JOIN smp ON smp.file = fr.file AND idx >= st AND idx < st + 256),
z AS (SELECT file, f, i, (x - avg(x) OVER (PARTITION BY file, f)) * (0.5 - 0.5 * cos(2 * pi() * i / 256)) AS v FROM y),
a AS (SELECT file, f, k, pow(sum(v * cos(2 * pi() * k * i / 256)), 2) + pow(sum(v * sin(2 * pi() * k * i / 256)), 2) AS p FROM z, range(0, 129) t(k) GROUP BY 1, 2, 3)
SELECT file, f AS slice, k AS band, round(1e6 * p * CASE WHEN k IN (0, 128) THEN 1 ELSE 2 END / (44100 * 96), 5) + 0.0 AS v FROM a"""),
    "stft_db": (stft_db, f"""{_FRAMED}, {_frames_cte(256, 128)},
y AS (SELECT fr.file, f, idx - st AS i, x AS v FROM fr JOIN smp ON smp.file = fr.file AND idx >= st AND idx < st + 256),
a AS (SELECT file, f, k, 10 * log10(sqrt(pow(sum(v * cos(2 * pi() * k * i / 256)), 2) + pow(sum(v * sin(2 * pi() * k * i / 256)), 2))) AS v
  FROM y, range(0, 16) t(k) GROUP BY 1, 2, 3)
SELECT file, f AS frame, k AS band, round(v / greatest(max(v) OVER (PARTITION BY file), 0), 5) + 0.0 AS v FROM a"""),
    "clip_spectrogram": (clip_spectrogram, f"""{_FRAMED}, {_frames_cte(128, 32)},
y AS (SELECT fr.file, f, idx - st AS i, x AS v FROM fr JOIN smp ON smp.file = fr.file AND idx >= st AND idx < st + 128),
a AS (SELECT file, f, k, sqrt(pow(sum(v * cos(2 * pi() * k * i / 128)), 2) + pow(sum(v * sin(2 * pi() * k * i / 128)), 2)) AS v FROM y, range(0, 65) t(k) GROUP BY 1, 2, 3)
SELECT file, f AS slice, b AS band, round(log10(abs(sum(v * greatest(least(k + 0.5, (b + 1) * 93.75 / 25) - greatest(k - 0.5, b * 93.75 / 25), 0))) + 0.001), 5) + 0.0 AS v
FROM a, range(0, 16) t(b) GROUP BY 1, 2, 3"""),
    "window_arrays": (window_arrays, f"""{_FRAMED}, {_frames_cte(1200, 400)},
y AS (SELECT fr.file, f, st, (idx - st) // 120 AS s, (idx - st) % 120 AS i, x FROM fr JOIN smp ON smp.file = fr.file AND idx >= st AND idx < st + 1200),
z AS (SELECT *, (x - avg(x) OVER (PARTITION BY file, f, s)) * (0.5 - 0.5 * cos(2 * pi() * i / 120)) AS v FROM y),
a AS (SELECT file, f, st, s, k, (pow(sum(v * cos(2 * pi() * k * i / 128)), 2) + pow(sum(v * sin(2 * pi() * k * i / 128)), 2))
  * CASE WHEN k IN (0, 64) THEN 1 ELSE 2 END / 3600 AS p FROM z, range(0, 65) t(k) GROUP BY 1, 2, 3, 4, 5),
e AS (SELECT b, (20 + b * 160 / 12.0::DOUBLE) / 3.125::DOUBLE AS lo, (20 + (b + 1) * 160 / 12.0::DOUBLE) / 3.125::DOUBLE AS hi FROM range(0, 12) t(b)),
q AS (SELECT file, f, st, s, b, sum(p * greatest(least(k + 0.5, hi) - greatest(k - 0.5, lo), 0)) AS v FROM a, e GROUP BY 1, 2, 3, 4, 5),
u AS (SELECT file, f, st, s, b + 1 AS band, v FROM q UNION ALL SELECT file, f, st, s, 0, sum(v) FROM q GROUP BY 1, 2, 3, 4)
SELECT file, f AS "window", st / 400.0::DOUBLE AS start_s, st / 400.0::DOUBLE + 3 AS end_s, s AS slice, band, round(v * 1000, 6) AS v,
  round(CASE WHEN v0 > 0 THEN 10 * log10(v0) + 12.5::DOUBLE END, 5) AS broadband_db
FROM (SELECT *, max(v) FILTER (band = 0) OVER (PARTITION BY file, f, s) AS v0 FROM u)"""),
    "array_manifest": (array_manifest, f"""{_FRAMED}, {_frames_cte(1200, 400)}
SELECT file, count(*) AS n_arrays, min(st / 400.0::DOUBLE) AS first_s, max(st / 400.0::DOUBLE + 3) AS last_s FROM fr GROUP BY 1"""),
    "label_spectrogram": (label_spectrogram, _label_sql([0, 6, 12, 18, 24], "sqrt(sqrt(v))")),
    "label_spectrogram_log": (label_spectrogram_log, _label_sql([0, 4, 8, 15, 24], "v * v")),
    "spectrogram_records": (spectrogram_records, f"""WITH {SAMPLES_SQL}, {_CLIP_SQL},
u AS (SELECT file, clip_id, 'KW' AS object_class, lo / {FS}.0::DOUBLE AS s, (hi - lo) / {FS}.0::DOUBLE AS d FROM clip
  UNION ALL SELECT file, -clip_id - 1, 'Background', lo / {FS}.0::DOUBLE + 0.2::DOUBLE, (hi - lo) / {FS}.0::DOUBLE FROM clip),
w AS (SELECT *, greatest(trunc((s + d / 2) * {FS})::BIGINT - 800, 0) AS st FROM u),
xs AS (SELECT file, list(x ORDER BY idx) AS xs FROM smp GROUP BY 1),
fr AS (SELECT DISTINCT file, st + f * 20 AS st FROM w, range(0, 80) t(f)),
y AS (SELECT file, st, xs[st + 1:st + 256] AS x FROM fr JOIN xs USING (file)),
z AS (SELECT file, st, list_transform(x, lambda v, i: (v - m) * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 256))) AS v FROM (SELECT *, list_avg(x) AS m FROM y WHERE len(x) = 256)),
tw AS (SELECT k, list_transform(range(256), lambda i: cos(2 * pi() * k * i / 256)) AS c, list_transform(range(256), lambda i: sin(2 * pi() * k * i / 256)) AS d FROM range(8, 120) a(k)),
p AS (SELECT file, st, k, (pow(list_dot_product(v, c), 2) + pow(list_dot_product(v, d), 2)) * 2 / 16384 AS v FROM z, tw),
r AS MATERIALIZED (SELECT clip_id, f // 10 AS slice, (k - 8) // 14 AS band, v FROM (SELECT w.file, clip_id, f, st + f * 20 AS at_ FROM w, range(0, 80) t(f)) q JOIN p ON p.file = q.file AND p.st = at_),
e AS (SELECT clip_id, min(v) AS lo, max(v) AS hi FROM r GROUP BY 1),
b AS MATERIALIZED (SELECT clip_id, slice, band, sum((v - lo) / (hi - lo) + 0.01::DOUBLE) / 10 AS v FROM r JOIN e USING (clip_id) GROUP BY 1, 2, 3),
d1 AS (SELECT clip_id, slice, band, 10 * log10((v - min(v) OVER c) / (max(v) OVER c - min(v) OVER c) + 0.01::DOUBLE) AS v FROM b WINDOW c AS (PARTITION BY clip_id)),
d2 AS (SELECT clip_id, slice, band, sqrt(sqrt((v - min(v) OVER c) / (max(v) OVER c - min(v) OVER c) + 0.01::DOUBLE)) AS v FROM d1 WINDOW c AS (PARTITION BY clip_id))
SELECT clip_id, round(sum(v * (slice + 1)), 3) AS by_slice, round(sum(v * (band + 1)), 3) AS by_band, round(max(v) FILTER (slice = 2 AND band = 3), 4) AS cell,
  any_value(object_class) AS object_class, any_value(st) AS window_start_idx, any_value(st) + 1600 AS window_stop_idx FROM d2 JOIN w USING (clip_id) GROUP BY 1"""),
    "tone_levels": (tone_levels, f"""WITH {_TONE_SQL}
SELECT file, round(tone_hz, 3) AS tone_hz, round(135.5::DOUBLE - 10 * log10(ms), 3) AS cal_db, round(level_db + 135.5::DOUBLE - 10 * log10(ms), 3) AS level_db,
  round(spread_db, 3) AS spread_db FROM hz JOIN pow_ USING (file) JOIN lev USING (file) WHERE tone_hz BETWEEN 950 AND 1050"""),
    "blob_classes": (blob_classes, """WITH o AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS good, count(*) AS n, count(DISTINCT l_suppkey) AS c, max(l_quantity) AS a
  FROM lineitem GROUP BY 1) SELECT l_orderkey, good > 0 AND good / n > 0.5 AND c < 6 AND a > 30 AS signal, good > 0 AND good / n < 0.6::DOUBLE AND c > 3 AS background FROM o"""),
    "training_windows": (training_windows, f"""WITH {SAMPLES_SQL}, {_CLIP_SQL}, len AS (SELECT file, max(idx) + 1 AS n FROM smp GROUP BY 1),
ex AS (SELECT file, e, e * 512 AS s FROM len, range(0, 1000) t(e) WHERE e < n // 512),
nr AS (SELECT ex.file, e, sqrt(sum(x * x)) + 1e-7::DOUBLE AS nr, sum(x * (idx - s + 129)) AS wx FROM ex JOIN smp ON smp.file = ex.file AND idx >= s - 128 AND idx < s + 128 GROUP BY 1, 2),
y AS (SELECT ex.file, e, coalesce(max((clip_id % 3 = 0)::INT), 0) AS y0, coalesce(max((clip_id % 3 = 1)::INT), 0) AS y1, coalesce(max((clip_id % 3 = 2)::INT), 0) AS y2
  FROM ex LEFT JOIN clip ON clip.file = ex.file AND lo <= s AND s < hi GROUP BY 1, 2)
SELECT ex.file, ex.e AS example, s, round(coalesce(a.x, 0) / nr, 6) + 0.0 AS x100, round(coalesce(b.x, 0) / nr, 6) + 0.0 AS x200,
  round(wx / nr, 5) + 0.0 AS weighted, y0, y1, y2
FROM ex JOIN nr USING (file, e) JOIN y USING (file, e) LEFT JOIN smp a ON a.file = ex.file AND a.idx = s - 28 LEFT JOIN smp b ON b.file = ex.file AND b.idx = s + 72"""),
    "augmented_windows": (augmented_windows, f"""WITH {SAMPLES_SQL}, {_CLIP_SQL}, len AS (SELECT file, max(idx) + 1 AS n FROM smp GROUP BY 1),
ex AS (SELECT file, e, e * 512 + floor({draw_sql("file || '|' || e", "3s")} * 512)::BIGINT AS s,
  floor((2 * {draw_sql("file || '|' || e", "3p")} - 1) * 2) + (2 * {draw_sql("file || '|' || e", "3j")} - 1) * 0.5 AS shift
  FROM len, range(0, 1000) t(e) WHERE e < n // 512),
sc AS (SELECT ex.*, pow(2, shift / 12) AS scale, floor(floor(pow(2, shift / 12) * 256) / 2)::BIGINT AS half, n FROM ex JOIN len USING (file)),
nr AS (SELECT sc.file, e, sqrt(sum(x * x)) + 1e-7::DOUBLE AS nr FROM sc JOIN smp ON smp.file = sc.file AND idx >= s - half AND idx < s + half GROUP BY 1, 2),
tt AS (SELECT file, e, s, half, i, least(i * scale, 2 * half - 1)::DOUBLE AS t FROM sc, range(0, 256) r(i)),
v AS (SELECT tt.file, tt.e, i, (coalesce(a.x, 0) + (t - floor(t)) * (coalesce(CASE WHEN floor(t) + 1 < 2 * half THEN coalesce(b.x, 0) END, coalesce(a.x, 0)) - coalesce(a.x, 0))) / nr AS v
  FROM tt JOIN nr USING (file, e) LEFT JOIN smp a ON a.file = tt.file AND a.idx = s - half + floor(t)::BIGINT
  LEFT JOIN smp b ON b.file = tt.file AND b.idx = s - half + floor(t)::BIGINT + 1),
w AS (SELECT file, e, max(v) FILTER (i = 0) AS x0, max(v) FILTER (i = 100) AS x100, max(v) FILTER (i = 255) AS x255, sum(v * (i + 1)) AS weighted FROM v GROUP BY 1, 2)
SELECT file, e AS example, s, round(shift, 6) + 0.0 AS shift, round(x0, 6) + 0.0 AS x0, round(x100, 6) + 0.0 AS x100, round(x255, 6) + 0.0 AS x255, round(weighted, 5) + 0.0 AS weighted,
  EXISTS (SELECT 1 FROM clip WHERE clip.file = sc.file AND lo <= s AND s < hi)::INT AS y FROM sc JOIN w USING (file, e)"""),
    "declick": (declick, """WITH s AS (SELECT user_id, event_id AS i, value - 50 AS x, abs(value - 50) AS a FROM events),
t AS (SELECT *, avg(a) OVER u AS ave, stddev_pop(a) OVER u AS sd, lag(a) OVER o AS l, lead(a) OVER o AS n FROM s
      WINDOW u AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY i)),
q AS (SELECT *, sum(CASE WHEN a > l AND a > n AND a < ave + sd THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g,
        a > ave + 2 * sd AS trig FROM t),
r AS (SELECT user_id, g, min(i) AS lo, max(i) + 1 AS hi, max(a) AS top, min(i) FILTER (a = m) AS pk
      FROM (SELECT *, max(a) OVER (PARTITION BY user_id, g) AS m FROM q) GROUP BY 1, 2 HAVING bool_or(trig)),
z AS (SELECT q.*, CASE WHEN pk IS NULL THEN 1 WHEN i < pk THEN (ave + sd) / (top - (pk - i) * (top - (ave + sd)) / (pk - lo))
        ELSE (ave + sd) / (top + (i - pk) * (top - (ave + sd)) / (hi - pk)) END AS gain FROM q LEFT JOIN r USING (user_id, g))
SELECT i AS event_id, trig AS is_trigger, round(gain, 6) AS gain, round(x * gain, 6) + 0.0 AS y FROM z"""),
    "detector_frames": (detector_frames, detector_sql.FRAMES),
    "detect_calls": (detect_calls, detector_sql.CALLS),
    "scan_status": (scan_status, f"""WITH {SAMPLES_SQL} SELECT file, count(*) AS n_samples, CASE WHEN count(*) >= 10000 THEN 'ok' ELSE 'too short' END AS status FROM smp GROUP BY 1"""),
    "first_arrays": (first_arrays, """SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 10"""),
    "sample_n": (sample_n, f"SELECT event_id, value FROM events ORDER BY {draw_sql('event_id', 999)}, event_id LIMIT 500"),
    "shuffled": (shuffled, f"SELECT event_id, round({draw_sql('event_id', 5)}, 6) AS draw FROM events"),
}
