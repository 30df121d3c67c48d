"""Sources, sinks and streams, fed from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ais
from ..operators import detect as D
from ..operators import framing as FR
from ..operators import kernels as K
from ..operators import tracks as TR
from ..sources import sinks, tables, wav
from ..streaming import calls as SC
from ..streaming import registry as REG
from ..session import pin_utc, shared_dir
from . import audio, detector_sql, vessels
from .bouts import CALLS_CTE
from .common import DAY0_US, SAMPLES_SQL, chunks, levels, r, table


def _stream_events(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = pin_utc(spark).readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    return raw.select(
        "user_id", "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")
    )


def stream_registry(spark, sf):
    """Registry kept by a stream over the events, read from its last snapshot."""
    reg = REG.ships_in_range(
        _stream_events(spark, sf), "user_id", [F.col("t"), F.col("event_id")], "value", vessels.LIMIT
    )
    out, state = shared_dir(spark, "registry"), shared_dir(spark, "registry-state")
    REG.snapshot(reg, out, state, every=None).awaitTermination()
    return REG.latest_snapshot(spark, out).select("user_id", "event_id", "event_type", "value", "t")


def stream_enriched(spark, sf):
    """Snapshot joined with specifications when it is written."""
    specs = vessels._specs(spark, sf).select(F.col("mmsi").alias("user_id"), "shipname")
    reg = REG.ships_in_range(
        _stream_events(spark, sf), "user_id", [F.col("t"), F.col("event_id")], "value", vessels.LIMIT
    )
    out, state = shared_dir(spark, "enriched"), shared_dir(spark, "enriched-state")
    REG.snapshot(reg, out, state, every=None, enrich=lambda b: TR.with_specs(b, specs, "user_id")).awaitTermination()
    return REG.latest_snapshot(spark, out).select("user_id", "event_id", "shipname")


def stream_decode(spark, sf):
    """Sentence files read and decoded as a stream."""
    folder, out, state = shared_dir(spark, "lines"), shared_dir(spark, "positions"), shared_dir(spark, "positions-state")
    vessels.sentences(spark, sf).select("line").write.text(folder)
    pos = ais.decode_ais(tables.read_ais(spark, folder, stream=True))
    q = pos.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out)
    return got.groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"), r(F.max("lat")).alias("lat"), F.max("sog").alias("sog"))


def _spectra(spark, sf):
    c = audio._bursts(spark, sf)
    framed = FR.frames(c, D.WIN, D.HOP, min_len=D.HOP)
    spectra = framed.select("file", "frame", "start_sample", K.welch(F.col("x"), 44100.0, D.SEGMENT).alias("psd"))
    first = D.initial_background(c, 44100.0).select(
        "file", F.lit(-1).cast("long").alias("frame"), F.lit(-1).cast("long").alias("start_sample"), "psd"
    )
    return spectra.unionByName(first)


def stream_calls(spark, sf):
    """Closed calls found by the streaming detector on written spectra."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    folder, out, state = shared_dir(spark, "spectra"), shared_dir(spark, "calls"), shared_dir(spark, "calls-state")
    _spectra(spark, sf).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    found = SC.streaming_calls(spark.readStream.schema(schema).parquet(folder), 44100.0 / D.SEGMENT)
    q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(SC.OUTPUT).parquet(out).select("file", "startidx", "stopidx", "lencall", "n_frames")


def _le(value, n_bytes: int):
    """Little-endian bytes of an integer column, as hexadecimal text."""
    text = F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(1 << (8 * n_bytes)))), 2 * n_bytes, "0")
    return F.concat(*[F.substring(text, 2 * k + 1, 2) for k in reversed(range(n_bytes))])


def _recordings(spark, sf):
    """Vectors as 16-bit mono files: one row per recording, at most 256 vectors."""
    pcm = F.transform("samples", lambda v: _le(F.round(v * 32767).cast("long"), 2))
    rows = chunks(spark, sf).select("file", F.struct("chunk_no", F.array_join(pcm, "").alias("p")).alias("c"))
    data = rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["p"]), "").alias("hex"))
    n = (F.length("hex") / 2).cast("long")
    i4, i2 = (lambda v: _le(F.lit(v), 4)), (lambda v: _le(F.lit(v), 2))
    head = F.concat(
        F.hex(F.lit("RIFF")), _le(n + 36, 4), F.hex(F.lit("WAVEfmt ")), i4(16), i2(1), i2(1), i4(44100), i4(88200), i2(2), i2(16),
        F.hex(F.lit("data")), _le(n, 4),
    )
    return data.select(F.concat(F.lit("/rec/"), F.col("file"), F.lit(".wav")).alias("path"), F.unhex(F.concat(head, "hex")).alias("content"))


def wav_decode(spark, sf):
    """Files decoded to chunks of 1000 samples with a tail, then framed."""
    c = wav.first_channel(wav.decode_recordings(_recordings(spark, sf), 1000, 255))
    f = FR.frames(c, 256, 200)
    return f.select(
        "file", "sample_rate", "frame", F.size("x").alias("n"), r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 5).alias("total")
    )


def pcm_levels(spark, sf):
    """Samples from raw PCM bytes."""
    raw = chunks(spark, sf).select(
        "file", "chunk_no",
        F.unhex(F.array_join(F.transform("samples", lambda v: _le(F.round(v * 32767).cast("long"), 2)), "")).alias("b"),
    )
    x = raw.select("file", F.explode(K.pcm_decode(F.col("b"))).alias("x"))
    return x.groupBy("file").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("x") * F.col("x"))).alias("energy"))


def labels_csv(spark, sf):
    """Expert labels written as tab-separated text and read back."""
    path = shared_dir(spark, "labels")
    lab = levels(spark, sf).select(
        F.concat(F.col("user_id").cast("string"), F.lit(".wav")).alias("wav_filename"),
        ((F.col("t") - DAY0_US) / 1e6).alias("start_time_s"),
        F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value") / 10).alias("duration_s"),
        F.lit("OS").alias("location"), F.lit("").alias("date"), F.col("event_type").alias("master"),
    )
    lab.write.csv(path, header=True, sep="\t")
    got = tables.read_labels(spark, path, "\t")
    return got.groupBy("wav_filename").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("duration_s")).alias("span"), r(F.max("start_time_s")).alias("last")
    )


def label_track(spark, sf):
    """Label track with frequency lines, written and read back."""
    path = shared_dir(spark, "track")
    ev = levels(spark, sf)
    a = F.concat_ws("\t", ((F.col("t") - DAY0_US) / 1e6).cast("string"), ((F.col("t") - DAY0_US) / 1e6 + 5).cast("string"), "event_type")
    b = F.concat_ws("\t", F.lit("\\"), F.lit("100.0"), F.lit("200.0"))
    ev.select(F.explode(F.array(a, b)).alias("value")).write.text(path)
    got = tables.read_label_track(spark, path)
    return got.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("end_s") - F.col("start_s")), 4).alias("span"))


def annotation_log(spark, sf):
    """Boxes appended to a log in two steps, read back and cleaned."""
    from ..operators.labels import drop_uncoded
    from .labelling import _boxes

    path = shared_dir(spark, "log")
    boxes = _boxes(spark, sf)
    sinks.append_annotations(boxes.filter("t_lo <= 1000"), path)
    sinks.append_annotations(boxes.filter("t_lo > 1000"), path)
    return drop_uncoded(tables.read_annotation_log(spark, path)).groupBy("file", "code").agg(F.count(F.lit(1)).alias("n"))


def selection_table(spark, sf):
    """Selections written tab-separated and read back."""
    path = shared_dir(spark, "selections")
    p = table(spark, sf, "part")
    sel = p.select(
        F.col("p_partkey").cast("int").alias("selection"), F.lit("Spectrogram 1").alias("view"), F.lit(1).alias("channel"),
        (F.col("p_partkey") * 1.5).alias("begin_s"), (F.col("p_partkey") * 1.5 + F.col("p_size") / 8).alias("end_s"),
        (F.col("p_size") * 10.0).alias("f_lo"), (F.col("p_size") * 25.5).alias("f_hi"), F.lit(3.25).alias("agg_entropy"),
        F.lit(700.0).alias("peak_freq"), (F.col("p_retailprice") / 100).alias("peak_power"), F.lit(12.5).alias("snr"), F.col("p_type").alias("call_type"),
    )
    sel.write.csv(path, header=True, sep="\t")
    got = tables.read_selection_table(spark, path)
    return got.groupBy("call_type").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(F.col("end_s") - F.col("begin_s"))).alias("width"), r(F.avg("peak_power")).alias("power")
    )


def range_report(spark, sf):
    """Snapshot report written, read back and joined with specifications."""
    path = shared_dir(spark, "report")
    ships = ais.with_geometry(ais.decode_ais(vessels.sentences(spark, sf)))
    near = TR.in_range(ships, "mmsi", [F.col("t"), F.col("event_id")], "lane_range_m", 20_000.0)
    sinks.write_range_snapshot(sinks.range_report(near.withColumn("ts", F.timestamp_micros("t"))), path)
    return tables.read_range_report(spark, path)


def call_list(spark, sf):
    """Calls written as a tab-separated list and read back."""
    from ..operators.bouts import segment_calls
    from .bouts import _frames

    path = shared_dir(spark, "calls-list")
    target = sinks.write_calls(segment_calls(_frames(spark, sf)), path, "sf")
    got = spark.read.csv(target, sep="\t", header=True, schema=", ".join(
        f"{c} {'string' if c == 'filename' else 'long'}" for c in sinks.CALL_COLUMNS))
    return got.groupBy("filename").agg(
        F.count(F.lit(1)).alias("n"), F.sum("lencall").alias("total"), F.sum("f0").alias("f0"), F.sum("mean_peak").alias("peak")
    )


def clip_table(spark, sf):
    """Clips with names and tags written as a table and read back."""
    from ..operators.catalog import clip_records
    from .audio import _clips, CHUNK

    path = shared_dir(spark, "clips")
    cut = FR.cut_clips(chunks(spark, sf), _clips(spark, sf), CHUNK).select(
        F.concat(F.lit("OS_10_28_2021_19_55_0"), F.col("file"), F.lit("_.wav")).alias("file"), "clip_id",
        (F.col("start_idx") / 3000).alias("start_s"), F.lit(500.0).alias("f_lo"), F.lit(1000.0).alias("f_hi"), F.lit(12.3).alias("snr"),
        F.lit("S01").alias("call_type"), F.lit("ship").alias("comments"), "samples",
    )
    sinks.write_clips(clip_records(cut, "Salish Sea", "lab", "E"), path)
    got = spark.read.parquet(path)
    return got.select("clip_id", "clip_name", F.size("samples").alias("n"), F.size("tags").alias("n_tags"), F.col("tags")["year"].alias("taken"))


_REG = f"""WITH q AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS t FROM events WHERE value <> {vessels.LIMIT}
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""

QUERIES = {
    "stream_registry": (stream_registry, _REG + f" SELECT * FROM q WHERE value < {vessels.LIMIT}"),
    "stream_enriched": (stream_enriched, _REG + f""" SELECT user_id, event_id, c_name AS shipname FROM q
LEFT JOIN customer ON c_custkey = user_id AND c_acctbal > 0 WHERE value < {vessels.LIMIT}"""),
    "stream_decode": (stream_decode, f"""WITH {vessels.RAW_SQL} SELECT mmsi, count(*) AS n, round(max(lat), 6) AS lat, max(sog) AS sog FROM raw GROUP BY 1"""),
    "stream_calls": (stream_calls, detector_sql.CLOSED_CALLS),
    "wav_decode": (wav_decode, f"""WITH {SAMPLES_SQL}, len AS (SELECT file, max(idx) + 1 AS n FROM smp GROUP BY 1),
fr AS (SELECT file, f, f * 200 AS st FROM len, range(0, 100000) t(f) WHERE f * 200 + 256 <= n)
SELECT fr.file || '.wav' AS file, 44100 AS sample_rate, f AS frame, count(*) AS n, round(sum(round(x * 32767)) / 32768, 5) + 0.0 AS total
FROM fr JOIN smp ON smp.file = fr.file AND idx >= st AND idx < st + 256 GROUP BY fr.file, f"""),
    "pcm_levels": (pcm_levels, f"""WITH {SAMPLES_SQL} SELECT file, count(*) AS n, round(sum(pow(round(x * 32767) / 32768, 2)), 6) AS energy FROM smp GROUP BY 1"""),
    "labels_csv": (labels_csv, f"""SELECT user_id || '.wav' AS wav_filename, count(*) AS n, round(sum(value / 10), 6) AS span, round(max((epoch_us(ts) - {DAY0_US}) / 1e6::DOUBLE), 6) AS last
FROM events WHERE event_type <> 'view' AND value > 0 GROUP BY 1"""),
    "label_track": (label_track, "SELECT event_type AS label, count(*) AS n, round(count(*) * 5.0::DOUBLE, 4) AS span FROM events GROUP BY 1"),
    "annotation_log": (annotation_log, """WITH d AS (SELECT DISTINCT l_suppkey::VARCHAR AS file, l_partkey, l_linenumber, l_partkey + l_quantity::BIGINT AS t_hi,
  l_linenumber + round(l_discount * 100)::INT AS f_hi, 'C_' || l_returnflag AS code FROM lineitem WHERE l_returnflag <> 'R')
SELECT file, code, count(*) AS n FROM d GROUP BY 1, 2"""),
    "selection_table": (selection_table, """SELECT p_type AS call_type, count(*) AS n, round(avg(p_partkey * 1.5::DOUBLE + p_size / 8 - p_partkey * 1.5::DOUBLE), 6) AS width, round(avg(p_retailprice / 100), 6) AS power FROM part GROUP BY 1"""),
    "range_report": (range_report, f"""WITH {vessels.RAW_SQL}, {vessels.GEO_SQL},
q AS (SELECT * FROM pos WHERE lane_range_m <> 20000 QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY t DESC, event_id DESC) = 1)
SELECT mmsi, strftime(make_timestamp(t), '%H:%M:%S') AS time_of_day, trunc(range_m)::INT AS range_m, trunc(bearing_deg)::INT AS bearing_deg, round(sog, 2) AS sog,
  {vessels.NAV_SQL} AS nav_status, trunc(lane_range_m)::INT AS lane_range_m, trunc(lane_minutes)::INT AS lane_minutes FROM q WHERE lane_range_m < 20000"""),
    "call_list": (call_list, f"""WITH {CALLS_CTE} SELECT file AS filename, count(*) AS n, sum(stopidx - startidx)::BIGINT AS total,
sum(trunc(f0)::BIGINT)::BIGINT AS f0, sum(trunc(mean_peak)::BIGINT)::BIGINT AS peak FROM calls GROUP BY 1"""),
    "clip_table": (clip_table, """WITH c AS (SELECT vec_id, vec_id // 256 AS f, (vec_id * 131) % 7000 AS lo, 50 + vec_id % 100 AS n FROM embeddings)
SELECT vec_id AS clip_id, printf('OS_10_28_2021_19_55_0%d_-%.3f-secs-S01.flac', f, lo / 3000) AS clip_name, n, 6 AS n_tags, printf('2021/10/28 19:55:0%d', f) AS taken FROM c"""),
}
