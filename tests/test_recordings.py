"""Files, framing, clips and detection against direct slicing."""

from __future__ import annotations

import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundkeel.operators import bouts, detect, framing, kernels, levels, spectrograms
from soundkeel.operators.declick import declick
from soundkeel.session import shared_dir
from soundkeel.sources import sinks, tables, wav
from soundkeel.streaming import calls as stream_calls

FS = 44100


def write_wav(path, data, fs=FS):
    data = np.atleast_2d(data)
    with wave.open(str(path), "wb") as f:
        f.setnchannels(len(data))
        f.setsampwidth(2)
        f.setframerate(fs)
        f.writeframes(data.T.astype("<i2").tobytes())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("wav")
    rng = np.random.default_rng(0)
    write_wav(d / "b_mono.wav", rng.integers(-3000, 3000, 5001))
    write_wav(d / "a_stereo.WAV", np.array([rng.integers(-10, 10, 700), rng.integers(-900, 900, 700)]))
    write_wav(d / "c_short.wav", rng.integers(-5, 5, 20))
    write_wav(d / "d_empty.wav", np.empty((1, 0)))
    (d / "notes.txt").write_text("x")
    return d


def samples(folder, name):
    with wave.open(str(folder / name)) as f:
        raw = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels())
    return raw.astype(np.float32) / 32768


@pytest.mark.parametrize("chunk", [64, 1000, 1 << 16])
def test_chunks_hold_every_sample(spark, folder, chunk):
    got = wav.read_wav(spark, str(folder), chunk).collect()
    for name in ("b_mono.wav", "a_stereo.WAV", "c_short.wav"):
        rows = sorted((r for r in got if r["file"] == name), key=lambda r: r["chunk_no"])
        want = samples(folder, name)
        for k in range(want.shape[1]):
            assert np.array_equal(np.concatenate([r["ch"][k] for r in rows]).astype(np.float32), want[:, k])
        assert all(r["sample_rate"] == FS and r["subtype"] == "PCM_16" for r in rows)
    assert not [r for r in got if r["file"] == "d_empty.wav"]


@pytest.mark.parametrize("chunk", [128, 777, 8192])
def test_frames_do_not_depend_on_chunks(spark, folder, chunk):
    want = samples(folder, "b_mono.wav")[:, 0]
    c = wav.first_channel(wav.read_wav(spark, str(folder), chunk, tail=299)).filter("file = 'b_mono.wav'")
    got = {r["frame"]: r["x"] for r in framing.frames(c, 300, 70, min_len=100).collect()}
    starts = [s for s in range(0, 5001, 70) if s + 100 <= 5001]
    assert sorted(got) == list(range(len(starts)))
    for i, s in enumerate(starts):
        assert np.array_equal(np.array(got[i], np.float32), want[s : s + 300])
    bare = wav.first_channel(wav.read_wav(spark, str(folder), chunk)).filter("file = 'b_mono.wav'").drop("n_own")
    same = {r["frame"]: r["x"] for r in framing.frames_from_chunks(bare, 300, 70, chunk, min_len=100).collect()}
    assert same == got


def test_options_prune_byte_ranges(spark, folder):
    base = {"path": str(folder), "chunksamples": "100", "chunksperpartition": "1"}
    parts = wav.WavReader({**base, "files": "b_mono.wav", "fromsample": "1000", "tosample": "1500"}).partitions()
    assert len(parts) == 5 < len(wav.WavReader(base).partitions()) and all(p.path.endswith("b_mono.wav") for p in parts)
    df = wav.read_wav(spark, str(folder), 100, files=["b_mono.wav"], start=1000, stop=1500)
    assert sorted(r["chunk_no"] for r in df.select("chunk_no").collect()) == [10, 11, 12, 13, 14]


def test_branches_with_other_filters_do_not_mix(spark, folder):
    df = wav.read_wav(spark, str(folder), 100).filter("file = 'b_mono.wav'")
    both = df.filter("start_sample < 1000").select("chunk_no").unionByName(df.select("chunk_no"))
    assert both.count() == 10 + 51


def test_filters_reach_the_reader(spark, folder):
    """Fewer partitions are planned, and branches with other filters keep their rows."""
    name, chunk = "b_mono.wav", 32
    whole = wav.read_wav(spark, str(folder), chunk)
    some = wav.select_wav(spark, str(folder), [name], 2048, 4200, chunk)
    assert some.rdd.getNumPartitions() < whole.rdd.getNumPartitions()
    assert sorted(r["start_sample"] for r in some.select("start_sample").collect()) == list(range(2048, 4200, chunk))
    a, b = some.filter("start_sample < 3000"), some.filter("start_sample >= 3000 AND start_sample < 4000")
    both = a.unionByName(b).unionByName(some.filter("file = 'c_short.wav'")).select("start_sample").collect()
    assert sorted(r[0] for r in both) == list(range(2048, 4000, chunk))
    assert some.count() == len(range(2048, 4200, chunk)), "what a branch has pushed does not stay"
    c, d = (whole.filter(F.col("file") == n).select("chunk_no") for n in (name, "c_short.wav"))
    assert c.unionByName(d).count() == -(-5001 // chunk) + 1, "a relation that is not bound takes no filter"
    two = wav.select_wav(spark, str(folder), ["c_short.wav", "a_stereo.WAV"], chunk_samples=chunk)
    assert {r["file"] for r in two.select("file").collect()} == {"c_short.wav", "a_stereo.WAV"}
    assert wav.select_wav(spark, str(folder), first=10**9).count() == 0 == wav.select_wav(spark, str(folder), before=0).count()


def noise_with_tones(rng, n: int) -> np.ndarray:
    """Noise with tones of several peaks now and then."""
    t, x = np.arange(n) / FS, rng.normal(0, 30, n)
    for at in range(20_000, n - 8000, 30_000):
        for hz in (1500, 3000, 4500):
            x[at : at + 8000] += 4000 * np.sin(2 * np.pi * hz * t[:8000])
    return x.clip(-32000, 32000)


def test_recordings_that_grow(spark, tmp_path):
    """Several triggers over recordings that are added and grow find the calls of one scan of the finished folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(3)
    done, live = tmp_path / "done", tmp_path / "live"
    done.mkdir()
    live.mkdir()
    for name, n in (("a.wav", 150_000), ("b.wav", 97_000), ("short.wav", 6_000)):
        write_wav(done / name, noise_with_tones(rng, n))
    full = {p.name: p.read_bytes() for p in done.iterdir()}

    def run() -> list[int]:
        q = stream_calls.follow_calls(spark, str(live), FS, 16_384)
        q = q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        q = q.trigger(availableNow=True).start()
        q.awaitTermination()
        return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]

    def recording(name: str, n_bytes: int) -> bytes:
        return full[name][:40] + b"\xff\xff\xff\xff" + full[name][44 : 44 + n_bytes]

    (live / "a.wav").write_bytes(recording("a.wav", 100_001))
    (live / "b.wav").write_bytes(full["b.wav"][:30])  # not even a header
    first = run()
    (live / "a.wav").write_bytes(recording("a.wav", 220_000))
    (live / "short.wav").write_bytes(full["short.wav"])
    run()
    for name, data in full.items():
        (live / name).write_bytes(data)
    run()
    assert first and not run(), "what was read is not read again"
    key = ["file", "startidx", "stopidx", "n_frames"]
    want = sorted(map(tuple, detect.scan_folder(spark, str(done), FS, 16_384).select(*key).collect()))
    got = spark.read.schema(stream_calls.OUTPUT).parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select(*key).collect())) == want and len({w[0] for w in want}) == 2


def test_table_functions_cut_like_frames(spark, folder):
    from soundkeel.operators import table_functions as tf

    for win, hop, need in ((300, 70, 100), (64, 64, 64), (50, 200, 20)):
        tf.register(spark, win, hop, need)
        wav.first_channel(wav.read_wav(spark, str(folder), 333)).createOrReplaceTempView("plain_chunks")
        tails = wav.first_channel(wav.read_wav(spark, str(folder), 333, tail=win - 1))
        tails.createOrReplaceTempView("tail_chunks")
        want = sorted((r.file, r.frame, r.start_sample, r.x) for r in framing.frames(tails, win, hop, need).collect())
        a = spark.sql("SELECT * FROM frames_of(TABLE(plain_chunks) PARTITION BY file ORDER BY chunk_no)").collect()
        b = spark.sql("SELECT c.file, f.frame, f.frame_start, f.x FROM tail_chunks c, LATERAL chunk_frames(c.samples, c.start_sample, c.n_own) f").collect()
        assert sorted(map(tuple, a)) == want == sorted(map(tuple, b)) and want


def test_segment_requests(spark, folder):
    req = spark.createDataFrame([("b_mono.wav", 0.01, 50), ("b_mono.wav", 0.11, 500), ("a_stereo.WAV", 0.0, 3)], "file string, start_s double, n long")
    got = {(r["file"], r["start_s"]): r["ch"] for r in wav.read_segments(req, str(folder)).collect()}
    x = samples(folder, "b_mono.wav")[:, 0]
    assert np.array_equal(np.array(got["b_mono.wav", 0.01][0], np.float32), x[441:491])
    assert len(got["b_mono.wav", 0.11][0]) == 5001 - 4851
    assert len(got["a_stereo.WAV", 0.0]) == 2


def test_binary_files_decode_alike(spark, folder):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{wav,WAV}").load(str(folder))
    a = wav.decode_recordings(files, 500, 20).orderBy("file", "chunk_no").collect()
    b = wav.read_wav(spark, str(folder), 500, 20).orderBy("file", "chunk_no").collect()
    assert a == b


def test_listing_and_louder_channel(spark, folder):
    names = [r["file"] for r in tables.list_audio(spark, str(folder)).collect()]
    assert names == ["a_stereo.WAV", "b_mono.wav", "c_short.wav", "d_empty.wav"]
    got = levels.pick_louder(wav.read_wav(spark, str(folder), 300)).groupBy("file").agg(F.max("channel").alias("c")).collect()
    assert {r["file"]: r["c"] for r in got} == {"a_stereo.WAV": 1, "b_mono.wav": 0, "c_short.wav": 0}


def test_clips_equal_slices(spark, folder):
    x = samples(folder, "b_mono.wav")[:, 0]
    lab = [("b_mono.wav", 1, 0, 10), ("b_mono.wav", 2, 95, 305), ("b_mono.wav", 3, 4990, 6000), ("b_mono.wav", 4, 7, 7)]
    labels = spark.createDataFrame(lab, "file string, clip_id long, start_idx long, end_idx long")
    c = wav.first_channel(wav.read_wav(spark, str(folder), 100, tail=30))
    got = {r["clip_id"]: r["samples"] for r in framing.cut_clips(c, labels, 100).collect()}
    assert sorted(got) == [1, 2, 3]
    for _, i, a, b in lab[:3]:
        assert np.array_equal(np.array(got[i], np.float32), x[a:b])


@pytest.fixture(scope="module")
def bursts(spark, tmp_path_factory):
    """Two recordings with tone bursts over noise, and one that is too short."""
    d = tmp_path_factory.mktemp("bursts")
    rng = np.random.default_rng(4)
    for k, spans in enumerate([[(12000, 20000), (30000, 33000)], [(15000, 16000), (38000, 41000)]]):
        x = rng.normal(0, 40, 41000)
        i = np.arange(len(x))
        for a, b in spans:
            for f in (2100, 4200 + 300 * k, 6300):
                x[a:b] += 2500 * np.sin(2 * np.pi * f * i[a:b] / FS)
        write_wav(d / f"r{k}.wav", x)
    write_wav(d / "short.wav", rng.normal(0, 40, 6000))
    return d


def expected_calls(x, keep_open=False):
    """Direct rendering of the detector's rules."""
    hz = FS / 1024
    b = kernels.welch_matrix(x[None, 5000:10000], FS, 1024)[0]
    b[1:25] = 0
    thr = b.mean() + 4 * b.std()
    out, run, at = [], [], 0
    while True:
        psd = kernels.welch_matrix(x[None, at : at + 4096], FS, 1024)[0]
        d = psd - b
        d[:25] = 0
        d[d < thr] = 0
        p = [i for i in range(1, len(d) - 1) if d[i] > d[i - 1] and d[i] > d[i + 1] and d[i] >= d.std()]
        gaps = [(p[i + 1] - p[i]) * hz for i in range(len(p) - 1)]
        wide = [g for g in gaps if g > 100]
        n = 1 if len(p) == 1 else (len(wide) + 1 if wide else 0)
        if n:
            if not run:
                start = at
            run.append(np.mean(wide) if wide else 0.0)
        else:
            if run:
                out.append((start, at, len(run), round(float(np.mean(run)), 6)))
            run = []
            b = 0.99 * b + 0.01 * psd
            b[:25] = 0
        at += 1024
        if at > len(x) - 1024:
            break
    if run and keep_open:
        out.append((start, at - 1024, len(run), round(float(np.mean(run)), 6)))
    return out


def test_detector(spark, bursts):
    c = wav.first_channel(wav.read_wav(spark, str(bursts), 5000, tail=detect.WIN - 1))
    got = detect.detect_calls(c, FS).collect()
    assert {r["file"] for r in got} <= {"r0.wav", "r1.wav"}
    for k in (0, 1):
        x = samples(bursts, f"r{k}.wav")[:, 0].astype(float)
        rows = sorted((r["startidx"], r["stopidx"], r["n_frames"], round(r["f0"], 6)) for r in got if r["file"] == f"r{k}.wav")
        assert rows == expected_calls(x) and rows
    folder_scan = detect.scan_folder(spark, str(bursts), FS, 5000)
    assert sorted(folder_scan.collect()) == sorted(got)
    open_too = detect.detect_calls(c, FS, keep_open=True).filter("file = 'r1.wav'").count()
    assert open_too == len(expected_calls(samples(bursts, "r1.wav")[:, 0].astype(float), True))
    status = {r["file"]: r["status"] for r in detect.scan_status(c).collect()}
    assert status == {"r0.wav": "ok", "r1.wav": "ok", "short.wav": "too short"}


def test_streaming_detector_equals_batch(spark, bursts):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    c = wav.first_channel(wav.read_wav(spark, str(bursts), 5000, tail=detect.WIN - 1))
    spectra = framing.frames(c, detect.WIN, detect.HOP, detect.HOP).select(
        "file", "frame", "start_sample", kernels.welch(F.col("x"), FS, 1024).alias("psd")
    )
    first = detect.initial_background(c, FS).select(
        "file", F.lit(-1).cast("long").alias("frame"), F.lit(-1).cast("long").alias("start_sample"), "psd"
    )
    rows, out, state = (shared_dir(spark, p) for p in ("t-rows", "t-calls", "t-state"))
    # Three files read one per trigger: state has to carry over.
    everything = spectra.unionByName(first).cache()
    for lo, hi in ((-1, 12), (12, 25), (25, 10_000)):
        everything.filter(f"frame >= {lo} and frame < {hi}").coalesce(1).write.mode("append").parquet(rows)
    schema = spark.read.parquet(rows).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(rows)
    found = stream_calls.streaming_calls(stream, FS / 1024)
    q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    cols = ["file", "startidx", "stopidx", "n_frames"]
    digits = [F.round(c, 6).alias(c) for c in ("f0", "sigma_f0", "mean_peak", "sigma_peak")]
    got = spark.read.schema(stream_calls.OUTPUT).parquet(out).select(*cols, *digits).collect()
    want = detect.detect_calls(c, FS).select(*cols, *digits).collect()
    assert sorted(got) == sorted(want) and want


def test_short_file_windows_are_marked(spark, folder):
    c = wav.first_channel(wav.read_wav(spark, str(folder), 512, tail=255)).filter("file = 'b_mono.wav'")
    got = spectrograms.catalog_spectrograms(c, FS).agg(F.count("*"), F.max(F.size("x"))).head()
    assert got[0] == (5001 - 256) // 224 + 1 and got[1] == 129


def test_short_recordings_are_centred(spark, folder):
    c = wav.first_channel(wav.read_wav(spark, str(folder), 512))
    files = spark.createDataFrame([("b_mono.wav",), ("a_stereo.WAV",)], "file string")
    heads = wav.read_headers(files, str(folder))
    assert {r["file"]: (r["n_samples"], r["channels"]) for r in heads.collect()} == {"b_mono.wav": (5001, 1), "a_stereo.WAV": (700, 2)}
    lab = [("b_mono.wav", 1, 2000 / FS, 0.0), ("a_stereo.WAV", 2, 600 / FS, 0.0)]
    labels = spark.createDataFrame(lab, "file string, clip_id long, start_s double, duration_s double")
    got = {r["clip_id"]: r for r in spectrograms.label_windows(c, labels, FS, 1000 / FS, 512, 64, heads).collect()}
    assert got[1]["samples"] == samples(folder, "b_mono.wav")[1500:2564, 0].tolist()
    p = np.zeros(1001, np.float32)
    p[150:850] = samples(folder, "a_stereo.WAV")[:, 0]
    assert got[2]["samples"] == p[100:1164].tolist() and (got[2]["start_idx"], got[2]["end_idx"]) == (100, 1100)


def test_declick_leaves_quiet_recordings_alone(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, 2000)
    x[1000] = 60
    df = spark.createDataFrame([("f", i, float(v)) for i, v in enumerate(x)], "file string, i long, x double")
    r = {q["i"]: q for q in declick(df, ["file"], "i", "x").collect()}
    a = np.abs(x)
    limit = a.mean() + a.std()
    assert r[1000]["is_trigger"] and abs(r[1000]["y"]) == pytest.approx(limit)
    assert r[10]["gain"] == 1.0 and sum(q["gain"] != 1.0 for q in r.values()) < 60
    calm = df.filter("i < 900")
    assert declick(calm, ["file"], "i", "x").filter("gain <> 1").count() == 0


def test_declick_joins_clicks_by_chunk(spark, small_groups):
    """A click that reaches through many chunks scales all of them; its region is not copied to salts, nor broadcast."""
    n, top = 400, 150
    x = [100.0 - abs(i - top) / 4 if i != top else 1000.0 for i in range(n)]  # rises, then falls: no quiet peak
    rows = [("a", i, v) for i, v in enumerate(x)] + [("b", i, 1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "file string, i long, x double")
    out = declick(df, ["file"], "i", "x")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_salt" not in plan and "Broadcast" not in plan
    r = {(q["file"], q["i"]): q for q in out.collect()}
    assert len(r) == 2 * n
    limit = np.mean(x) + np.std(x)
    for i in range(n):
        level = 1000 - (top - i) * (1000 - limit) / top if i < top else 1000 + (i - top) * (1000 - limit) / (n - top)
        assert r["a", i]["gain"] == pytest.approx(limit / level) and r["b", i]["gain"] == 1.0
        assert r["a", i]["is_trigger"] == (i == top) and r["a", i]["y"] == pytest.approx(x[i] * limit / level)


def test_written_tables(spark, tmp_path):
    frames = spark.createDataFrame(
        [("f", i * 1024, int(3 <= i < 6), 100.0 * i, float(i)) for i in range(10)],
        "file string, start_sample long, n_peaks int, f0 double, peak double",
    )
    calls = bouts.segment_calls(frames)
    row = calls.head()
    assert (row["startidx"], row["stopidx"], row["n_frames"], row["f0"]) == (3072, 6144, 3, 400.0)
    same = bouts.segment_calls(frames.withColumn("peak", F.lit(2.0))).head()
    assert same["sigma_peak"] is None
    target = sinks.write_calls(calls, str(tmp_path / "calls"), "r1")
    assert spark.read.csv(target, sep="\t", header=True).columns == list(sinks.CALL_COLUMNS)
    spec = spark.createDataFrame([(1, [[1.0]])], "clip_id long, spectrogram array<array<double>>")
    where = sinks.write_spectrograms(spec, str(tmp_path), n_bands=80, n_slices=80, f_low=400, f_high=10000, delta_t=3, log=True)
    assert where.endswith("80x80_400to10000_3.0sec_logF") and spark.read.parquet(where).count() == 1
    empty = spark.createDataFrame([], "mmsi long, ts timestamp")
    assert not sinks.write_range_snapshot(empty, str(tmp_path / "none"))


def test_equal_base_names_in_folders_stay_apart(spark, tmp_path):
    rng = np.random.default_rng(6)
    for site in ("a", "b/deep"):
        (tmp_path / site).mkdir(parents=True)
        write_wav(tmp_path / site / "x.wav", rng.integers(-900, 900, 500 if site == "a" else 700))
    got = wav.read_wav(spark, str(tmp_path), 100).groupBy("file").agg(F.sum("n_own").alias("n"), F.count("*").alias("c")).collect()
    assert {(r["file"], r["n"], r["c"]) for r in got} == {("a/x.wav", 500, 5), ("b/deep/x.wav", 700, 7)}
    listed = tables.list_audio(spark, str(tmp_path))
    assert [r["file"] for r in listed.collect()] == ["a/x.wav", "b/deep/x.wav"]
    heads = {r["file"]: r["n_samples"] for r in wav.read_headers(listed, f"file://{tmp_path}").collect()}
    assert heads == {"a/x.wav": 500, "b/deep/x.wav": 700}
    req = spark.createDataFrame([("b/deep/x.wav", 0.0, 9), ("a/x.wav", 0.001, 9)], "file string, start_s double, n long")
    want = samples(tmp_path, "b/deep/x.wav")[:9, 0]
    read = {r["file"]: r["ch"][0] for r in wav.read_segments(req, str(tmp_path)).collect()}
    assert np.array_equal(np.array(read["b/deep/x.wav"], np.float32), want) and len(read["a/x.wav"]) == 9


def plain_gate(first, psds, bin_hz, adaptive):
    """The gate frame by frame."""
    def level(b):
        return b.mean() + detect.GATE_SIGMAS * b.std()

    background, threshold, out = first.copy(), level(first), []
    for psd in psds:
        d = psd - background
        d[: detect.HIGHPASS_BIN] = 0
        d[d < threshold] = 0
        at = [i for i in range(1, len(d) - 1) if d[i - 1] < d[i] > d[i + 1] and d[i] >= d.std()]
        wide = [k for k in range(1, len(at)) if (at[k] - at[k - 1]) * bin_hz > detect.MIN_SPACING_HZ]
        if len(at) == 1:
            out.append((1, 0.0, 0.0, d[at[0]]))
        elif wide:
            gaps = np.array([(at[k] - at[k - 1]) * bin_hz for k in wide])
            out.append((len(wide) + 1, gaps.mean(), gaps.std(), max(d[i] for i in [*(at[k] for k in wide), at[wide[0] - 1]])))
        else:
            out.append((0, 0.0, 0.0, np.nan))
            background = detect.KEEP * background + (1 - detect.KEEP) * psd
            background[: detect.HIGHPASS_BIN] = 0
            threshold = level(background) if adaptive else threshold
    return out, background


@pytest.mark.parametrize("adaptive", [False, True])
@pytest.mark.parametrize("loud", [0.0, 0.03, 0.5, 1.0])
def test_quiet_stretches_are_frames_one_by_one(adaptive, loud):
    rng = np.random.default_rng(int(100 * loud))
    first = np.concatenate([np.zeros(25), rng.random(40)]) * 3
    psds = rng.random((400, 65)) * (1 + np.arange(400)[:, None] / 60) + np.where(np.arange(65) % 9 == 3, 40.0, 0.0) * (rng.random((400, 1)) < loud)
    gate = detect.Gate(first, 43.0, adaptive=adaptive)
    got = [x for k in (1, 2, 7, 390) for x in gate.run(psds[len(psds) - 400 + {1: 0, 2: 1, 7: 3, 390: 10}[k] :][:k])]
    want, background = plain_gate(first, psds, 43.0, adaptive)
    assert [x[0] for x in got] == [x[0] for x in want] and len(got) == 400
    assert np.allclose([x[1:] for x in got], [x[1:] for x in want], equal_nan=True) and np.allclose(gate.background, background)


@pytest.mark.parametrize("adaptive", [False, True])
def test_blocks_of_frames_settle_to_one_run(spark, adaptive, monkeypatch):
    """Spectra whose level drifts, so that the guessed backgrounds are wrong and blocks run several times."""
    rng = np.random.default_rng(8)
    rows, heads, want = [], [], {}
    for file in range(3):
        first = np.concatenate([np.zeros(25), rng.random(40)]) * 3
        heads.append((f"f{file}", first.tolist()))
        gate = detect.Gate(first, 43.0, adaptive=adaptive)
        for k in range(120):
            psd = rng.random(65) * (1 + 9 * (k // 20)) + np.where(np.arange(65) % 9 == 3, 40.0 * (rng.random() < 0.4), 0.0)
            rows.append((f"f{file}", k, k * 1024, psd.tolist()))
            want[f"f{file}", k] = gate.step(psd)
    rows.append(("no start", 0, 0, [1.0] * 65))
    spectra = spark.createDataFrame(rows, "file string, frame long, start_sample long, psd array<double>").repartition(5)
    background = spark.createDataFrame(heads, "file string, psd array<double>")
    assert 20 < sum(w[0] > 0 for w in want.values()) < 350
    runs = []
    plain = detect._run_blocks
    monkeypatch.setattr(detect, "_run_blocks", lambda *a: runs.append(1) or plain(*a))
    for block in (5, 50, 2048):
        runs.clear()
        got = detect.gate_frames(spectra, background, 43.0, adaptive, block).collect()
        assert len(got) == len(want) and (len(runs) == 1) == (block == 2048)
        for r in got:
            n, f0, sd, peak = want[r.file, r.frame]
            assert r.n_peaks == n and r.start_sample == r.frame * 1024
            assert (r.f0, r.f0_std) == pytest.approx((f0, sd)) and (r.peak is None if n == 0 else r.peak == pytest.approx(peak))


def test_files_have_their_name_when_they_are_whole(tmp_path):
    from pyarrow import fs

    from soundkeel.sources.files import new_file

    system, at = fs.LocalFileSystem(), str(tmp_path / "a" / "x.wav")
    with new_file(system, at) as first, new_file(system, at) as second:  # two attempts at once
        first.write(b"same")
        second.write(b"same")
        assert not (tmp_path / "a" / "x.wav").exists()
    with pytest.raises(RuntimeError), new_file(system, at) as third:
        third.write(b"half")
        raise RuntimeError
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["x.wav"] and (tmp_path / "a" / "x.wav").read_bytes() == b"same"


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        conf = Conf
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "app"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session, "x")
