"""Sentences, registry, nearest neighbours and score rules."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundkeel.functions import ais, geo, tags, text
from soundkeel.functions.bands import bands, geo_bands
from soundkeel.operators import knn, labels, scores, tracks
from soundkeel.sources import tables
from soundkeel.streaming import registry


def test_known_sentence(spark):
    line = "!AIVDM,1,1,,A,15M67FC000G?ufbE`FepT@3n00Sa,0*5C"
    other = "!AIVDM,2,1,3,A,55P5TL01VIaAL@7WKO@mBplU@<PDhh000000001S;AJ::4A80?4i@E53,0*3E"
    df = spark.createDataFrame(
        [(line,), (other,), ("$GPGGA,1",), ("!AIVDM,1,1,,A,15M6,0*00",), ("",), (line.replace("ufb", "uXb"),), (None,)],
        "line string",
    )
    got = ais.decode_ais(df).collect()
    assert len(got) == 1, "truncated and damaged payloads are dropped"
    r = got[0]
    assert (r["mmsi"], r["msg_type"]) == (366053209, 1)
    assert r["lon"] == pytest.approx(-122.341618, abs=1e-5) and r["lat"] == pytest.approx(37.802118, abs=1e-5)


def test_geometry(spark):
    df = spark.createDataFrame([(geo.HYDRO_LAT + 0.1, geo.HYDRO_LON), (geo.HYDRO_LAT, geo.HYDRO_LON - 0.1)], "lat double, lon double")
    got = df.select(geo.range_m(F.col("lat"), F.col("lon")), geo.bearing_deg(F.col("lat"), F.col("lon"))).collect()
    assert got[0][0] == pytest.approx(6371000 * np.pi / 1800) and got[0][1] == pytest.approx(0)
    assert got[1][1] == pytest.approx(270)


def test_registry_rules(spark, tmp_path):
    rows = [(1, 1, 5.0), (1, 2, 20.0), (2, 1, 5.0), (2, 2, 10.0), (3, 1, 10.0), (4, 1, 30.0), (4, 2, 9.0), (5, 1, 3.0), (5, 2, 30.0), (5, 3, 10.0)]
    df = spark.createDataFrame(rows, "mmsi long, t long, d double")
    want = {2, 4}
    assert {r["mmsi"] for r in tracks.in_range(df, "mmsi", [F.col("t")], "d", 10.0).collect()} == want
    src = tmp_path / "in"
    for t in (1, 2, 3):
        df.filter(F.col("t") == t).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    reg = registry.ships_in_range(stream, "mmsi", [F.col("t")], "d", 10.0)
    registry.snapshot(reg, str(tmp_path / "out"), str(tmp_path / "state"), every=None).awaitTermination()
    got = registry.latest_snapshot(spark, str(tmp_path / "out"))
    assert {r["mmsi"] for r in got.collect()} == want


def test_photo_and_specs(spark):
    ships = spark.createDataFrame([(11,), (12,)], "mmsi long")
    photos = spark.createDataFrame([("album_7/ship_11.jpg",), ("album_7/ship_11_b.jpg",), ("x",), ("album_120/x",)], "key string")
    got = {r["mmsi"]: r["photo"] for r in tracks.photo_for(ships, photos).collect()}
    assert got == {11: "album_7/ship_11_b.jpg", 12: None}
    specs = spark.createDataFrame([(11, "b", 2), (11, "a", 3), (12, None, 1)], "mmsi long, name string, n int")
    assert [tuple(r) for r in tracks.valid_specs(specs, ["name"]).collect()] == [(11, "b", 2)]


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    t, q = rng.normal(size=(60, 8)), rng.normal(size=(40, 8))
    lab = rng.integers(0, 4, 60)
    train = spark.createDataFrame([(i, t[i].tolist(), int(lab[i])) for i in range(60)], "id long, x array<double>, label int")
    query = spark.createDataFrame([(i, q[i].tolist()) for i in range(40)], "id long, x array<double>")
    got = {r["query_id"]: r for r in knn.knn_classify(train, query, 5, train_rows=1000).collect()}
    for i in range(40):
        d = np.sqrt(((t - q[i]) ** 2).sum(1))
        best = np.argsort(d)[:5]
        votes = {}
        for b in best:
            n, m = votes.get(lab[b], (0, 9e9))
            votes[lab[b]] = (n + 1, min(m, d[b]))
        want = min(votes, key=lambda k: (-votes[k][0], votes[k][1]))
        assert got[i]["label"] == want and got[i]["nearest"] == pytest.approx(d[best[0]])
    few = knn.nearest(train, query, 5, train_rows=3).collect()
    assert {n["train_id"] for r in few for n in r["near"]} <= set(range(60)) and all(len(r["near"]) == 3 for r in few)
    own = knn.nearest(train, train.drop("label"), 1, train_rows=1000, others=True).collect()
    assert len(own) == 60 and all(r["near"][0]["train_id"] != r["query_id"] for r in own)


def test_score_rules(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0), (1.0, 1), (0.0, 0)], "yhat double, y int")
    ap = scores.average_precision(df).head()[0]
    assert ap == pytest.approx((1 / 3) * 1 + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 4))
    perfect = scores.log_loss(df.filter("yhat in (0.0, 1.0)")).head()[0]
    assert perfect == pytest.approx(0)
    wrong = scores.log_loss(spark.createDataFrame([(0.0, 1)], "yhat double, y int")).head()[0]
    assert wrong == pytest.approx(100)
    none = scores.prf(df, 2.0).head()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)


def test_histograms_sum_to_one_and_last_block_is_quiet(spark):
    n = 4
    rows = [("f", i, (i % 11) / 10, i % 5 == 0 if i < 16 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "file string, hop long, yhat double, truth boolean")
    model = scores.nb_train(df, n)
    sums = model.groupBy("offset", "is_pos").agg(F.sum("p").alias("s"), F.count("*").alias("c")).collect()
    assert len(sums) == 10 and all(r["s"] == pytest.approx(1) and r["c"] == 50 for r in sums)
    blocks = scores.nb_predict(df, model, n)
    assert sorted(r["block"] for r in blocks.collect()) == [0, 1, 2, 3]
    hops = scores.block_predict(df, blocks, n)
    assert hops.count() == 20 and hops.filter("hop >= 16 and yes <> 0").count() == 0


def test_label_files(spark, tmp_path):
    (tmp_path / "track.txt").write_text("0.5\t1.5\tcll\n\\\t100\t200\n2\t3\tbuzz call\n4\t5\twhi stle\n6\t7\tzzz\n")
    track = tables.read_label_track(spark, str(tmp_path / "track.txt")).withColumn("c", text.label_class(F.col("label")))
    assert [(r["start_s"], r["c"]) for r in track.orderBy("start_s").collect()] == [(0.5, 0), (2.0, 0), (4.0, 2), (6.0, None)]
    (tmp_path / "lab.tsv").write_text("wav\tstart\tdur\tloc\tdate\tm\na.wav\t1.0\t0\tx\t\t\na.wav\t2.0\t0.05\tx\t\t\na.wav\t3.0\t0.1\tx\t\t\n")
    lab = tables.read_labels(spark, str(tmp_path / "lab.tsv"), "\t")
    assert lab.count() == 2 and labels.usable(lab).count() == 1


def test_background_rule(spark):
    df = spark.createDataFrame([("f", 10.0, 1.0), ("f", 30.0, 2.0), ("f", 34.0, 1.0), ("g", 2.0, 1.0)], "file string, s double, d double")
    got = labels.background_intervals(df, ["file"], [F.col("s")], "s", "d", 3.0).collect()
    want = [0.75 + 1.5 * i for i in range(4)] + [14.75 + 1.5 * i for i in range(8)]
    assert sorted(r["start_s"] for r in got) == pytest.approx(want) and {r["file"] for r in got} == {"f"}


def test_names_and_tags(spark):
    df = spark.createDataFrame(
        [("/x/OS_10_28_2021_19_55_00_.wav", "rpi_bush_point/hls/1540000000/live12.ts", "FO-S07.mp3")], "f string, k string, c string"
    )
    r = df.select(
        text.recording_ts(F.col("f")), text.hls_node(F.col("k")), text.hls_unix(F.col("k")), text.hls_seq(F.col("k")),
        text.pad4(F.lit(12345)), text.catalog_id(F.col("c")), text.class_from_name(F.col("c")), text.recording_ts(F.lit("bad")),
        text.hls_seq(F.lit("none")),
        text.clip_name(F.lit("b"), F.lit(1.5), F.lit("S1"), F.lit("wav")),
        tags.rename_tags(F.create_map(F.lit("TIT2"), F.lit("a"), F.lit("other"), F.lit("b")), "wav"),
    ).head()
    assert r[0] == dt.datetime(2021, 10, 28, 19, 55) and r[1:7] == ("bush_point", 1540000000, 12, "12345", "S07", 7)
    assert r[7] is None and r[8] is None and r[9] == "b-1.500-secs-S1.wav" and r[10] == {"data_region": "a", "other": "b"}


def test_bands(spark):
    lin = bands(spark, 300, 8000, 150).orderBy("band").collect()
    assert len(lin) == 150 and lin[0]["f_lo"] == 300 and lin[-1]["f_hi"] == pytest.approx(8000)
    log = bands(spark, 100, 10000, 4, log=True).orderBy("band").collect()
    assert [r["f_lo"] for r in log] == pytest.approx([100, 10**2.5, 1000, 10**3.5])
    g = geo_bands(spark, 400, 100000, 20, 4096, 44100).orderBy("band").collect()
    assert g[-1]["f_hi"] == pytest.approx(22050) and all(a["bin_hi"] == b["bin_lo"] for a, b in zip(g, g[1:], strict=False))
    with pytest.raises(ValueError):
        geo_bands(spark, 10, 1000, 200, 256, 44100)


def test_registry_over_triggers_keeps_few_snapshots(spark, tmp_path):
    """Enter, refresh, at the limit, leave and enter again, one report a trigger."""
    steps = [(1, 1, 5.0), (1, 2, 4.0), (1, 3, 10.0), (1, 4, 20.0), (2, 5, 1.0), (1, 6, 3.0), (2, 7, 30.0)]
    df = spark.createDataFrame(steps, "mmsi long, t long, d double")
    src, out = tmp_path / "in", tmp_path / "out"
    for _, t, _ in steps:
        df.filter(F.col("t") == t).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(df.schema).parquet(str(src))
        reg = registry.ships_in_range(stream, "mmsi", [F.col("t")], "d", 10.0)
        registry.snapshot(reg, str(out), str(tmp_path / "state"), every=None, keep=2).awaitTermination()
        last = {}
        for m, s, d in steps[:t]:
            if d != 10.0:
                last[m] = d
        want = {m for m, d in last.items() if d < 10}
        if want:
            assert {r["mmsi"] for r in registry.latest_snapshot(spark, str(out)).collect()} == want
    assert len(list(out.glob("batch=*"))) == 2


def test_frames_wait_for_their_predecessors():
    import pandas as pd

    from soundkeel.streaming.calls import _in_order

    def block(*frames):
        return pd.DataFrame({"frame": frames, "start_sample": [f * 10 for f in frames], "psd": [[float(f)] for f in frames]})

    got = [f for f, _, _ in _in_order(iter([block(2, -1, 0), block(1, 3), block(7, 5)]), -1)]
    assert got == [-1, 0, 1, 2, 3, 5, 7]


def test_the_loss_is_flat_at_the_fitted_weights(spark):
    """The gradient of the regularised loss, whose penalty is on standardised weights, is zero there and not beside."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) * np.array([1, 2, 0.5, 3, 1, 1])
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.4 * x[:, 3] + 0.3)))).astype(int)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(300)], "id long, x array<double>, y int")
    model = scores.fit_linear(df, "x", "y", max_iter=200, reg=0.05)

    def gradient(w, bias):
        error = 1 / (1 + np.exp(-(x @ w + bias))) - y
        return np.append(x.T @ error / 300 + 0.05 * x.var(axis=0, ddof=1) * w, error.mean())

    w = model.coefficients.toArray()
    assert np.abs(gradient(w, model.intercept)).max() < 1e-4 < np.abs(gradient(1.05 * w, model.intercept)).max()
    got = {r.id: r.yhat for r in scores.score_windows(model, df, "x").collect()}
    assert np.allclose([got[i] for i in range(300)], 1 / (1 + np.exp(-(x @ w + model.intercept))))
