"""Kernels against closed forms."""

from __future__ import annotations

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from soundkeel.functions import arrays as A
from soundkeel.operators import kernels as K
from soundkeel.operators import levels
from soundkeel.operators import spectra as S


def column(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id int, x array<double>")


def test_pure_tone_fills_one_bin(spark):
    n, k = 256, 20
    x = np.cos(2 * np.pi * k * np.arange(n) / n)
    got = column(spark, [x]).select(K.amplitude_spectrum(F.col("x"))).head()[0]
    assert np.argmax(got) == k and got[k] == pytest.approx(n / 2)
    assert sum(got) - got[k] < 1e-9


def test_density_integrates_to_variance(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=1 << 14)
    fs = 1000.0
    got = column(spark, [x]).select(K.welch(F.col("x"), fs, 512)).head()[0]
    assert sum(got) * fs / 512 == pytest.approx(x.var(), rel=0.05)


def test_spectrum_scaling_gives_tone_power(spark):
    n = 4096
    x = 3 * np.sin(2 * np.pi * 32 * np.arange(n) / 256)
    got = column(spark, [x]).select(K.welch(F.col("x"), 1.0, 256, 1024, "spectrum")).head()[0]
    assert len(got) == 513 and max(got) == pytest.approx(4.5, rel=1e-6)


def test_rows_of_different_length(spark):
    rows = [np.arange(8.0), np.arange(16.0), np.arange(8.0) + 1, []]
    got = [r[0] for r in column(spark, rows).orderBy("id").select(K.amplitude_spectrum(F.col("x"))).collect()]
    assert [len(g) for g in got] == [5, 9, 5, 0]
    assert got[1][0] == pytest.approx(120)


def test_filterbank_equals_direct_product(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    k, d, hop = 6, 64, 32
    got = column(spark, [x]).select(K.filterbank(F.col("x"), k, d, hop, 50.0, 600.0, 4400.0)).head()[0]
    want = []
    for at in range(0, 200 - d + 1, hop):
        for f in range(k):
            i = np.arange(d)
            ph = 50.0 * d / 4400.0 * np.exp(f * np.log(12) / k) * 2 * np.pi * i / d
            m = 1 - np.cos(2 * np.pi * i / d)
            y = x[at : at + d]
            want.append((y @ (m * np.sin(ph))) ** 2 + (y @ (m * np.cos(ph))) ** 2)
    assert np.allclose(got, want)


def test_smoothing_keeps_a_cubic_shape(spark):
    i = np.arange(40.0)
    x = 0.01 * i**3 - 0.3 * i**2 + 5
    got = np.array(column(spark, [x]).select(S.smooth_spectrum(F.col("x"))).head()[0])
    line = np.polyfit(i, x, 1)
    assert np.allclose(got, x - np.polyval(line, i))


def test_compact_peaks_rules(spark):
    cases = {(): (0, 0.0), (5,): (1, 0.0), (5, 6): (0, 0.0), (5, 8): (2, 150.0), (1, 2, 10, 12): (2, 400.0), (1, 5, 10): (3, 225.0)}
    rows = [(i, list(k)) for i, k in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, p array<int>")
    got = df.orderBy("id").select(S.compact_peaks(F.col("p"), 50.0).alias("c")).collect()
    for r, (peaks, (n, mean)) in zip(got, cases.items(), strict=True):
        assert (r["c"]["n"], r["c"]["spacing_mean"]) == (n, pytest.approx(mean)), peaks


def test_band_power_keeps_total(spark):
    x = np.arange(1.0, 33.0)
    got = column(spark, [x]).select(S.with_broadband(S.band_power(F.col("x"), 10.0, [-5.0, 40.0, 101.0, 315.0]))).head()[0]
    assert got[0] == pytest.approx(x.sum()) and sum(got[1:]) == pytest.approx(x.sum())


def test_dilate_erode_are_ordered(spark):
    rng = np.random.default_rng(5)
    spec = spark.createDataFrame([(0, t, [float(v) for v in rng.normal(size=12)]) for t in range(30)], "clip_id long, slice long, x array<double>")
    base = {r["slice"]: np.array(r["x"]) for r in spec.collect()}
    up = {r["slice"]: np.array(r["x"]) for r in S.dilate(spec, 5, 2).collect()}
    down = {r["slice"]: np.array(r["x"]) for r in S.erode(spec, 5, 1).collect()}
    m = np.array([base[t] for t in range(30)])
    for t in range(30):
        for b in range(12):
            assert up[t][b] == m[max(0, t - 4) : t + 5, max(0, b - 4) : b + 5].max()
            assert down[t][b] == m[max(0, t - 2) : t + 3, max(0, b - 2) : b + 3].min()


def test_array_helpers(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [0, 2])], "x array<double>, c array<int>")
    r = df.select(
        A.centred_slice(F.col("x"), F.lit(0), 4).alias("cut"),
        A.resample_linear(F.col("x"), 0.5).alias("up"),
        A.multi_hot(F.col("c"), 3).alias("hot"),
        A.multi_hot(F.col("c"), 3, collapse=True).alias("any"),
        A.l2_normalise(F.array(F.lit(0.0), F.lit(0.0))).alias("zero"),
        A.std_pop(F.col("x")).alias("sd"),
        A.mono(F.array("x", "x"), "sum").alias("mix"),
    ).head()
    assert r["cut"] == [0.0, 0.0, 1.0, 2.0]
    assert r["up"] == [1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.0]
    assert (r["hot"], r["any"], r["zero"]) == ([1.0, 0.0, 1.0], [1.0], [0.0, 0.0])
    assert r["sd"] == pytest.approx(np.std([1, 2, 3, 4])) and r["mix"] == [2.0, 4.0, 6.0, 8.0]


def test_tone_measure(spark):
    fs, n = 96000, 19200
    tone = np.sin(2 * np.pi * 1000 * np.arange(n) / fs)
    r = column(spark, [tone]).select(K.tone_measure(F.col("x"), 16384)).head()[0]
    assert abs(r["by_prominence"] * fs / 16384 - 1000) < 10
    assert r["mean_square"] == pytest.approx(np.mean((tone * np.hamming(n)) ** 2))


def plain_peaks(spec, prominence, widths):
    """The two first peaks by walking outwards from each."""
    found = [-1, -1]
    for p in range(1, len(spec) - 1):
        if not spec[p - 1] < spec[p] > spec[p + 1]:
            continue
        lo = hi = p
        while lo > 0 and spec[lo - 1] <= spec[p]:
            lo -= 1
        while hi < len(spec) - 1 and spec[hi + 1] <= spec[p]:
            hi += 1
        prom = spec[p] - max(min(spec[lo : p + 1]), min(spec[p : hi + 1]))
        level, a, b = spec[p] - prom / 2, p, p
        while a > lo and spec[a] > level:
            a -= 1
        while b < hi and spec[b] > level:
            b += 1
        left = a + (level - spec[a]) / (spec[a + 1] - spec[a]) if spec[a] < level else a
        right = b - (level - spec[b]) / (spec[b - 1] - spec[b]) if spec[b] < level else b
        if found[0] < 0 and widths[0] <= right - left <= widths[1]:
            found[0] = p
        if found[1] < 0 and prom >= prominence:
            found[1] = p
    return tuple(found)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1.0, 2.0, 3.0, 5.0, 8.0, 2.5]), min_size=3, max_size=60), st.sampled_from([0.5, 2.0, 6.0]), st.sampled_from([(0.0, 1.5), (1.0, 2.0), (2.0, 9.0)]))
def test_first_peaks_by_walking(values, prominence, widths):
    assert K.first_peaks(np.array(values), prominence, widths) == plain_peaks(values, prominence, widths)


def test_first_peaks_of_a_long_spectrum():
    rng = np.random.default_rng(1)
    spec = rng.random(1 << 16)
    start = time.perf_counter()
    assert K.first_peaks(spec, 2.0, (50.0, 60.0)) == (-1, -1)
    assert time.perf_counter() - start < 0.5


def test_only_tones_near_the_calibration_frequency(spark):
    """A tone outside 5 % of 1 kHz is rejected, by the spectrum of its samples."""
    rate, rows = 96000, []
    for hz in (900.0, 949.0, 960.0, 1000.0, 1040.0, 1053.0, 1100.0):
        rows.append((f"{hz:.0f}", rate, (1000 * np.sin(2 * np.pi * hz * np.arange(19200) / rate)).tolist()))
    tone = spark.createDataFrame(rows, "file string, sample_rate int, x array<double>")
    measured = spark.createDataFrame([(r[0], [1.0, -1.0]) for r in rows], "file string, samples array<double>")
    got = {r.file: r.tone_hz for r in levels.calibrated_recordings(tone, measured).collect()}
    assert set(got) <= {"960", "1000", "1040"} and len(got) >= 2 and all(abs(hz - float(f)) < 6 for f, hz in got.items())
