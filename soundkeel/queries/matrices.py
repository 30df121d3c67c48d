"""Spectrogram and array operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.geo import db, safediv
from ..operators import kernels as K
from ..operators import spectra as S
from .common import CELLS_SQL, r, spectrogram, table

EDGES = [200.0 * (3000.0 / 200.0) ** (i / 6) for i in range(7)]
BIN_HZ = 50.0


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def _cells(df, digits=6, value="x"):
    out = S.long_form(df, value)
    return out.withColumn("v", r("v", digits))


def zmask(spark, sf):
    return S.long_form(S.zmask(spectrogram(spark, sf), 1.0))


def minmax(spark, sf):
    return _cells(S.minmax(spectrogram(spark, sf)))


def display_curve(spark, sf):
    return _cells(S.display_curve(spectrogram(spark, sf), "root4"), 5)


def dilate(spark, sf):
    return _cells(S.dilate(spectrogram(spark, sf), 5, 2))


def erode(spark, sf):
    return _cells(S.erode(spectrogram(spark, sf), 5, 1))


def compress_matrix(spark, sf):
    out = S.compress(spectrogram(spark, sf), 10, 7, 50)
    return out.withColumn("v", r("v"))


def compress_stepwise(spark, sf):
    out = S.compress(spectrogram(spark, sf), 10, 7, 50, per_row_division=True)
    return out.withColumn("v", r("v"))


def extent(spark, sf):
    return S.extent(spectrogram(spark, sf)).select("clip_id", r("lo").alias("lo"), r("hi").alias("hi"))


def _squared(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.transform("x", lambda v: v * v).alias("psd"))


def band_power(spark, sf):
    out = S.band_levels(_squared(spark, sf), ["vec_id"], BIN_HZ, EDGES)
    return out.withColumn("power", r("power", 9))


def band_totals(spark, sf):
    """Bands, broadband and means of recordings of 50 frames in one pass."""
    bands = _squared(spark, sf).select(
        F.floor(F.col("vec_id") / 50).alias("file"), (F.col("vec_id") % 50).alias("frame"),
        F.posexplode(S.band_power(F.col("psd"), BIN_HZ, EDGES)).alias("band", "power"),
    )
    out = S.band_totals(bands, "file")
    return out.withColumns({"power": r("power", 9), "peak": r("peak", 9)})


def integrate_bands(spark, sf):
    out = _squared(spark, sf).select("vec_id", F.posexplode(S.integrate_bands(F.col("psd"), [0, 5, 11, 20, 40, 64])).alias("band", "power"))
    return out.withColumn("power", r("power", 9))


def running_levels(spark, sf):
    bands = S.long_form(
        table(spark, sf, "embeddings").select(
            F.floor(F.col("vec_id") / 128).alias("file"), (F.col("vec_id") % 128).alias("frame"),
            S.integrate_bands(F.transform("embedding", lambda v: v.cast("double")), [0, 8, 24, 64]).alias("x"),
        )
    )
    out = S.running_levels(bands, ["file", "band"], "frame", "v", [5, 30])
    return out.select("file", "band", "frame", r("avg_5").alias("avg_5"), r("avg_30").alias("avg_30"))


def spectral_peaks(spark, sf):
    peaks = _vectors(spark, sf).select("vec_id", F.explode(S.spectral_peaks(F.col("x"))).alias("bin"))
    return peaks


def peak_stats(spark, sf):
    out = S.peak_stats(_vectors(spark, sf), BIN_HZ, 100.0, "x")
    return out.select("vec_id", "n_peaks", r("f0").alias("f0"), r("f0_std").alias("f0_std"), r("peak").alias("peak"))


PEAKS_SQL = """s AS (SELECT vec_id, i - 1 AS bin, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)),
w AS (SELECT *, lag(v) OVER o AS l, lead(v) OVER o AS n, stddev_pop(v) OVER (PARTITION BY vec_id) AS sd
      FROM s WINDOW o AS (PARTITION BY vec_id ORDER BY bin)),
pk AS (SELECT vec_id, bin, v FROM w WHERE v > l AND v > n AND v >= sd)"""


def frame_peak_norm(spark, sf):
    return _cells(_vectors(spark, sf).select("vec_id", S.frame_peak_norm(F.transform("x", F.abs)).alias("x")))


def highpass_gate(spark, sf):
    """High pass, then a level gate at mean + sigma of the spectrum."""
    x = F.col("x")
    gated = A.let(A.mean(x) + A.std_pop(x), lambda t: A.gate(A.highpass(x, 10), t))
    return _cells(_vectors(spark, sf).select("vec_id", gated.alias("x")))


def l2_normalise(spark, sf):
    return _cells(_vectors(spark, sf).select("vec_id", A.l2_normalise(F.col("x")).alias("x")))


def resample_linear(spark, sf):
    return _cells(_vectors(spark, sf).select("vec_id", A.resample_linear(F.col("x"), 1.7).alias("x")))


def centred_slice(spark, sf):
    return _cells(_vectors(spark, sf).select("vec_id", A.centred_slice(F.col("x"), F.col("vec_id") % 64, 24).alias("x")))


def taper(spark, sf):
    """Three tapers of every vector in one scan."""
    kinds = [F.struct(F.lit(k).alias("kind"), A.taper(F.col("x"), k).alias("x")) for k in ("hann", "hamming", "mask")]
    return _cells(_vectors(spark, sf).select("vec_id", F.inline(F.array(*kinds))))


def dft_power(spark, sf):
    return _cells(_vectors(spark, sf).select("vec_id", K.amplitude_spectrum(F.col("x"), power=True).alias("x")))


def padded_spectrum(spark, sf):
    return _cells(_vectors(spark, sf).select("vec_id", K.amplitude_spectrum(F.col("x"), 128, "hamming").alias("x")))


def welch_density(spark, sf):
    return _cells(_vectors(spark, sf).select("vec_id", K.welch(F.col("x"), 64.0, 32).alias("x")), 9)


def welch_spectrum(spark, sf):
    return _cells(_vectors(spark, sf).select("vec_id", K.welch(F.col("x"), 64.0, 32, 64, "spectrum").alias("x")), 9)


def filterbank_power(spark, sf):
    return _cells(_vectors(spark, sf).select("vec_id", K.filterbank(F.col("x"), 8, 32, 16, 2000.0, 6000.0, 44000.0, True).alias("x")))


def _smooth_rows(n: int = 64) -> str:
    """Smoothing weights as (out, in, weight): 11 in the middle; at the ends the values of the least-squares cubic."""
    at = np.arange(11.0) - 5
    cubic = np.stack([at**k for k in range(4)], axis=1)
    ends = cubic @ np.linalg.solve(cubic.T @ cubic, cubic.T)
    rows = [(i, i - 5 + k, w / S.SMOOTH_DIVISOR) for i in range(5, n - 5) for k, w in enumerate(S.SMOOTH_WEIGHTS)]
    rows += [(i, k, ends[i, k]) for i in range(5) for k in range(11)]
    rows += [(n - 5 + i, n - 11 + k, ends[6 + i, k]) for i in range(5) for k in range(11)]
    return ", ".join(f"({o}, {i}, {float(w)!r}::DOUBLE)" for o, i, w in rows)


def smooth_spectrum(spark, sf):
    return _cells(_vectors(spark, sf).select("vec_id", S.smooth_spectrum(F.col("x")).alias("x")))


def decibels(spark, sf):
    """dB with an offset, safe division and multi-hot targets on order lines."""
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("d"),
        F.collect_set(F.col("l_linenumber") - 1).alias("c"),
    ).select(
        "l_orderkey", r(db(F.col("q"), 12.5)).alias("level"), r(safediv(F.col("q"), F.round("d", 2))).alias("ratio"),
        F.array_join(F.transform(A.multi_hot(F.col("c"), 7), lambda v: v.cast("int").cast("string")), "").alias("hot"),
    )


def _welch_sql(nperseg: int, nfft: int, scale: str) -> str:
    return f"""WITH s AS (SELECT vec_id, g, i, embedding[g * {nperseg // 2} + i + 1]::DOUBLE AS v
  FROM embeddings, range(0, {64 // (nperseg // 2) - 1}) a(g), range(0, {nperseg}) b(i)),
d AS (SELECT vec_id, g, i, (v - avg(v) OVER (PARTITION BY vec_id, g)) * (0.5 - 0.5 * cos(2 * pi() * i / {nperseg})) AS v FROM s),
f AS (SELECT vec_id, g, k, pow(sum(v * cos(2 * pi() * k * i / {nfft})), 2) + pow(sum(v * sin(2 * pi() * k * i / {nfft})), 2) AS p
      FROM d, range(0, {nfft // 2 + 1}) t(k) GROUP BY ALL),
w AS (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * i / {nperseg}), 2)) AS w2, pow(sum(0.5 - 0.5 * cos(2 * pi() * i / {nperseg})), 2) AS w1 FROM range(0, {nperseg}) t(i))
SELECT vec_id, k AS band, round(avg(p) * CASE WHEN k IN (0, {nfft // 2}) THEN 1 ELSE 2 END / {scale}, 9) AS v FROM f, w GROUP BY vec_id, k, w1, w2"""


def _morph_sql(reach: int, fn: str) -> str:
    return f"""WITH {CELLS_SQL},
a AS (SELECT clip_id, slice, band, {fn}(v) OVER (PARTITION BY clip_id, slice ORDER BY band RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS v FROM cell)
SELECT clip_id, slice, band, round({fn}(v) OVER (PARTITION BY clip_id, band ORDER BY slice RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING), 6) + 0.0 AS v FROM a"""


_V = "(SELECT vec_id, i - 1 AS band, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i))"
_EDGE_SQL = "(VALUES " + ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))) + ") e(b, lo, hi)"

QUERIES = {
    "zmask": (zmask, f"""WITH {CELLS_SQL}
SELECT clip_id, slice, band, (v > avg(v) OVER r + stddev_pop(v) OVER r AND v > avg(v) OVER b + stddev_pop(v) OVER b)::INT AS v
FROM cell WINDOW r AS (PARTITION BY clip_id, slice), b AS (PARTITION BY clip_id, band)"""),
    "minmax": (minmax, f"""WITH {CELLS_SQL}
SELECT clip_id, slice, band, round((v - min(v) OVER c) / (max(v) OVER c - min(v) OVER c) + 0.01::DOUBLE, 6) AS v FROM cell WINDOW c AS (PARTITION BY clip_id)"""),
    "display_curve": (display_curve, f"""WITH {CELLS_SQL},
a AS (SELECT clip_id, slice, band, 10 * log10((v - min(v) OVER c) / (max(v) OVER c - min(v) OVER c) + 0.01::DOUBLE) AS v FROM cell WINDOW c AS (PARTITION BY clip_id))
SELECT clip_id, slice, band, round(sqrt(sqrt((v - min(v) OVER c) / (max(v) OVER c - min(v) OVER c) + 0.01::DOUBLE)), 5) AS v FROM a WINDOW c AS (PARTITION BY clip_id)"""),
    "dilate": (dilate, _morph_sql(4, "max")),
    "erode": (erode, _morph_sql(2, "min")),
    "compress_matrix": (compress_matrix, f"""WITH {CELLS_SQL},
g AS (SELECT clip_id, ceil((slice + 1) * 7 / 50.0::DOUBLE)::INT - 1 AS slice, ceil((band + 1) * 10 / 64.0::DOUBLE)::INT - 1 AS band, v, slice AS s FROM cell)
SELECT clip_id, slice, band, round(sum(v) / (floor((slice + 1) * 50 / 7.0::DOUBLE) - floor(slice * 50 / 7.0::DOUBLE)), 6) + 0.0 AS v FROM g GROUP BY clip_id, slice, band"""),
    "compress_stepwise": (compress_stepwise, f"""WITH {CELLS_SQL},
g AS (SELECT clip_id, ceil((slice + 1) * 7 / 50.0::DOUBLE)::INT - 1 AS slice, ceil((band + 1) * 10 / 64.0::DOUBLE)::INT - 1 AS band, v, band AS b FROM cell),
h AS (SELECT *, floor((slice + 1) * 50 / 7.0::DOUBLE) - floor(slice * 50 / 7.0::DOUBLE) AS w, floor((band + 1) * 64 / 10.0::DOUBLE) - b AS k FROM g)
SELECT clip_id, slice, band, round(sum(v / pow(w, k)), 6) + 0.0 AS v FROM h GROUP BY clip_id, slice, band"""),
    "extent": (extent, f"WITH {CELLS_SQL} SELECT clip_id, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM cell GROUP BY 1"),
    "band_power": (band_power, f"""WITH b AS (SELECT vec_id, b AS band, sum(v * v * greatest(least(band + 0.5, hi / {BIN_HZ}) - greatest(band - 0.5, lo / {BIN_HZ}), 0)) AS power
  FROM {_V}, {_EDGE_SQL} GROUP BY 1, 2)
SELECT vec_id, band, round(power, 9) AS power FROM b UNION ALL SELECT vec_id, -1, round(sum(power), 9) FROM b GROUP BY 1"""),
    "band_totals": (band_totals, f"""WITH b AS (SELECT vec_id // 50 AS file, vec_id % 50 AS frame, b AS band,
  sum(v * v * greatest(least(band + 0.5, hi / {BIN_HZ}) - greatest(band - 0.5, lo / {BIN_HZ}), 0)) AS power FROM {_V}, {_EDGE_SQL} GROUP BY 1, 2, 3),
f AS (SELECT file, frame, sum(power) AS power, max(power) AS peak, count(*) AS cells FROM b GROUP BY 1, 2)
SELECT file, frame, band, 0 AS level, round(power, 9) AS power, round(power, 9) AS peak, 1 AS cells FROM b
UNION ALL SELECT file, frame, NULL, 1, round(power, 9), round(peak, 9), cells FROM f
UNION ALL SELECT file, NULL, band, 2, round(avg(power), 9), round(max(power), 9), count(*) FROM b GROUP BY file, band
UNION ALL SELECT file, NULL, NULL, 3, round(avg(power), 9), round(max(peak), 9), sum(cells) FROM f GROUP BY file"""),
    "integrate_bands": (integrate_bands, f"""SELECT vec_id, CASE WHEN band < 5 THEN 0 WHEN band < 11 THEN 1 WHEN band < 20 THEN 2 WHEN band < 40 THEN 3 ELSE 4 END AS band,
round(sum(v * v), 9) AS power FROM {_V} GROUP BY ALL"""),
    "running_levels": (running_levels, """WITH b AS (SELECT vec_id // 128 AS file, vec_id % 128 AS frame, CASE WHEN i <= 8 THEN 0 WHEN i <= 24 THEN 1 ELSE 2 END AS band,
  sum(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) t(i) GROUP BY ALL)
SELECT file, band, frame, round(avg(v) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) + 0.0 AS avg_5,
       round(avg(v) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) + 0.0 AS avg_30 FROM b WINDOW w AS (PARTITION BY file, band ORDER BY frame)"""),
    "spectral_peaks": (spectral_peaks, f"WITH {PEAKS_SQL} SELECT vec_id, bin FROM pk"),
    "peak_stats": (peak_stats, f"""WITH {PEAKS_SQL},
d AS (SELECT *, (bin - lag(bin) OVER o) * {BIN_HZ} AS gap, lag(v) OVER o AS pv FROM pk WINDOW o AS (PARTITION BY vec_id ORDER BY bin)),
e AS (SELECT *, count(*) FILTER (gap > 100) OVER (PARTITION BY vec_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS k FROM d),
g AS (SELECT vec_id, count(*) AS n, count(*) FILTER (gap > 100) AS k, avg(gap) FILTER (gap > 100) AS m, stddev_pop(gap) FILTER (gap > 100) AS sd,
        max(v) AS top, max(CASE WHEN gap > 100 AND k = 1 THEN greatest(v, pv) WHEN gap > 100 THEN v END) AS kept FROM e GROUP BY 1)
SELECT v.vec_id, CASE WHEN n = 1 THEN 1 WHEN k > 0 THEN k + 1 ELSE 0 END AS n_peaks, round(coalesce(m, 0), 6) AS f0, round(coalesce(sd, 0), 6) AS f0_std,
       round(CASE WHEN n = 1 THEN top WHEN k > 0 THEN kept END, 6) AS peak FROM embeddings v LEFT JOIN g USING (vec_id)"""),
    "frame_peak_norm": (frame_peak_norm, f"""WITH a AS (SELECT vec_id, band, CASE WHEN band = 0 THEN 0 ELSE abs(v) END AS v FROM {_V})
SELECT vec_id, band, round(v / max(v) OVER (PARTITION BY vec_id), 6) AS v FROM a"""),
    "highpass_gate": (highpass_gate, f"""WITH a AS (SELECT *, avg(v) OVER (PARTITION BY vec_id) + stddev_pop(v) OVER (PARTITION BY vec_id) AS t FROM {_V})
SELECT vec_id, band, round(CASE WHEN band < 10 THEN CASE WHEN t > 0 THEN 0 ELSE 0 END WHEN v < t THEN 0 ELSE v END, 6) + 0.0 AS v FROM a"""),
    "l2_normalise": (l2_normalise, f"SELECT vec_id, band, round(v / (sqrt(sum(v * v) OVER (PARTITION BY vec_id)) + 1e-7::DOUBLE), 6) + 0.0 AS v FROM {_V}"),
    "resample_linear": (resample_linear, """WITH o AS (SELECT vec_id, i AS band, i * 1.7::DOUBLE AS t, embedding AS e FROM embeddings, range(0, 37) t(i))
SELECT vec_id, band, round(e[floor(t)::INT + 1]::DOUBLE * (1 - (t - floor(t))) + coalesce(e[floor(t)::INT + 2], e[floor(t)::INT + 1])::DOUBLE * (t - floor(t)), 6) + 0.0 AS v FROM o"""),
    "centred_slice": (centred_slice, """SELECT vec_id, i AS band, round(CASE WHEN vec_id % 64 - 12 + i BETWEEN 0 AND 63 THEN embedding[(vec_id % 64 - 12 + i + 1)::INT]::DOUBLE ELSE 0 END, 6) + 0.0 AS v
FROM embeddings, range(0, 24) t(i)"""),
    "taper": (taper, f"""SELECT vec_id, kind, band, round(v * CASE kind WHEN 'hann' THEN 0.5 - 0.5 * cos(2 * pi() * band / 63) WHEN 'hamming' THEN 0.54 - 0.46 * cos(2 * pi() * band / 63)
  ELSE 1 - cos(2 * pi() * band / 64) END, 6) + 0.0 AS v FROM {_V}, (VALUES ('hann'), ('hamming'), ('mask')) k(kind)"""),
    "dft_power": (dft_power, f"""SELECT vec_id, k AS band, round(pow(sum(v * cos(2 * pi() * k * band / 64)), 2) + pow(sum(v * sin(2 * pi() * k * band / 64)), 2), 6) AS v
FROM {_V}, range(0, 33) t(k) GROUP BY 1, 2"""),
    "padded_spectrum": (padded_spectrum, f"""WITH a AS (SELECT vec_id, band, v * (0.54 - 0.46 * cos(2 * pi() * band / 63)) AS v FROM {_V})
SELECT vec_id, k AS band, round(sqrt(pow(sum(v * cos(2 * pi() * k * band / 128)), 2) + pow(sum(v * sin(2 * pi() * k * band / 128)), 2)), 6) AS v
FROM a, range(0, 65) t(k) GROUP BY 1, 2"""),
    "welch_density": (welch_density, _welch_sql(32, 32, "(64 * w2)")),
    "welch_spectrum": (welch_spectrum, _welch_sql(32, 64, "w1")),
    "filterbank_power": (filterbank_power, """WITH b AS (SELECT f, i, (1 - cos(2 * pi() * i / 32)) * sin(a) AS s, (1 - cos(2 * pi() * i / 32)) * cos(a) AS c
  FROM (SELECT f, i, 2000 * 32 / 44000.0::DOUBLE * exp(f * ln(3.0::DOUBLE) / 8) * 2 * pi() * i / 32 AS a FROM range(0, 8) x(f), range(0, 32) y(i)))
SELECT vec_id, h * 8 + f AS band, round(ln(1 + pow(sum(embedding[h * 16 + i + 1]::DOUBLE * s), 2) + pow(sum(embedding[h * 16 + i + 1]::DOUBLE * c), 2)), 6) AS v
FROM embeddings, range(0, 3) t(h), b GROUP BY vec_id, h, f"""),
    "smooth_spectrum": (smooth_spectrum, f"""WITH k(o, i, w) AS (VALUES {_smooth_rows()}),
x AS (SELECT vec_id, i - 1 AS band, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)),
a AS (SELECT vec_id, o AS band, sum(w * v) AS v FROM x JOIN k ON k.i = band GROUP BY 1, 2),
l AS (SELECT vec_id, regr_slope(v, band) AS m, regr_intercept(v, band) AS c FROM a GROUP BY 1),
d AS (SELECT vec_id, band, v - (m * band + c) AS v FROM a JOIN l USING (vec_id))
SELECT vec_id, o AS band, round(sum(w * v), 6) AS v FROM d JOIN k ON k.i = band GROUP BY 1, 2"""),
    "decibels": (decibels, """WITH a AS (SELECT l_orderkey, sum(l_quantity) AS q, round(sum(l_discount), 2) AS d, list_distinct(list(l_linenumber - 1)) AS c FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(10 * log10(q) + 12.5, 6) AS level, round(CASE WHEN d = 0 THEN q ELSE q / d END, 6) AS ratio,
       array_to_string([CASE WHEN list_contains(c, i) THEN '1' ELSE '0' END FOR i IN range(0, 7)], '') AS hot FROM a"""),
}
