"""Calls, bouts and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bouts as B
from ..operators import sampling
from .common import levels, r, table


def _bouts(spark, sf):
    return B.bout_report(
        levels(spark, sf), ["user_id"], [F.col("t"), F.col("event_id")], F.col("value"), F.col("t")
    )


def bout_report(spark, sf):
    return _bouts(spark, sf).select(
        "user_id", "start", "stop", "n", r("mean_level").alias("mean_level"), r("sd_level").alias("sd_level"), "peak_level"
    )


BOUTS_CTE = """lv AS (
  SELECT user_id, event_id, value, epoch_us(ts) AS t,
         value > avg(value) OVER u + stddev_pop(value) OVER u AS loud
  FROM events WINDOW u AS (PARTITION BY user_id)),
num AS (
  SELECT *, count(*) FILTER (NOT loud) OVER (PARTITION BY user_id ORDER BY t, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM lv),
bout AS (
  SELECT user_id, min(t) FILTER (loud) AS start, min(t) FILTER (NOT loud) AS stop, count(*) FILTER (loud) AS n,
         avg(value) FILTER (loud) AS mean_level, stddev_pop(value) FILTER (loud) AS sd_level,
         max(value) FILTER (loud) AS peak_level
  FROM num GROUP BY user_id, run
  HAVING count(*) FILTER (loud) > 0 AND count(*) FILTER (NOT loud) > 0)"""


def bout_topk(spark, sf):
    top = sampling.strongest(
        _bouts(spark, sf), 20, F.col("n").desc(), F.col("peak_level").desc(), F.col("user_id"), F.col("start")
    )
    return top.select("user_id", "start", "n", "peak_level")


def strong_bouts(spark, sf):
    b = _bouts(spark, sf).select(
        "user_id", "start", (F.col("stop") - F.col("start")).alias("lencall"), F.col("peak_level").alias("mean_peak")
    )
    return B.strong_calls(b, 6 * 3600 * 1_000_000, 120.0)


def _frames(spark, sf):
    v = F.col("value")
    return levels(spark, sf).select(
        F.col("user_id").cast("string").alias("file"),
        F.col("t").alias("start_sample"),
        F.floor(v / 40).cast("int").alias("n_peaks"),
        (v * 2).alias("f0"),
        (v * v).alias("peak"),
    )


def segment_calls(spark, sf):
    c = B.segment_calls(_frames(spark, sf))
    return c.select(
        "file", "startidx", "stopidx", "lencall", "n_frames",
        *[r(k).alias(k) for k in ("f0", "sigma_f0", "mean_peak", "sigma_peak")],
    )


CALLS_CTE = """fr AS (
  SELECT user_id::VARCHAR AS file, epoch_us(ts) AS t, floor(value / 40) AS n_peaks, value * 2 AS f0, value * value AS peak
  FROM events),
num AS (
  SELECT *, n_peaks > 0 AS loud, count(*) FILTER (n_peaks <= 0) OVER (PARTITION BY file ORDER BY t
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM fr),
calls AS (
  SELECT file, min(t) FILTER (loud) AS startidx, min(t) FILTER (NOT loud) AS stopidx, count(*) FILTER (loud) AS n_frames,
         avg(f0) FILTER (loud) AS f0, stddev_pop(f0) FILTER (loud) AS sigma_f0,
         10 * log10(avg(peak) FILTER (loud)) AS mean_peak,
         CASE WHEN count(*) FILTER (loud) = 1 THEN 0.0
              WHEN stddev_pop(peak) FILTER (loud) > 0 THEN 10 * log10(stddev_pop(peak) FILTER (loud)) END AS sigma_peak
  FROM num GROUP BY file, run HAVING count(*) FILTER (loud) > 0 AND count(*) FILTER (NOT loud) > 0)"""


def detection_series(spark, sf):
    frames = _frames(spark, sf)
    out = B.detection_series(frames, B.segment_calls(frames))
    return out.select("file", "start_sample", *[r(k).alias(k) for k in ("n_peaks", "call_len", "call_peak")])


def merge_segments(spark, sf):
    ev = levels(spark, sf)
    return B.merge_segments(
        ev, ["user_id"], [F.col("t"), F.col("event_id")], "event_type", F.col("t")
    )


def merge_turns(spark, sf):
    """Segments of equal speaker role per conversation."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return B.merge_segments(turns, ["conv_id"], [F.col("turn"), F.col("role")], "role", F.col("turn"))


def _merged_sql(src: str, key: str, order: str, label: str, at: str) -> str:
    return f"""WITH a AS (SELECT *, lag({label}) OVER (PARTITION BY {key} ORDER BY {order}) AS p FROM {src}),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> {label} THEN 1 ELSE 0 END)
        OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS seg FROM a)
SELECT {key}, {label}, min({at}) AS start, max({at}) AS stop, count(*) AS n FROM b GROUP BY {key}, seg, {label}"""


QUERIES = {
    "bout_report": (bout_report, f"""WITH {BOUTS_CTE}
SELECT user_id, start, stop, n, round(mean_level, 6) AS mean_level, round(sd_level, 6) AS sd_level, peak_level FROM bout"""),
    "bout_topk": (bout_topk, f"""WITH {BOUTS_CTE}
SELECT user_id, start, n, peak_level FROM bout ORDER BY n DESC, peak_level DESC, user_id, start LIMIT 20"""),
    "strong_bouts": (strong_bouts, f"""WITH {BOUTS_CTE}
SELECT user_id, start, stop - start AS lencall, peak_level AS mean_peak FROM bout
WHERE stop - start >= 21600000000 AND peak_level >= 120"""),
    "segment_calls": (segment_calls, f"""WITH {CALLS_CTE}
SELECT file, startidx, stopidx, stopidx - startidx AS lencall, n_frames, round(f0, 6) AS f0, round(sigma_f0, 6) AS sigma_f0,
       round(mean_peak, 6) AS mean_peak, round(sigma_peak, 6) AS sigma_peak FROM calls"""),
    "detection_series": (detection_series, f"""WITH {CALLS_CTE},
s AS (SELECT f.file, f.t, f.n_peaks::DOUBLE AS n_peaks, coalesce((c.stopidx - c.startidx)::DOUBLE, 0) AS call_len,
             coalesce(pow(10, c.mean_peak / 10), 0) AS call_peak
      FROM fr f LEFT JOIN calls c ON c.file = f.file AND c.stopidx = f.t),
m AS (SELECT *, max(n_peaks) OVER w AS a, max(call_len) OVER w AS b, max(call_peak) OVER w AS c FROM s WINDOW w AS (PARTITION BY file))
SELECT file, t AS start_sample, round(CASE WHEN a = 0 THEN n_peaks ELSE n_peaks / a END, 6) AS n_peaks,
       round(CASE WHEN b = 0 THEN call_len ELSE call_len / b END, 6) AS call_len,
       round(CASE WHEN c = 0 THEN call_peak ELSE call_peak / c END, 6) AS call_peak FROM m"""),
    "merge_segments": (merge_segments, _merged_sql(
        "(SELECT user_id, event_id, event_type, epoch_us(ts) AS t FROM events)", "user_id", "t, event_id", "event_type", "t")),
    "merge_turns": (merge_turns, _merged_sql("conversations", "conv_id", "turn, role", "role", "turn")),
}
