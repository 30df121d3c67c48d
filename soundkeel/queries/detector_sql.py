"""SQL of the call detector on the recordings with louder stretches.

Spectra of half-overlapping segments are sums over their samples; the background
follows the quiet frames, so the frames are stepped through by recursion.
"""

from __future__ import annotations

from ..operators import detect as D
from ..operators.spectra import HIGHPASS_BIN, MIN_SPACING_HZ
from .common import SAMPLES_SQL

RATE = 44100.0
_N, _HALF, _B = D.SEGMENT, D.SEGMENT // 2, HIGHPASS_BIN
_BINS = _HALF + 1  # 0 to the highest
_BACK = (D.BACKGROUND_TO - D.BACKGROUND_FROM - _N) // _HALF + 1  # segments of the first background


def _zeros(n: int) -> str:
    return f"list_resize([]::DOUBLE[], {n}, 0)"


GATE_CTE = f"""{SAMPLES_SQL},
loud AS (SELECT file, idx, x * CASE WHEN idx // 64 BETWEEN 176 AND 207 THEN 10 ELSE 1 END AS x FROM smp),
len AS (SELECT file, max(idx) + 1 AS n FROM loud GROUP BY 1),
seg AS (SELECT file, g * {_HALF} AS pos, false AS back FROM len, range(0, 100000) t(g) WHERE g * {_HALF} + {_N} <= n
  UNION ALL SELECT file, {D.BACKGROUND_FROM} + g * {_HALF}, true FROM len, range(0, {_BACK}) t(g) WHERE n >= {D.BACKGROUND_TO}),
cut AS (SELECT s.file, pos, back, idx - pos AS i, x - avg(x) OVER (PARTITION BY s.file, pos, back) AS x
  FROM seg s JOIN loud l ON l.file = s.file AND idx >= pos AND idx < pos + {_N}),
tap AS (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * i / {_N})) AS v FROM cut),
pow_ AS (SELECT file, pos, back, k, (pow(sum(v * cos(2 * pi() * k * i / {_N})), 2) + pow(sum(v * sin(2 * pi() * k * i / {_N})), 2))
  * CASE WHEN k IN (0, {_HALF}) THEN 1 ELSE 2 END / ({RATE!r}::DOUBLE * {_N * 3 / 8}::DOUBLE) AS p
  FROM tap, (SELECT k FROM range(0, {_BINS}) t(k) WHERE k = 0 OR k >= {_B}) GROUP BY 1, 2, 3, 4),
fr AS (SELECT file, f, f * {D.HOP} AS a, least(n, f * {D.HOP} + {D.WIN}) AS e FROM len, range(0, 100000) t(f) WHERE f * {D.HOP} + {D.HOP} <= n),
spec AS (SELECT file, f, list_concat({_zeros(_B)}, list(p ORDER BY k)) AS p
  FROM (SELECT fr.file, f, k, avg(p) AS p FROM fr JOIN pow_ s ON s.file = fr.file AND NOT back AND pos >= a AND pos + {_N} <= e
        WHERE k > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2),
init AS (SELECT file, list_concat([max(p) FILTER (k = 0)], {_zeros(_B - 1)}, list(p ORDER BY k) FILTER (k > 0)) AS bg
  FROM (SELECT file, k, avg(p) AS p FROM pow_ WHERE back GROUP BY 1, 2) GROUP BY 1),
st AS (SELECT file, -1::BIGINT AS f, bg, list_avg(bg) + {D.GATE_SIGMAS}::DOUBLE * list_stddev_pop(bg) AS thr, 0 AS n_peaks, 0::DOUBLE AS f0 FROM init
  UNION ALL
  SELECT file, f, CASE WHEN n_peaks > 0 THEN bg ELSE
      list_transform(range(1, {_BINS + 1}), lambda i: {D.KEEP}::DOUBLE * bg[i] + {1 - D.KEEP!r}::DOUBLE * p[i]) END, thr, n_peaks, f0
  FROM (SELECT *, CASE WHEN len(tops) = 1 THEN 1 WHEN len(wide) = 0 THEN 0 ELSE len(wide) + 1 END AS n_peaks,
          CASE WHEN len(tops) = 1 OR len(wide) = 0 THEN 0 ELSE list_avg(wide) END AS f0
   FROM (SELECT *, list_filter(list_transform(range(2, len(tops) + 1), lambda j: (tops[j] - tops[j - 1]) * {RATE / _N!r}::DOUBLE),
           lambda g: g > {MIN_SPACING_HZ}::DOUBLE) AS wide
    FROM (SELECT *, list_filter(range(2, {_BINS}), lambda i: d[i] > d[i - 1] AND d[i] > d[i + 1] AND d[i] >= sd) AS tops
     FROM (SELECT *, list_stddev_pop(d) AS sd
      FROM (SELECT s.file, s.f + 1 AS f, bg, thr, p,
              list_transform(range(1, {_BINS + 1}), lambda i: CASE WHEN i <= {_B} OR p[i] - bg[i] < thr THEN 0::DOUBLE ELSE p[i] - bg[i] END) AS d
            FROM st s JOIN spec r ON r.file = s.file AND r.f = s.f + 1)))))),
det AS (SELECT file, f, f * {D.HOP} AS pos, n_peaks, f0 FROM st WHERE f >= 0),
found AS (SELECT file, min(pos) FILTER (n_peaks > 0) AS startidx, min(pos) FILTER (n_peaks = 0) AS stop, max(pos) FILTER (n_peaks > 0) AS last,
    count(*) FILTER (n_peaks > 0) AS n_frames
  FROM (SELECT *, count(*) FILTER (n_peaks = 0) OVER (PARTITION BY file ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM det)
  GROUP BY file, run HAVING count(*) FILTER (n_peaks > 0) > 0)"""

FRAMES = f"WITH RECURSIVE {GATE_CTE} SELECT file, f AS frame, n_peaks, round(f0, 6) AS f0 FROM det"
CALLS = f"""WITH RECURSIVE {GATE_CTE}
SELECT file, startidx, coalesce(stop, last) AS stopidx, coalesce(stop, last) - startidx AS lencall, n_frames FROM found"""
CLOSED_CALLS = f"""WITH RECURSIVE {GATE_CTE}
SELECT file, startidx, stop AS stopidx, stop - startidx AS lencall, n_frames FROM found WHERE stop IS NOT NULL"""
